"""From raw documents to pieces for training: quality, language, near duplicates, decontamination, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A stage
judges what its predecessor kept. Models are fitted on the documents that the stage is given.

Defined cases, of every stage: texts are judged whole, whatever their length; repeated rows are judged alike (and stay once
in near duplicates); an empty table gives an empty result; columns besides doc_id, text and lang pass through unread, nulls
and unlike names included, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelattice.llm import decontaminate, language, neardup, quality, sentencepiece
from notelattice.llm.queries import VOCABULARY
from notelattice.llm.storage import free, materialize, read, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_LANGUAGE_SCORE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the classifier reject go.

    A null, empty or wordless text goes; a row without doc_id is judged by its text. Without usable labels the base rules
    alone decide; a probability at the threshold is kept."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("kept").select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language, or of none that is likely, go.

    A null text or one without a letter goes; a null lang is not learned from and does not matter otherwise. If no row has
    a lang, nothing is learned and all go; equal scores go to the language that sorts first."""
    model = language.fit(docs.select("text", "lang"))
    return language.predict(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest doc_id.

    Texts without words are no duplicates of anything; rows without doc_id stay."""
    return neardup.deduplicate(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    A null or empty text holds none, a null or empty item is held by none; a row without doc_id is judged by its text."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark")).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str, vocab: str = VOCABULARY) -> DataFrame:
    """The pieces of each document, and whether they decode to its text.

    A null text has null pieces and n_pieces null, an empty one none; a row without doc_id is one more document."""
    both = sentencepiece.decode(sentencepiece.encode(docs.select("doc_id", "text"), vocab), vocab)
    return both.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), F.expr("decoded <=> text").alias("lossless"))


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("encoding", encoding)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each on the written result of the one before; a stage's own tables go when it is written."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        since = written()
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, "stage")
            free(spark, since, keep=docs)
    return docs
