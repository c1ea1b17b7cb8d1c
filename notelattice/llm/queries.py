"""The queries opN_<name>: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html, language, licenses, lm, neardup, phrases, quality, search, sentencepiece, toxicity, urls, warc
from .sql import OP11_SQL, OP12_SQL, OP13_SQL
from .storage import materialize, read

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
PER_ARCHIVE = 1000


def remainder(column: str, n: int) -> F.Column:
    """crc32 of the id as text, modulo n; null ids count as remainder -1."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n)), F.lit(-1))


def op1_sentencepiece(spark: SparkSession, sf_dir: str, vocab: str = VOCABULARY) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    both = sentencepiece.decode(sentencepiece.encode(docs, vocab), vocab)
    return both.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.greatest(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.expr("decoded <=> text").alias("lossless"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    return quality.score(docs, quality.fit(docs, labels)).drop("text")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    part = remainder("doc_id", 3)
    model = language.fit(docs.where(part != 1).select("text", "lang"))
    return language.predict(docs.select("doc_id", (part == 1).alias("held_out"), "text"), model).drop("text")


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's pages as archives, audited against a replica with planted faults: altered, lost and added records."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    bad = F.col("page_id") % 97 == 13
    stored = F.when(bad, F.concat(F.lit("\u0001"), F.col("html"))).otherwise(F.col("html"))
    ours = materialize(warc.records(pages, PER_ARCHIVE).where("not coalesce(page_id % 83 = 5, false)"), "ours")
    theirs = materialize(warc.records(pages.withColumn("stored", stored), PER_ARCHIVE, "stored").where("not coalesce(page_id % 89 = 7, false)"), "theirs")
    names = ours.select("archive", "offset", "page_id").union(theirs.select("archive", "offset", "page_id")).distinct()
    return warc.audit(ours, theirs).join(names, ["archive", "offset"]).select("archive", "offset", "page_id", "status")


OP4_SQL = f"""
WITH sized AS (
  SELECT page_id, 'pages-' || CAST(page_id // {PER_ARCHIVE} AS VARCHAR) AS archive,
         strlen('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ') + strlen(coalesce(url, ''))
         + 2 + strlen('Content-Length: ') + strlen(CAST(strlen(coalesce(html, '')) AS VARCHAR)) + 4 + strlen(coalesce(html, '')) + 4 AS length
  FROM pages),
placed AS (
  SELECT archive, page_id, CAST(coalesce(sum(length) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM sized)
SELECT archive, "offset", page_id,
       CASE WHEN page_id % 83 = 5 THEN 'extra' WHEN page_id % 89 = 7 THEN 'missing' ELSE 'corrupt' END AS status
FROM placed
WHERE (page_id % 83 = 5 AND page_id % 89 <> 7) OR (page_id % 89 = 7 AND page_id % 83 <> 5) OR (page_id % 97 = 13 AND page_id % 83 <> 5 AND page_id % 89 <> 7)
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    part = remainder("doc_id", 5)
    model = toxicity.fit(docs.where(part != 0), labels.where(part != 0))
    return toxicity.score(docs.select("doc_id", (part == 0).alias("held_out"), "text"), model).drop("text")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", remainder("doc_id", 7) == 2)
    learned = docs.where("not held_out")
    counts = materialize(lm.count_words(learned), "counts")
    vocab = lm.vocabulary(counts, learned.count())
    return lm.score(docs, lm.train(learned, vocab), vocab, counts, keep=["doc_id", "held_out"])


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.matches(docs, read(spark, sf_dir, "benchmark"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.components(docs, size=3, percent=85)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents").select("text", "lang"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages").select("page_id", "url"), share=urls.SHARE, widest=urls.WIDEST).drop("url")  # as its SQL has it


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sentencepiece, op2_quality_rules, op3_language_id, op4_warc_fixity, op5_toxicity, op6_html_extraction, op7_lm_scoring, op8_decontamination, op9_license_scan, op10_near_duplicates, op11_phrase_collocations, op12_ranked_search, op13_url_filter)}
ORACLE_SQL: dict[str, str] = {"op4_warc_fixity": OP4_SQL, "op11_phrase_collocations": OP11_SQL, "op12_ranked_search": OP12_SQL, "op13_url_filter": OP13_SQL}
