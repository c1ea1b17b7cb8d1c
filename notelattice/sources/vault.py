"""Vaults of markdown files as DataFrames of (file_path, text, checksum, size, updated_at, outcome)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown
from ..functions import text as T


def _files(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """file_path below root and what the reader knows of each .md file, those of `paths` only if given."""
    base = root.rstrip("/")
    reader = spark.read.format("binaryFile")
    if paths is None:
        files = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(base)
    else:
        files = reader.load([re.sub(r"([\[\]{}*?\\])", r"\\\1", f"{base}/{p}") for p in paths])
    top = F.regexp_replace(F.lit(base), "^[a-z]+:/*", "/")
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), F.concat(F.lit("^.*?\\Q"), top, F.lit("\\E/")), "")
    return files.select(path.alias("file_path"), "content", "length", "modificationTime").where(~F.col("file_path").rlike(r"(^|/)\.[^/]*/"))


def listed(spark: SparkSession, root: str) -> DataFrame:
    """The paths of all .md files, without reading any."""
    return _files(spark, root).select("file_path")


def scan(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """Every .md file below root, in folders that don't begin with a dot; or those of `paths`, which must be there. Contents
    that are no UTF-8 are `missing`.

    Spark lists and reads the files, on any store it knows; files whose own name begins with a dot or underscore are left
    out by its readers.
    """
    valid = F.expr("is_valid_utf8(cast(content as string))")
    text = F.when(valid, F.col("content").cast("string"))
    return _files(spark, root, paths).select("file_path", text.alias("text"), F.sha2("content", 256).alias("checksum"), F.col("length").alias("size"), F.col("modificationTime").alias("updated_at"), F.when(valid, "loaded").otherwise("missing").alias("outcome"))


def documents(files: DataFrame, project: str) -> DataFrame:
    """Parsed notes of scanned files with permalink, external_id and outcome (loaded, malformed, failed, missing).

    An explicit permalink wins over the one made of the project and the path.
    """
    notes = markdown.parse_notes(files)
    own = F.concat(F.lit(project + "/"), T.permalink(F.col("file_path")))
    outcome = F.when(F.col("outcome") == "missing", "missing").when(F.col("error").startswith("frontmatter"), "malformed").when(F.col("error").isNotNull(), "failed").otherwise("loaded")
    key = F.concat(F.lit(project), F.lit("\u0000"), F.col("file_path"))
    return notes.withColumns({"outcome": outcome, "permalink": F.coalesce("permalink", own), "external_id": T.external_id(key)})


def raw(spark: SparkSession, path: str, most: int = 350_000) -> DataFrame:
    """One file as (file_path, kind, payload): text as it is, other files in base64 up to `most` bytes."""
    file = spark.read.format("binaryFile").load(path)
    is_text = F.lower("path").rlike(r"\.(md|markdown|mdx|txt|json|yaml|yml|toml|csv|html)$")
    image = F.lower("path").rlike(r"\.(png|jpe?g|gif|webp|svg)$")
    payload = F.when(is_text, F.col("content").cast("string")).when(F.col("length") <= most, F.base64("content"))
    return file.select(F.col("path").alias("file_path"), F.when(is_text, "text").when(image, "image").otherwise("document").alias("kind"), payload.alias("payload"))
