"""Directory listings: folders derived from file paths, depth, globs and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MOST_PAGE = 200
# The orders that a listing takes.
ORDERS = ("default", "title_asc", "title_desc", "updated_asc", "updated_desc")


def nodes(files: DataFrame, root: str = "") -> DataFrame:
    """(path, name, kind, depth, title, updated_at) of files (file_path, title, updated_at) and their folders below root.

    root matches in either case of the letters A to Z. A folder appears once for all of its files: each path gives its prefixes, and a distinct makes the folders.
    """
    root = root.strip("/")
    inside = files if not root else files.where(T.ascii_lower(F.col("file_path")).startswith(T.ascii_lower(F.lit(root + "/"))))
    parts = F.split("file_path", "/")
    base = len(root.split("/")) if root else 0
    folder = inside.where(F.size(parts) > base + 1).select(F.explode(F.transform(F.sequence(F.lit(base + 1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("path")).distinct()
    folder = folder.select("path", F.lit("directory").alias("kind"), F.lit(None).cast("string").alias("title"), F.lit(None).cast(files.schema["updated_at"].dataType).alias("updated_at"))
    file = inside.select(F.col("file_path").alias("path"), F.lit("file").alias("kind"), "title", "updated_at")
    both = folder.unionByName(file)
    return both.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "kind", (F.size(F.split("path", "/")) - base).alias("depth"), "title", "updated_at")


def listing(files: DataFrame, root: str = "", depth: int = 1, glob: str | None = None, order: str = "default") -> tuple[DataFrame, list[Column]]:
    """The nodes down to a depth whose name passes the glob (which never hides what is below), and their order."""
    found = nodes(files, root).where(F.col("depth") <= depth)
    if glob:
        found = found.where(F.col("name").rlike(T.glob_to_regex(glob)))
    return found, order_by(order)


def order_by(order: str) -> list[Column]:
    """Folders come first, except for title_desc."""
    if order not in ORDERS:
        raise ValueError(f"unknown order {order!r}")
    first = F.when(F.col("kind") == "directory", 0).otherwise(1)
    name = [F.lower("name"), F.lower("path"), F.col("path")]
    title = F.lower(F.coalesce("title", "name"))
    if order == "default":
        return [first, *name]
    if order == "title_asc":
        return [first, title, *name[1:]]
    if order == "title_desc":
        return [first.desc(), title.desc(), *name[1:]]
    updated = F.col("updated_at").asc_nulls_last() if order == "updated_asc" else F.col("updated_at").desc_nulls_last()
    return [first, updated, *name]
