"""The driver's tables seen as engine tables: documents as notes, conversations as observations, keys as a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fulltext
from ..sources import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as entities: a path by source and language, metadata with language and source."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".md")))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.lit(1).alias("project_id"), F.concat(F.lit("Doc "), F.col("doc_id")).alias("title"), F.col("source").alias("note_type"), F.regexp_replace(path, r"\.md$", "").alias("permalink"), path.alias("file_path"),
        F.col("text").alias("body"), F.array("lang").alias("tags"), F.to_json(F.struct(F.array("lang").alias("tags"), F.col("lang").alias("status"), "source")).alias("entity_metadata"),
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("doc_id") * 3_600_000_000).cast("timestamp_ntz").alias("updated_at"),
    )


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search rows of the entities: title, the text as stems and snippet, permalink."""
    e = entities(spark, sf_dir)
    return e.select("id", "title", F.col("body").alias("content_stems"), F.col("body").alias("content_snippet"), "permalink", "file_path", F.lit("entity").alias("type"), "project_id", F.col("id").alias("entity_id"), F.lit(None).cast("string").alias("category"), F.to_json(F.struct("note_type", "tags")).alias("metadata"), "updated_at")


_INDEXES: dict[tuple, fulltext.Index] = {}


def text_index(spark: SparkSession, sf_dir: str) -> fulltext.Index:
    """The full-text index of the search rows, written by the first query of a session that needs it, and anew if the table has changed."""
    where, store = scratch.place(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
    held = store.getContentSummary(where)
    key = (spark.sparkContext.applicationId, sf_dir, store.getFileStatus(where).getModificationTime(), held.getLength(), held.getFileCount())
    if key not in _INDEXES:
        _INDEXES[key] = fulltext.write_index(index(spark, sf_dir), scratch.new_path(spark, "text-index"))
    return _INDEXES[key]


#: Entity ids of the graph: nations from 1000, regions from 2000, customers from 1,000,000, orders from 100,000,000.
NATION, REGION, CUSTOMER, ORDER = 1000, 2000, 1_000_000, 100_000_000


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of regions, nations, customers and orders; orders over 300,000 point at nothing."""
    region, nation, customer, orders = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    when = F.lit("2024-01-01 00:00:00.000000")
    nodes = [
        region.select((F.col("r_regionkey") + REGION).cast("long").alias("id"), F.col("r_name").alias("title"), when.alias("created_at")),
        nation.select((F.col("n_nationkey") + NATION).cast("long").alias("id"), F.col("n_name").alias("title"), when.alias("created_at")),
        customer.select((F.col("c_custkey") + CUSTOMER).cast("long").alias("id"), F.col("c_name").alias("title"), when.alias("created_at")),
        orders.select((F.col("o_orderkey") + ORDER).cast("long").alias("id"), F.concat(F.lit("order "), F.col("o_orderkey")).alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at")),
    ]
    edges = [
        nation.select((F.col("n_nationkey") + 1_000).cast("long").alias("id"), (F.col("n_nationkey") + NATION).cast("long").alias("from_id"), (F.col("n_regionkey") + REGION).cast("long").alias("to_id"), F.lit("in_region").alias("relation_type")),
        customer.select((F.col("c_custkey") + CUSTOMER).cast("long").alias("id"), (F.col("c_custkey") + CUSTOMER).cast("long").alias("from_id"), (F.col("c_nationkey") + NATION).cast("long").alias("to_id"), F.lit("in_nation").alias("relation_type")),
        orders.select((F.col("o_orderkey") + ORDER).cast("long").alias("id"), (F.col("o_orderkey") + ORDER).cast("long").alias("from_id"), F.when(F.col("o_totalprice") <= 300_000, F.col("o_custkey") + CUSTOMER).cast("long").alias("to_id"), F.lit("placed_by").alias("relation_type")),
    ]
    return nodes[0].unionByName(nodes[1]).unionByName(nodes[2]).unionByName(nodes[3]), edges[0].unionByName(edges[1]).unionByName(edges[2])


def field_values(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """conversations as notes with observations: the role is the category."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.col("conv_id").alias("note"), F.col("turn").alias("place"), F.col("role").alias("field"), F.col("text").alias("value")), turns.select(F.col("conv_id").alias("note")).distinct()
