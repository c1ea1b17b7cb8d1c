"""Writes as table-to-table functions: each takes a table's version and returns the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """table with the rows put in: those of equal key are replaced. One anti-join and a union."""
    return table.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows)


def replace_documents(tables: dict[str, DataFrame], fresh: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """entity, observation, relation and search_index with everything of the entities in fresh["entity"] replaced."""
    ids = fresh["entity"].select("id").distinct()
    owner = {"entity": "id", "observation": "entity_id", "relation": "from_id", "search_index": "entity_id"}
    return {name: table.join(ids.withColumnRenamed("id", owner[name]), owner[name], "left_anti").unionByName(fresh[name]) for name, table in tables.items() if name in owner}


def refresh_relation_rows(search_index: DataFrame, relation_rows: DataFrame) -> DataFrame:
    """The search index with all relation rows made anew."""
    return search_index.where("type <> 'relation'").unionByName(relation_rows)


def move_document(entities: DataFrame, source: str, target: str, permalink: str | None = None) -> DataFrame:
    """The entity at a path under another; its permalink changes only if one is given."""
    here = F.col("file_path") == source
    moved = entities.withColumn("permalink", F.when(here & F.lit(permalink is not None), F.lit(permalink)).otherwise(F.col("permalink")))
    return moved.withColumn("file_path", F.when(here, F.lit(target)).otherwise(F.col("file_path")))


def delete_project(tables: dict[str, DataFrame], project_id: int) -> dict[str, DataFrame]:
    return {name: t.where(F.col("id" if name == "project" else "project_id") != project_id) for name, t in tables.items()}


def replace_vectors(vectors: DataFrame, fresh: DataFrame, project_id: int) -> DataFrame:
    """All chunks of a project replaced."""
    return vectors.where(F.col("project_id") != project_id).unionByName(fresh)


def counts(entity: DataFrame, observation: DataFrame, relation: DataFrame) -> DataFrame:
    """One row: how many entities, observations and relations there are, and how many relations are unresolved."""
    tagged = entity.select(F.lit("e").alias("t"), F.lit(True).alias("done")).unionByName(observation.select(F.lit("o").alias("t"), F.lit(True).alias("done"))).unionByName(relation.select(F.lit("r").alias("t"), F.col("to_id").isNotNull().alias("done")))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias
    return tagged.agg(n(F.col("t") == "e")("n_entities"), n(F.col("t") == "o")("n_observations"), n(F.col("t") == "r")("n_relations"), n((F.col("t") == "r") & ~F.col("done"))("n_unresolved"))
