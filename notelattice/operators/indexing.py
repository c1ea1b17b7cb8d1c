"""Index maintenance: search rows, link resolution, reconciling snapshots, moves, cascades, vector reuse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import scratch

SEARCH_COLUMNS = "id title content_stems content_snippet permalink file_path type project_id from_id to_id relation_type entity_id category metadata created_at updated_at".split()


def assign_ids(notes: DataFrame, known: DataFrame | None = None, after: tuple[int, int, int] = (0, 0, 0)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """entities, observations and relations of parsed notes, with ids in the order of paths, places and (type, target).

    Notes in known (file_path, id) keep that id; all other ids go on after those given out so far.

    Ids are global ranks. A global row_number would put all rows in one task, so ranks are computed per range of the sort
    key: ranges by a range partitioning, offsets from the counts of the ranges before (one row for each range).
    """
    if known is None:
        entities = ranked(notes, ["file_path"], after=after[0])
    else:
        fresh = ranked(notes.join(known, "file_path", "left_anti"), ["file_path"], after=after[0])
        entities = fresh.unionByName(notes.join(known.select("file_path", "id"), "file_path").select(*fresh.columns))
    own = entities.select("id", "file_path", "observations", "relations").withColumnRenamed("id", "entity_id")
    obs = own.select("entity_id", F.posexplode("observations").alias("place", "o")).select("entity_id", "place", "o.*")
    first = Window.partitionBy("entity_id", "relation_type", "to_name").orderBy("place")
    rel = own.select(F.col("entity_id"), F.posexplode("relations").alias("place", "r")).select("entity_id", "place", "r.*").withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    return entities.drop("observations", "relations"), ranked(obs, ["entity_id", "place"], after=after[1]), ranked(rel.withColumnRenamed("entity_id", "from_id"), ["from_id", "relation_type", "to_name"], after=after[2])


def ranked(rows: DataFrame, order: list[str], name: str = "id", after: int = 0) -> DataFrame:
    """rows with their rank in a total order, counted from after + 1.

    Ranges are drawn from a sample, and another plan, with other columns, may draw others: so rows are dealt once and written
    with their place, range in the high bits and row in the low ones, and both counts and ranks are read from there."""
    spark = rows.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = scratch.written(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__m", 33)
    counts = dealt.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("__p", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))  # one row for each range
    rank = F.col("__b") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + 1 + after
    return dealt.withColumn("__p", part).join(F.broadcast(before), "__p").withColumn(name, rank.cast("long")).drop("__p", "__m", "__b")


def entity_rows(entities: DataFrame) -> DataFrame:
    """Search rows of entities (id, project_id, title, note_type, permalink, file_path, body, tags, created_at, updated_at)."""
    nothing = F.array().cast("array<string>")
    body = F.when(F.col("body") != "", F.array("body")).otherwise(nothing)
    link = F.when(F.col("permalink").isNotNull(), T.variants(F.col("permalink"))).otherwise(nothing)
    stems = T.join_variants(T.variants(F.col("title")), body, link, T.variants(F.col("file_path")), F.coalesce("tags", nothing))
    null = F.lit(None)
    return entities.select(
        "id", "title", stems.alias("content_stems"), F.when(F.col("body") != "", F.col("body")).alias("content_snippet"), "permalink", "file_path", F.lit("entity").alias("type"), "project_id",
        null.cast("long").alias("from_id"), null.cast("long").alias("to_id"), null.cast("string").alias("relation_type"), F.col("id").alias("entity_id"), null.cast("string").alias("category"),
        F.to_json(F.struct("note_type")).alias("metadata"), "created_at", "updated_at",
    )


def observation_rows(observations: DataFrame, entities: DataFrame) -> DataFrame:
    """Search rows of observations (id, entity_id, category, content, context, tags); the category defaults to note."""
    owner = entities.select(F.col("id").alias("entity_id"), "project_id", F.col("permalink").alias("owner"), "file_path", "created_at", "updated_at")
    kind = F.coalesce("category", F.lit("note"))
    rows = observations.join(owner, "entity_id")
    link = T.observation_permalink(F.coalesce("owner", "file_path"), kind, F.col("content"))
    title = F.concat(kind, F.lit(": "), F.substring("content", 1, 100), F.lit("..."))
    null = F.lit(None)
    return rows.select(
        "id", title.alias("title"), T.join_variants(T.variants(F.col("content")), T.variants(link)).alias("content_stems"), F.col("content").alias("content_snippet"), link.alias("permalink"), "file_path", F.lit("observation").alias("type"), "project_id",
        null.cast("long").alias("from_id"), null.cast("long").alias("to_id"), null.cast("string").alias("relation_type"), "entity_id", kind.alias("category"),
        F.to_json(F.struct(F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))).alias("metadata"), "created_at", "updated_at",
    )


def relation_rows(relations: DataFrame, entities: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Search rows of relations (id, from_id, to_id, to_name, relation_type, context); targets: the entities they point to, if others."""
    source = entities.select(F.col("id").alias("from_id"), "project_id", F.col("title").alias("from_title"), F.col("permalink").alias("from_link"), "file_path", "created_at", "updated_at")
    target = (entities if targets is None else targets).select(F.col("id").alias("to_id"), F.col("title").alias("to_title"), F.col("permalink").alias("to_link"))
    rows = relations.join(source, "from_id").join(target, "to_id", "left")
    title = relation_title(F.col("from_title"), F.col("to_title"))
    link = T.relation_permalink(F.col("from_link"), F.col("relation_type"), F.coalesce("to_link", "to_name"))
    null = F.lit(None)
    return rows.select(
        "id", title.alias("title"), T.join_variants(T.variants(title)).alias("content_stems"), null.cast("string").alias("content_snippet"), link.alias("permalink"), "file_path", F.lit("relation").alias("type"), "project_id",
        "from_id", "to_id", "relation_type", F.col("from_id").alias("entity_id"), null.cast("string").alias("category"), F.lit("{}").alias("metadata"), "created_at", "updated_at",
    )


def relation_title(source, target):
    return F.when(target.isNotNull(), F.concat(source, F.lit(" -> "), target)).otherwise(source)


def search_index(entities: DataFrame, observations: DataFrame, relations: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    return reduce(DataFrame.unionByName, [entity_rows(entities), observation_rows(observations, entities), relation_rows(relations, entities, targets)])


def link_keys() -> Column:
    """What links to an entity may say: its permalink, its path, and its path without .md."""
    return F.array_distinct(F.filter(F.array("permalink", "file_path", F.regexp_replace("file_path", r"\.md$", "")), lambda k: k.isNotNull()))


def link_name() -> Column:
    """What a relation's target is looked up by."""
    return F.trim(F.split("to_name", r"\|").getItem(0))


def resolve_links(targets: DataFrame, entities: DataFrame) -> DataFrame:
    """targets (to_name, to_id) with to_id, where it is null, set to the first entity by id whose permalink or path, with or
    without .md, is the target. Where both sides have project_id, only entities of the target's own project count.

    What stands after a bar is a label. Each entity offers its keys, so this is one hash join instead of a nested loop.
    """
    own = ["project_id"] if "project_id" in targets.columns and "project_id" in entities.columns else []
    offered = entities.select(*own, "id", F.explode(link_keys()).alias("key")).groupBy(*own, "key").agg(F.min("id").alias("__found"))
    known = F.col("to_id") if "to_id" in targets.columns else F.lit(None).cast("long")
    columns = [F.coalesce(known, "__found").alias("to_id") if c == "to_id" else F.col(c) for c in dict.fromkeys([*targets.columns, "to_id"])]
    return targets.withColumn("key", link_name()).join(offered, [*own, "key"], "left").select(*columns)


def reconcile(disk: DataFrame, stored: DataFrame, key: str = "file_path") -> DataFrame:
    """key and change (added, updated, unchanged, removed) by comparing checksums of two snapshots: one full outer join."""
    both = disk.select(key, F.col("checksum").alias("now")).join(stored.select(key, F.col("checksum").alias("was")), key, "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") == F.col("was"), "unchanged").otherwise("updated")
    return both.select(key, change.alias("change"))


def pair_moves(deleted: DataFrame, created: DataFrame) -> DataFrame:
    """(checksum, from_path, to_path): each deleted file with the created one of equal content, in order of path.

    Equal contents several times pair first with first, second with second.
    """
    order = lambda: F.row_number().over(Window.partitionBy("checksum").orderBy("file_path"))
    a = deleted.select("checksum", F.col("file_path").alias("from_path"), order().alias("n"))
    b = created.select("checksum", F.col("file_path").alias("to_path"), order().alias("n"))
    return a.join(b, ["checksum", "n"]).select("checksum", "from_path", "to_path")


def remove(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """entity, observation, relation and search_index without the entities gone (id): both ends of relations cascade,
    search rows go by their own entity only."""
    ids = gone.select(F.col("id").alias("__gone")).distinct()

    def without(df: DataFrame, column: str) -> DataFrame:
        return df.join(ids, df[column] == ids["__gone"], "left_anti")

    return {"entity": without(tables["entity"], "id"), "observation": without(tables["observation"], "entity_id"), "relation": without(without(tables["relation"], "from_id"), "to_id"), "search_index": without(tables["search_index"], "entity_id")}


def reusable_vectors(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """chunks (chunk_key, source_hash, ...) with the stored embedding of equal key and hash, null where one is to be made."""
    return chunks.join(stored.select("chunk_key", "source_hash", "embedding"), ["chunk_key", "source_hash"], "left")
