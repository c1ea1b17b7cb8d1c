"""Bounded graph traversal over entities and relations, context assembly and recent activity.

A step goes from an entity to its relations (either direction) and from a relation to the entity at its other end, so a
depth of d entity hops is 2 * d steps. Paths are per path, not global: a node may be reached again on another path, but no
path meets an entity twice. Only the least depth of a row is reported, so paths with the same set of entities and the same
end are merged on each level, which keeps hubs from multiplying them.

Each level is written before the next one starts from it, so no level is computed twice. A hub's edges are dealt into parts
of about HUB, and a path that reaches it is asked in every part, so no task gets all of a hub's edges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch

MOST_RELATED = 100
HUB = 10_000


def traverse(entities: DataFrame, relations: DataFrame, seeds: DataFrame, depth: int, since: str | None = None) -> DataFrame:
    """(root_id, type, id, title, depth) of all rows within `depth` entity hops of the seeds (id), without the seeds.

    entities: id, title, created_at (text). relations: id, from_id, to_id (null if unresolved), relation_type. Depths count
    steps: a relation beside the seed has depth 1, the entity behind it 2. Times are compared as text, like the bound.
    """
    recent = entities if since is None else entities.where(F.col("created_at") >= since)
    sources = recent.select(F.col("id").alias("from_id"))
    usable = relations if since is None else relations.join(sources, "from_id", "left_semi")
    forward = usable.select("id", "relation_type", F.col("from_id").alias("node"), F.col("to_id").alias("other"))
    backward = usable.where("to_id is not null and to_id <> from_id").select("id", "relation_type", F.col("to_id").alias("node"), F.col("from_id").alias("other"))
    edges = forward.unionByName(backward)
    ends = recent.select(F.col("id").alias("other"), F.col("title").alias("other_title"))
    level = seeds.select("id").distinct().join(recent.select("id"), "id", "left_semi").select(F.col("id").alias("root_id"), F.col("id").alias("node"), F.array("id").alias("path"))
    found, spark = [], seeds.sparkSession
    kept = lambda rows, name: scratch.written(rows, name) if depth > 1 else rows
    hubs = kept(edges.groupBy("node").agg(F.expr(f"cast(count(1) div {HUB} as int) + 1").alias("parts")).where("parts > 1"), "hubs")
    edges = kept(edges.join(hubs, "node", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts"), "edges")
    for d in range(depth):
        asked = level.join(hubs, "node", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        step = asked.join(edges, ["node", "part"])
        found.append(step.select("root_id", F.lit("relation").alias("type"), "id", F.col("relation_type").alias("title"), F.lit(2 * d + 1).alias("depth")).distinct())
        hop = step.where("other is not null and not array_contains(path, other)").join(ends, "other")
        level = hop.select("root_id", F.col("other").alias("node"), F.array_sort(F.array_append("path", F.col("other"))).alias("path"), "other_title").distinct()
        level = kept(level, "level")
        found.append(level.select("root_id", F.lit("entity").alias("type"), F.col("node").alias("id"), F.col("other_title").alias("title"), F.lit(2 * d + 2).alias("depth")).distinct())
        level = level.drop("other_title")
    if not found:
        return spark.createDataFrame([], "root_id long, type string, id long, title string, depth int")
    return reduce(DataFrame.unionByName, found).groupBy("root_id", "type", "id", "title").agg(F.min("depth").alias("depth"))


def related(found: DataFrame, most: int) -> DataFrame:
    """The first `most` rows by depth, type and id."""
    return found.orderBy("depth", "type", "id", "root_id").limit(most)


def context_counts(found: DataFrame, observations: DataFrame) -> DataFrame:
    """For each root: distinct related entities, distinct relations, and the observations of those entities."""
    distinct = found.select("root_id", "type", "id").distinct()
    kinds = distinct.groupBy("root_id").agg(F.sum((F.col("type") == "entity").cast("long")).alias("n_entities"), F.sum((F.col("type") == "relation").cast("long")).alias("n_relations"))
    seen = distinct.where("type = 'entity'").select("root_id", F.col("id").alias("entity_id"))
    notes = observations.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    totals = seen.join(notes, "entity_id").groupBy("root_id").agg(F.sum("n").alias("n_observations"))
    return kinds.join(totals, "root_id", "left").select("root_id", "n_entities", "n_relations", F.coalesce("n_observations", F.lit(0)).cast("long").alias("n_observations"))


#: What an identifier may be, best first.
KINDS = ("permalink", "path", "path without .md", "end of a permalink", "title")


def identifier_keys(entities: DataFrame) -> DataFrame:
    """key, rank (a place in KINDS) and id: for all that identifiers of entities (id, permalink, file_path, title) may say, the first entity by path.

    Every permalink gives all its ends behind a slash, so an end is found by equality, not by a scan for each identifier. Of
    equal titles the shortest path counts, then the first."""
    parts = F.split("permalink", "/")
    ends = F.when(F.col("permalink").contains("/"), F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).otherwise(F.array().cast("array<string>"))
    one = lambda c: F.array(c)
    bare = F.when(F.col("file_path").endswith(".md"), F.array(F.regexp_replace("file_path", r"\.md$", ""))).otherwise(F.array().cast("array<string>"))
    said = [one(F.col("permalink")), one(F.col("file_path")), bare, ends, one(F.col("title"))]
    of = lambda r: lambda k: F.struct(k.alias("key"), F.lit(r).alias("rank"))
    keys = F.flatten(F.array(*[F.transform(keys, of(r)) for r, keys in enumerate(said)]))
    rows = entities.select("id", "file_path", F.explode(keys).alias("k")).select("k.key", "k.rank", "id", "file_path").where("key is not null and key <> ''")
    first = F.struct(F.when(F.col("rank") == len(KINDS) - 1, F.length("file_path")).otherwise(0), F.col("file_path"), F.col("id"))
    return rows.groupBy("key", "rank").agg(F.min_by("id", first).alias("id"))


def resolve_identifiers(asked: DataFrame, entities: DataFrame, identifier: str = "identifier") -> DataFrame:
    """asked with id and kind (null if there is none): what each identifier names, by the best kind that fits; one equi-join for all."""
    name = F.trim(F.regexp_replace(F.regexp_replace(identifier, "^memory://", ""), "^/+|/+$", ""))
    best = asked.select(identifier).distinct().withColumn("key", name).join(identifier_keys(entities), "key").groupBy(identifier).agg(F.min(F.struct("rank", "id")).alias("best"))
    kind = F.when(F.col("best").isNotNull(), F.element_at(F.array(*map(F.lit, KINDS)), F.col("best.rank") + 1))
    return asked.join(best, identifier, "left").select(*asked.columns, F.col("best.id").alias("id"), kind.alias("kind"))


def normalize_url(url: str) -> str:
    """The path of a memory:// address; raises ValueError for what can't be one."""
    path = url.strip().removeprefix("memory://")
    if not path or "://" in path or "//" in path or any(c in '<>"|?' for c in path) or len(path.encode()) > 2028:
        raise ValueError(f"not a memory address: {url!r}")
    return path.strip("/")


def build_context(entities: DataFrame, relations: DataFrame, observations: DataFrame, seeds: DataFrame, depth: int = 1, most: int = 10, since: str | None = None) -> DataFrame:
    """One row for each seed: its observations and related rows as nested arrays, with counts."""
    if not 1 <= most <= MOST_RELATED:
        raise ValueError(f"max_related must be between 1 and {MOST_RELATED}")
    found = traverse(entities, relations, seeds, depth, since)
    first = Window.partitionBy("root_id").orderBy("depth", "type", "id")
    kept = found.withColumn("pos", F.row_number().over(first)).where(F.col("pos") <= most)
    lists = kept.groupBy("root_id").agg(F.array_sort(F.collect_list(F.struct("pos", "type", "id", "title", "depth"))).alias("related"))
    own = observations.join(F.broadcast(seeds.select(F.col("id").alias("entity_id")).distinct()), "entity_id", "left_semi").groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("id", "category", "content"))).alias("observations"))
    primary = entities.join(seeds.select("id").distinct(), "id", "left_semi")
    out = primary.join(own.withColumnRenamed("entity_id", "id"), "id", "left").join(lists.withColumnRenamed("root_id", "id"), "id", "left")
    return out.join(context_counts(found, observations).withColumnRenamed("root_id", "id"), "id", "left")


def recent(rows: DataFrame, since: Column, page: int, size: int) -> DataFrame:
    """The newest rows since a bound, one more than the page holds, so that a caller sees whether others follow."""
    return rows.where(F.col("updated_at") >= since).orderBy(F.desc("updated_at"), "type", "id").offset((page - 1) * size).limit(size + 1)


def recent_context(rows: DataFrame, entities: DataFrame, relations: DataFrame, observations: DataFrame, since: str, page: int = 1, size: int = 10, depth: int = 1, most: int = 10) -> DataFrame:
    """The newest rows since a bound (a page of them), each with what is related to it: all are traversed at once, with one
    cut to `most` related rows over all of them, by depth, type and id.

    pos, type, id, title, n_observations (of an entity row itself), n_relations (of its related rows) and related (array of
    type, id, title, depth). rows: type, id, title, updated_at, of which an entity row's id is its entity's. Roots are ids,
    as rows of other types share them with entities.
    """
    newest = [F.desc("updated_at"), F.col("type"), F.col("id")]
    first = rows.where(F.col("updated_at") >= F.lit(since).cast("timestamp_ntz")).orderBy(*newest).offset((page - 1) * size).limit(size)
    primary = scratch.written(first.select("type", "id", "title", "updated_at").withColumn("pos", F.row_number().over(Window.orderBy(*newest))), "primary")  # one page
    found = related(traverse(entities, relations, primary.select("id").distinct(), depth, since), most)
    lists = found.groupBy("root_id").agg(F.array_sort(F.collect_list(F.struct("depth", "type", "id", "title"))).alias("related"), F.count_if(F.col("type") == "relation").alias("n_relations"))
    notes = observations.join(F.broadcast(primary.where("type = 'entity'").select(F.col("id").alias("entity_id"))), "entity_id", "left_semi").groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("n_observations"))
    out = primary.join(lists.withColumnRenamed("root_id", "id"), "id", "left").join(notes.withColumn("type", F.lit("entity")), ["type", "id"], "left")
    none = F.array().cast("array<struct<depth: int, type: string, id: bigint, title: string>>")
    return out.select("pos", "type", "id", "title", F.coalesce("n_observations", F.lit(0)).cast("long").alias("n_observations"), F.coalesce("n_relations", F.lit(0)).cast("long").alias("n_relations"), F.coalesce("related", none).alias("related"))
