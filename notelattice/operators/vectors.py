"""Vector search: similarity, the best chunks of each row, fusion with full-text scores, reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_SIMILARITY = 0.55
CHUNKS_PER_ROW = 5
MOST_CHUNKS = 4096
SMALL_NOTE = 2000
FUSION_BONUS = 0.3


def dot(a: Column, b: Column) -> Column:
    """The dot product in double; 0 if the lengths differ."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(F.lit(0.0))


def normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: (x.cast("double") / norm).cast("float"))).otherwise(v)


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector]).cast("array<float>")


def nearest(chunks: DataFrame, query: Column, k: int, order: list[str], vector: str = "embedding") -> DataFrame:
    """The k chunks with the highest similarity, ties by `order`: exact, a per-task top-k and one merge."""
    return chunks.withColumn("similarity", dot(F.col(vector), query)).orderBy(F.desc("similarity"), *order).limit(min(k, MOST_CHUNKS))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a batch as doubles; a null one and one of another length count as zeros, so their products are 0."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column).fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64)
    good = np.flatnonzero(n == width)
    out = np.zeros((len(column), width))
    if len(good):
        starts = np.cumsum(n) - n
        out[good] = flat[starts[good][:, None] + np.arange(width)]
    return out


class Nearest:
    """The k best (similarity, id) of each query so far."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.similarity, self.ids = [np.zeros(0)] * len(queries), [np.zeros(0, np.int64)] * len(queries)

    def take(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """One matrix product picks candidates; what is kept is summed in order, as `dot` does."""
        near = vectors @ self.queries.T
        k = min(self.k, len(ids))
        least = np.partition(near, len(ids) - k, axis=0)[len(ids) - k]
        for q in range(len(self.queries)):
            known = self.similarity[q][-1] if len(self.ids[q]) == self.k else -np.inf
            at = np.flatnonzero(near[:, q] >= max(least[q], known) - 1e-9 * (1 + abs(least[q])))
            if not len(at):
                continue
            exact = np.add.accumulate(vectors[at] * self.queries[q], axis=1)[:, -1] + 0.0
            similarity, own = np.concatenate([self.similarity[q], exact]), np.concatenate([self.ids[q], ids[at]])
            order = np.lexsort((own, -similarity))[: self.k]
            self.similarity[q], self.ids[q] = similarity[order], own[order]


def nearest_for_queries(chunks: DataFrame, queries: DataFrame, k: int, block_values: int = 1 << 22, salts: int = 16) -> DataFrame:
    """(query_id, vec_id, similarity, rank) of the k nearest chunks (vec_id, embedding) of each of many queries (query_id, query): exact.

    Queries are dealt by hash into blocks of about `block_values` numbers; a block is broadcast, and one pass over the chunks
    multiplies each Arrow batch with it and keeps k chunks for each query and task. What a task holds follows the block, not
    the number of queries; what is shuffled is k rows for each query and task, merged within salts first. Query ids are
    integers. A similarity of vectors of unlike lengths is 0; null vectors count as such; a query without a vector has none."""
    spark, asked = chunks.sparkSession, queries.where("query is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query"))
    values = asked.agg(F.coalesce(F.sum(F.size("query")), F.lit(0))).first()[0]
    parts, found = values // block_values + 1, None
    for part in range(parts):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).toArrow()
        widths = pc.list_value_length(own.column("query")).to_numpy() if len(own) else np.zeros(0)
        for width in np.unique(widths).tolist():
            same = own.filter(pa.array(widths == width))
            shared = spark.sparkContext.broadcast((same.column("query_id").to_numpy(), _matrix(same.column("query").combine_chunks(), width)))

            def run(batches: Iterator[pa.RecordBatch], shared=shared, width=width) -> Iterator[pa.RecordBatch]:
                names, matrix = shared.value
                best = Nearest(matrix, k)
                for batch in batches:
                    for at in range(0, len(batch), 1024):
                        some = batch.slice(at, 1024)
                        best.take(some.column(0).to_numpy(zero_copy_only=False), _matrix(some.column(1), width))
                n = [len(x) for x in best.ids]
                if sum(n):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, n)), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.similarity))], ["query_id", "vec_id", "similarity"])

            got = chunks.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "query_id long, vec_id long, similarity double")
            found = got if found is None else found.unionByName(got)
    if found is None:
        return spark.createDataFrame([], "query_id long, vec_id long, similarity double, rank int")
    order = [F.desc("similarity"), "vec_id"]
    found = found.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts))).withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "salt").orderBy(*order))).where(F.col("rank") <= k)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", "vec_id", "similarity", "rank")


def best_per_row(scored: DataFrame, row: list[str], chunk: str, floor: float = MIN_SIMILARITY) -> DataFrame:
    """The best similarity of each row and its chunks, best first (at most CHUNKS_PER_ROW); rows below the floor go."""
    w = Window.partitionBy(*row).orderBy(F.desc("similarity"), chunk)
    top = scored.withColumn("r", F.row_number().over(w)).where(F.col("r") <= CHUNKS_PER_ROW)
    grouped = top.groupBy(*row).agg(F.max("similarity").alias("score"), F.transform(F.array_sort(F.collect_list(F.struct("r", chunk))), lambda s: s[chunk]).alias("chunks"))
    return grouped.where(F.col("score") >= floor) if floor > 0 else grouped


def matched_chunk(body: Column, texts: Column) -> Column:
    """The whole body if it is short, else the best chunks between rules."""
    size = F.length(body)
    return F.when((size > 0) & (size <= SMALL_NOTE), body).when(F.size(texts) > 0, F.array_join(F.slice(texts, 1, CHUNKS_PER_ROW), "\n---\n"))


def normalize_scores(found: DataFrame, score: str = "score") -> DataFrame:
    """|score| over the largest |score|: by a one-row aggregate, so nothing is sorted or gathered."""
    top = found.agg(F.max(F.abs(score)).alias("__top"))
    return found.crossJoin(F.broadcast(top)).withColumn(score, F.when(F.col("__top") > 0, F.abs(score) / F.col("__top")).otherwise(0.0)).drop("__top")


def fuse(text: DataFrame, vector: DataFrame, key: list[str]) -> DataFrame:
    """The union of both legs (key, score) with max + 0.3 * min of the scores, a missing one being 0."""
    both = text.withColumnRenamed("score", "f").join(vector.withColumnRenamed("score", "v"), key, "full")
    f, v = F.coalesce("f", F.lit(0.0)), F.coalesce("v", F.lit(0.0))
    return both.select(*key, f.alias("text_score"), v.alias("vector_score"), (F.greatest(f, v) + FUSION_BONUS * F.least(f, v)).alias("score"))


def rerank(ranked: DataFrame, scores: DataFrame, key: list[str], candidates: int = 20) -> DataFrame:
    """ranked (key, pos from 1): the first `candidates` by their new score, then the others in order below the least one.

    The tail keeps its order with scores floor / (index + 2). Only the tail's size is unbounded, and it is not reordered.
    A candidate without a score has 0, as in the reference's fixture provider; of several scores the highest counts.
    """
    first = ranked.where(F.col("pos") <= candidates)
    known = scores.join(F.broadcast(first.select(*key)), key, "left_semi").groupBy(*key).agg(F.max("rerank_score").alias("rerank_score"))
    pool = first.join(F.broadcast(known), key, "left").withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0)))
    floor = pool.agg(F.min("rerank_score").alias("floor"))
    tail = ranked.where(F.col("pos") > candidates).crossJoin(F.broadcast(floor))
    head = pool.select(*key, F.col("rerank_score").alias("score"), F.lit(0).alias("part"), "pos")
    tail = tail.select(*key, (F.col("floor") / (F.col("pos") - candidates - 1 + 2)).alias("score"), F.lit(1).alias("part"), "pos")
    return head.unionByName(tail).orderBy("part", F.desc("score"), "pos").select(*key, "score", "pos")


def rerank_document(title: str | None, body: str | None, most: int = 0) -> str:
    """What a reranker reads of a row: the body, then the title on a line of its own; at most `most` characters if positive."""
    text = "\n".join(part for part in (body, title) if part)
    return text[:most] if most > 0 else text


def rerank_rows(rows: list[dict], scores: list[float], candidates: int = 20) -> list[dict]:
    """`rerank` for the rows of a page's window, which are on the driver: scores are those of the first `candidates` rows.

    ValueError if scores are too few, too many, not finite or outside 0 to 1.
    """
    pool = rows[:candidates]
    if len(scores) != len(pool):
        raise ValueError(f"reranker returned {len(scores)} scores for {len(pool)} documents")
    for k, s in enumerate(scores):
        if not 0.0 <= s <= 1.0:
            raise ValueError(f"reranker score at index {k} must be finite and in [0, 1], got {s}")
    first = sorted((row | {"score": float(s)} for row, s in zip(pool, scores)), key=lambda row: -row["score"])
    floor = first[-1]["score"] if first else 0.0
    return first + [row | {"score": floor / (k + 2)} for k, row in enumerate(rows[candidates:])]


def squash(logit: Column) -> Column:
    """The sigmoid of a logit clamped to +-30."""
    return 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0))))


def rerank_limit(candidates: int, limit: int, offset: int) -> int:
    return max(100, candidates * 4) + 10 * max(0, limit + offset - candidates)
