"""Ranked lexical search: WAND per document shard, shard heaps merged.

A term is a maximal run of letters, digits and characters beyond ASCII, with A-Z lower-cased. The terms of a block of
items are few, so the block's term table is broadcast (its size is bounded by `block` rows) and one pass over the
documents writes shards: postings of these terms by term, with frequencies, and every document's size. Global statistics
come from the shards. Then each shard is searched on its own: documents are met in order, in runs; a term's greatest
impact in the shard bounds what it can add. Terms that cannot reach the heap's threshold even together select no pivot, so
documents that hold only such terms are skipped unread; a pivot document is scored only if the greatest impacts of the
terms it holds reach the threshold. The heap goes on from shard to shard of a task; what tasks find is merged by item,
first within salts.

A document's score for an item sums w * ((1000000000 * tf) div (1000 * tf + 12 * m)) over the item's terms, repeats
included, with w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))) and m = 100 - 25 + ((25 * n * N) div L).

Defined cases: null texts, and texts without terms, are no documents and match nothing; the rows of one item_id are one
item; an item without terms, or whose terms no document holds, has no rows. Repeated rows of documents are documents each;
one without doc_id is ranked after others of its score. Texts are read whole. Empty tables give an empty result; other
columns are ignored. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import BYTE_VALUE, LOWER, U64, Chunk, chunks, release, span_hashes
from .storage import materialize

_TERM = LOWER.copy()
_TERM[[i for i in range(128) if not chr(i).isalnum()]] = 0x20
POSTINGS = 1 << 19  # of a shard, unless one document has more
BLOCK = 200_000  # rows of (item, term) asked at once
NO_ID = np.iinfo(np.int64).max
SALTS = 16
FIRST_RUN = 256  # documents that are met at once, doubled each time


def term_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each term and the offsets of each row's terms."""
    data = _TERM[chunk.data]
    starts, ends, off = chunk.words(data)
    return span_hashes(BYTE_VALUE[data], starts, ends), off


def terms_of(items: DataFrame, name: str = "item_id", text: str = "text") -> DataFrame:
    """item, term (hash) and times of each term of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                hashes, off = term_hashes(chunk)
                row = np.repeat(np.arange(len(chunk)), np.diff(off))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.start, len(chunk)).take(pa.array(row)), pa.array(hashes.view(np.int64))], ["item", "term"])
        release()

    kind = items.schema[name].dataType.simpleString()
    return items.select(F.col(name).alias("item"), F.col(text).alias("text")).mapInArrow(run, f"item {kind}, term long").groupBy("item", "term").agg(F.count(F.lit(1)).alias("times"))


SHARD = "doc_ids array<long>, sizes array<long>, terms array<long>, ends array<int>, places array<int>, tf array<long>, n_docs long, n_terms long"


class Builder:
    """Gathers postings of the asked terms until a shard is full."""

    def __init__(self, asked: np.ndarray):
        self.asked = asked
        self.clear()

    def clear(self) -> None:
        self.ids, self.sizes, self.hits, self.rows, self.held = [], [], [], 0, 0

    def take(self, ids: pa.Array, hashes: np.ndarray, off: np.ndarray) -> None:
        n = np.diff(off)
        row = np.repeat(np.arange(len(n)), n)
        place = np.minimum(np.searchsorted(self.asked, hashes), len(self.asked) - 1)
        hit = self.asked[place] == hashes
        keys, tf = np.unique(place[hit].astype(np.int64) << 32 | (row[hit] + self.rows), return_counts=True)
        self.ids.append(ids)
        self.sizes.append(n)
        self.hits.append((keys, tf))
        self.rows += len(n)
        self.held += len(keys)

    def full(self) -> bool:
        return self.held >= POSTINGS or self.rows >= POSTINGS

    def shard(self) -> Iterator[pa.RecordBatch]:
        """One row: sizes of all documents, and by term the places of the documents that hold it."""
        if not self.rows:
            return
        keys, tf = (np.concatenate(x) for x in zip(*self.hits, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, tf, sizes = keys[order], tf[order], np.concatenate(self.sizes).astype(np.int64)
        term = keys >> 32
        edges = np.flatnonzero(np.concatenate([term[1:] != term[:-1], [True]])) + 1 if len(term) else np.zeros(0, np.int64)
        row = [pa.concat_arrays(self.ids), pa.array(sizes), pa.array(self.asked[term[edges - 1]].view(np.int64)), pa.array(edges.astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(tf.astype(np.int64))]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in row]
        counts = [pa.array([int((sizes > 0).sum())], pa.int64()), pa.array([int(sizes.sum())], pa.int64())]
        yield pa.RecordBatch.from_arrays([*lists, *counts], [x.split()[0] for x in SHARD.split(", ")])
        self.clear()


def shards(docs: DataFrame, terms, name: str = "doc_id", text: str = "text") -> DataFrame:
    """Shards of docs for a broadcast sorted array of term hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder = Builder(terms.value)
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for chunk in chunks(batch.column(1)):
                builder.take(ids.slice(chunk.start, len(chunk)), *term_hashes(chunk))
                if builder.full():
                    yield from builder.shard()
        yield from builder.shard()
        release()

    return docs.select(name, text).mapInArrow(run, SHARD)


class Shard:
    """A shard with the impact of each posting and each term's greatest."""

    def __init__(self, row: dict[str, np.ndarray], n_docs: int, n_terms: int):
        self.ids, self.terms, self.places = row["doc_ids"], row["terms"].view(U64), row["places"].astype(np.int64)
        self.starts = np.concatenate([[0], row["ends"][:-1]]).astype(np.int64) if len(self.terms) else np.zeros(0, np.int64)
        self.ends = row["ends"].astype(np.int64)
        m = 75 + (25 * row["sizes"] * n_docs) // n_terms
        tf = row["tf"]
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[self.places])
        self.most = np.maximum.reduceat(self.impact, self.starts) if len(self.terms) else self.impact
        self.rows = len(self.ids)


class Heap:
    """The k best documents so far: highest score, then smallest id."""

    def __init__(self, k: int):
        self.k, self.score, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def threshold(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def push(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.ids = score[order], ids[order]


def wand(shard: Shard, terms: np.ndarray, weights: np.ndarray, heap: Heap) -> int:
    """Puts the best documents of the shard for an item (hashes and weights of its terms) into the heap; how many were scored."""
    at = np.searchsorted(shard.terms, terms)
    held = (at < len(shard.terms)) & (weights > 0)
    held[held] = shard.terms[at[held]] == terms[held]
    at, weights = at[held], weights[held]
    if not len(at):
        return 0
    bound = weights * shard.most[at]
    order = np.argsort(bound, kind="stable")
    at, weights, bound = at[order], weights[order], bound[order]
    reach = np.cumsum(bound)  # what a term and all lesser ones can add together
    cursor, stop = shard.starts[at].copy(), shard.ends[at]
    low, width, scored = 0, FIRST_RUN, 0
    while low < shard.rows:
        high = min(shard.rows, low + width)
        until = np.array([c + np.searchsorted(shard.places[c:s], high) for c, s in zip(cursor.tolist(), stop.tolist(), strict=True)])
        least = int(np.searchsorted(reach, heap.threshold))  # terms below it make no pivot, even all together
        if least < len(at):
            top = np.zeros(high - low, np.int64)
            for t in range(least, len(at)):
                top[shard.places[cursor[t] : until[t]] - low] += bound[t]
            spare = int(reach[least - 1]) if least else 0
            pivots = np.flatnonzero((top > 0) & (top + spare >= heap.threshold))
            if len(pivots):
                slot = np.full(high - low, -1)
                slot[pivots] = np.arange(len(pivots))
                for t in range(least):  # the lesser terms that pivots hold after all
                    of = slot[shard.places[cursor[t] : until[t]] - low]
                    top[pivots[of[of >= 0]]] += bound[t]
                pivots = pivots[top[pivots] >= heap.threshold]
                slot.fill(-1)
                slot[pivots] = np.arange(len(pivots))
                score = np.zeros(len(pivots), np.int64)
                for t in range(len(at)):
                    of = slot[shard.places[cursor[t] : until[t]] - low]
                    hit = of >= 0
                    score[of[hit]] += weights[t] * shard.impact[cursor[t] : until[t]][hit]
                scored += len(pivots)
                good = score >= heap.threshold
                heap.push(score[good], shard.ids[low + pivots[good]])
        cursor, low, width = until, high, width * 2
    return scored


def best(written: DataFrame, asked, k: int, kind: str) -> DataFrame:
    """item, score and doc_id: each task's k best of its shards. asked: (items, [(terms, weights)], N, L), broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, queries, n_docs, n_terms = asked.value
        heaps = [Heap(k) for _ in items]
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].values for c in ("doc_ids", "sizes", "terms", "ends", "places", "tf")}
                row["doc_ids"] = row["doc_ids"].fill_null(NO_ID)
                shard = Shard({c: v.to_numpy() for c, v in row.items()}, n_docs, n_terms)
                for heap, (terms, weights) in zip(heaps, queries, strict=True):
                    wand(shard, terms, weights, heap)
        number = np.repeat(np.arange(len(items)), [len(h.score) for h in heaps])
        if len(number):
            score, ids = np.concatenate([h.score for h in heaps]), np.concatenate([h.ids for h in heaps])
            yield pa.RecordBatch.from_arrays([items.take(pa.array(number)), pa.array(score), pa.array(ids, mask=ids == NO_ID)], ["item", "score", "doc_id"])
        release()

    return written.select("doc_ids", "sizes", "terms", "ends", "places", "tf").mapInArrow(run, f"item {kind}, score long, doc_id long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of docs (doc_id, text) for each item of items (item_id, text)."""
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType.simpleString()
    terms = materialize(terms_of(items), "asked")
    parts = terms.count() // block + 1
    found = None
    for part in range(parts):  # whole items, about `block` rows at a time
        own = terms.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).toArrow()
        if not len(own):
            continue
        number, hashes = own.column("item").combine_chunks().dictionary_encode("encode"), own.column("term").to_numpy().view(U64)
        known = np.unique(hashes)
        written = materialize(shards(docs, spark.sparkContext.broadcast(known)), "shards")
        counted = written.select("n_docs", "n_terms").agg(F.sum("n_docs"), F.sum("n_terms")).first()
        n_docs, n_terms = int(counted[0] or 0), int(counted[1] or 0)
        size = F.expr("transform(ends, (e, i) -> e - if(i = 0, 0, ends[i - 1]))")
        df = written.select(F.explode(F.arrays_zip(F.col("terms").alias("term"), size.alias("df"))).alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df")).toArrow()
        weight = np.zeros(len(known), np.int64)
        for term, n in zip(df.column("term").to_numpy().view(U64), df.column("df").to_pylist(), strict=True):
            weight[np.searchsorted(known, term)] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))
        full = weight[np.searchsorted(known, hashes)] * own.column("times").to_numpy()
        of = number.indices.to_numpy()
        order = np.argsort(of, kind="stable")
        edges = np.searchsorted(of[order], np.arange(len(number.dictionary) + 1))
        queries = [(hashes[order[a:b]], full[order[a:b]]) for a, b in zip(edges, edges[1:], strict=False)]
        hits = best(written, spark.sparkContext.broadcast((number.dictionary, queries, n_docs, max(1, n_terms))), k, kind)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    found = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))  # no task gets more than SALTS * k rows of an item in the end
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return found.select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")
