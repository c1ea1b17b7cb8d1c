"""Phrase collocations by merged count-min sketches and an exact second pass.

Words are lower-cased (A-Z), pieces end at `.,;:!?` and line breaks, and a phrase is a run of 1 to `longest` words within a
piece, counted by language. Pass 1: every task adds words and pairs to a count-min sketch of small saturating counters; the
sketches travel as compressed blocks and are added up block by block as they stream in: 2**MOST_BITS cells for each of DEPTH
hashes at most, whatever the input. Later passes only ask whether a cell reaches the threshold, so one bit for each cell of
the sum is collected and broadcast. Longer runs go to a second sketch in the same way, only those whose pairs all reach the
threshold in the first. A sketch never underestimates, so nothing frequent is lost. Pass 2:
n-grams whose estimate, and that of both their shorter parts, reaches the threshold are counted exactly, first within a
task and then by phrase. Parts of a frequent phrase are frequent themselves, so the exact table answers every later
question: the frequencies of the two sides of a cut, and the longer phrases that subsume a shorter one.

The passes run in as many tasks as the cluster has cores, twice over: what they send (a sketch, and a row for each phrase that
they meet) then follows the cluster and the phrases, not the number of splits. The width follows the number of bytes until
the bound is reached. Beyond it estimates grow and more rare n-grams are counted exactly: that costs time and shuffled
bytes, never a result. Phrases are told apart by 64-bit hashes within a task, by their text across tasks.

Defined cases: null, empty and wordless texts have no phrases; a null language is `und`; repeated rows count repeatedly; a
text is read whole, whatever its length; phrases of one score rank by frequency, then in byte order; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import BYTE_VALUE, LOWER, U64, Chunk, chunks, mix, release, span_hashes
from .storage import materialize

DEPTH = 2
PAIRS = 2  # runs of up to so many words are in the first sketch
LEAST_BITS, MOST_BITS = 16, 25
BLOCK = 1 << 16  # cells that travel together
FULL = 255  # a counter's greatest value
ENTRIES = 1 << 20  # distinct phrases that a task counts before it hands them on
SALTS = 32
BATCH = "2m"  # bytes of an Arrow batch: the JVM and the Python worker of each task hold some of them beside their work

_FOLD = LOWER.copy()
_FOLD[list(b".,;:!?")] = 0x0A
_BREAK = np.zeros(256, np.int64)
_BREAK[[0x0A, 0x0B, 0x0C, 0x0D]] = 1
_FACTORS = [U64(pow(0xC2B2AE3D27D4EB4F, k, 1 << 64)) for k in range(16)]
_ODD = [U64(0x9E3779B97F4A7C15), U64(0xD1B54A32D192ED03)]


def _language_value(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Runs:
    """The words of a chunk, and hashes of the runs of 1 to `longest` words inside its pieces."""

    def __init__(self, chunk: Chunk, langs: list[str], longest: int):
        data = _FOLD[chunk.data]
        self.data = data
        self.starts, self.ends, off = chunk.words(data)
        row = np.repeat(np.arange(len(chunk)), np.diff(off))
        piece = np.cumsum(_BREAK[data])[self.starts] + row if len(row) else row
        names, which = np.unique(np.array(langs, object), return_inverse=True)
        self.names, self.lang = names.tolist(), which[row] if len(row) else row
        words = span_hashes(BYTE_VALUE[data], self.starts, self.ends)
        salts = np.array([_language_value(x) for x in names], U64)
        base = salts[self.lang] if len(row) else np.zeros(0, U64)
        self.at, self.hashes = [], []  # by length - 1: the first words of the runs, and the runs' hashes
        total, n = base.copy(), len(words)
        for k in range(longest):
            total = total[: n - k] + words[k:] * _FACTORS[k] if n > k else total[:0]
            inside = np.flatnonzero(piece[: n - k] == piece[k:]) if n > k else np.zeros(0, np.int64)
            self.at.append(inside)
            self.hashes.append(mix(total[inside] + U64((k + 1) * 0xA0761D6478BD642F % (1 << 64))))

    def text(self, at: np.ndarray, length: np.ndarray) -> pa.Array:
        """The runs' words, joined by spaces."""
        sizes = self.ends - self.starts
        clean = np.full(int(sizes.sum()) + len(sizes), 0x20, np.uint8)
        begin = np.cumsum(sizes + 1) - sizes - 1
        spot = np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
        clean[spot] = self.data[np.repeat(self.starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))]
        low, high = begin[at], (begin + sizes)[at + length - 1]
        wide = high - low
        off = np.concatenate([[0], np.cumsum(wide)])
        take = np.repeat(low - off[:-1], wide) + np.arange(off[-1])
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(clean[take])])


def _runs(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[Runs]:
    for batch in batches:
        langs = ["und" if x is None else x for x in batch.column(1).to_pylist()]
        for chunk in chunks(batch.column(0), 1 << 20):
            yield Runs(chunk, langs[chunk.start : chunk.stop], longest)
        del batch  # before the next one is read


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH bytes for the queries that run meanwhile: by default a batch has 10,000 texts, whatever their sizes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _cells(hashes: np.ndarray, depth: int, bits: int) -> np.ndarray:
    return ((hashes * _ODD[depth]) >> U64(64 - bits)).astype(np.uint32)


def add(sketch: np.ndarray, hashes: np.ndarray, bits: int) -> None:
    """Adds one for each hash to its cell in every row of the sketch; counters stay at FULL."""
    for d in range(DEPTH):
        cells = np.sort(_cells(hashes, d, bits))
        edges = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.zeros(0, np.int64)
        n = np.diff(np.append(edges, len(cells)))
        where = cells[edges]
        sketch[d, where] = np.minimum(sketch[d, where] + n, FULL)


def estimate(sketch: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    return np.minimum.reduce([sketch[d, _cells(hashes, d, bits)] for d in range(DEPTH)])


def reaching(cells: np.ndarray, least: int) -> np.ndarray:
    """A bit for each cell, set if it reaches the threshold: all that `reach` asks of a sketch, in an eighth of its size."""
    return np.packbits(cells >= min(least, FULL), axis=-1, bitorder="little")


def reach(marks: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes have an estimate that reaches the threshold of these marks, a row of `reaching` for each row of the sketch."""
    cells = [_cells(hashes, d, bits) for d in range(DEPTH)]
    return np.bitwise_and.reduce([marks[d, c >> 3] >> (c & 7).astype(np.uint8) for d, c in enumerate(cells)]) & 1 == 1


def bits_for(n_bytes: int) -> int:
    """A cell for each 24 bytes of text: some 8 words and pairs a cell."""
    return int(min(MOST_BITS, max(LEAST_BITS, int(n_bytes // 24).bit_length())))


def survivors(runs: Runs, marks: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """By length: which runs may reach the threshold by the sketches' marks (of lengths up to PAIRS, of longer ones) and by their parts."""
    keep, shorter = [], None
    for k, (at, hashes) in enumerate(zip(runs.at, runs.hashes, strict=True)):
        which = 0 if k < PAIRS else 1
        good = reach(marks[which], hashes, bits) if which < len(marks) else np.ones(len(at), bool)
        if shorter is not None:  # both parts of one word less, which lie within the same piece
            good &= shorter[at] & shorter[at + 1]
        keep.append(good)
        shorter = np.zeros(len(runs.starts) + 1, bool)
        shorter[at[good]] = True
    return keep


def marks_of(texts: DataFrame, longest: int, bits: int, least: int, first=None) -> np.ndarray:
    """The marks of the sum of all tasks' sketches of texts (text, lang): of words and pairs, or, given the broadcast marks of these, of longer runs."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, codec = None, pa.Codec("zstd", 1)
        for runs in _runs(batches, longest if first is not None else PAIRS):
            if sketch is None:
                sketch = np.zeros((DEPTH, 1 << bits), np.uint8)
            if first is None:
                for hashes in runs.hashes:
                    add(sketch, hashes, bits)
            else:
                for good, hashes in zip(survivors(runs, [first.value], bits)[PAIRS:], runs.hashes[PAIRS:], strict=True):
                    add(sketch, hashes[good], bits)
        if sketch is not None:
            flat = sketch.reshape(-1, BLOCK)
            for i in np.flatnonzero(flat.any(axis=1)).tolist():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([codec.compress(flat[i].tobytes(), asbytes=True)], pa.binary())], ["block", "cells"])
        release()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            for block, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.frombuffer(codec.decompress(cells.as_buffer(), BLOCK), np.uint8)
                before = sums.get(block)
                sums[block] = got.copy() if before is None else np.minimum(before.astype(np.uint16) + got, FULL).astype(np.uint8)
        for block, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([reaching(total, least).tobytes()], pa.binary())], ["block", "marks"])
        release()

    kind, blocks = "block int, cells binary", DEPTH * (1 << bits) // BLOCK
    merged = texts.mapInArrow(build, kind).repartition(min(blocks, 256), "block").mapInArrow(merge, "block int, marks binary")
    out = np.zeros((blocks, BLOCK // 8), np.uint8)
    for row in merged.collect():  # DEPTH * 2**MOST_BITS bits at most: 8 MB
        out[row.block] = np.frombuffer(row.marks, np.uint8)
    return out.reshape(DEPTH, (1 << bits) // 8)


class Counter:
    """Distinct runs with their counts; texts are kept once for each run."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []
        self.known: list[np.ndarray] = []  # sorted, each less than half as long as the one before
        self.size = 0
        self.more: list[tuple[np.ndarray, np.ndarray]] = []
        self.totals: dict[str, int] = {}

    def take(self, runs: Runs, keep: list[np.ndarray]) -> None:
        for k, name in enumerate(runs.names):
            self.totals[name] = self.totals.get(name, 0) + int((runs.lang == k).sum())
        hashes = np.concatenate([h[m] for h, m in zip(runs.hashes, keep, strict=True)])
        at = np.concatenate([a[m] for a, m in zip(runs.at, keep, strict=True)])
        length = np.repeat(np.arange(1, len(keep) + 1, dtype=np.int32), [int(m.sum()) for m in keep])
        found, first, n = np.unique(hashes, return_index=True, return_counts=True)
        self.more.append((found, n))
        if sum(len(x) for x, _ in self.more) > 2 * ENTRIES:
            self._settle()
        seen = np.zeros(len(found), bool)
        for ordered in self.known:
            seen |= ordered[np.minimum(np.searchsorted(ordered, found), len(ordered) - 1)] == found
        fresh = first[~seen]
        if len(fresh):
            self.parts.append((hashes[fresh], runs.lang[at[fresh]].astype(np.int32), np.array(runs.names, object), length[fresh], runs.text(at[fresh], length[fresh])))
            self.size += len(fresh)
            self.known.append(found[~seen])
            while len(self.known) > 1 and 2 * len(self.known[-1]) > len(self.known[-2]):
                self.known[-2:] = [np.sort(np.concatenate(self.known[-2:]))]

    def _settle(self) -> tuple[np.ndarray, np.ndarray]:
        hashes, n = (np.concatenate(x) for x in zip(*self.more, strict=True))
        order = np.argsort(hashes, kind="stable")
        hashes, n = hashes[order], n[order]
        edges = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
        self.more = [(hashes[edges], np.add.reduceat(n, edges) if len(edges) else n)]
        return self.more[0]

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.more:
            distinct, sums = self._settle()
            for own, lang, names, length, text in self.parts:
                count = sums[np.searchsorted(distinct, own)]
                for i in range(0, len(own), 1 << 15):
                    part = slice(i, i + (1 << 15))
                    yield pa.RecordBatch.from_arrays([pa.array(names[lang[part]], pa.string()), pa.array(length[part].astype(np.int32)), text[part].cast(pa.string()), pa.array(count[part].astype(np.int64))], ["lang", "length", "phrase", "f"])
        if self.totals:
            names = list(self.totals)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([0] * len(names), pa.int32()), pa.array([""] * len(names), pa.string()), pa.array([self.totals[x] for x in names], pa.int64())], ["lang", "length", "phrase", "f"])


def frequencies(docs: DataFrame, least: int, longest: int, bits: int | None = None) -> DataFrame:
    """lang, length, phrase and f of every phrase with f >= least; length 0 has the number of words of the language."""
    context = docs.sparkSession.sparkContext
    texts = docs.select("text", "lang")
    if bits is None:
        bits = bits_for(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    texts = texts.coalesce(2 * context.defaultParallelism)
    first = context.broadcast(marks_of(texts, longest, bits, least))
    shared = [first, *([context.broadcast(marks_of(texts, longest, bits, least, first))] if longest > PAIRS else [])]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, counter = [x.value for x in shared], Counter()
        for runs in _runs(batches, longest):
            keep = survivors(runs, marks, bits)
            counter.take(runs, keep)
            if counter.size >= ENTRIES:
                yield from counter.flush()
                counter = Counter()
        yield from counter.flush()
        release()

    counted = texts.mapInArrow(count, "lang string, length int, phrase string, f long")
    return counted.groupBy("lang", "length", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= F.when(F.col("length") == 0, 1).otherwise(least))


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, percent: int = 80, top: int = 2000, bits: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best phrases of 2 to `longest` words of each language of docs (text, lang).

    A phrase with a = f >= least scores floor(2000000 * a / (l + r)) at its worst cut, of equal ones the first. Left out are
    those inside a longer one with percent % or more of their occurrences."""
    with small_batches(docs.sparkSession):
        counts = materialize(frequencies(docs, least, longest, bits), "phrases")
    phrases = counts.where("length > 0").select("lang", "length", "phrase", "f")
    sizes = counts.where("length = 0").select("lang", F.col("f").alias("n"))
    words = F.split("phrase", " ")
    part = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    split = phrases.where("length > 1").select("lang", "length", "phrase", F.col("f").alias("a"), words.alias("words"))
    cuts = split.select("*", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("length") - F.col("k")).alias("rest"))
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("cast((cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + r) as bigint)")
    worst = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = split.where("length > 2").select("lang", "length", "words", "a", F.explode(F.sequence(F.lit(2), F.col("length") - 1)).alias("n"))
    inner = inner.select("lang", "words", "a", "n", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("n") + 1)).alias("i"))
    longer = inner.groupBy("lang", part(F.col("i"), F.col("n")).alias("phrase")).agg(F.max("a").alias("inside"))
    kept = worst.join(longer, ["lang", "phrase"], "left").where(F.expr(f"inside is null or cast(inside as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * {int(percent)}"))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    best = "order by score desc, a desc, phrase"
    kept = kept.withColumn("rank", F.expr(f"row_number() over (partition by lang, salt {best})")).where(F.col("rank") <= top)  # no task gets more than SALTS * top rows of a language
    kept = kept.withColumn("rank", F.expr(f"row_number() over (partition by lang {best})")).where(F.col("rank") <= top)
    return kept.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
