"""Quality rules: a calibrated logistic regression on hashed word and character n-grams, after fixed base rules.

Features of a text are the words, the pairs of neighbouring words and the n-grams of 1 to 4 characters (code points),
hashed to 2**bits buckets; a bucket's value is the sum over kinds of its share of the text's features of that kind, so a
text's length does not matter. The model is fitted on a bounded, documented sample of labelled rows: in the order of a
keyed hash of doc_id, at most `max_labelled` rows, and of those as many as have `max_values` values together. It is
calibrated on a fifth of them that the weights have not seen. Scoring is one pass over Arrow batches, in which the text
alone goes to Python and the verdict alone comes back.

Defined cases: a null or empty text, or one without words, has zero counts, fails the base rules and is not kept. With no
usable labels (none, or one class only) every text that passes the base rules is kept with probability 1; labels without
doc_id or quality are not learned from, several labels of one doc_id count as the greatest. Texts of any length are taken
whole. Repeated rows are scored alike, ties at the threshold are kept. Columns that clash with those added are replaced;
all other columns pass through `score`. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .arrow_text import BYTE_VALUE, IS_WORD, U64, Chunk, chunks, mix, release, repeated_in_row, row_sums, span_hashes, word_hashes
from .storage import fresh

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
KINDS = 6
ADDED = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "quality": "double", "kept": "boolean"}


@dataclass(frozen=True)
class QualityModel:
    """Weights by bucket, divided by nothing; probability = sigmoid(slope * margin + offset). None: no usable labels."""

    weights: np.ndarray | None
    bias: float
    slope: float
    offset: float
    bits: int = 16
    threshold: float = 0.5


def base_counts(chunk: Chunk) -> dict[str, np.ndarray]:
    """The counts of the base rules for each row of the chunk."""
    data, off = chunk.data, chunk.off
    starts, ends, word_off = chunk.words()
    hashes = span_hashes(BYTE_VALUE[data], starts, ends)
    n_words = np.diff(word_off)
    points = IS_WORD[data] & ((data & 0xC0) != 0x80)
    out = {"n_words": n_words, "word_chars": row_sums(points, off), "n_symbols": row_sums(SYMBOL[data], off)}
    # lines: ended by \n or by the row's end
    cut = data == 10
    line_start = np.union1d(off[:-1][np.diff(off) > 0], np.flatnonzero(cut) + 1)
    line_start = line_start[line_start < len(data)]
    row_of = np.searchsorted(off, line_start, side="right") - 1
    breaks = np.concatenate([np.flatnonzero(cut), [len(data)]])
    line_end = np.minimum(breaks[np.searchsorted(breaks, line_start)], off[row_of + 1])
    with_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, row_of = line_start[with_word], line_end[with_word], row_of[with_word]
    line_off = np.searchsorted(row_of, np.arange(len(off)))
    _, later = repeated_in_row(span_hashes(BYTE_VALUE[data], line_start, line_end), line_off)
    out["n_dup_lines"] = row_sums(later, line_off)
    # windows of eight words
    windows = np.zeros(len(hashes), U64)
    for k in range(8):
        windows[: len(hashes) - k] += hashes[k:] * U64(pow(0xC2B2AE3D27D4EB4F, k, 1 << 64)) if len(hashes) > k else U64(0)
    last = np.repeat(word_off[1:], n_words)
    whole = np.flatnonzero(np.arange(len(hashes)) + 8 <= last)
    win_off = np.searchsorted(whole, word_off)
    twice, _ = repeated_in_row(mix(windows[whole]), win_off)
    change = np.zeros(len(hashes) + 9, np.int64)
    np.add.at(change, whole[twice], 1)
    np.add.at(change, whole[twice] + 8, -1)
    out["n_repeat_words"] = row_sums(np.cumsum(change)[: len(hashes)] > 0, word_off)
    n = out["n_words"]
    out["base_failed"] = (n < 20) | (100 * out["n_repeat_words"] > 30 * n)
    return out


def characters(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """A number for each character, its UTF-8 bytes one after another, and the offsets of the rows' characters."""
    data = chunk.data
    follows = (data & 0xC0) == 0x80
    if not follows.any():
        return data.astype(U64), chunk.off
    at = np.flatnonzero(~follows)
    codes = data[at].astype(U64)
    long = np.arange(len(at))
    for k in range(1, 4):
        long = long[at[long] + k < len(data)]
        long = long[follows[at[long] + k]]
        codes[long] = codes[long] << U64(8) | data[at[long] + k].astype(U64)
    return codes, np.searchsorted(at, chunk.off)


def hashed_features(chunk: Chunk, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: the buckets, and their offsets by row."""
    shift = U64(64 - bits)
    words, word_off = word_hashes(chunk, lower=False)
    out = [((mix(words + U64(11)) >> shift).astype(np.int32), word_off)]
    counts = np.diff(word_off)
    pairs = mix(words[:-1] * U64(3) + words[1:] * U64(5) + U64(12)) if len(words) > 1 else words[:0]
    inside = np.ones(len(pairs), bool)
    inside[(word_off[1:-1] - 1)[(word_off[1:-1] > 0) & (word_off[1:-1] < len(words))]] = False
    pair_off = np.searchsorted(np.flatnonzero(inside), word_off)
    out.append(((pairs[inside] >> shift).astype(np.int32), pair_off))
    codes, char_off = characters(chunk)
    rolled = np.zeros(len(codes), U64)
    for n in range(1, 5):
        m = len(codes) - n + 1
        if m < 1:
            out.append((np.zeros(0, np.int32), np.zeros(len(chunk.off), np.int64)))
            continue
        rolled = rolled[:m] * U64(0xD6E8FEB86659FD93) + codes[n - 1 :]
        buckets = ((rolled + U64(n)) * U64(0x9E3779B97F4A7C15)) >> shift
        # n-grams over a row's end belong to no row: offsets end before them
        begin = np.minimum(char_off[:-1], m)
        out.append((buckets.astype(np.int32), np.stack([begin, np.clip(char_off[1:] - n + 1, begin, m)])))
    assert len(out) == KINDS and len(counts) == len(chunk)
    return out


def margins(chunk: Chunk, model: QualityModel) -> np.ndarray:
    """The linear score of each row: the mean weight of its features, summed over the kinds."""
    total = np.full(len(chunk), model.bias)
    for buckets, off in hashed_features(chunk, model.bits):
        begin, end = off if off.ndim == 2 else (off[:-1], off[1:])
        sums = np.zeros(len(buckets) + 1)
        np.cumsum(model.weights[buckets], out=sums[1:])
        total += (sums[end] - sums[begin]) / np.maximum(1, end - begin)
    return total


def _sparse(chunk: Chunk, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and values of each row, at most 2**bits of them."""
    kinds = hashed_features(chunk, bits)
    for i in range(len(chunk)):
        index, value = [], []
        for buckets, off in kinds:
            begin, end = (off[0][i], off[1][i]) if off.ndim == 2 else (off[i], off[i + 1])
            found, count = np.unique(buckets[begin:end], return_counts=True)
            index.append(found)
            value.append(count / max(1, end - begin))
        found, place = np.unique(np.concatenate(index), return_inverse=True)
        yield found, np.bincount(place, weights=np.concatenate(value), minlength=len(found))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 4000, max_values: int = 1 << 24, bits: int = 16, threshold: float = 0.5, seed: int = 17) -> QualityModel:
    """A model from the labels (doc_id, quality). One task holds at most max_values values of 8 bytes, or one row."""
    key = F.xxhash64(F.lit(seed), F.col("doc_id"))
    sample = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(key, "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(key.alias("key"), "text", (F.col("quality") > 0).alias("good"), (F.pmod(key, F.lit(5)) == 0).alias("held"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                part = batch.slice(chunk.start, len(chunk))
                pairs = list(_sparse(chunk, bits))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array([i.astype(np.int32).tobytes() for i, _ in pairs], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in pairs], pa.binary())], ["key", "good", "held", "index", "value"])
        release()

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = linear.Bounded(max_values)
        for batch in batches:
            for key, good, held, index, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kept.add((key, zlib.crc32(index), zlib.crc32(value)), (good, held, index, value), len(index) // 4)
        model = fit_rows([row for _, _, row in kept.rows], bits, threshold)
        weights = None if model.weights is None else model.weights.tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([weights], pa.binary()), pa.array([model.bias]), pa.array([model.slope]), pa.array([model.offset])], ["weights", "bias", "slope", "offset"])
        del kept, model
        release()

    # the sample is bounded, so one task fits the model; the driver gets the weights alone
    got = rows.mapInArrow(features, "key long, good boolean, held boolean, index binary, value binary").repartition(1).mapInArrow(train, "weights binary, bias double, slope double, offset double").collect()
    if not got or got[0].weights is None:
        return QualityModel(None, 0.0, 1.0, 0.0, bits, threshold)
    return QualityModel(np.frombuffer(bytes(got[0].weights)), got[0].bias, got[0].slope, got[0].offset, bits, threshold)


def fit_rows(rows: list[tuple[bool, bool, bytes, bytes]], bits: int, threshold: float) -> QualityModel:
    """The model of labelled rows: is it good, is it held back for calibrating, buckets (int32) and values (float32)."""
    if len({r[0] for r in rows}) < 2:
        return QualityModel(None, 0.0, 1.0, 0.0, bits, threshold)
    split = all(len({r[0] for r in rows if r[1] == side}) == 2 for side in (False, True))
    rows = sorted(rows, key=lambda r: r[1]) if split else rows  # the rows held back come last
    n_fit = sum(not r[1] for r in rows) if split else len(rows)
    label = np.array([float(r[0]) for r in rows])
    off = np.concatenate([[0], np.cumsum([len(r[2]) // 4 for r in rows])])
    index, value = np.frombuffer(b"".join(r[2] for r in rows), np.int32), np.frombuffer(b"".join(r[3] for r in rows), np.float32)
    weights, bias = linear.fit(index, value, off[: n_fit + 1], label[:n_fit], 1 << bits, l2=1e-6, steps=80)
    first = n_fit if split else 0
    at = off[first:]
    slope, offset = linear.calibrate(row_sums(weights[index[at[0] :]] * value[at[0] :], at - at[0]) + bias, label[first:])
    return QualityModel(weights, bias, slope, offset, bits, threshold)


def score(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """docs with the base counts, base_failed, quality (the calibrated probability) and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([(c, {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[t]) for c, t in ADDED.items()])

    @F.arrow_udf("struct<" + ", ".join(f"{c}: {t}" for c, t in ADDED.items()) + ">")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for texts in batches:
            parts = []
            for chunk in chunks(texts):
                out = base_counts(chunk)
                if model.weights is None:
                    out["quality"] = np.ones(len(chunk))
                else:
                    out["quality"] = linear.sigmoid(model.slope * margins(chunk, model) + model.offset)
                out["kept"] = ~out["base_failed"] & (out["quality"] >= model.threshold)
                parts.append(pa.StructArray.from_arrays([pa.array(out[c]).cast(f.type) for c, f in zip(ADDED, kind, strict=True)], fields=list(kind)))
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)
        release()

    verdict = fresh(docs, "verdict")
    judged = docs.withColumn(verdict, judge.asNondeterministic()(F.col(text)))  # not to be computed twice
    return judged.select(*[c for c in docs.columns if c == text or c not in ADDED], *[F.col(f"{verdict}.{c}").alias(c) for c in ADDED if c != text])
