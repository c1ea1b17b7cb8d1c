"""Language identification: multinomial naive Bayes over hashed character n-grams.

Features are the n-grams of 1 to 3 characters of the lower-cased words, each word between two spaces, hashed to 2**bits
buckets. Training counts buckets by language in one pass over every training row: a task keeps sparse sums and hands them
on when they are many, one shuffle adds them up, and each language's log probabilities are packed into one row of a table.
Every language is learned. The matrix is taken in blocks of `block` languages, in their order: a block is all that the
driver holds and broadcasts. Scoring looks rows of the block up and sums them by text; up to `block` languages take one
pass, more take one pass for each block, which carries the best language so far and the sum for its posterior.

Defined cases: a null text, or one without a letter, is `und` with score 0. With no training rows every text is `und`.
Rows without a language or text are not learned from. Ties go to the language that sorts first. Repeated rows count
repeatedly and are predicted alike; texts of any length are taken whole; an empty table gives an empty result. Columns
named like those added are replaced, all others pass through.
`score` is the posterior probability of the predicted language, tempered by the square root of the number of n-grams
(n-grams overlap, so their evidence is not independent).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import release, row_sums
from .storage import fresh, materialize

ADDED = {"lang_pred": "string", "score": "double"}
PIECE = 1 << 16  # characters handled at once
HELD = 1 << 21  # sums that a task keeps
PLANES = 0x40000  # no code point from here on is a letter


@dataclass(frozen=True)
class Block:
    """Some languages in their order."""

    languages: tuple[str, ...]
    log_prob: np.ndarray  # buckets x languages
    log_prior: np.ndarray
    bits: int


@dataclass(frozen=True)
class LanguageModel:
    """columns: a table (lang, n texts, packed: the log probabilities of all buckets as float32)."""

    columns: DataFrame
    n_texts: int
    n_languages: int
    bits: int
    block: int

    def blocks(self) -> Iterator[Block]:
        after = None
        for _ in range(0, self.n_languages, self.block):
            more = self.columns if after is None else self.columns.where(F.col("lang") > after)
            got = more.orderBy("lang").limit(self.block).collect()
            after = got[-1].lang
            matrix = np.stack([np.frombuffer(bytes(r.packed), np.float32) for r in got], axis=1)
            yield Block(tuple(r.lang for r in got), np.ascontiguousarray(matrix), np.log(np.array([r.n for r in got]) / self.n_texts), self.bits)


_TABLES: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point below PLANES: is it a letter, and its lower-case form (one character). The last stands for all beyond."""
    if not _TABLES:
        letter, lower = np.zeros(PLANES, bool), np.arange(PLANES, dtype=np.uint32)
        for i in range(PLANES):
            c = chr(i)
            letter[i] = c.isalpha()
            low = c.lower()
            if len(low) == 1:
                lower[i] = ord(low)
        _TABLES.extend([letter, lower])
    return _TABLES[0], _TABLES[1]


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of the texts with every non-letter as a space, one space before and after each text."""
    letter, lower = _tables()
    joined = " " + " ".join(texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = np.minimum(points, PLANES - 1)
    return np.where(letter[small], lower[small], np.uint32(32)), np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])


def grams(texts: list[str], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2, 3: buckets of the n-grams, and their offsets by text. Runs of spaces count as one."""
    points, off = _points(texts)
    space = points == 32
    single = np.ones(len(points), bool)
    single[:-1] = ~(space[:-1] & space[1:])  # of a run of spaces the last stays: it never belongs to the text before
    at = np.flatnonzero(single)
    points, off = points[at], np.searchsorted(at, off)
    letters = points != 32
    out, code = [], np.zeros(len(points), np.uint64)
    for n in (1, 2, 3):
        m = len(points) - n + 1
        if m < 1:
            out.append((np.zeros(0, np.int64), np.zeros(len(off), np.int64)))
            continue
        code = (code[:m] << np.uint64(20)) | points[n - 1 :]
        good = letters[:m] | letters[n - 1 :]
        if n == 3:
            good &= letters[1 : 1 + m]
        where = np.flatnonzero(good)
        found = code[where] + np.uint64(n << 60)
        buckets = ((found * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
        out.append((buckets, np.searchsorted(where, off)))
    return out


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    texts = [t or "" for t in column.to_pylist()]
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > PIECE * 4:
            yield start, i, texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts), texts[start:]


class _Sums:
    """Sparse sums of (language, bucket); bucket -1 counts texts."""

    def __init__(self):
        self.names: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, langs: list[str], texts: list[str], bits: int) -> None:
        names = sorted(set(langs))
        if len(names) > 64:
            half = len(texts) // 2
            self.add(langs[:half], texts[:half], bits)
            self.add(langs[half:], texts[half:], bits)
            return
        size, local = (1 << bits) + 1, {x: i for i, x in enumerate(names)}
        of = np.array([local[x] for x in langs], np.int64)
        total = np.bincount(of * size, minlength=len(names) * size)
        for buckets, off in grams(texts, bits):
            total += np.bincount(np.repeat(of, np.diff(off)) * size + buckets + 1, minlength=len(names) * size)
        found = np.flatnonzero(total)
        own = np.array([self.names.setdefault(x, len(self.names)) for x in names], np.int64)
        self.parts.append(((own[found // size] << 32) + found % size, total[found]))
        self.held += len(found)
        if self.held > HELD:
            self._settle()

    def _settle(self) -> None:
        keys, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        keys, at = np.unique(keys, return_inverse=True)
        self.parts, self.held = [(keys, np.bincount(at, weights=n, minlength=len(keys)).astype(np.int64))], len(keys)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._settle()
            keys, n = self.parts[0]
            names = pa.array(list(self.names), pa.string())
            for i in range(0, len(keys), 1 << 16):
                part = keys[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(part >> 32)), pa.array(((part & 0xFFFFFFFF) - 1).astype(np.int32)), pa.array(n[i : i + (1 << 16)])], ["lang", "bucket", "n"])


def fit(rows: DataFrame, bits: int = 15, alpha: float = 0.5, block: int = 256) -> LanguageModel:
    """A model from every row of rows (text, lang); a block of its matrix has 2**bits * block numbers of 4 bytes."""
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for start, stop, texts in _pieces(batch.column(0)):
                sums.add(langs[start:stop], texts, bits)
                if sums.held > HELD // 2:  # still, after equal keys have met
                    yield from sums.rows()
                    sums = _Sums()
        yield from sums.rows()
        release()

    def pack(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        """A language's counts, at most one for each bucket, as a column of the matrix."""
        column = np.zeros(size + 1)
        column[table.column("bucket").to_numpy()] = table.column("n").to_numpy()  # bucket -1, the last, has the number of texts
        log_prob = np.log((column[:size] + alpha) / (column[:size].sum() + alpha * size)).astype(np.float32)
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "n": pa.array([int(column[size])], pa.int64()), "packed": pa.array([log_prob.tobytes()], pa.binary())})

    usable = rows.where("text is not null and lang is not null").select("text", "lang")
    counts = usable.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    columns = materialize(counts.groupBy("lang").applyInArrow(pack, "lang string, n long, packed binary"), "languages")
    n_texts, n_languages = columns.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    return LanguageModel(columns, n_texts, n_languages, bits, block)


def judge_texts(texts: list[str], block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By text: the place of the block's best language, its value, the sum of all values' exponentials over the best's, and is there a letter?"""
    total = np.zeros((len(texts), len(block.languages)))
    n = np.zeros(len(texts))
    letters = np.zeros(len(texts))
    for k, (buckets, off) in enumerate(grams(texts, block.bits)):
        n += np.diff(off)
        if k == 0:
            letters = np.diff(off)
        for j in range(len(block.languages)):
            total[:, j] += row_sums(block.log_prob[buckets, j].astype(np.float64), off)
    scaled = total / np.sqrt(np.maximum(1, n))[:, None] + block.log_prior
    best = scaled.argmax(axis=1)
    value = scaled[np.arange(len(texts)), best]
    return best, value, np.exp(scaled - value[:, None]).sum(axis=1), letters > 0


def predict_texts(texts: list[str], block: Block) -> tuple[list[str], np.ndarray]:
    best, _, mass, letters = judge_texts(texts, block)
    return ["und" if not a else block.languages[b] for a, b in zip(letters, best, strict=True)], np.where(letters, 1 / mass, 0.0)


def _judge(shared):
    @F.arrow_udf("struct<lang: string, value: double, mass: double>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        block, names = shared.value, pa.array(shared.value.languages, pa.string())
        for texts in batches:
            found = [judge_texts(part, block) for _, _, part in _pieces(texts)]
            place, value, mass, letters = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), *[np.zeros(0)] * 3)
            yield pa.StructArray.from_arrays([names.take(pa.array(place, mask=letters == 0)), pa.array(value), pa.array(mass)], ["lang", "value", "mass"])
        release()

    return judge.asNondeterministic()  # not to be computed twice


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with lang_pred and score; the text alone goes to Python, and the verdict alone comes back."""
    best = fresh(docs, "verdict")
    judged = None
    for block in model.blocks():
        verdict = _judge(docs.sparkSession.sparkContext.broadcast(block))(F.col(text))
        if judged is None:
            judged = docs.withColumn(best, verdict)
            continue
        both = materialize(judged, "judged").withColumn(best + "2", verdict)
        a, b = F.col(best), F.col(best + "2")
        top = F.greatest(a["value"], b["value"])
        mass = a["mass"] * F.exp(a["value"] - top) + b["mass"] * F.exp(b["value"] - top)
        lang = F.when(b["value"] > a["value"], b["lang"]).otherwise(a["lang"])
        judged = both.withColumn(best, F.struct(lang.alias("lang"), top.alias("value"), mass.alias("mass"))).drop(best + "2")
    if judged is None:
        judged = docs.withColumn(best, F.lit(None).cast("struct<lang: string, value: double, mass: double>"))
    lang = F.col(f"{best}.lang")
    added = {"lang_pred": F.coalesce(lang, F.lit("und")), "score": F.when(lang.isNull(), 0.0).otherwise(1 / F.col(f"{best}.mass"))}
    return judged.select(*[c for c in docs.columns if c == text or c not in ADDED], *[v.alias(c) for c, v in added.items() if c != text])
