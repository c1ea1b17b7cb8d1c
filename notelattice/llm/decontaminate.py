"""Benchmark decontamination by pigeonhole edit matching.

A test item of m normalised characters may differ by k = floor(m * error_rate) edits. Split into k + 1 pieces, at least
one piece of it must occur unchanged in any such copy. All pieces of a block of items are searched for at once (an
Aho-Corasick automaton built from the broadcast block), and each hit is verified over the one window of the text that it
allows, with Myers's bit-parallel edit distance. The distinct (item_id, text) are dealt into blocks by hash, as many as
keep a block to about `block` items and `block_chars` characters; each block is searched for in all documents, so what is
broadcast stays bounded however large the benchmark is, and no item is left out.

Normalising: lower case, every run of other than letters, digits and marks becomes one space, trimmed. Items of every size
keep one rule for word borders: an item is looked for with a space on either side, in the text with a space on either side,
and these spaces may be edited like all other characters. An item too short for an edit (k = 0) must thus occur as it is, on
word borders; an item without a letter or digit matches nothing.

Defined cases: null or empty texts and items match nothing; repeated rows of documents each give their matches, repeated
rows of the benchmark are one item; an item found several times in a text gives its best match (smallest distance, then
earliest); items that share an item_id each give theirs; any text is searched whole; empty tables give an empty result.
Extra columns are ignored by `matches` and kept by `clean`, whatever their names; `clean` judges each row by its own text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import release
from .storage import fresh, materialize

_OTHER = re.compile(r"[\W_]+")


def normalize(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def pieces_of(item: str, k: int) -> tuple[int, list[tuple[int, str]]]:
    """The error budget of an item, and its pieces with their places."""
    cut = [len(item) * i // (k + 1) for i in range(k + 2)]
    return k, [(a, item[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def masks_of(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """The least edit distance of the pattern to a part of text, and where the first such part ends."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        pv = ((mh << 1) & full) | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Finder:
    """The automaton of a block of items."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        import ahocorasick

        self.items: list[tuple[int, str, int]] = []
        self.masks: dict[int, tuple[dict[str, int], dict[str, int]]] = {}
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            norm = normalize(text or "")
            if not norm:
                continue
            k, pieces = pieces_of(f" {norm} ", int(len(norm) * error_rate))
            number = len(self.items)
            self.items.append((item_id, f" {norm} ", k))
            for at, piece in pieces:
                places.setdefault(piece, []).append((number, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), tuple(where)))
        if places:
            self.automaton.make_automaton()

    def _masks(self, number: int) -> tuple[dict[str, int], dict[str, int]]:
        if number not in self.masks:
            item = self.items[number][1]
            self.masks[number] = (masks_of(item), masks_of(item[::-1]))
        return self.masks[number]

    def find(self, text: str, first: bool = False) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, begin, end) in the normalised text, the best match of each item; with `first`, one match of any."""
        if not self.items or not text:
            return []
        text = f" {text} "
        best: dict[int, tuple[int, int, int]] = {}
        done: dict[int, set[int]] = {}
        for end, (length, where) in self.automaton.iter(text):
            for number, at in where:
                item_id, item, k = self.items[number]
                begin = end + 1 - length - at  # where the item would begin without insertions or deletions before the piece
                seen = done.setdefault(number, set())
                if begin in seen:
                    continue
                seen.add(begin)
                if number in best and best[number][0] == 0:
                    continue
                m = len(item)
                if begin >= 0 and text.startswith(item, begin):
                    found = (0, begin, begin + m)
                elif k == 0:
                    continue
                else:
                    low = max(0, begin - k)
                    masks, backward = self._masks(number)
                    distance, stop = myers(masks, m, text[low : begin + m + k])
                    if distance > k:
                        continue
                    stop += low
                    head = text[max(0, stop - m - k) : stop]
                    _, back = myers(backward, m, head[::-1])
                    found = (distance, stop - back, stop)
                if number not in best or found < best[number]:
                    best[number] = found
                if first:
                    return [(item_id, *found)]
        return [(self.items[i][0], d, a + (text[a] == " ") - 1, b - (text[b - 1] == " ") - 1) for i, (d, a, b) in sorted(best.items())]


def blocks(benchmark: DataFrame, block: int, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The distinct items, dealt by hash into blocks: a block is all that the driver holds."""
    items = benchmark.where("text is not null and item_id is not null").select("item_id", "text").distinct()
    n, chars = items.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    parts = max(-(-n // block), -(-(chars or 0) // block_chars))
    if parts > 1:
        items = materialize(items, "items")
    for part in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        got = sorted((r.item_id, r.text) for r in own.collect())
        if got:
            yield got


RESULT = "doc_id long, item_id long, distance int, begin int, end int"


def matches(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.08, block: int = 20_000, block_chars: int = 1 << 23) -> DataFrame:
    """doc_id, item_id, distance, begin, end (in the normalised text) of each item found in each document."""
    context, out = docs.sparkSession.sparkContext, None
    for got in blocks(benchmark, block, block_chars):
        found = _search(docs, context.broadcast(got), error_rate)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], RESULT) if out is None else out


_KEPT: list = []  # the block that a worker has seen last, and its automaton


def _finder(shared, error_rate: float) -> Finder:
    if not _KEPT or _KEPT[0] is not shared.value:
        _KEPT[:] = [shared.value, Finder(shared.value, error_rate)]
    return _KEPT[1]


def _search(docs: DataFrame, shared, error_rate: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(shared, error_rate)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    rows += [(doc_id, *x) for x in finder.find(normalize(text))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()], strict=True)], ["doc_id", "item_id", "distance", "begin", "end"])
        release()

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


def _dirty(shared, error_rate: float):
    @F.arrow_udf("boolean")
    def dirty(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = _finder(shared, error_rate)
        for texts in batches:
            yield pa.array([bool(t) and bool(finder.find(normalize(t), first=True)) for t in texts.to_pylist()], pa.bool_())
        release()

    return dirty.asNondeterministic()  # not to be computed twice


def clean(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.08, block: int = 20_000, block_chars: int = 1 << 23) -> DataFrame:
    """docs without the rows whose text holds a benchmark item. Only texts go to Python and only verdicts come back."""
    context, kept = docs.sparkSession.sparkContext, docs
    for got in blocks(benchmark, block, block_chars):
        verdict = fresh(docs, "dirty")
        kept = kept.withColumn(verdict, _dirty(context.broadcast(got), error_rate)(F.col("text"))).where(~F.col(verdict)).drop(verdict)
    return kept
