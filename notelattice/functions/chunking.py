"""Chunks of search rows for embedding: boundaries at headings and bullets, windows for what is too long."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import slices, text_sizes

SIZE, OVERLAP = 900, 120
_HEADING, _BULLET = re.compile(r"\s*#{1,6}\s"), re.compile(r"[-*] ")


def source_text(title: Column, permalink: Column, kind: Column, snippet: Column) -> Column:
    """What is embedded of a search row: its non-empty parts between blank lines."""
    return F.array_join(F.filter(F.array(title, permalink, kind, snippet), lambda p: p.isNotNull() & (p != "")), "\n\n")


def windows(text: Column) -> Column:
    """Windows of SIZE characters that overlap by OVERLAP, as an array: the native form for texts without structure."""
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - OVERLAP - 1), F.lit(SIZE - OVERLAP))
    return F.when(n > 0, F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(SIZE)))).otherwise(F.array().cast("array<string>"))


def _cut(text: str) -> list[str]:
    text = text.strip()
    starts = range(0, max(1, len(text) - OVERLAP), SIZE - OVERLAP)
    return [c for c in (text[s : s + SIZE].strip() for s in starts) if c]


def _groups(lines: list[str], begins) -> list[str]:
    """Lines joined into blocks; a line that begins one closes the block before."""
    blocks: list[list[str]] = []
    for line in lines:
        if not blocks or begins(line):
            blocks.append([line])
        else:
            blocks[-1].append(line)
    return ["\n".join(b).strip() for b in blocks]


class _Packer:
    """Fills chunks up to SIZE characters with parts between blank lines."""

    def __init__(self):
        self.done: list[str] = []
        self.open = ""

    def flush(self) -> None:
        if self.open:
            self.done.append(self.open)
        self.open = ""

    def add(self, part: str) -> None:
        joined = f"{self.open}\n\n{part}" if self.open else part
        if len(joined) > SIZE:
            self.flush()
            joined = part
        self.open = joined


def _long(section: str) -> list[str]:
    pack = _Packer()
    for paragraph in section.split("\n\n"):
        lines = paragraph.strip().split("\n")
        parts = _groups(lines, _BULLET.match) if any(_BULLET.match(x) for x in lines) else ["\n".join(lines)]
        for part in parts:
            if len(part) > SIZE:
                pack.flush()
                pack.done += _cut(part)
            elif part:
                pack.add(part)
    pack.flush()
    return pack.done


def split(text: str) -> list[str]:
    """The chunks of a text: sections are merged up to SIZE; a bullet is a chunk; the last piece of a long section stays open."""
    text = text.strip().replace("\r\n", "\n")
    if not text:
        return []
    pack = _Packer()
    for section in _groups(text.split("\n"), lambda x: _HEADING.match(x) or _BULLET.match(x)):
        if len(section) > SIZE:
            pack.flush()
            *whole, last = _long(section) or [""]
            pack.done += whole
            pack.open = last
        elif _BULLET.match(section):
            pack.flush()
            pack.done.append(section)
        else:
            pack.add(section)
    pack.flush()
    return [c for c in pack.done if c.strip()]


def chunk_records(rows: DataFrame) -> DataFrame:
    """(chunk_key, type, id, chunk_text, source_hash) of search rows (type, id, title, permalink, category, relation_type, content_snippet)."""
    source = rows.select("type", "id", source_text(F.col("title"), F.col("permalink"), F.coalesce("category", "relation_type"), F.col("content_snippet")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_sizes(2)):
            out = [(f"{t}:{i}:{k}", t, i, c, hashlib.sha256(c.encode()).hexdigest()) for t, i, text in zip(*(part.column(j).to_pylist() for j in range(3)), strict=True) for k, c in enumerate(split(text or ""))]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()], strict=True)], ["chunk_key", "type", "id", "chunk_text", "source_hash"])
            del part, out, columns

    return source.mapInArrow(run, "chunk_key string, type string, id long, chunk_text string, source_hash string")


def fingerprint(chunks: DataFrame, by: str) -> DataFrame:
    """SHA-256 over the sorted [chunk_key, source_hash] pairs of each entity."""
    pair = F.concat(F.lit('["'), F.col("chunk_key"), F.lit('","'), F.col("source_hash"), F.lit('"]'))
    joined = F.array_join(F.array_sort(F.collect_list(pair)), ",")
    return chunks.groupBy(by).agg(F.sha2(F.concat(F.lit("["), joined, F.lit("]")), 256).alias("entity_fingerprint"))
