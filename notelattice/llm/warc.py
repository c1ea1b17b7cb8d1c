"""WARC records, and the Merkle fixity audit of replicas.

`records` turns pages into WARC response records with their archive and offset; `read_warc` reads records of stored
archives (plain or gzip by record) and the ranges that can't be read. `audit` compares two replicas: a leaf is the SHA-256 of one record with its offset;
each level above hashes the ordered digests of `fan_out` neighbouring ranges of offsets, up to one root for each archive,
and archives are grouped in the same way up to a single root. Comparing goes from the roots down: only ranges below a
mismatch are looked at on the next level, and none if the replicas' roots agree. What is shuffled is digests, never
records. There are as many levels as the largest archive needs, so a range gathers at most `fan_out` digests, or the
records of one leaf, whatever an archive's size.

Ranges are cut by the offset: range i of level l holds the offsets from i * leaf * fan_out**l on, so a lost record leaves
a gap in its own range and shifts nothing.

Defined cases: two empty replicas match; a record that only one replica has is `missing` or `extra`; unlike bytes at one
offset are `corrupt`; repeated records at one offset are hashed together in order of their digests, so replicas agree only
if they repeat alike; null payloads are hashed as empty with a mark of their own. Records of any length are hashed whole.
Pages without page_id have archives of their own, as many as their share of the table asks for; repeated page_ids lie in
one archive one after another. An empty table has no archives. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import materialize

LEAF = 1 << 16  # bytes of offsets in a range of the lowest level


def record_bytes(url: Column, payload: Column) -> Column:
    """The bytes of a WARC response record."""
    body = F.coalesce(payload, F.lit("")).cast("binary")
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n")).cast("binary")
    return F.concat(head, body, F.lit("\r\n\r\n").cast("binary"))


def records(pages: DataFrame, per_archive: int = 1000, stored: str = "html") -> DataFrame:
    """archive, offset, page_id, length and digest of each page's record.

    An archive holds `per_archive` consecutive page_ids, in order, so its size is bounded; rows without page_id are spread
    by the record's digest over archives of their own, one for each `per_archive` of them. Offsets follow from html, as in the archive's index; the digest is that
    of the bytes in the column `stored`, which for a replica may differ.
    """
    payload = F.col(stored)
    rows = pages.select(
        "page_id",
        F.octet_length(record_bytes(F.col("url"), F.col("html"))).cast("long").alias("length"),
        F.sha2(F.concat(record_bytes(F.col("url"), payload), F.when(payload.isNull(), F.lit(b"\x00")).otherwise(F.lit(b""))), 256).alias("digest"),
    )
    named = F.concat(F.lit("pages-"), F.floor(F.col("page_id") / per_archive).cast("string"))
    unnamed = pages.where("page_id is null").count() // per_archive + 1
    rows = rows.withColumn("archive", F.coalesce(named, F.concat(F.lit("unnamed-"), F.pmod(F.xxhash64("digest"), F.lit(unnamed)).cast("string"))))
    before = Window.partitionBy("archive").orderBy("page_id", "length", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).select("archive", "offset", "page_id", "length", "digest")


_RECORD = re.compile(rb"WARC/\d+\.\d+\r\n")
_SIZE = re.compile(rb"\d+")
_BEGIN = re.compile(rb"\x1f\x8b\x08|(?<=\n)WARC/")
UNREADABLE = "unreadable"


def _member(data: bytes, at: int, most: int | None = None) -> tuple[bytes, int]:
    """The content of the gzip member at `at`, its checksum confirmed, and where it ends; or only the first `most` bytes."""
    stream, inner, view = zlib.decompressobj(31), [], memoryview(data)
    while not stream.eof:
        part = view[at : at + (1 << 16)]
        if not part:
            raise zlib.error("truncated member")
        inner.append(stream.decompress(part, most or 0))
        at += len(part)
        if most:
            break
    return b"".join(inner), at - len(stream.unused_data)


def _starts(data: bytes, at: int) -> bool:
    """Does a record, plain or in a gzip member, begin here?"""
    if data[at : at + 3] == b"\x1f\x8b\x08":
        try:
            return _RECORD.match(_member(data, at, 16)[0]) is not None
        except zlib.error:
            return False
    return _RECORD.match(data, at) is not None


def _plain(data: bytes, at: int) -> tuple[int, dict[bytes, bytes], bytes] | None:
    """Where the plain record at `at` ends, its fields and its payload; None if it is not whole and well formed."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0 or not _RECORD.match(data, at):
        return None
    lines = data[at:end].split(b"\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in lines)}
    size = fields.get(b"content-length", b"")
    if not _SIZE.fullmatch(size):
        return None
    stop = end + 4 + int(size)
    return (stop + 4, fields, data[end + 4 : stop]) if data[stop : stop + 4] == b"\r\n\r\n" else None


def parse(data: bytes) -> Iterator[tuple[int, int, str, str, bytes | None]]:
    """(offset, length, type, target URI, payload) of all that a stored archive holds; offsets and lengths are those in the file.

    A gzip member is unpacked by itself; records that share one have its place. A range that can't be read (a damaged
    member, a malformed header, a wrong length) is a row of the type `unreadable` without payload, and reading goes on at
    the next place where a record begins. The rows cover the file without gaps.
    """
    at = 0
    while at < len(data):
        found, stop = [], at
        if data[at : at + 2] == b"\x1f\x8b":
            try:
                inner, stop = _member(data, at)
                found = [(kind, uri, payload) for _, _, kind, uri, payload in parse(inner)] if not inner.startswith(b"\x1f\x8b") else []
                found = found or [(UNREADABLE, "", None)]
            except zlib.error:
                pass
        elif record := _plain(data, at):
            stop, fields, payload = record
            found = [(fields.get(b"warc-type", b"").decode("latin-1"), fields.get(b"warc-target-uri", b"").decode("utf-8", "replace"), payload)]
        if not found:
            places = (m.start() for m in _BEGIN.finditer(data, at + 1))
            stop = next((p for p in places if _starts(data, p)), len(data))
            found = [(UNREADABLE, "", None)]
        for kind, uri, payload in found:
            yield at, stop - at, kind, uri, payload
        at = stop


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """archive, offset, length, type, uri, payload and digest (of the stored bytes, headers too) of the records of the archives under path.

    Ranges that can't be read are rows of the type `unreadable`, so that an audit names them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for offset, length, kind, uri, payload in parse(content):
                    digest = hashlib.sha256(memoryview(content)[offset : offset + length]).hexdigest()
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([offset]), pa.array([length]), pa.array([kind]), pa.array([uri]), pa.array([payload], pa.binary()), pa.array([digest])], ["archive", "offset", "length", "type", "uri", "payload", "digest"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "archive string, offset long, length long, type string, uri string, payload binary, digest string")


def _joined(column: str) -> Column:
    return F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(column))), 256)


def depth(rows: DataFrame, fan_out: int, leaf: int = LEAF) -> int:
    """How many times `fan_out` leaves must be grouped until the largest archive of rows is one range."""
    last = rows.agg(F.max("offset").alias("last")).first().last or 0
    levels = 0
    while last // (leaf * fan_out**levels) >= fan_out:
        levels += 1
    return levels


def tree(rows: DataFrame, levels: int, fan_out: int, leaf: int = LEAF) -> list[DataFrame]:
    """Levels of (archive, node, digest): records by offset first, then leaves, then ranges of ranges; the last is the archive."""
    out = [materialize(rows.groupBy("archive", F.col("offset").alias("node")).agg(_joined("digest").alias("digest")), "leaves")]
    for level in range(levels + 2):
        up = F.floor(F.col("node") / (leaf if level == 0 else fan_out)).cast("long")
        entry = F.concat_ws("@", F.lpad(F.hex("node"), 16, "0"), "digest")
        ranges = out[-1].select("archive", up.alias("up"), entry.alias("entry")).groupBy("archive", F.col("up").alias("node"))
        out.append(materialize(ranges.agg(_joined("entry").alias("digest")), "ranges"))  # a level is read again by the next and by the audit
    return out


def root(archives: DataFrame) -> str:
    """One digest for a whole replica from its archives' roots (archive, digest), by way of 65536 groups of archives."""
    entry = F.concat_ws("@", "archive", "digest").alias("entry")
    groups = archives.select(F.substring(F.sha2("archive", 256), 1, 4).alias("g"), entry).groupBy("g").agg(_joined("entry").alias("digest"))
    rows = sorted((r.g, r.digest) for r in groups.collect())
    return hashlib.sha256("|".join(f"{a}@{b}" for a, b in rows).encode()).hexdigest()


def audit(ours: DataFrame, theirs: DataFrame, fan_out: int = 16) -> DataFrame:
    """archive, offset and status (corrupt, missing, extra) of what the replica `theirs` has other than `ours`.

    Both have archive, offset and digest. The roots of the replicas are compared first, then those of the archives; a
    level's nodes are read only below the mismatching nodes of the level above.
    """
    sides = [x.select("archive", "offset", "digest") for x in (ours, theirs)]
    levels = max(depth(x, fan_out) for x in sides)
    trees = [tree(x, levels, fan_out) for x in sides]
    top = [t[-1].select("archive", "digest") for t in trees]
    if root(top[0]) == root(top[1]):
        return sides[0].where("false").select("archive", "offset", F.lit("").alias("status"))
    suspects = None
    for level in range(levels + 2, -1, -1):
        a, b = (t[level] for t in trees)
        if suspects is not None:
            up = F.floor(F.col("node") / (LEAF if level == 0 else fan_out)).cast("long")
            a, b = (x.withColumn("up", up).join(suspects, ["archive", "up"], "left_semi").drop("up") for x in (a, b))
        both = a.withColumnRenamed("digest", "a").join(b.withColumnRenamed("digest", "b"), ["archive", "node"], "full").where("not (a <=> b)")
        both = materialize(both, "mismatches")
        suspects = both.select("archive", F.col("node").alias("up"))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("corrupt")
    return both.select("archive", F.col("node").alias("offset"), status.alias("status"))
