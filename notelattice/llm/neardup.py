"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard verification.

Two permutations make every signature coordinate: the first (sigma) maps a shingle to a position in a circle of
2**CIRCLE positions; coordinate k is the least value of the second permutation (pi), shifted by k, over the positions of
the document's shingles. Bands of coordinates are hashed; documents that share a band are candidates.

Plan. (1) One Arrow pass over the texts gives each document its set size, a 128-bit fingerprint of the whole set and its
band keys. (2) Documents with equal sets collapse to a class (a node), so that copies never meet in a bucket. (3) Nodes are
grouped by band key with partial aggregation: only counts and the most popular member of each bucket are kept, never a
list. (4) Each member is compared with that pivot; pairs are distinct, so a group of n near copies costs about n pairs.
(5) Members of a bucket that are still in different components may be linked all the same. In a bucket of at most
SMALL_BUCKET members they are compared pair by pair, as far as sizes and distances to the pivot (Jaccard distance is a
metric) allow; in a larger one by prefix filtering of their differences from a reference (`close_pairs`), which is exact as
well. All pivots of one component share one reference, so a member is taken once and not once for each of its pivots. No
link is lost to the choice of pivots or references. (6) Every pair is confirmed on the full sets of shingle hashes.
(7) Components come from min-label propagation with hooking and pointer jumping over the confirmed links.

Tables that are joined on a key that may be hot (a group of copies, a pivot) are written first, so that both sides of the
join are plain exchanges, which adaptive execution splits; a pivot's set is repeated for each few hundred partners.

Defined cases: a null text, an empty one or one without words has an empty set and links with nothing; a text with fewer
words than a shingle is one shingle; texts of any length are taken whole. Ties and repeated rows: equal texts are linked,
doc_id decides what stays. A row without doc_id has no component and is always kept; it makes no other row
its copy. Rows that share a doc_id are judged each by its own text; `deduplicate` keeps repeated rows once. An empty table
gives an empty result. Extra columns, whatever their names, are ignored by `components` and kept by `deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import U64, chunks, mix, release, shingle_hashes, word_hashes
from .storage import fresh, materialize

CIRCLE = 18
ROWS = 6  # coordinates of a band
SMALL_BUCKET = 32  # members of a bucket that are compared pair by pair
MISS = 1e-6  # the greatest probability that a pair at the threshold shares no band


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """The least number of bands of `rows` coordinates that miss a pair at the threshold with at most this probability."""
    return int(np.ceil(np.log(miss) / np.log(1 - threshold**rows)))


_PI: list[np.ndarray] = []


def _pi(length: int) -> np.ndarray:
    """The second permutation, continued past the end of the circle so that shifts need no modulo."""
    if not _PI or len(_PI[0]) < (1 << CIRCLE) + length:
        pi = np.random.default_rng(20).permutation(1 << CIRCLE).astype(np.uint32)
        _PI[:] = [np.concatenate([pi, pi[: max(length, 256)]])]
    return _PI[0]


def signatures(shingles: np.ndarray, off: np.ndarray, length: int) -> np.ndarray:
    """rows x length coordinates; rows with an empty set hold the largest value."""
    n = np.diff(off)
    full = np.flatnonzero(n > 0)
    out = np.full((len(n), length), 0xFFFFFFFF, np.uint32)
    if not len(full):
        return out
    pi, at = _pi(length), (shingles >> U64(64 - CIRCLE)).astype(np.int64)
    starts = off[:-1][full]
    for k in range(length):
        out[full, k] = np.minimum.reduceat(pi[k:][at], starts)
    return out


def distinct_by_row(shingles: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes in order, and their offsets."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((shingles, row))
    shingles, row = shingles[order], row[order]
    first = np.ones(len(row), bool)
    first[1:] = (shingles[1:] != shingles[:-1]) | (row[1:] != row[:-1])
    return shingles[first], np.searchsorted(row[first], np.arange(len(off)))


def _prints(sets: np.ndarray, off: np.ndarray) -> list[str | None]:
    """A 128-bit fingerprint of each row's set, with its size; None for an empty set."""
    n = np.diff(off)
    sums = [np.concatenate([np.zeros(1, U64), np.cumsum(x)]) for x in (mix(sets + U64(1)), mix(sets ^ U64(0xABCDEF)))]
    pairs = np.stack([s[off[1:]] - s[off[:-1]] for s in sums], axis=1)
    return [f"{a:016x}{b:016x}{c:x}" if c else None for (a, b), c in zip(pairs.tolist(), n.tolist(), strict=True)]


def sketches(docs: DataFrame, size: int, rows: int, bands: int) -> DataFrame:
    """doc_id, text_key, n_shingles, fingerprint and bands (array of longs) of each row of docs (doc_id, text_key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                sets, off = distinct_by_row(*shingle_hashes(*word_hashes(chunk, lower=True), size))
                n = np.diff(off)
                signature = signatures(sets, off, rows * bands).astype(U64)
                keys = np.zeros((len(n), bands), U64)
                for j in range(rows):
                    keys = mix(keys * U64(31) + signature[:, j::rows] + U64(7))
                keys = mix(keys + np.arange(bands, dtype=U64) * U64(0x9E3779B97F4A7C15))
                keys_off = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(keys_off), pa.array(keys[n > 0].ravel().view(np.int64)))
                part = batch.slice(chunk.start, len(chunk))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(_prints(sets, off), pa.string()), lists], ["doc_id", "text_key", "n_shingles", "fingerprint", "bands"])
        release()

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, "doc_id long, text_key long, n_shingles long, fingerprint string, bands array<long>")


def shingle_sets(rows: DataFrame, size: int) -> DataFrame:
    """node, alone and the sorted distinct shingle hashes (array of longs) of the rows (node, alone, fingerprint, text) whose text has that fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(3)):
                sets, off = distinct_by_row(*shingle_hashes(*word_hashes(chunk, lower=True), size))
                part = batch.slice(chunk.start, len(chunk))
                own = pa.array([a == b for a, b in zip(_prints(sets, off), part.column(2).to_pylist(), strict=True)], pa.bool_())
                out = pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(sets.view(np.int64)))], ["node", "alone", "shingles"])
                yield out.filter(own)
        release()

    return rows.select("node", "alone", "fingerprint", "text").mapInArrow(run, "node long, alone boolean, shingles array<long>")


def with_sets(pairs: DataFrame, sets: DataFrame, group: int = 500) -> DataFrame:
    """pairs (a, b) with both sets, left_set and right_set.

    b may be the same for very many a: its set is repeated for each `group` of them and the join is on (b, part), so no
    task gets more than about `group` pairs of one b.
    """
    spread = materialize(pairs.groupBy("b").agg(F.expr(f"cast(count(1) div {group} as int) + 1").alias("parts")), "parts")
    right = spread.join(sets.withColumnRenamed("node", "b"), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("shingles").alias("right_set"))
    left = pairs.join(spread, "b").select("a", "b", F.expr("cast(pmod(xxhash64(a), parts) as int)").alias("part"))
    left = left.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left_set")), "a")
    return left.join(right, ["b", "part"]).select("a", "b", "left_set", "right_set")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) with n_both, the size of the intersection, n_any, that of the union, n_a, and linked."""
    both = F.size(F.array_intersect("left_set", "right_set")).cast("long")
    out = with_sets(pairs, sets).select("a", "b", both.alias("n_both"), F.size("left_set").cast("long").alias("n_a"), F.size("right_set").cast("long").alias("n_b"))
    return out.select("a", "b", "n_both", F.expr("n_a + n_b - n_both").alias("n_any"), "n_a").withColumn("linked", F.expr(f"100 * n_both >= {percent} * n_any"))


def close_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of members (a, ref, component, ref_component) of one reference whose sets may be linked though their components differ.

    Let D be the symmetric difference of a member's set and the reference's, and c = (1 - t) / (1 + t). Two sets are linked
    only if they differ in at most c * (|a| + |b|) shingles, hence only if their D have at least (u_a + u_b) / 2 elements in
    common, with u = |D| - c * |set|. That is at least one, unless both are linked to the reference: such members are
    given as pairs with it. Two D with o common elements share one among the |D| - o + 1 rarest of each (prefix filtering),
    so members meet by equi-joins on rare elements; elements that all members of one component, or a single member, have to
    themselves can't join two components and are left out. Classes of u keep prefixes short; the pair's own o is then
    applied to the places. Nothing is estimated and nothing lost.
    """
    t = percent / 100
    c = (1 - t) / (1 + t)
    pairs = members.where("a <> ref").select("a", F.col("ref").alias("b")).distinct()
    apart = F.concat(F.array_except("left_set", "right_set"), F.array_except("right_set", "left_set"))
    width = F.greatest(F.lit(1.0), F.size("right_set") * (2 * c))
    sizes = [(F.size(apart) - c * F.size("left_set")).alias("u"), (F.size(apart) <= c * (F.size("left_set") + F.size("right_set")) + 1e-6).alias("by_ref"), width.alias("width")]
    differ = with_sets(pairs, sets).select("a", F.col("b").alias("ref"), apart.alias("d"), *sizes)
    differ = materialize(differ.withColumn("own", F.floor(F.col("u") / F.col("width") + 1e-9)).join(members, ["a", "ref"]), "differences")
    direct = differ.where("by_ref and component <> ref_component").select(F.least("a", "ref").alias("a"), F.greatest("a", "ref").alias("b"))
    classes = differ.groupBy("ref").agg(F.collect_set("own").alias("classes"))  # a few dozen numbers: |D| <= |a| + |b|
    flat = differ.select("ref", "a", "component", F.explode("d").alias("e"))
    shared = flat.groupBy("ref", "e").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("ref", "e", "n")
    shared = materialize(shared, "shared")
    order = flat.select("ref", "a", "e").join(shared, ["ref", "e"]).groupBy("ref", "a").agg(F.array_sort(F.collect_list(F.struct("n", "e"))).alias("ordered"))
    known = differ.select("ref", "a", "component", "u", "width", "own").join(order, ["ref", "a"]).join(classes, "ref")
    asked = known.select("ref", "a", "component", "own", "u", "width", "ordered", F.explode("classes").alias("other"))
    need = F.greatest(F.lit(1), F.ceil((F.col("u") + F.col("other") * F.col("width")) / 2 - 1e-6))
    prefix = F.slice("ordered", 1, F.greatest(F.lit(0), F.size("ordered") - need + 1).cast("int"))
    kept = ["ref", "a", "component", "own", "other", "u", F.size("ordered").alias("m")]
    keyed = asked.select(*kept, F.posexplode(prefix).alias("at", "x")).select("ref", "a", "component", "own", "other", "u", "m", "at", F.col("x.e").alias("e"))
    keyed = materialize(keyed, "prefixes")
    mate = keyed.select("ref", F.col("a").alias("b"), F.col("component").alias("c_b"), F.col("own").alias("other"), F.col("other").alias("own"), F.col("u").alias("u_b"), F.col("m").alias("m_b"), F.col("at").alias("at_b"), "e")
    common = "greatest(1, ceil((u + u_b) / 2 - 1e-6))"  # of this very pair: what is left behind the place must suffice
    met = keyed.join(mate, ["ref", "e", "own", "other"]).where(f"a < b and component <> c_b and at <= m - {common} and at_b <= m_b - {common}")
    return met.select("a", "b").union(direct).distinct()


def label(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node of links (a, b).

    Each round a node takes the least label of its neighbours, hands it to the node its own label names (hooking, so whole
    trees join, not nodes one by one), and then takes the label of its label. Rounds grow with the logarithm of a chain's
    length; they end when nothing changes, and then all nodes of a component have one label, that of its smallest node.
    """
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    nodes = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        near = edges.join(nodes.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        moved = materialize(nodes.join(near, "node").select("node", "component", F.least("component", "near").alias("next")), "moved")
        hooks = moved.where("next < component").groupBy(F.col("component").alias("node")).agg(F.min("next").alias("hook"))
        hooked = moved.join(hooks, "node", "left").select("node", "component", F.least("next", "hook").alias("next"))
        jump = hooked.select(F.col("node").alias("next"), F.col("next").alias("beyond"))
        after = materialize(hooked.join(jump, "next").select("node", F.least("next", "beyond").alias("component"), (F.least("next", "beyond") < F.col("component")).alias("changed")), "labels")
        nodes = after.select("node", "component")
        if not after.where("changed").limit(1).count():
            return nodes


def text_key(text: str = "text") -> Column:
    """Tells the texts of rows that share a doc_id apart."""
    return F.xxhash64(F.col(text), F.col(text).isNull())


def _components(docs: DataFrame, size: int, percent: int, rows: int) -> DataFrame:
    """doc_id, text_key, n_shingles and component_id of each row of docs (doc_id, text)."""
    threshold = percent / 100
    bands = bands_for(threshold, rows)
    docs = docs.select("doc_id", "text")
    sketch = materialize(sketches(docs.withColumn("text_key", text_key()), size, rows, bands), "sketches")
    # equal sets have equal bands and sizes, so any row of a class tells them
    classes = sketch.where("fingerprint is not null and doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), (F.count(F.lit(1)) == 1).alias("alone"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    in_bands = classes.select("node", "n_shingles", F.explode("bands").alias("band"))
    shared = in_bands.groupBy("band").agg(F.count(F.lit(1)).alias("n_in")).where("n_in > 1")
    buckets = materialize(in_bands.join(shared, "band"), "buckets")  # only bands that several classes share
    # a member's popularity: with how many others it shares its bands; the source of a group of copies has the most
    popular = buckets.groupBy("node").agg(F.sum("n_in").alias("popularity"))
    ranked = buckets.join(popular, "node")
    pivots = materialize(ranked.groupBy("band").agg(F.max_by("node", F.struct("popularity", -F.col("node"))).alias("pivot")), "pivots")
    starred = materialize(buckets.join(pivots, "band").select("band", "node", "n_shingles", "n_in", "pivot"), "starred")
    star = starred.select(F.col("node").alias("a"), F.col("pivot").alias("b")).where("a <> b").distinct()
    involved = classes.select("node", "alone", "fingerprint", F.col("rep").alias("doc_id")).join(buckets.select("node").distinct(), "node", "left_semi")
    found = materialize(shingle_sets(docs.join(involved, "doc_id"), size), "sets")
    # a class of several rows may have its representative's row repeated
    again = materialize(found.where("not alone").dropDuplicates(["node"]), "sets")
    sets = found.where("alone").unionByName(again).select("node", "shingles")
    first = materialize(verify(star, sets, percent), "verified")
    links = first.where("linked").select("a", "b")
    labels = label(links)
    # what is still apart in a bucket: all pairs that the sizes and the distances to the pivot do not rule out
    apart = starred.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_bands = apart.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band")
    far = first.select(F.col("a").alias("node"), F.col("b").alias("pivot"), F.expr("1 - n_both / n_any").alias("far"))
    open_rows = materialize(apart.where("node <> pivot").join(open_bands, "band", "left_semi").join(far, ["node", "pivot"]).select("band", "node", "pivot", "n_shingles", "n_in", "component", "far"), "open")
    one = open_rows.where(f"n_in <= {SMALL_BUCKET}")
    other = one.select("band", F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("component").alias("c_b"), F.col("far").alias("far_b"))
    direct = one.join(other, "band").where(f"node < b and component <> c_b and abs(far - far_b) <= {1 - threshold} + 1e-9 and 100 * least(n_shingles, n_b) >= {percent} * greatest(n_shingles, n_b)").select(F.col("node").alias("a"), "b")
    large = open_rows.where(f"n_in > {SMALL_BUCKET}").select("node", "pivot", "component").distinct()
    # one reference for all pivots of a component: that with the most members
    used = large.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).join(labels.withColumnRenamed("node", "pivot"), "pivot", "left").withColumn("ref_component", F.coalesce("component", "pivot"))
    refs = used.groupBy("ref_component").agg(F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("ref"))
    refs = materialize(used.select("pivot", "ref_component").join(refs, "ref_component"), "references")
    members = materialize(large.join(refs, "pivot").select(F.col("node").alias("a"), "ref", "component", "ref_component").distinct(), "members")
    rest = materialize(direct.union(close_pairs(members, sets, percent)).distinct(), "rest")
    second = verify(rest, sets, percent).where("linked").select("a", "b")
    links = materialize(links.union(second).distinct(), "links")
    named = materialize(classes.select("node", "fingerprint", "rep").join(label(links), "node", "left"), "labelled")
    least = materialize(named.where("component is not null").groupBy("component").agg(F.min("rep").alias("least")), "least")
    named = named.join(least, "component", "left").select("fingerprint", F.coalesce("least", "rep").alias("component_id"))
    named = materialize(named, "named")
    with_class = F.expr("fingerprint is not null and doc_id is not null")
    rows_of = sketch.select("doc_id", "text_key", "n_shingles", "fingerprint")
    joined = rows_of.where(with_class).join(named, "fingerprint").select("doc_id", "text_key", "n_shingles", "component_id")
    return joined.unionByName(rows_of.where(~with_class).select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id")))


def components(docs: DataFrame, size: int = 5, percent: int = 80, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs."""
    return _components(docs, size, percent, rows).select("doc_id", "n_shingles", "component_id", F.expr("doc_id is null or doc_id = component_id").alias("kept"))


def deduplicate(docs: DataFrame, size: int = 5, percent: int = 80, rows: int = ROWS) -> DataFrame:
    """docs, with one document of each component: that with the smallest doc_id, once if the row is repeated.

    If rows of unlike texts share that doc_id, the one with the smallest text hash stays."""
    key = fresh(docs, "text_key")
    found = _components(docs, size, percent, rows).where("doc_id = component_id").groupBy("doc_id").agg(F.min("text_key").alias(key))
    named = docs.where("doc_id is not null").withColumn(key, text_key())
    kept = named.join(found, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key]).drop(key)
    return kept.unionByName(docs.where("doc_id is null"))
