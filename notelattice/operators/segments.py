"""Tables and a text index kept as immutable segments, with a manifest for every version.

A pass over changed notes writes one segment: the new rows of these notes, their postings, and `gone`, the entities whose
rows in earlier segments are dead from now on. What is alive is the union of all segments without the rows whose owner a
later segment names: an anti-join on ids and the segment's place. Numbers that a search needs of the whole table (rows, sum
of sizes) add up over segments, less those of the dead, and stand in the manifest. Segments of like size are merged, so
there are about as many as the logarithm of the rows, and a row is rewritten as often.

A manifest names its segments; it is one small file, written under a number that must be free. Readers take the newest, so
they see one version; a second writer of the same number fails. It also holds the last batch that each stream has applied:
a replayed batch changes nothing, and what a writer left behind before its manifest was there is in no version.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import Files
from . import fulltext

#: By table, the column that names the entity a row belongs to.
OWNER = {"entity": "id", "observation": "entity_id", "relation": "from_id", "search_index": "entity_id", "text/sizes": "owner", "text/postings": "owner"}
LIKE = 4  # segments within this factor are of like size, and so many of them are merged
KEPT = 3  # versions that stay readable


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)

    # -- versions

    def manifest(self) -> dict | None:
        names = [n for n in self.files.names("manifests") if n.endswith(".json")]
        return json.loads(self.files.read(f"manifests/{names[-1]}")) if names else None

    def commit(self, manifest: dict) -> dict:
        """The manifest as the next version; FileExistsError if another writer was first."""
        manifest = manifest | {"version": manifest.get("version", 0) + 1}
        self.files.claim(f"manifests/{manifest['version']:012d}.json", json.dumps(manifest))
        return manifest

    def vacuum(self) -> list[str]:
        """Deletes what none of the last versions needs; returns what went."""
        names = [n for n in self.files.names("manifests") if n.endswith(".json")]
        kept = [json.loads(self.files.read(f"manifests/{n}")) for n in names[-KEPT:]]
        used = {s["name"] for m in kept for s in m["segments"]} | {m["skipped"] for m in kept}
        gone = [n for n in self.files.names("") if n.startswith(("segment-", "skipped-")) and n not in used]
        gone += [f"manifests/{n}" for n in names[:-KEPT]]
        for name in gone:
            self.files.delete(name)
        return gone

    def new_name(self, kind: str = "segment") -> str:
        return f"{kind}-{uuid.uuid4().hex}"

    # -- reading

    def read(self, segment: str, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{segment}/{table}")

    def table(self, name: str, segments: list[dict] | None = None) -> DataFrame:
        """The rows that are alive; KeyError before the first version."""
        if segments is None:
            manifest = self.manifest()
            if manifest is None:
                raise KeyError("the project is not indexed yet")
            segments = manifest["segments"]
        later = [(s["name"], k) for k, s in enumerate(segments) if k and s["gone"]]
        gone = reduce(DataFrame.unionByName, [self.read(s, "gone").select(F.col("id").alias("__gone"), F.lit(k).alias("__by")) for s, k in later]) if later else None
        parts = []
        for k, segment in enumerate(segments):
            rows = self.read(segment["name"], name)
            if gone is not None and any(by > k for _, by in later):
                dead = gone.where(F.col("__by") > k).select("__gone").distinct()
                rows = rows.join(dead, rows[OWNER[name]] == dead["__gone"], "left_anti")
            parts.append(rows)
        return reduce(lambda a, b: a.unionByName(b), parts)

    def index(self) -> fulltext.Index:
        """The full-text index of the newest version."""
        manifest = self.manifest()
        if manifest is None:
            raise KeyError("the project is not indexed yet")
        n, size = manifest["n_rows"], manifest["size"]
        stats = self.spark.range(1).select(F.lit(n).cast("long").alias("n_rows"), F.lit(size / n if n else None).cast("double").alias("avg_d"))
        return fulltext.Index(self.table("text/postings", manifest["segments"]), self.table("text/sizes", manifest["segments"]), stats)

    # -- writing

    def write(self, segment: str, tables: dict[str, DataFrame]) -> None:
        for name, rows in tables.items():
            rows.write.parquet(f"{self.path}/{segment}/{name}")

    def seal(self, segment: str) -> dict:
        """Writes the text index of the segment's search rows; what its manifest says of it."""
        fulltext.write_index(self.read(segment, "search_index"), f"{self.path}/{segment}/text")
        n, size = self.read(segment, "text/sizes").agg(F.count(F.lit(1)), F.coalesce(F.sum("d"), F.lit(0))).first()
        return {"name": segment, "rows": n, "size": size, "gone": self.read(segment, "gone").count()}

    def append(self, manifest: dict | None, segment: str, more: dict) -> dict:
        """A version with one more segment, then merged if there are many of like size."""
        before = manifest or {"segments": [], "n_rows": 0, "size": 0}
        sealed, n, size = self.seal(segment), 0, 0
        if before["segments"] and sealed["gone"]:
            sizes, gone = self.table("text/sizes", before["segments"]), self.read(segment, "gone").select(F.col("id").alias("owner")).distinct()
            n, size = sizes.join(gone, "owner", "left_semi").agg(F.count(F.lit(1)), F.coalesce(F.sum("d"), F.lit(0))).first()
        made = before | more | {"segments": [*before["segments"], sealed], "n_rows": before["n_rows"] - n + sealed["rows"], "size": before["size"] - size + sealed["size"]}
        return self.commit(self.merged(made))

    def merged(self, manifest: dict) -> dict:
        """The manifest with its last segments of like size as one, if there are LIKE of them or more."""
        segments = manifest["segments"]
        first = len(segments) - 1
        while first and segments[first - 1]["rows"] <= LIKE * max(s["rows"] for s in segments[first:]):
            first -= 1
        own = segments[first:]
        if len(own) < LIKE:
            return manifest
        name = self.new_name()
        fulltext.write_postings(self.table("text/postings", own), f"{self.path}/{name}/text/postings")
        self.write(name, {t: self.table(t, own) for t in OWNER if t != "text/postings"} | {"gone": reduce(DataFrame.unionByName, [self.read(s["name"], "gone") for s in own]).distinct() if first else self.read(own[0]["name"], "gone").limit(0)})
        n, size = self.read(name, "text/sizes").agg(F.count(F.lit(1)), F.coalesce(F.sum("d"), F.lit(0))).first()
        return manifest | {"segments": [*segments[:first], {"name": name, "rows": n, "size": size, "gone": self.read(name, "gone").count()}]}
