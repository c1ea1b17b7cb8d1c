"""The watch stream: events of files are debounced by path, paired into moves, and applied to the index.

An event is pending until its path has been quiet for the window; the newest event of a path wins. In event time that is a
session window: a session ends when the watermark passes its last event by the gap, so events in order give what a
wall-clock debouncer gives. State is bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import indexing

# Patterns that the watcher ignores by default.
IGNORED = """.* *.db *.db-shm *.db-wal config.json .git .svn __pycache__ *.pyc *.pyo *.pyd .pytest_cache .coverage *.egg-info .tox .mypy_cache .ruff_cache
.venv venv env .env node_modules build dist .cache .idea .vscode .DS_Store Thumbs.db desktop.ini .obsidian *.tmp *.swp *.swo *~""".split()


def patterns_of(text: str | None) -> list[str]:
    """The default patterns and those of an ignore file, one a line, without blank lines and comments."""
    own = [line.strip() for line in (text or "").splitlines()]
    return [*IGNORED, *(p for p in own if p and not p.startswith("#"))]


def ignored(path: Column, patterns: tuple[str, ...] | list[str] = IGNORED) -> Column:
    """Does a glob match the path or any part of it? A trailing slash names a part as well."""
    any_of = "|".join(T.glob_to_regex(p.rstrip("/"), strict=True).replace("(?s)^", "").rstrip("$") for p in patterns)
    whole = f"(?s)^(?:{any_of})$"
    return F.exists(F.split(path, "/"), lambda p: p.rlike(whole)) | path.rlike(whole)


def map_kind(kind: Column) -> Column:
    """Kinds of the file system's events as created, modified or deleted; both halves of a rename count."""
    low = F.lower(kind)
    return F.when(low.isin("create", "created", "rename_to", "moved_to"), "created").when(low.isin("modify", "modified", "write", "rename_any"), "modified").when(low.isin("remove", "removed", "delete", "deleted", "rename_from", "moved_from"), "deleted")


def relevant(events: DataFrame, patterns: tuple[str, ...] | list[str] = IGNORED) -> DataFrame:
    """Markdown events that are not ignored, with mapped kinds; unknown kinds go."""
    return events.withColumn("kind", map_kind(F.col("kind"))).where(F.col("kind").isNotNull() & F.lower("path").endswith(".md") & ~ignored(F.col("path"), patterns))


def debounce(events: DataFrame, gap: str = "1 second", watermark: str | None = None) -> DataFrame:
    """path, kind (of the newest event), first and last instant and n events of each burst of events (path, kind, ts).

    Works on a stream (with a watermark, append mode) and on a batch, where all bursts are released.
    """
    if watermark:
        events = events.withWatermark("ts", watermark)
    grouped = events.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.max_by("kind", "ts").alias("kind"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_events"))
    return grouped.drop("w")


def islands(events: DataFrame, seconds: int, tie: str | None = None) -> DataFrame:
    """The same bursts by gaps and islands, for a batch: the check of the stream. Ties of time go to the largest `tie`."""
    order = ["ts", *([tie] if tie else [])]
    w = Window.partitionBy("path").orderBy(*order)
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) >= seconds * 1_000_000
    marked = events.withColumn("start", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("burst", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    newest = F.struct(*order)
    return marked.groupBy("path", "burst").agg(F.max_by("kind", newest).alias("kind"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_events"))


def plan_batch(released: DataFrame, stored: DataFrame, disk: DataFrame) -> dict[str, DataFrame]:
    """What a released batch asks for: moves (paired by checksum), paths to index, paths to remove.

    stored and disk are (file_path, checksum); a created or modified path whose checksum is stored is unchanged.
    """
    gone = released.where("kind = 'deleted'").select(F.col("path").alias("file_path")).join(stored, "file_path").join(disk.select("file_path"), "file_path", "left_anti")
    there = released.where("kind <> 'deleted'").select(F.col("path").alias("file_path")).join(disk, "file_path")
    fresh = there.join(stored.select("file_path", F.col("checksum").alias("was")), "file_path", "left")
    moves = indexing.pair_moves(gone.select("file_path", "checksum"), fresh.where("was is null").select("file_path", "checksum"))
    index = fresh.where("was is null or was <> checksum").select("file_path", "checksum").join(moves.select(F.col("to_path").alias("file_path")), "file_path", "left_anti")
    remove = gone.select("file_path").join(moves.select(F.col("from_path").alias("file_path")), "file_path", "left_anti")
    return {"moves": moves, "index": index, "remove": remove}


def watch(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, gap: str = "1 second", watermark: str = "1 second", once: bool = False, patterns: tuple[str, ...] | list[str] = IGNORED) -> StreamingQuery:
    """A query that hands every released batch to apply(batch, batch_id).

    once: all events that are there are taken as one batch whose bursts are released to the last one, then it ends."""
    kept = relevant(events, patterns)
    if once:

        def flush(batch: DataFrame, batch_id: int) -> None:
            apply(debounce(batch, gap), batch_id)

        return kept.writeStream.option("checkpointLocation", checkpoint).foreachBatch(flush).trigger(availableNow=True).start()
    released = debounce(kept, gap, watermark)
    return released.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(apply).trigger(processingTime="1 second").start()
