"""A project: a vault of notes, its tables as Parquet, and the operations that clients call.

Notes are the durable state; tables are derived and kept as segments (operators/segments.py): a pass writes what changed and
then a manifest, so readers never see a half-written version. There is one writer. Vault and store may be on any store that
Spark's Hadoop client knows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from functools import reduce
from pathlib import PurePosixPath
from urllib.parse import quote

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .functions import chunking, dates, edits, markdown
from .functions import text as T
from .operators import directory, filters, fulltext, graph, indexing, paging, schema, segments, tables, vectors
from .sources import scratch, vault
from .sources.files import Files
from .streaming import watch

RERANKED, RERANK_CHARS = 20, 2000
Reranker = Callable[[str, list[str]], list[float]]  # a question and texts to a score from 0 to 1 of each

TABLES = ("entity", "observation", "relation", "search_index", "skipped")


def safe_path(path: str) -> str:
    """A relative path without empty, dot or parent parts; ValueError for any other."""
    parts = path.split("/")
    if not path or path.startswith("/") or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"unsafe path {path!r}")
    return path


class Project:
    def __init__(self, spark: SparkSession, name: str, root: str, store: str, project_id: int = 1):
        self.spark, self.name, self.root, self.project_id = spark, name, str(root).rstrip("/"), project_id
        self.files, self.store = Files(spark, self.root), segments.Store(spark, str(store))

    # -- tables

    def table(self, name: str) -> DataFrame:
        """A table of the current version; KeyError before the first index pass."""
        if name != "skipped":
            return self.store.table(name)
        manifest = self.store.manifest()
        if manifest is None:
            raise KeyError("the project is not indexed yet")
        return self.spark.read.parquet(f"{self.store.path}/{manifest['skipped']}")

    def reindex(self) -> dict[str, int]:
        """Compares the vault with the tables by checksum, and writes what changed: added, updated, unchanged, removed, skipped.

        Skipped notes (malformed, no UTF-8) keep the row that they had; notes with an invalid permalink, created or modified
        fail the pass. The first pass is a rebuild.
        """
        manifest = self.store.manifest()
        if manifest is None:
            return self.rebuild()
        disk, stored = vault.scan(self.spark, self.root), self.table("entity")
        change = scratch.written(indexing.reconcile(disk.select("file_path", "checksum"), stored.select("file_path", "checksum")), "change")
        files = disk.join(change.where("change in ('added', 'updated')").select("file_path"), "file_path", "left_semi")
        gone = stored.join(change.where("change = 'removed'"), "file_path", "left_semi").select("id", "file_path")
        made = self._change(manifest, self.store.new_name(), files, gone)
        counted = change.join(self.table("skipped").select("file_path"), "file_path", "left_anti").groupBy("change").count().collect()
        found = {r.change: r["count"] for r in counted}
        return {k: found.get(k, 0) for k in ("added", "updated", "unchanged", "removed")} | {"skipped": made["n_skipped"]}

    def rebuild(self) -> dict[str, int]:
        """Reads all notes, whatever their checksums, and writes everything as one segment; counts as `reindex` does."""
        before = self.store.manifest()
        old = self.table("entity").select("file_path", "checksum") if before else None
        made = self._change(None, self.store.new_name(), vault.scan(self.spark, self.root), None, keep={k: before[k] for k in ("version", "applied") if k in before} if before else {})
        fresh = self.table("entity").select("file_path", "checksum")
        change = {"added": fresh.count()} if old is None else {x.change: x["count"] for x in indexing.reconcile(fresh, old).groupBy("change").count().collect()}
        return {k: change.get(k, 0) for k in ("added", "updated", "unchanged", "removed")} | {"skipped": made["n_skipped"]}

    def _change(self, manifest: dict | None, segment: str, files: DataFrame, gone: DataFrame | None, moved: DataFrame | None = None, keep: dict | None = None) -> dict:
        """The next version: notes of `files` are new or replaced, the entities `gone` (id, file_path) are no more, and those
        of `moved` (id, file_path) have another path. Without a manifest, all there is.

        Links that may lead elsewhere now are those that say a key which a changed note offers or has offered: the notes that
        hold them are written again from the tables, with all others left as they are."""
        read = lambda name: self.store.read(segment, name)
        self.store.write(segment, {"notes": vault.documents(files, self.name)})
        notes = read("notes")
        failed = notes.where("outcome = 'failed'").select("file_path", "error").limit(1).collect()
        if failed:
            self.store.files.delete(segment)
            raise ValueError(f"{failed[0].file_path}: {failed[0].error}")
        skipped, place = notes.where("outcome in ('malformed', 'missing')").select("file_path", "outcome"), self.store.new_name("skipped")
        n_skipped = skipped.count()
        if manifest:
            seen = notes.select("file_path") if gone is None else notes.select("file_path").unionByName(gone.select("file_path"))
            skipped = self.spark.read.parquet(f"{self.store.path}/{manifest['skipped']}").join(seen, "file_path", "left_anti").unionByName(skipped)
        skipped.write.parquet(f"{self.store.path}/{place}")
        more = {"skipped": place} | (keep or {})
        if manifest and not notes.where("outcome = 'loaded'").limit(1).count() and (gone is None or not gone.limit(1).count()):
            self.store.files.delete(segment)
            return self.store.commit(manifest | more) | {"n_skipped": n_skipped}
        good = notes.where("outcome = 'loaded'").withColumn("project_id", F.lit(self.project_id).cast("long"))
        # the note's own instants win over the file's; a note with an invalid one has failed the pass above
        said = lambda name: F.try_to_timestamp(markdown.instant_of(F.get_json_object("metadata", f"$.{name}")))
        good = good.withColumn("created_at", F.coalesce(said("created"), "updated_at")).withColumn("updated_at", F.coalesce(said("modified"), "updated_at"))
        after = manifest["next"] if manifest else [0, 0, 0]
        known = self.store.table("entity", manifest["segments"]) if manifest else None
        paths = None
        if known is not None:
            paths = known.select("file_path", "id")
            if moved is not None:
                paths = paths.join(moved.select("id"), "id", "left_anti").select("file_path", "id").unionByName(moved.select("file_path", "id"))
        made = indexing.assign_ids(good, paths, tuple(after))
        # without earlier rows, what changed is all there is
        own = dict(zip(("changed/entity", "changed/observation", "changed/relation") if manifest else ("entity", "observation", "changed/relation"), (made[0].withColumnRenamed("metadata", "entity_metadata").drop("text", "wikilinks", "error", "outcome"), *made[1:]), strict=True))
        self.store.write(segment, own)
        entity, observation, relation = (read(n) for n in own)
        relation = relation.withColumn("to_id", F.lit(None).cast("long"))
        state, ids = entity, None
        if known is not None:
            replaced = entity.select("id").join(known.select("id"), "id", "left_semi")
            ids = replaced if gone is None else replaced.unionByName(gone.select("id")).distinct()
            state = known.join(ids, "id", "left_anti").unionByName(entity)
            keys = known.join(ids, "id", "left_semi").select(F.explode(indexing.link_keys()).alias("key")).unionByName(entity.select(F.explode(indexing.link_keys()).alias("key"))).distinct()
            links = self.store.table("relation", manifest["segments"])
            touched = links.withColumn("key", indexing.link_name()).join(keys, "key", "left_semi").select(F.col("from_id").alias("id")).distinct().join(ids, "id", "left_anti")
            self.store.write(segment, {"changed/touched": touched})
            touched = read("changed/touched")
            owner = lambda rows, c: rows.join(touched.withColumnRenamed("id", c), c, "left_semi")
            entity = entity.unionByName(owner(known, "id"))
            observation = observation.unionByName(owner(self.store.table("observation", manifest["segments"]), "entity_id"))
            relation = relation.unionByName(owner(links, "from_id").withColumn("to_id", F.lit(None).cast("long")))
            ids = ids.unionByName(touched)
        if known is not None:
            self.store.write(segment, {"entity": entity, "observation": observation})
        self.store.write(segment, {"relation": indexing.resolve_links(relation, state), "gone": ids if ids is not None else self.spark.createDataFrame([], "id long")})
        self.store.write(segment, {"search_index": indexing.search_index(read("entity"), read("observation"), read("relation"), state)})
        top = [max(a, read(n).agg(F.max("id")).first()[0] or 0) for a, n in zip(after, own, strict=True)]
        made = self.store.append(manifest, segment, {"next": top} | more)
        for name in ("notes", "changed"):  # what the pass has written for itself alone
            self.store.files.delete(f"{segment}/{name}")
        self.store.vacuum()
        return made | {"n_skipped": n_skipped}

    def index_file(self, path: str) -> str:
        """One file: indexed, unchanged (by checksum), skipped (malformed, no UTF-8) or missing."""
        return self.index_files([path])[path]

    def index_files(self, paths: Iterable[str]) -> dict[str, str]:
        """Files by their paths, in one pass."""
        asked = sorted({safe_path(p) for p in paths})
        there = [p for p in asked if self.files.exists(p)]
        out = dict.fromkeys(asked, "missing") | dict.fromkeys(there, "unchanged")
        if not there:
            return out
        if self.store.manifest() is None:
            self.rebuild()
            fresh = set(there)
        else:
            files = vault.scan(self.spark, self.root, there)
            fresh = {r.file_path for r in files.join(self.table("entity").select("file_path", "checksum"), ["file_path", "checksum"], "left_anti").select("file_path").collect()}
            if fresh:
                self._change(self.store.manifest(), self.store.new_name(), vault.scan(self.spark, self.root, sorted(fresh)), None)
        skipped = {r.file_path for r in self.table("skipped").collect()}
        return out | {p: "skipped" if p in skipped else "indexed" for p in fresh}

    def apply_batch(self, events: DataFrame, batch_id: int, stream: str = "watch") -> dict[str, int]:
        """Released file events (path, kind) put into the index: moved, indexed, removed. A sink for `watch.watch`.

        A batch that has been applied before changes nothing. Moves are noted in the store before a file is touched, so a
        pass that ended halfway is done again with the same moves. The driver holds the paths of the batch."""
        manifest, done = self.store.manifest() or (self.rebuild() and self.store.manifest()), {"moved": 0, "indexed": 0, "removed": 0}
        if manifest.get("applied", {}).get(stream, -1) >= batch_id:
            return done
        kinds = {r.path: r.kind for r in events.select("path", "kind").collect()}
        there = sorted(p for p, kind in kinds.items() if kind != "deleted" and self.files.exists(p))
        released = self.spark.createDataFrame([(p, "created" if p in there else "deleted") for p in kinds], "path string, kind string")
        stored, note = self.table("entity").select("id", "file_path", "checksum", "title", "note_type", "permalink"), f"moves/{stream}-{batch_id}.json"
        disk = vault.scan(self.spark, self.root, there).select("file_path", "checksum") if there else self.spark.createDataFrame([], "file_path string, checksum string")
        plan = watch.plan_batch(released, stored.select("file_path", "checksum"), disk)
        if not self.store.files.exists(note):
            pairs = plan["moves"].join(stored.withColumnRenamed("file_path", "from_path"), "from_path").select("id", "from_path", "to_path", "title", "note_type", "permalink")
            self.store.files.write(note, json.dumps([r.asDict() for r in pairs.collect()]))
        moves = json.loads(self.store.files.read(note))
        for m in moves:
            self._keep_identity(m["to_path"], m)
        targets, sources = {m["to_path"] for m in moves}, {m["from_path"] for m in moves}
        fresh = sorted({r.file_path for r in plan["index"].collect()} - targets)
        gone = stored.join(plan["remove"], "file_path", "left_semi").where(~F.col("file_path").isin(*sources)).select("id", "file_path") if sources else stored.join(plan["remove"], "file_path", "left_semi").select("id", "file_path")
        done |= {"moved": len(moves), "indexed": len(fresh), "removed": gone.count()}
        keep = {"applied": manifest.get("applied", {}) | {stream: batch_id}}
        if not any(done.values()):
            self.store.commit(manifest | keep)
        else:
            moved = self.spark.createDataFrame([(m["id"], m["to_path"]) for m in moves], "id long, file_path string")
            paths = [*fresh, *sorted(targets)]
            files = vault.scan(self.spark, self.root, paths) if paths else vault.scan(self.spark, self.root).limit(0)
            self._change(manifest, self.store.new_name(), files, gone, moved if moves else None, keep)
        self.store.files.delete(note)
        return done

    def watch(self, events: DataFrame, checkpoint: str, **options):
        """A streaming query of file events that keeps the index up to date."""
        return watch.watch(events, self.apply_batch, checkpoint, **options)

    def _keep_identity(self, path: str, entity: dict) -> None:
        """A moved note says the title, type and permalink that its entity has."""
        said = {"title": entity["title"], "type": entity["note_type"]} | ({"permalink": entity["permalink"]} if entity["permalink"] else {})
        self.files.write(path, edits.merge_metadata(self.files.read(path), said, identity=True))

    def reindex_embeddings(self, embed: Callable[[DataFrame], DataFrame], model: str = "default") -> dict[str, int]:
        """Chunks all search rows and embeds those without a stored vector of equal key and hash. embed adds `embedding`.

        Vectors are kept by project and model; those of other models stay as they are."""
        chunks = chunking.chunk_records(self.table("search_index"))
        files, place = self.store.files, f"vectors/project={self.project_id}/model={quote(model, safe='')}"
        before = files.names(place)
        if before:
            both = indexing.reusable_vectors(chunks, self.stored_vectors(model))
        else:
            both = chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
        name, made = f"v-{uuid.uuid4().hex}", f"{self.store.path}/{place}"
        kept, fresh = both.where("embedding is not null"), embed(both.where("embedding is null").drop("embedding"))
        fresh.select(*both.columns).withColumn("made", F.lit(True)).unionByName(kept.withColumn("made", F.lit(False))).write.parquet(f"{made}/.{name}")
        n = self.spark.read.parquet(f"{made}/.{name}").agg(F.count(F.lit(1)), F.count_if("made")).first()
        files.rename(f"{place}/.{name}", f"{place}/{name}")  # from here on it is the one that is read
        for old in before:
            files.delete(f"{place}/{old}")
        return {"chunks": n[0], "embedded": n[1]}

    def stored_vectors(self, model: str = "default") -> DataFrame:
        """The stored vectors of a model; FileNotFoundError if there are none."""
        place = f"vectors/project={self.project_id}/model={quote(model, safe='')}"
        names = [n for n in self.store.files.names(place) if n.startswith("v-")]
        if not names:
            raise FileNotFoundError(f"no vectors of model {model!r}")
        newest = max(names, key=lambda n: self.store.files.changed(f"{place}/{n}"))
        return self.spark.read.parquet(f"{self.store.path}/{place}/{newest}").drop("made")

    def status(self) -> dict[str, int]:
        return tables.counts(*(self.table(t) for t in TABLES[:3])).first().asDict() | {"n_skipped": self.table("skipped").count()}

    # -- notes

    def write_note(self, title: str, folder: str, body: str = "", note_type: str = "note", tags: list[str] | None = None, metadata: dict | None = None, overwrite: bool = False) -> str:
        path = safe_path(str(PurePosixPath(folder) / f"{title.replace('/', '-')}.md"))
        if not overwrite and self.files.exists(path):
            raise FileExistsError(f"note already exists: {path}")
        head = {"title": title, "type": note_type} | ({"tags": list(tags)} if tags else {}) | {k: v for k, v in (metadata or {}).items() if k not in ("title", "type", "permalink")}
        self.files.write(path, edits.render(head, body or f"# {title}"))
        return path

    def read_note(self, identifier: str) -> dict:
        """A note by permalink, path or exact title; a miss gives the closest texts as suggestions."""
        found = self._resolve(identifier)
        if found is None:
            return {"found": False, "suggestions": [r.permalink for r in self.search(identifier, page_size=5).results]}
        text = self.files.read(found.file_path)
        note = markdown.parse_note(found.file_path, text)
        return {"found": True, "file_path": found.file_path, "permalink": found.permalink, "content": text} | {k: note[k] for k in ("title", "note_type", "tags", "observations", "relations")}

    def edit_note(self, identifier: str, operation: str, content: str, **options) -> str:
        """An edit of a note. Appending to or prepending a note that is not there creates it."""
        found = self._resolve(identifier)
        if found is None:
            if operation not in ("append", "prepend"):
                raise FileNotFoundError(identifier)
            folder, _, title = identifier.rpartition("/")
            return self.write_note(title, folder or ".", content)
        self.files.write(found.file_path, edits.edit(self.files.read(found.file_path), operation, content, **options))
        return found.file_path

    def set_metadata(self, identifier: str, updates: dict) -> str:
        found = self._resolve(identifier)
        if found is None:
            raise FileNotFoundError(identifier)
        self.files.write(found.file_path, edits.merge_metadata(self.files.read(found.file_path), updates))
        return found.file_path

    def move_note(self, identifier: str, target: str) -> str:
        """A note under another path: it keeps its title, type and permalink, in the file as well, and the index follows."""
        found = self._resolve(identifier)
        if found is None:
            raise FileNotFoundError(identifier)
        self._move([(found.asDict(), safe_path(target))])
        return target

    def move_folder(self, folder: str, target: str) -> dict[str, list[str]]:
        """All notes below a folder under another one, in one pass over the index; what moved and what did not."""
        source, target = safe_path(folder), safe_path(target)
        known = self.table("entity").where(F.col("file_path").startswith(source + "/")).select("id", "file_path", "title", "note_type", "permalink")
        return self._move((r.asDict(), target + r.file_path[len(source) :]) for r in known.orderBy("file_path").toLocalIterator())

    def _move(self, moves: Iterable[tuple[dict, str]]) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {"done": [], "failed": []}
        done = []
        for entity, target in moves:
            try:
                self.files.rename(entity["file_path"], target)
            except OSError as e:
                out["failed"].append(f"{entity['file_path']}: {type(e).__name__}")
                continue
            self._keep_identity(target, entity)
            done.append((entity["id"], target))
            out["done"].append(target)
        if not done and out["failed"]:
            raise FileExistsError(out["failed"][0])
        if done:
            moved = self.spark.createDataFrame(done, "id long, file_path string")
            self._change(self.store.manifest(), self.store.new_name(), vault.scan(self.spark, self.root, [p for _, p in done]), None, moved)
        return out

    def delete_note(self, identifier: str) -> bool:
        found = self._resolve(identifier)
        return found is not None and self.files.delete(found.file_path)

    def each_under(self, folder: str, action: Callable[[str], object]) -> dict[str, list[str]]:
        """action on every note below a folder, with what succeeded and what failed."""
        out: dict[str, list[str]] = {"done": [], "failed": []}
        for path in sorted(self.files.below(safe_path(folder), ".md")):
            try:
                action(path)
                out["done"].append(path)
            except (OSError, ValueError) as e:
                out["failed"].append(f"{path}: {e}")
        return out

    def _resolve(self, identifier: str) -> Row | None:
        """The entity that an identifier names: its permalink, path, the end of its permalink, or its title."""
        entities = self.table("entity")
        asked = self.spark.createDataFrame([(identifier,)], "identifier string")
        return entities.join(F.broadcast(graph.resolve_identifiers(asked, entities).where("id is not null").select("id")), "id", "left_semi").first()

    def resolve(self, identifiers: DataFrame) -> DataFrame:
        """identifiers (identifier, ...) with id and kind: any number of them in one join."""
        return graph.resolve_identifiers(identifiers, self.table("entity"))

    # -- search

    def index(self) -> fulltext.Index:
        """The full-text index of the current version; KeyError before the first index pass."""
        return self.store.index()

    def _hits(self, expression: str, options: filters.Filters, legs: tuple[str, ...] = fulltext.LEGS) -> DataFrame:
        """The search rows that match and pass the filters, with leg and score."""
        rows = filters.apply(self.table("search_index"), options, self.table("entity"))
        return rows.join(self.index().match(expression, legs), fulltext.KEY)

    def search(self, query: str | None = None, kind: str = "text", options: filters.Filters | None = None, page: int = 1, page_size: int = 10) -> paging.Page:
        """A page of results: text, title or permalink search, or filters alone; the newest first without a query."""
        options = options or filters.Filters(types=("entity",))
        scopes = filters.scopes(options)
        if kind == "text" and scopes and (query or options.title):
            asked = [(fulltext.prepare(query) or '""', fulltext.LEGS)] if query else []
            rows = filters.apply(self.table("search_index"), options, self.table("entity"))
            found = rows.join(self.index().match_scopes(asked + scopes), fulltext.KEY)
            return paging.exact(found, [F.col("score"), *([F.desc("updated_at")] if options.after else []), F.col("type"), F.col("id")], page, page_size)
        if not query:
            rows = filters.apply(self.table("search_index"), options, self.table("entity")).withColumn("score", F.lit(0.0))
            return paging.exact(rows, [F.desc("updated_at"), F.col("type"), F.col("id")], page, page_size)
        if kind == "permalink":
            rows = filters.apply(self.table("search_index"), options, self.table("entity")).where(filters.permalink_matches(F.col("permalink"), query))
            return paging.exact(rows, [F.desc("updated_at"), F.col("type"), F.col("id")], page, page_size)

        def page_of(expression: str | None) -> paging.Page:
            legs = ("title",) if kind == "title" else fulltext.LEGS
            found = self._hits(expression or '""', options, legs)
            order = [F.col("score"), *([F.desc("updated_at")] if options.after else []), F.col("type"), F.col("id")]
            return paging.exact(found, order, page, page_size)

        got = page_of(fulltext.prepare_title(query) if kind == "title" else fulltext.prepare(query))
        loose = fulltext.relaxed(query) if kind == "text" and got.total == 0 else None
        return page_of(loose) if loose else got

    def search_vectors(self, query: list[float], options: filters.Filters | None = None, text: str | None = None, floor: float = vectors.MIN_SIMILARITY, page: int = 1, page_size: int = 10, rerank: Reranker | None = None, asked: str | None = None, model: str = "default") -> paging.Page:
        """Rows by their best chunk's similarity; with a text as well, both legs are fused.

        With a reranker and a question (`asked`, else the text), the first RERANKED rows are scored anew; the others follow in
        their order. Only the rows up to the page's end are gathered, and RERANKED of them at least.
        """
        options, asked = options or filters.Filters(types=("entity",)), asked or text
        page, page_size = paging.clamp(page, page_size)
        pool = paging.candidate_window(page_size, (page - 1) * page_size)
        if rerank and asked:
            pool = max(pool, vectors.rerank_limit(RERANKED, page_size, (page - 1) * page_size))
        chunks = self.stored_vectors(model)
        scored = vectors.nearest(chunks, vectors.literal(query), pool * (10 if text else 1), ["chunk_key"])
        best = vectors.best_per_row(scored, ["type", "id"], "chunk_text", floor).withColumnRenamed("chunks", "texts")
        rows = filters.apply(self.table("search_index"), options, self.table("entity"))
        if text:
            found = self._hits(fulltext.prepare(text) or '""', options).orderBy("score", "type", "id").limit(pool)
            fused = vectors.fuse(vectors.normalize_scores(found.select("type", "id", "score")), best.select("type", "id", "score"), ["type", "id"])
            best = fused.join(best.select("type", "id", "texts"), ["type", "id"], "left")
        hits = best.join(rows.drop("score") if "score" in rows.columns else rows, ["type", "id"])
        hits = hits.withColumn("matched_chunk", vectors.matched_chunk(F.col("content_snippet"), F.coalesce("texts", F.array().cast("array<string>"))))
        # equal scores: the text leg in its order, then the vector leg in its
        ties = [F.desc(c) for c in ("text_score", "vector_score") if c in hits.columns]
        order = [F.desc("score"), *ties, F.col("type"), F.col("id")]
        if not (rerank and asked):
            return paging.probe(hits, order, page, page_size)
        end = page * page_size
        rows = [r.asDict() for r in paging.window(hits, order, 1, max(end, RERANKED), 1).collect()]
        if (page - 1) * page_size < len(rows):
            texts = [vectors.rerank_document(r["title"], r["matched_chunk"] or r["content_snippet"], RERANK_CHARS) for r in rows[:RERANKED]]
            rows = vectors.rerank_rows(rows, rerank(asked, texts), RERANKED)
        return paging.Page([Row(**r) for r in rows[end - page_size : end]], 0, False, len(rows) > end, page, page_size)

    def search_documents(self, query: str) -> dict:
        """The first ten results as id, title and url."""
        found = self.search(query).results
        rows = [{"id": r.permalink or f"doc-{k}", "title": (r.title or "").strip() or "Untitled", "url": r.permalink or ""} for k, r in enumerate(found)]
        return {"results": rows, "total_count": len(rows), "query": query}

    def fetch(self, identifier: str) -> dict:
        """A note's whole markdown with a title: its first line if that is a heading, else the identifier's last part in words."""
        note = self.read_note(identifier)
        text = note["content"] if note["found"] else f"# Note Not Found in {self.name}: \"{identifier}\""
        first = text.split("\n", 1)[0]
        title = first[2:].strip() if first.startswith("# ") else identifier.rsplit("/", 1)[-1].replace("-", " ").title()
        about = {"format": "markdown"} if note["found"] else {"error": "Document not found"}
        return {"id": identifier, "title": title or "Untitled Document", "text": text, "url": identifier, "metadata": about}

    # -- graph, directories, schemas

    def context(self, url: str, depth: int = 1, most: int = 10, timeframe: str | None = "7d") -> Row | None:
        found = self._resolve(graph.normalize_url(url))
        if found is None:
            return None
        since = dates.since_bound(dates.parse_timeframe(timeframe)) if timeframe else None
        e = self.table("entity").withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        return graph.build_context(e, self.table("relation"), self.table("observation"), self.spark.createDataFrame([(found.id,)], "id long"), depth, most, since).first()

    def recent(self, timeframe: str = "7d", types: tuple[str, ...] = ("entity",), page: int = 1, page_size: int = 10, depth: int = 1, most: int = 10) -> list[Row]:
        """The newest rows of a timeframe, each with what is related to it; one row more than the page tells that others follow."""
        since = dates.since_bound(dates.parse_timeframe(timeframe))
        e = self.table("entity").withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        rows = self.table("search_index").where(F.col("type").isin(*types)).select("type", "id", "title", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))
        return graph.recent_context(rows, e, self.table("relation"), self.table("observation"), since, page, page_size, depth, most).orderBy("pos").collect()

    def directory(self, folder: str = "", depth: int = 1, glob: str | None = None, order: str = "default", page: int = 1, page_size: int = 50) -> paging.Page:
        found, by = directory.listing(self.table("entity").select("file_path", "title", "updated_at"), folder, depth, glob, order)
        return paging.exact(found, by, page, min(page_size, directory.MOST_PAGE))

    def _fields_of(self, note_type: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Values (note, place, field, value) of the observations by category and of the relations by type, and the notes of a type."""
        own = self.table("entity").where(T.note_type(F.col("note_type")) == F.lit(note_type)).select(F.col("id").alias("note"))
        o = self.table("observation").select(F.col("entity_id").alias("note"), "place", F.coalesce("category", F.lit("note")).alias("field"), F.col("content").alias("value"))
        r = self.table("relation").select(F.col("from_id").alias("note"), "place", F.col("relation_type").alias("field"), F.col("to_name").alias("value"))
        return o.join(own, "note", "left_semi"), r.join(own, "note", "left_semi"), own

    def schema_of(self, note_type: str) -> tuple[list[schema.Field], str]:
        """The fields and the mode of the schema note for a type."""
        rows = self.table("entity").where("note_type = 'schema'").where(T.note_type(F.get_json_object("entity_metadata", "$.entity")) == F.lit(note_type)).orderBy("file_path").limit(1).collect()
        if not rows:
            raise KeyError(f"no schema for {note_type!r}")
        head, _ = markdown.split_frontmatter(self.files.read(rows[0].file_path))
        _, fields, mode = schema.parse_schema(markdown.load_yaml(head or ""))
        return fields, mode

    def schema_infer(self, note_type: str) -> DataFrame:
        """The use of each observation category and relation type; one name may be both, told apart by source."""
        observations, relations, notes = self._fields_of(note_type)
        found = [schema.infer(values, notes).withColumn("source", F.lit(source)) for values, source in ((observations, "observation"), (relations, "relation"))]
        return found[0].unionByName(found[1])

    def _checked(self, note_type: str | None) -> tuple[DataFrame, DataFrame]:
        """The notes (of a type, or all) with the schema that holds for each, and all their values by source."""
        e = self.table("entity")
        resolved = schema.resolve(e, scratch.written(schema.definitions(e), "definitions"))
        if note_type is not None:
            resolved = resolved.where(T.note_type(F.col("note_type")) == T.note_type(F.lit(note_type)))
            if not resolved.limit(1).count():
                raise KeyError(f"no schema for {note_type!r}")
        o = self.table("observation").select(F.col("entity_id").alias("note"), F.lit("observation").alias("source"), "place", F.coalesce("category", F.lit("note")).alias("field"), F.col("content").alias("value"))
        r = self.table("relation").select(F.col("from_id").alias("note"), F.lit("relation").alias("source"), "place", F.col("relation_type").alias("field"), F.col("to_name").alias("value"))
        return resolved, o.unionByName(r).unionByName(schema.frontmatter_values(e))

    def schema_validate(self, note_type: str | None = None) -> DataFrame:
        """note, n_warnings, n_errors and passed of the notes of a type, or of all notes that have a schema, in one plan.

        Each note is held against its own schema: its mapping, the one that it names, or that of its type."""
        return schema.reports(schema.check(*self._checked(note_type)))

    def schema_findings(self, note_type: str | None = None) -> DataFrame:
        """note, source, field and message of every missing required field and every value outside an enum."""
        return schema.messages(schema.check(*self._checked(note_type)))

    def schema_unmatched(self, note_type: str | None = None) -> DataFrame:
        """note, source, field and n of the observation categories and relation types that the note's schema does not name."""
        return schema.unnamed(*self._checked(note_type))

    def schema_types(self) -> DataFrame:
        """type, n_notes and has_schema of every note type in use or in a schema."""
        e = self.table("entity")
        return schema.covered(e, schema.definitions(e))

    def schema_for(self, identifier: str) -> tuple[list[schema.Field], str] | None:
        """The fields and mode that hold for a note: its own `schema` mapping, the type its `schema` names, or its own type."""
        found = self._resolve(identifier)
        if found is None:
            raise FileNotFoundError(identifier)
        head, _ = markdown.split_frontmatter(self.files.read(found.file_path))
        said = markdown.load_yaml(head or "") or {}
        if isinstance(said.get("schema"), dict):
            return schema.parse_schema({"settings": said.get("settings"), "entity": str(said.get("type") or "unknown"), "schema": said["schema"]})[1:]
        for name in (said.get("schema"), said.get("type")):
            if isinstance(name, str) and name:
                try:
                    return self.schema_of(name)
                except KeyError:
                    continue
        return None

    def schema_diff(self, note_type: str) -> DataFrame:
        """The drift of the fields declared and used as observations, and of those declared and used as relations."""
        observations, relations, notes = self._fields_of(note_type)
        table = schema.field_table(self.spark, self.schema_of(note_type)[0])
        own = schema.drift(table.where("not is_reference"), schema.frequencies(observations, notes, 3))
        return own.unionByName(schema.drift(table.where("is_reference"), schema.frequencies(relations, notes, 3)))


def search_all(projects: list[Project], query: str, page: int = 1, page_size: int = 10, options: filters.Filters | None = None) -> paging.Page:
    """One page over several projects: each gives page * page_size results in its own order, then scores descend (text hits
    worst first), ties by project and place. A project in which nothing is found strictly is asked the relaxed query.

    Every project keeps its own statistics; hits of all are one union, so the page is one job and the totals another."""
    page, page_size = paging.clamp(page, page_size)
    options, strict, loose = options or filters.Filters(types=("entity",)), fulltext.prepare(query), fulltext.relaxed(query)
    if not projects or strict is None:
        return paging.Page([], 0, True, False, page, page_size)
    hits = lambda expression: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p._hits(expression, options).withColumns({"place": F.lit(k), "project": F.lit(p.name)}) for k, p in enumerate(projects)])
    found = hits(strict)
    if loose:
        found = scratch.written(found, "hits")
        found = found.unionByName(hits(loose).join(found.select("place").distinct(), "place", "left_anti"))
    found = scratch.written(found, "hits")
    rows = paging.merge_projects(found, "place", "score", [F.col("score"), F.col("type"), F.col("id")], page, page_size).drop("pos", "place").collect()
    totals = paging.project_totals(found, "place", page, page_size).first()
    return paging.Page(rows, totals.total, totals.total_is_exact, totals.has_more, page, page_size)


def registry(spark: SparkSession, path: str) -> dict[str, dict]:
    """Registered projects by name, from a JSON file."""
    folder, _, name = path.rpartition("/")
    files = Files(spark, folder)
    return json.loads(files.read(name)) if files.exists(name) else {}


def register(spark: SparkSession, path: str, name: str, root: str) -> dict[str, dict]:
    """A project added or repointed; ids are given once."""
    known = registry(spark, path)
    known[name] = known.get(name, {"id": 1 + max((p["id"] for p in known.values()), default=0)}) | {"root": root}
    folder, _, file = path.rpartition("/")
    Files(spark, folder).write(file, json.dumps(known))
    return known
