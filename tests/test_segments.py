"""Segments: random edits against a rebuild, what a small change writes, batches that are replayed or end halfway, streams."""

import random

import pytest
from pyspark.sql import functions as F

from notelattice import engine
from notelattice.functions import markdown
from notelattice.operators import graph, vectors


def content(p):
    """All that a project's tables say, with paths in place of ids."""
    e, o, r = (p.table(t) for t in ("entity", "observation", "relation"))
    path, to = e.select(F.col("id").alias("own"), F.col("file_path").alias("path")), e.select(F.col("id").alias("to_id"), F.col("file_path").alias("to_path"))
    out = {
        "entity": e.select("file_path", "title", "permalink", "checksum", "note_type"),
        "observation": o.join(path, o["entity_id"] == path["own"]).select("path", "place", "category", "content"),
        "relation": r.join(path, r["from_id"] == path["own"]).join(to, "to_id", "left").select("path", "relation_type", "to_name", "to_path"),
        "search": p.table("search_index").select("type", "title", "content_stems", "permalink", "file_path"),
        "stats": p.index().stats.select("n_rows", F.round("avg_d", 9)),
        "found": p.index().match("river OR al*").join(p.table("search_index"), ["type", "id"]).select("type", "title", "file_path", "leg", F.round("score", 9)),
        "skipped": p.table("skipped"),
    }
    return {k: sorted(map(repr, (tuple(x) for x in v.collect()))) for k, v in out.items()}


def test_random_edits_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(12)
    p = engine.Project(spark, "demo", str(tmp_path / "vault"), str(tmp_path / "store"))
    names = ["Alpha", "Beta", "Gamma", "Delta", "Odd [x] {y}*", "Ünïcode note"]

    def body():
        lines = [rng.choice(["- [fact] the river is wide #w", "- knows [[f/{}]]".format(rng.choice(names)), "- [idea] alpine alder", "- part_of [[f/{}.md]]".format(rng.choice(names)), "plain al text"]) for _ in range(rng.randint(0, 5))]
        return "\n".join(lines) + f"\nno {rng.random()}\n"

    for n in names[:4]:
        p.write_note(n, "f", body())
    assert p.reindex()["added"] == 4
    for turn in range(2):
        for n in rng.sample(names, 3):
            path = f"f/{n}.md"
            if p.files.exists(path) and rng.random() < 0.4:
                p.files.delete(path)
            elif rng.random() < 0.2:
                p.files.write(path, "---\ntitle: [unclosed\n---\nbroken")
            else:
                p.files.write(path, f"---\ntitle: {rng.choice(['Al', 'Bo'])} {rng.randint(0, 3)}\n---\n{body()}")
        p.reindex()
    assert p.reindex() | {"unchanged": 0, "skipped": 0} == dict.fromkeys(("added", "updated", "unchanged", "removed", "skipped"), 0)
    got, kept = content(p), {r.file_path for r in p.table("skipped").collect()}
    whole = engine.Project(spark, "demo", str(tmp_path / "vault"), str(tmp_path / "other"))
    whole.rebuild()
    want = content(whole)
    if not kept:  # a note that became malformed keeps the rows it had; a rebuild has none
        assert got == want
    else:
        assert [x for x in got["entity"] if not any(repr(k) in x for k in kept)] == want["entity"]
    merged = p.store.merged(p.store.manifest() | {"segments": p.store.manifest()["segments"]})
    p.store.commit(merged)
    assert content(p) == got


def test_small_changes_write_little_and_segments_merge(spark, tmp_path):
    p = engine.Project(spark, "demo", str(tmp_path / "vault"), str(tmp_path / "store"))
    (tmp_path / "vault").mkdir()
    for k in range(120):
        (tmp_path / "vault" / f"n{k}.md").write_text(f"# Note {k}\n- [fact] number {k} is here\n- next [[n{(k + 1) % 120}]]\n" + f"words of {k} " * 200)
    p.rebuild()
    first = p.store.manifest()["segments"][0]
    (tmp_path / "vault" / "n7.md").write_text("# Other\n- [fact] zebra\n")
    assert p.reindex()["updated"] == 1
    manifest = p.store.manifest()
    assert [s["name"] for s in manifest["segments"]][0] == first["name"] and manifest["segments"][1]["rows"] <= 6  # the note, and the one that links to it
    assert [r.file_path for r in p.index().match("zebra").where("type = 'entity'").join(p.table("search_index"), ["type", "id"]).collect()] == ["n7.md"]
    assert p.index().match('"number 7 is"').count() == 0 and p.index().stats.first().n_rows == p.table("search_index").count() == manifest["n_rows"]
    for k in range(20, 23):
        (tmp_path / "vault" / f"n{k}.md").write_text(f"# Note {k}\nchanged {k}")
        assert p.index_file(f"n{k}.md") == "indexed"
    assert p.index_file("n20.md") == "unchanged"
    assert len(p.store.manifest()["segments"]) < 5 and p.table("entity").count() == 120
    assert p.index_files(["gone.md"]) == {"gone.md": "missing"}


def events(spark, *rows):
    return spark.createDataFrame(rows, "path string, kind string")


def test_batches_are_applied_once(spark, tmp_path, monkeypatch):
    def fresh(name):
        p = engine.Project(spark, "demo", str(tmp_path / name / "vault"), str(tmp_path / name / "store"))
        p.write_note("Alpha", "f", "- [fact] one\n- knows [[f/Beta]]", metadata={"status": "open"})
        p.write_note("Beta", "f", "- [fact] two")
        p.write_note("Old", "f", "text of its own")
        p.reindex()
        p.files.rename("f/Old.md", "g/New.md")  # a rename, an edit, a new note, a deletion
        p.files.write("f/Alpha.md", "# Alpha\n- [fact] changed\n- knows [[f/Beta]]")
        p.write_note("Gamma", "f", "- about [[f/Old]]")
        p.files.delete("f/Beta.md")
        return p

    batch = events(spark, ("f/Old.md", "deleted"), ("g/New.md", "created"), ("f/Alpha.md", "modified"), ("f/Gamma.md", "created"), ("f/Beta.md", "deleted"))
    whole = fresh("whole")
    permalink = whole.table("entity").where("title = 'Old'").first().permalink
    assert whole.apply_batch(batch, 0) == {"moved": 1, "indexed": 2, "removed": 1}
    moved = whole.table("entity").where("file_path = 'g/New.md'").first()
    assert (moved.title, moved.permalink) == ("Old", permalink) and f"permalink: {permalink}" in whole.files.read("g/New.md")
    want, version = content(whole), whole.store.manifest()["version"]
    assert whole.apply_batch(batch, 0) == {"moved": 0, "indexed": 0, "removed": 0} and whole.store.manifest()["version"] == version

    broken = fresh("broken")
    with monkeypatch.context() as m:  # ends after the moved file is rewritten and the segment is there, before the version is
        m.setattr(broken.store, "commit", lambda manifest: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            broken.apply_batch(batch, 0)
    assert {r.title for r in broken.table("entity").collect()} == {"Alpha", "Beta", "Old"}
    assert broken.apply_batch(batch, 0) == {"moved": 1, "indexed": 2, "removed": 1}
    assert content(broken) == want
    with pytest.raises(FileExistsError):
        broken.store.commit(broken.store.manifest() | {"version": broken.store.manifest()["version"] - 1})


def test_stream_into_the_index(spark, tmp_path):
    p = engine.Project(spark, "demo", str(tmp_path / "vault"), str(tmp_path / "store"))
    p.write_note("Alpha", "f", "one")
    p.reindex()
    p.write_note("Beta", "f", "two")
    (tmp_path / "events").mkdir()
    (tmp_path / "events" / "0.json").write_text('{"path": "f/Beta.md", "kind": "create", "ts": "2024-01-01T00:00:00"}\n{"path": ".git/x.md", "kind": "create", "ts": "2024-01-01T00:00:00"}\n')
    stream = lambda: spark.readStream.schema("path string, kind string, ts timestamp").json(str(tmp_path / "events"))
    p.watch(stream(), str(tmp_path / "checkpoint"), once=True).awaitTermination()
    assert {r.title for r in p.table("entity").collect()} == {"Alpha", "Beta"}
    p.files.delete("f/Alpha.md")
    (tmp_path / "events" / "1.json").write_text('{"path": "f/Alpha.md", "kind": "remove", "ts": "2024-01-02T00:00:00"}\n')
    p.watch(stream(), str(tmp_path / "checkpoint"), once=True).awaitTermination()
    assert {r.title for r in p.table("entity").collect()} == {"Beta"} and p.store.manifest()["applied"] == {"watch": 1}


def test_moved_folder_and_models(spark, tmp_path):
    p = engine.Project(spark, "demo", str(tmp_path / "vault"), str(tmp_path / "store"))
    for k in range(3):
        p.write_note(f"N{k}", "a/b", f"- see [[a/b/N{(k + 1) % 3}]]")
    p.reindex()
    links = {r.title: r.permalink for r in p.table("entity").collect()}
    assert p.move_folder("a/b", "c") == {"done": ["c/N0.md", "c/N1.md", "c/N2.md"], "failed": []}
    assert {r.title: r.permalink for r in p.table("entity").collect()} == links and {r.file_path for r in p.table("entity").collect()} == {"c/N0.md", "c/N1.md", "c/N2.md"}
    one = lambda df: df.withColumn("embedding", F.array(F.lit(1.0)).cast("array<float>"))
    p.reindex_embeddings(one, "first/model")
    kept = p.store.files.names("vectors/project=1/model=first%2Fmodel")
    p.reindex_embeddings(one, "second")
    assert p.reindex_embeddings(one, "second")["embedded"] == 0 and p.store.files.names("vectors/project=1/model=first%2Fmodel") == kept
    with pytest.raises(FileNotFoundError):
        p.stored_vectors("third")


def test_schemas_by_precedence(spark, tmp_path):
    p = engine.Project(spark, "demo", str(tmp_path / "vault"), str(tmp_path / "store"))
    note = lambda path, head, body="": p.files.write(path, f"---\n{head}\n---\n{body}")
    note("s/person.md", "title: S\ntype: schema\nentity: person\nschema:\n  name: string\n  boss?: Person\nsettings:\n  validation: strict\n  frontmatter:\n    status(enum): [open, done]")
    note("s/thing.md", "title: T\ntype: schema\nentity: thing\nschema:\n  kind(enum): [a, b]")
    note("a.md", "title: A\ntype: person\nstatus: open", "- [name] Ada")
    note("b.md", "title: B\ntype: person\nstatus: other", "- [nickname] B")
    note("c.md", "title: C\ntype: person\nschema: thing", "- [kind] z\n- [kind] a")
    note("d.md", "title: D\ntype: memo\nschema:\n  when: string", "- [then] x")
    note("e.md", "title: E\ntype: memo", "")
    p.reindex()
    path = {r.id: r.file_path for r in p.table("entity").collect()}
    got = {path[r.note]: (r.n_warnings, r.n_errors, r.passed) for r in p.schema_validate().collect()}
    assert got == {"a.md": (0, 0, True), "b.md": (0, 2, False), "c.md": (1, 0, True), "d.md": (1, 0, True)}
    said = {(path[r.note], r.message) for r in p.schema_findings().collect()}
    assert said == {
        ("b.md", "Missing required field: name (expected [name] observation)"),
        ("b.md", "Frontmatter key 'status' has invalid value: other (allowed: open, done)"),
        ("c.md", "Field 'kind' has invalid value(s): z (allowed: a, b)"),
        ("d.md", "Missing required field: when (expected [when] observation)"),
    }
    assert {(path[r.note], r.field, r.n) for r in p.schema_unmatched().collect()} == {("b.md", "nickname", 1), ("d.md", "then", 1)}
    assert {(r.type, r.n_notes, r.has_schema) for r in p.schema_types().collect()} == {("person", 3, True), ("memo", 2, False), ("thing", 0, True)}


def test_nearest_in_blocks_and_hubs_in_parts(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5)]) for i in range(400)] + [(400, None), (401, [1.0]), (402, [0.0] * 5)]
    asked = [(i, v) for i, v in rows[:37]] + [(900, [2.0]), (901, None)]
    chunks = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame(asked, "query_id long, query array<float>")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) if a and b and len(a) == len(b) else 0.0
    want = {(q, i, s, r) for q, v in asked if v for r, (s, i) in enumerate(sorted(((dot(v, e), i) for i, e in rows), key=lambda x: (-x[0], x[1]))[:7], 1)}
    for block in (1 << 22, 60):
        assert {tuple(x) for x in vectors.nearest_for_queries(chunks, queries, 7, block).collect()} == want
    plan = vectors.nearest_for_queries(chunks, queries, 7)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    e = spark.createDataFrame([(i, f"t{i}", "2024") for i in range(40)], "id long, title string, created_at string")
    r = spark.createDataFrame([(100 + i, i, 0, "to") for i in range(1, 30)] + [(200, 0, 35, "on")], "id long, from_id long, to_id long, relation_type string")
    seeds, form = spark.createDataFrame([(3,), (35,)], "id long"), lambda d: sorted(map(tuple, d.collect()))
    one = form(graph.traverse(e, r, seeds, 2))
    monkeypatch.setattr(graph, "HUB", 4)
    assert form(graph.traverse(e, r, seeds, 2)) == one and len(one) > 60


def test_malformed_stays_out(spark):
    assert markdown.parse_note("a.md", "---\ntitle: [x\n---\n")["error"].startswith("frontmatter")
