"""Engine operators on small cases: search rules, graph properties, indexing, listing, streaming."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from notelattice.functions import chunking
from notelattice.operators import directory, filters, fulltext, graph, indexing, paging, schema, vectors
from notelattice.sources import vault
from notelattice.streaming import watch


@pytest.fixture(scope="module")
def index(spark):
    rows = [(1, "Rust notes", "rust index search", "rust index", "p/rust", "entity"), (2, "Search", "full text search in rust", None, "p/search", "entity"), (3, "Other", "nothing here, really", "x", "p/rust-other", "entity")]
    frame = spark.createDataFrame(rows, "id long, title string, content_stems string, content_snippet string, permalink string, type string")
    return fulltext.tokenized(frame)


def test_leg_is_the_first_matching_column(index):
    got = {r.id: r.leg for r in fulltext.match(index, "rust*").collect()}
    assert got == {1: "title", 2: "content_stems"}  # the permalink of 3 is no leg
    assert {r.id for r in fulltext.match(index, "rust* AND text*").collect()} == {2}
    assert {r.id for r in fulltext.match(index, '"rust index"').collect()} == {1} and {r.id for r in fulltext.match(index, "rust* NOT text*").collect()} == {1}
    assert fulltext.match(index, '""').count() == 0


def test_scores_follow_the_formula(index):
    import math

    rows = {r.id: r for r in index.collect()}
    size = {i: sum(len(r[f"t_{c}"]) for c in fulltext.INDEXED) for i, r in rows.items()}
    avg = sum(size.values()) / 3
    got = {r.id: r.score for r in fulltext.match(index, "search").collect()}
    idf = lambda n: max(math.log((3 - n + 0.5) / (n + 0.5)), 0) or 1e-6
    want = {2: -idf(1) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * size[2] / avg)), 1: -idf(2) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * size[1] / avg))}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


@pytest.fixture(scope="module")
def written(index, tmp_path_factory):
    return fulltext.write_index(index.drop(*[c for c in index.columns if c.startswith("t_")]), str(tmp_path_factory.mktemp("text")))


@pytest.mark.parametrize("expression", ["rust*", "rust* AND text*", '"rust index"', '"rust in"*', "rust* NOT text*", "search OR (graph* AND rust*)", "zzz", "search"])
@pytest.mark.parametrize("legs", [fulltext.LEGS, ("title",), ("permalink",)])
def test_index_equals_scan(index, written, expression, legs):
    key = lambda r: (r.type, r.id, r.leg, round(r.score, 9))
    assert sorted(map(key, written.match(expression, legs).collect())) == sorted(map(key, fulltext.match(index, expression, legs).collect()))


def test_relaxation_only_after_nothing(written):
    found, used = fulltext.search(written, "what about rust zzz nowhere")
    assert used == "about* OR rust* OR zzz* OR nowhere*" and found.count() == 2
    assert fulltext.search(written, "rust index")[1] == "rust* AND index*"


def test_pages(spark):
    rows = spark.range(23).withColumn("s", F.col("id"))
    a, b = paging.exact(rows, [F.col("id")], 3, 10), paging.probe(rows, [F.col("id")], 2, 10)
    assert (a.total, a.has_more, [r.id for r in a.results]) == (23, False, [20, 21, 22]) and (b.has_more, len(b.results), b.total_is_exact) == (True, 10, False)
    assert paging.exact(rows, [F.col("id")], 0, 0).page_size == 1 and paging.candidate_window(5, 0) == 100


def test_filters(spark):
    rows = spark.createDataFrame([(1, "observation", 1, "fact", '{"tags":["a"]}', "p/x"), (2, "entity", 2, None, '{"note_type":"Note"}', "p/y-1"), (3, "observation", 2, "todo", '{"tags":[]}', "p/z")], "id long, type string, entity_id long, category string, metadata string, permalink string")
    owners = spark.createDataFrame([(1, '{"status":"open","n":"3"}'), (2, '{"status":"done","tags":["b"]}')], "id long, entity_metadata string")
    ids = lambda **k: {r.id for r in filters.apply(rows, filters.Filters(**k), owners).collect()}
    assert ids(categories=("fact", "todo")) == {1, 3} and ids() == {2} and ids(note_types=("NOTE",)) == {2}
    assert ids(types=("observation",), status="done") == {3} and ids(types=("observation",), metadata={"n": "3", "a b": "x"}) == {1}
    assert ids(types=("observation", "entity"), tags=("b", "a")) == {2, 3} and ids(types=("observation",), tags=("a",)) == {1}
    assert ids(permalink_match="p/*") == {2} and ids(permalink_match="p/y-1") == {2} and ids(permalink_match="y") == {2}


def test_traversal_properties(spark):
    e = spark.createDataFrame([(i, f"n{i}", "2024-01-01 00:00:00") for i in range(8)], "id long, title string, created_at string")
    edges = [(1, 0, 1), (2, 1, 2), (3, 2, 0), (4, 2, 3), (5, 3, None), (6, 6, 7), (7, 4, 4)]
    r = spark.createDataFrame([(i, a, b, "to") for i, a, b in edges], "id long, from_id long, to_id long, relation_type string")
    found = graph.traverse(e, r, spark.createDataFrame([(0,)], "id long"), 2).collect()
    assert len({(x.root_id, x.type, x.id) for x in found}) == len(found) and max(x.depth for x in found) <= 4
    assert {(x.id, x.depth) for x in found if x.type == "entity"} == {(1, 2), (2, 2), (3, 4)}
    assert {(x.id, x.depth) for x in found if x.type == "relation"} == {(1, 1), (3, 1), (2, 3), (4, 3)}
    assert graph.traverse(e, r, spark.createDataFrame([(0,)], "id long"), 0).count() == 0
    assert graph.traverse(e, r, spark.createDataFrame([(0,)], "id long"), 2, since="2025").count() == 0
    ctx = graph.build_context(e, r, spark.createDataFrame([(1, 1, "fact", "x")], "id long, entity_id long, category string, content string"), spark.createDataFrame([(0,)], "id long"), 1).first()
    assert (ctx.n_entities, ctx.n_relations, ctx.n_observations) == (2, 2, 1) and len(ctx.related) == 4
    assert graph.normalize_url("memory://a/b/") == "a/b"
    for bad in ("", "memory://", "http://x", "a//b", "a|b"):
        with pytest.raises(ValueError):
            graph.normalize_url(bad)


def test_vault_to_index(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "a.md").write_text("---\ntitle: A\ntags: [x]\n---\n- [fact] one #t (c)\n- uses [[sub/b]]\n- uses [[sub/b]]\n- uses [[gone]]\n")
    (tmp_path / "sub" / "b.md").write_text("plain [[a.md]]")
    (tmp_path / "bad.md").write_text("---\na: [\n---\nx")
    (tmp_path / "raw.md").write_bytes(b"\xff\xfe")
    (tmp_path / ".git" / "c.md").write_text("hidden")
    docs = vault.documents(vault.scan(spark, str(tmp_path)), "proj")
    outcome = {r.file_path: r.outcome for r in docs.collect()}
    assert outcome == {"a.md": "loaded", "sub/b.md": "loaded", "bad.md": "malformed", "raw.md": "missing"}
    notes = docs.where("outcome = 'loaded'").withColumns({"project_id": F.lit(1), "created_at": F.col("updated_at")})
    entities, observations, relations = indexing.assign_ids(notes)
    relations = indexing.resolve_links(relations, entities)
    assert {(r.from_id, r.to_name, r.to_id) for r in relations.collect()} == {(1, "gone", None), (1, "sub/b", 2), (2, "a.md", 1)}
    rows = {(r.type, r.id): r for r in indexing.search_index(entities, observations, relations).collect()}
    assert len(rows) == 6 and rows["entity", 1].permalink == "proj/a" and rows["observation", 1].permalink == "proj/a/observations/fact/one-t"
    assert {r.title for (t, _), r in rows.items() if t == "relation"} == {"A", "A -> b", "b -> A"}
    chunks = chunking.chunk_records(indexing.search_index(entities, observations, relations)).collect()
    assert len({c.chunk_key for c in chunks}) == len(chunks) >= 6
    left = indexing.remove({"entity": entities, "observation": observations, "relation": relations, "search_index": indexing.search_index(entities, observations, relations)}, entities.where("id = 2"))
    assert (left["entity"].count(), left["relation"].count(), left["search_index"].count()) == (1, 1, 4)  # the row of the relation to 2 stays


def test_full_rebuild_equals_incremental(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "file_path string, checksum string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], old.schema)
    change = {r.file_path: r.change for r in indexing.reconcile(new, old).collect()}
    assert change == {"a": "unchanged", "b": "updated", "c": "removed", "d": "added"}
    moved = indexing.pair_moves(old.where("file_path = 'c'"), new.where("file_path = 'd'")).collect()
    assert [(r.from_path, r.to_path) for r in moved] == [("c", "d")]


def test_directory_orders(spark):
    t = datetime(2024, 1, 1)
    files = spark.createDataFrame([("b/x.md", "Zed", t), ("b/c/y.md", "Abc", t + timedelta(1)), ("a.md", "Mid", t)], "file_path string, title string, updated_at timestamp")
    found, order = directory.listing(files, depth=3)
    assert [r.path for r in found.orderBy(*order).collect()] == ["b", "b/c", "a.md", "b/x.md", "b/c/y.md"]
    assert {r.path for r in directory.listing(files, "b", 1)[0].collect()} == {"b/c", "b/x.md"}
    assert {r.path for r in directory.listing(files, depth=3, glob="*.md")[0].collect()} == {"b/x.md", "b/c/y.md", "a.md"}
    with pytest.raises(ValueError):
        directory.order_by("size")


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [1.0])], "vec_id long, embedding array<float>")
    q = vectors.literal([1.0, 0.0])
    assert [(r.vec_id, round(r.similarity, 4)) for r in vectors.nearest(rows, q, 3, ["vec_id"]).collect()] == [(1, 1.0), (2, 0.6), (3, 0.0)]
    row = spark.range(1).select(vectors.normalize(vectors.literal([3.0, 4.0])).alias("a"), vectors.normalize(vectors.literal([0.0, 0.0])).alias("b"), vectors.squash(F.lit(99.0)).alias("c"), vectors.matched_chunk(F.lit("x" * 2001), F.array(F.lit("p"), F.lit("q"))).alias("d")).first()
    assert [round(x, 4) for x in row.a] == [0.6, 0.8] and list(row.b) == [0.0, 0.0] and 0.999 < row.c < 1 and row.d == "p\n---\nq"
    assert vectors.rerank_limit(20, 30, 0) == 200


def test_schema_ties_and_report(spark):
    values = spark.createDataFrame([("f", "B", 1), ("f", "A", 2), ("f", "A", 3), ("f", "B", 4), ("g", "C", 9)], "field string, target string, place long")
    assert {r.field: r.target for r in schema.most_common_target(values).collect()} == {"f": "B", "g": "C"}
    fields = schema.field_table(spark, schema.parse_fields({"a": "string", "b?(enum)": ["x"]}))
    have = spark.createDataFrame([(1, 1, "a", "v"), (1, 2, "b", "y"), (2, 1, "b", "x")], "note long, place long, field string, value string")
    out = schema.validate(have, spark.createDataFrame([(1,), (2,), (3,)], "note long"), fields)
    assert {(r.note, r.n_errors, r.passed) for r in schema.report(out, "strict").collect()} == {(1, 1, False), (2, 1, False), (3, 1, False)}
    assert {(r.note, r.n_warnings, r.passed) for r in schema.report(out, "warn").collect()} == {(1, 1, True), (2, 1, True), (3, 1, True)}


def test_watch_stream_equals_batch(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [("a.md", "create", t), ("a.md", "modify", t + timedelta(milliseconds=400)), ("a.md", "remove", t + timedelta(seconds=5)), ("b.md", "modify", t + timedelta(seconds=1)), (".git/c.md", "create", t), ("x.txt", "create", t), ("z.MD", "weird", t), ("end.md", "create", t + timedelta(hours=1))]
    source, seen = str(tmp_path / "in"), []
    spark.createDataFrame(rows, "path string, kind string, ts timestamp").coalesce(1).write.parquet(source)
    events = spark.readStream.schema("path string, kind string, ts timestamp").parquet(source)
    q = watch.watch(events, lambda batch, _: seen.extend((r.path, r.kind, r.n_events) for r in batch.collect()), str(tmp_path / "ck"), once=True)
    q.awaitTermination(120)
    batch = watch.debounce(watch.relevant(spark.read.parquet(source)), "1 second")
    want = {(r.path, r.kind, r.n_events) for r in batch.collect()}
    assert want == {("a.md", "modified", 2), ("a.md", "deleted", 1), ("b.md", "modified", 1), ("end.md", "created", 1)}
    assert set(seen) == want  # a single run flushes the last burst too
    assert {(r.path, r.kind, r.n_events) for r in watch.islands(watch.relevant(spark.read.parquet(source)), 1).collect()} == want


def test_plan_batch(spark):
    f = lambda rows: spark.createDataFrame(rows, "file_path string, checksum string")
    released = spark.createDataFrame([("old.md", "deleted"), ("new.md", "created"), ("same.md", "modified"), ("gone.md", "deleted"), ("more.md", "created")], "path string, kind string")
    plan = watch.plan_batch(released, f([("old.md", "1"), ("same.md", "2"), ("gone.md", "3")]), f([("new.md", "1"), ("same.md", "2"), ("more.md", "4")]))
    assert [(r.from_path, r.to_path) for r in plan["moves"].collect()] == [("old.md", "new.md")]
    assert [r.file_path for r in plan["index"].collect()] == ["more.md"] and [r.file_path for r in plan["remove"].collect()] == ["gone.md"]


def test_ignored_names(spark):
    paths = ["a/venv/x.md", "venv", "notes/target/x.md", "coverage/x.md", "a.egg-info/x.md", "config.json", "x.md", ".hid/x.md", "drafts/x.md", "a/b~"]
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path for r in frame.where(watch.ignored(F.col("path"), watch.patterns_of("# own\n\ndrafts/\n"))).collect()}
    assert got == {"a/venv/x.md", "venv", "a.egg-info/x.md", "config.json", ".hid/x.md", "drafts/x.md", "a/b~"}


def test_links_stay_in_their_project(spark):
    entities = spark.createDataFrame([(1, 1, "a/x", "a/x.md"), (2, 2, "a/x", "a/x.md"), (3, 2, "b", "b.md")], "id long, project_id long, permalink string, file_path string")
    targets = spark.createDataFrame([(1, 1, "a/x", None), (2, 2, "a/x|Label", None), (3, 1, "b", None), (4, 2, "b", 77)], "link long, project_id long, to_name string, to_id long")
    assert {r.link: r.to_id for r in indexing.resolve_links(targets, entities).collect()} == {1: 1, 2: 2, 3: None, 4: 77}
    assert {r.link: r.to_id for r in indexing.resolve_links(targets.drop("project_id"), entities).collect()} == {1: 1, 2: 1, 3: 3, 4: 77}


def test_filters_of_titles_and_permalinks(spark):
    rows = spark.createDataFrame([(1, "Alpha plan", "x/plan-77"), (2, "Alphabet", "x/plan-775"), (3, "Plan of alpha", "x/other")], "id long, title string, permalink string")
    pick = lambda f: {r.id for r in rows.withColumns({"type": F.lit("entity"), "metadata": F.lit("{}")}).where(filters.row_predicate(f)).collect()}
    assert pick(filters.Filters(permalink_match="77")) == {1} and pick(filters.Filters(permalink_match="PLAN")) == {1, 2} and pick(filters.Filters(permalink_match="x/*77*")) == {1, 2}
    assert pick(filters.Filters(title="alpha")) == {1, 3} and pick(filters.Filters(title="plan alpha")) == {1, 3}


def test_folders_match_in_either_case(spark):
    files = spark.createDataFrame([("Notes/A.md", "A", None), ("notes/b.md", "b", None), ("other/c.md", "c", None)], "file_path string, title string, updated_at timestamp")
    found, order = directory.listing(files, "NOTES")
    assert [r.path for r in found.orderBy(*order).collect()] == ["Notes/A.md", "notes/b.md"]
