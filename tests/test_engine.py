"""A project from notes to answers: index, search, vectors, context, schemas, edits, changes."""

import pytest
from pyspark.sql import functions as F

from notelattice import engine
from notelattice.operators import filters, tables, vectors


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root, store = tmp_path_factory.mktemp("vault"), tmp_path_factory.mktemp("store")
    p = engine.Project(spark, "demo", str(root), str(store))
    p.write_note("Alpha", "projects", "- [decision] Use parquet files\n- led_by [[people/Ada]]\n", tags=["x"], metadata={"status": "open"})
    p.write_note("Ada", "people", "- [name] Ada L\n- [mail] a@x #m\n", note_type="person")
    p.write_note("Bob", "people", "- [name] Bob\n- works_on [[projects/Alpha]]\n", note_type="person")
    (root / "schema.md").write_text("---\ntitle: S\ntype: schema\nentity: person\nschema:\n  name: string\n  mail: string\nsettings:\n  validation: strict\n---\n")
    assert p.reindex() == {"added": 4, "updated": 0, "unchanged": 0, "removed": 0, "skipped": 0}
    return p


def test_search(project):
    got = project.search("parquet")
    assert [(r.title, r.leg) for r in got.results] == [("Alpha", "content_stems")] and got.total == 1 and not got.has_more
    assert [r.title for r in project.search("Ada", kind="title").results] == ["Ada"]
    assert [r.title for r in project.search("people/*", kind="permalink").results] == [] and {r.permalink for r in project.search("demo/people/*", kind="permalink").results} == {"demo/people/ada", "demo/people/bob"}
    assert [r.title for r in project.search(options=filters.Filters(types=("entity",), status="open")).results] == ["Alpha"]
    assert project.search("what is the qqq parquet thing").total == 1
    assert [r.title for r in engine.search_all([project], "parquet").results] == ["Alpha"]
    two = engine.search_all([project, project], "what is the qqq parquet thing", page_size=1)
    assert (len(two.results), two.total, two.has_more, two.total_is_exact) == (1, 2, True, True) and engine.search_all([project], "qqqq").total == 0


def test_title_and_permalink_legs(project):
    both = project.search("parquet", options=filters.Filters(types=("entity",), title="Alpha"))
    alone, titled = project.search("parquet"), project.search(options=filters.Filters(types=("entity",), title="Alpha"))
    assert [r.title for r in both.results] == [r.title for r in titled.results] == ["Alpha"]
    assert both.results[0].score < alone.results[0].score < 0 and titled.results[0].score < 0
    assert project.search("parquet", options=filters.Filters(types=("entity",), title="Ada")).total == 0
    assert [r.title for r in project.search("parquet", options=filters.Filters(types=("entity",), permalink_match="projects")).results] == ["Alpha"]
    people = project.search(options=filters.Filters(types=("entity",), permalink_match="people"))
    assert {(r.title, r.score) for r in people.results} == {("Ada", 0.0), ("Bob", 0.0)}
    # with a further leg, the words of the text may stand in different columns
    assert project.search("Alpha parquet", options=filters.Filters(types=("entity",), permalink_match="alpha")).total == 1
    assert not filters.asks_for_something(" ", filters.Filters(project_id=1)) and filters.asks_for_something(None, filters.Filters(status="open"))


def test_scopes_against_a_formula(project):
    import math

    index = project.index()
    rows = project.table("search_index").collect()
    n, average = len(rows), index.stats.first().avg_d
    size = {(r.type, r.id): r.d for r in index.sizes.collect()}
    at = {}
    for p in index.postings.where("term in ('ada', 'people') and column in ('title', 'permalink')").collect():
        if (p.term, p.column) in (("ada", "title"), ("people", "permalink")):
            at.setdefault(p.term, {})[(p.type, p.id)] = len(p.positions)

    def weight(term, key):
        idf = math.log((n - len(at[term]) + 0.5) / (len(at[term]) + 0.5))
        return (idf if idf > 0 else 1e-6) * at[term][key] * 2.2 / (at[term][key] + 1.2 * (0.25 + 0.75 * size[key] / average))

    want = {k: -weight("ada", k) - weight("people", k) for k in at["ada"].keys() & at["people"].keys()}
    got = {(r.type, r.id): r.score for r in index.match_scopes([("ada", ("title",)), ("people", ("permalink",))]).collect()}
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert index.match_scopes([("ada", ("title",)), ('"!"', ("permalink",))]).count() == 0


def test_documents_of_clients(project):
    assert project.search_documents("parquet") == {"results": [{"id": "demo/projects/alpha", "title": "Alpha", "url": "demo/projects/alpha"}], "total_count": 1, "query": "parquet"}
    got, miss = project.fetch("projects/Alpha"), project.fetch("no/such-note")
    assert got["metadata"] == {"format": "markdown"} and got["title"] == "Alpha" and "parquet" in got["text"]
    assert miss["metadata"] == {"error": "Document not found"} and miss["id"] == "no/such-note"


def test_context_and_listing(project):
    row = project.context("memory://projects/Alpha", depth=1, timeframe=None)
    assert (row.title, row.n_entities, row.n_relations) == ("Alpha", 2, 2) and row.observations[0].category == "decision"
    assert project.context("nothing/here") is None
    assert [r.path for r in project.directory(depth=2).results] == ["people", "projects", "people/Ada.md", "projects/Alpha.md", "people/Bob.md", "schema.md"]
    assert len(project.recent()) == 4 and project.status()["n_unresolved"] == 0


def test_schemas(project):
    assert {(r.n_errors, r.passed) for r in project.schema_validate("person").collect()} == {(0, True), (1, False)}
    assert {r.field: r.suggestion for r in project.schema_infer("person").collect()} == {"name": "required", "mail": "optional", "works_on": "optional"}
    assert {(r.field, r.change) for r in project.schema_diff("person").collect()} == {("works_on", "new")}
    assert [(r.field, r.message) for r in project.schema_findings("person").collect()] == [("mail", "Missing required field: mail (expected [mail] observation)")]
    assert [(r.source, r.field, r.n) for r in project.schema_unmatched("person").collect()] == [("relation", "works_on", 1)]
    assert [f.name for f in project.schema_for("people/Ada")[0]] == ["name", "mail"] and project.schema_for("Alpha") is None
    with pytest.raises(KeyError):
        project.schema_of("thing")


def test_findings_of_enums(spark):
    from notelattice.operators import schema

    values = spark.createDataFrame([(1, 2, "s", "x"), (1, 1, "s", "y"), (1, 3, "s", "a"), (2, 1, "s", "a"), (2, 2, "t", "q"), (9, 1, "s", "z")], "note long, place int, field string, value string")
    notes, fields = spark.createDataFrame([(1,), (2,), (3,)], "note long"), schema.field_table(spark, schema.parse_fields({"s(enum)": ["a", "b"], "boss": "Person"}))
    got = {(r.note, r.field): r.message for r in schema.findings(values, notes, fields).collect()}
    assert got[1, "s"] == "Field 's' has invalid value(s): y, x (allowed: a, b)" and got[3, "s"] == "Missing required field: s (expected [s] observation)"
    assert got[2, "boss"] == "Missing required field: boss (no 'boss [[...]]' relation found)" and len(got) == 5
    assert [(r.note, r.field, r.n) for r in schema.unmatched(values, fields).collect()] == [(2, "t", 1)]


def test_vectors(project):
    embed = lambda df: df.withColumn("embedding", F.when(F.contains("chunk_text", F.lit("parquet")), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).cast("array<float>"))
    first, second = project.reindex_embeddings(embed), project.reindex_embeddings(embed)
    assert first["embedded"] == first["chunks"] == second["chunks"] and second["embedded"] == 0
    page = project.search_vectors([1.0, 0.0])
    assert [r.title for r in page.results] == ["Alpha"] and "parquet" in page.results[0].matched_chunk
    fused = project.search_vectors([1.0, 0.0], text="parquet")
    assert fused.results[0].title == "Alpha" and abs(fused.results[0].score - 1.3) < 1e-6
    plain = [r.title for r in project.search_vectors([0.0, 1.0]).results]
    seen = []
    score = lambda asked, texts: seen.append((asked, texts)) or [k / 10 for k in range(len(texts))]
    turned = project.search_vectors([0.0, 1.0], asked="who", rerank=score)
    assert len(plain) > 1 and [r.title for r in turned.results] == plain[::-1] and turned.results[0].score == (len(plain) - 1) / 10
    assert seen[0][0] == "who" and [t.rsplit("\n", 1)[-1] for t in seen[0][1]] == plain
    with pytest.raises(ValueError):
        project.search_vectors([0.0, 1.0], asked="who", rerank=lambda asked, texts: [float("nan")] * len(texts))
    tail = vectors.rerank_rows([{"id": k} for k in range(4)], [0.2, 0.6], 2)
    assert [(r["id"], r["score"]) for r in tail] == [(1, 0.6), (0, 0.2), (2, 0.1), (3, 0.2 / 3)]


def test_mutations(project):
    with pytest.raises(FileExistsError):
        project.write_note("Alpha", "projects")
    with pytest.raises(ValueError):
        project.write_note("x", "../out")
    project.edit_note("projects/Alpha", "append", "- [fact] more")
    project.set_metadata("Alpha", {"status": "done"})
    assert project.move_note("people/Bob", "people/old/Bob.md") == "people/old/Bob.md"
    assert project.edit_note("new/Note", "append", "text") == "new/Note.md" and not project.delete_note("nope")
    change = project.reindex()
    assert (change["added"], change["updated"], change["removed"], change["unchanged"]) == (1, 1, 0, 3)  # the move is in the index already
    note = project.read_note("Alpha")
    assert note["found"] and len(note["observations"]) == 2 and not project.read_note("zzz")["found"]
    assert project.each_under("people", lambda p: None)["done"] == ["people/Ada.md", "people/old/Bob.md"]


def test_table_writes(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, file_path string")
    assert {(r.id, r.file_path) for r in tables.upsert(old, spark.createDataFrame([(2, "c"), (3, "d")], old.schema), ["id"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    moved = tables.move_document(old.withColumn("permalink", F.lit("p")), "a", "z/a", "q").collect()
    assert {(r.file_path, r.permalink) for r in moved} == {("z/a", "q"), ("b", "p")}
    path = str(tmp_path / "projects.json")
    engine.register(spark, path, "a", "/x")
    assert engine.register(spark, path, "b", "/y")["b"]["id"] == 2 and engine.register(spark, path, "a", "/z")["a"] == {"id": 1, "root": "/z"} and len(engine.registry(spark, path)) == 2
