"""Inputs on which an operator of the engine once did less than its whole job."""

import numpy as np
import pyarrow as pa

from notelattice.functions import batches, markdown
from notelattice.operators import fulltext, indexing, vectors
from notelattice.plans import queries
from notelattice.plans.queries import QUERIES


def test_rerank_with_many_scores(spark):
    ranked = spark.range(1, 41).selectExpr("id", "id as pos")
    scores = spark.range(5000, 0, -1, 1).where("id <> 3").selectExpr("id", "0.5 + id / 10000.0 as rerank_score")
    got = {r.id: (r.pos, round(r.score, 6)) for r in vectors.rerank(ranked, scores, ["id"]).collect()}
    assert len(got) == 40 and got[3] == (3, 0.0) and got[20] == (20, 0.502) and got[21] == (21, 0.0)


def test_long_observations_stay_apart(spark, tmp_path):
    rows = [(1, 1, "user", "a b " * 100 + "x"), (1, 2, "user", "a b " * 100 + "y")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert QUERIES["observation_permalinks"](spark, str(tmp_path)).select("permalink").distinct().count() == 2


def test_batch_asks_all_items(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("text <> ''").count()
    got = QUERIES["fts_query_batch"](spark, sf_dir)
    assert got.select("item_id").distinct().count() == items and got.count() > items


def test_ranks_of_a_table_whose_ranges_are_sampled(spark):
    rows = spark.range(0, 200_000, 1, 8).selectExpr("id as n", "lpad(cast((id * 7919) % 200000 as string), 6, '0') as key", "repeat('x', 20) as other")
    assert indexing.ranked(rows, ["key"], after=5).where("id <> (n * 7919) % 200000 + 6").count() == 0


def test_slices_hold_all_rows_and_few_bytes():
    texts = ["x" * n for n in (5, 0, 3, 40, 1, 1, 9, 0)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(texts)], ["n", "text"])
    got = list(batches.slices(iter([batch.slice(1), batch.slice(0, 0), batch.slice(0, 1)]), batches.text_sizes(1), 10))
    assert [x for part in got for x in part.column(0).to_pylist()] == [*range(1, 10), 0]
    assert all(len(part) == 1 or sum(len(t or "") for t in part.column(1).to_pylist()) <= 10 for part in got)


def test_notes_of_one_batch_are_parsed_and_edited_in_slices():
    """A batch of many long texts once became one batch of all its results."""
    texts = [f"# Note {n}\n- [size] {n} x #a\n" + "word " * 20_000 for n in range(100)] + [None]
    notes = pa.RecordBatch.from_arrays([pa.array([f"{n}.md" for n in range(101)]), pa.array(texts)], ["file_path", "text"])
    parsed = list(markdown._parsed(iter([notes]), 0, 1))
    assert max(x.column(1).nbytes for x in parsed) <= 2 * batches.SLICE_BYTES and sum(map(len, parsed)) == 101
    assert [o[0]["content"] for x in parsed for o in x.column("observations").to_pylist() if o] == [f"{n} x #a" for n in range(100)]
    edited = list(queries._edited(iter([pa.RecordBatch.from_arrays([pa.array(range(101)), pa.array(texts)], ["doc_id", "text"])])))
    assert max(x.nbytes for x in edited) <= 2 * batches.SLICE_BYTES
    assert [t for x in edited for t in x.column(1).to_pylist()] == [f"## Intro\n{t or ''}\n## End\nReplaced." for t in texts]


def test_postings_of_one_batch_come_in_sorted_runs():
    """A batch was once gathered as a whole, whatever its size."""
    rng = np.random.default_rng(5)
    words = np.array(["a", "é", "z", "中", "\U0001f600b", "term"])
    lists = [words[rng.integers(0, 6, n)].tolist() for n in (0, 600_000, 3, 500_000, 700_000)] + [None]
    kind = pa.list_(pa.string())
    batch = pa.RecordBatch.from_arrays([pa.array(["e"] * 6), pa.array(range(6)), pa.array(range(6)), pa.array([["t"]] * 6, kind), pa.array(lists, kind), pa.array([None] * 6, kind), pa.array([[]] * 6, kind)], ["type", "id", "owner", *(f"t_{c}" for c in fulltext.INDEXED)])
    got, seen = list(fulltext._gathered(iter([batch]))), {}
    for part in got:
        rows = part.to_pylist()
        assert sum(len(r["positions"]) for r in rows) <= fulltext.RUN and [r["term"].encode() for r in rows] == sorted(r["term"].encode() for r in rows)
        seen |= {(r["column"], r["id"], r["term"]): r["positions"] for r in rows}
    want = {("title", i, "t"): [0] for i in range(6)}
    for i, tokens in enumerate(lists):
        for term in set(tokens or ()):
            want["content_stems", i, term] = np.flatnonzero(np.array(tokens) == term).tolist()
    assert seen == want


def test_an_index_is_written_where_its_rows_are(spark, tmp_path):
    """Postings were once dealt anew by term, and tokens written beside them; a row without tokens still has a size."""
    rows = spark.range(0, 300, 1, 3).selectExpr("'entity' as type", "id", "if(id = 7, null, concat('Doc ', id)) as title", "if(id = 7, '', 'one two one') as content_stems", "cast(null as string) as content_snippet", "'' as permalink")
    index = fulltext.write_index(rows, str(tmp_path / "text"))
    assert len(list((tmp_path / "text" / "postings").glob("*.parquet"))) == 3 and not (tmp_path / "text" / "tokens").exists()
    assert {(r.d, r["count"]) for r in index.sizes.groupBy("d").count().collect()} == {(0, 1), (5, 299)}
    assert index.stats.first().n_rows == 300 and index.match("one").count() == 299
