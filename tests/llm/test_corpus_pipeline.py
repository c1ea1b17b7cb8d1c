"""The corpus pipeline: each stage on its own input, and the whole run against the stages one after another."""

import corpus_pipeline
import pytest

from notelattice.llm import decontaminate, queries


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out, folder = [docs], tmp_path_factory.mktemp("stages")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(folder / str(k))
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages(spark, sf_dir, stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and all(s.columns == stages[0].columns for s in stages[1:-1])
    sizes = [s.count() for s in stages]
    assert all(a >= b for a, b in zip(sizes, sizes[1:], strict=False)) and sizes[-1] > 0.3 * sizes[0]
    items = [decontaminate.normalize(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(i in decontaminate.normalize(r.text) for r in stages[4].collect() for i in items)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    good = [d for d, q in labels.items() if q]
    assert sum(d in kept for d in good) > 0.85 * len(good)
    assert all(r.lossless and r.n_pieces == len(r.ids) for r in stages[5].collect())
    texts = [r.text for r in stages[3].collect()]
    assert len(set(texts)) == len(texts)


def test_run_equals_stages(spark, sf_dir, stages):
    got = {(r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {(r.doc_id, tuple(r.ids)) for r in stages[-1].collect()}


def test_queries_are_registered():
    import __spark_entry__ as entry_module

    names = entry_module.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names) and len(queries.QUERIES) == 10
