"""Every query with an oracle against DuckDB on the same tables: columns, rows and values, whatever their order."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from notelattice.plans.oracles import ORACLES
from notelattice.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def form(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
            return "~"
        if isinstance(v, bool | np.bool_):
            return str(bool(v))
        return f"{v:.5f}" if isinstance(v, float) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(form(v) for v in row) for row in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry_and_registry(spark):
    frame = entry_module.entry(spark)
    assert frame.columns == ["type", "id", "leg", "score"] and frame.count() > 0
    assert set(ORACLES) <= set(QUERIES) and set(entry_module.oracle_sql()) <= set(entry_module.queries())
