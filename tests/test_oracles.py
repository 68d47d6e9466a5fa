"""Every query of the core runs on the small tables; those with SQL agree with it value by value."""

import glob
import os

import pandas as pd
import pytest

from foliospark.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def canonical(d: pd.DataFrame) -> list[tuple]:
    d = d[sorted(d.columns)].copy()

    def show(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "NULL"
        return repr(round(float(v), 6)) if isinstance(v, float) else str(v)

    return sorted(tuple(map(show, r)) for r in d.itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def duck(small):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, duck, name):
    got, want = QUERIES[name](spark, small).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.columns and df.count() >= 0


def test_entry(spark, small):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
