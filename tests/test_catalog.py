"""Every query with SQL against DuckDB on the smallest tables, in any order of rows."""

import math
import os

import duckdb
import pytest

from colloquy.plans import catalog, more, speech  # noqa: F401  the others add their queries to the first

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(D):
        path = f"{D}/{f}" + ("/*.parquet" if os.path.isdir(f"{D}/{f}") else "")
        c.execute(f"create view {f[:-8]} as select * from read_parquet('{path}')")
    return c


def rows(df):
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 9) if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f" else v
    return sorted(repr([int(x) if hasattr(x, "dtype") and x.dtype.kind in "iu" else x for x in map(plain, r)]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, D).toPandas(), duck.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    num = [c for c in got.columns if got[c].dtype.kind == "f" or want[c].dtype.kind == "f"]
    for c in num:
        got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, D).count() > 0
