"""Every query against its SQL on the smallest tables, and the entry points."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lakewarden.plans import catalogue


def _plain(x):
    if x is None or x != x:
        return None
    return x.item() if hasattr(x, "item") else x


def _sorted(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(None if str(x) in ("<NA>", "nan", "NaT", "None") else _plain(x) for x in r) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, sf, name):
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    if name not in catalogue.ORACLES:
        assert len(got)
        return
    want = duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = _sorted(got), _sorted(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-12) for p, q in zip(x, y)), (x, y)


def test_entry_gives_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"id", "risk", "band", "status"} <= set(df.columns)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
