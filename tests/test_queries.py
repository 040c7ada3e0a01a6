"""Every query that has SQL gives the same rows in another engine."""

import math

import pytest

import __spark_entry__ as entry
from proofmill.plans import catalog

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return "NaN" if isinstance(v, float) and math.isnan(v) else repr(v + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, other, name):
    df, sql = catalog.QUERIES[name](spark, SF), other.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    places = [sql.columns.index(c) for c in df.columns]
    ours = sorted(tuple(map(plain, r)) for r in df.collect())
    assert ours == sorted(tuple(plain(r[i]) for i in places) for r in sql.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
