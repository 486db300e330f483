"""Every registered query of the core beside its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

CORE = {name: q for m in entry.CORE for name, q in m.QUERIES.items()}
SQL = {name: s for m in entry.CORE for name, s in getattr(m, "ORACLES", {}).items()}


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


def rows(data, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{r[i]:.6g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(CORE))
def test_matches_sql(name, spark, sf, db):
    df = CORE[name](spark, sf)
    got = df.collect()
    if name in SQL:
        want = db.sql(SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows([tuple(r) for r in got], df.columns) == rows(want.fetchall(), want.columns)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "utility", "confidence", "retrievals"] and df.count() == 10
