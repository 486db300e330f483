"""Every query of the subpackage runs, and those with SQL give the same rows."""

import os

import duckdb
import pytest

from lumora.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(name, spark, sf):
    df = queries.QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    if name in queries.ORACLES:
        c = duckdb.connect()
        for f in os.listdir(sf):
            c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
        want = c.sql(queries.ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns)
        order = lambda rows, cols: sorted(tuple(f"{r[i]:.6g}" if isinstance(r[i], float) else str(r[i]) for i in sorted(range(len(cols)), key=cols.__getitem__)) for r in rows)
        assert order(got, df.columns) == order(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", [n for n in sorted(queries.QUERIES) if not n.startswith(("p7_roundtrip", "p7_counts"))])
def test_empty_tables(name, spark, sf, tmp_path):
    for f in os.listdir(sf):
        spark.read.parquet(f"{sf}/{f}").limit(0).write.parquet(str(tmp_path / f))
    assert queries.QUERIES[name](spark, str(tmp_path)).collect() == []
