from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lumora.llm.varied import hilbert_keys, varied_subset

SCHEMA = "id string, t string, g array<string>, cell string, key string, p string"


def subset(df, size):
    return varied_subset(df, "id", F.col("t"), F.col("g"), [F.col("id")], size).collect()


def test_curve_visits_every_cell_and_neighbours():
    points = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = hilbert_keys(points, 3)
    assert sorted(keys.tolist()) == list(range(512))
    walk = points[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_a_large_group_does_not_dominate(spark):
    kinds = ["mend the broken gate", "paint a wall in green", "carry stones uphill", "listen to old radio plays", "count birds before dawn", "bake bread with rye"]
    rows = [(f"a{i:04}", f"nightly sweep of n{i}x done", ["sweep"], "", "", "") for i in range(900)]
    rows += [(f"b{i:03}", f"{kinds[i % 6]} q{i}z", ["home"], "", "", "") for i in range(120)]
    got = subset(spark.createDataFrame(rows, SCHEMA), 12)
    n = Counter(r.t.split()[0] for r in got)
    assert len(got) == 12 and len({r.id for r in got}) == 12
    # nine tenths of the rows get about a share like any other kind's
    assert n["nightly"] <= 6 and len(n) >= 5


def test_sizes_ties_nulls_and_repeats(spark):
    rows = [("a", "same", None, "", "", ""), ("a", "same", None, "", "", ""), ("b", "same", None, "", "", ""), ("c", None, None, "", "", ""), ("d", " ", [None, ""], "", "", ""), (None, "x", None, "", "", ""), ("e", "long " * 50_000, ["t"], "", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    for size in (0, 1, 2, 3, 4, 5, 99):
        got = subset(df, size)
        assert len(got) == min(size, 5) and len({r.id for r in got}) == len(got)
    # one cell holds the blank ones: the smaller id comes first
    assert "c" in {r.id for r in subset(df, 3)}
    assert sorted(r.id for r in subset(df, 3)) == sorted(r.id for r in subset(df.repartition(5), 3))
    assert subset(df.limit(0), 3) == []
