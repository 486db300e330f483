from datetime import datetime

from pyspark.sql import functions as F

from lumora.llm import survivor

T = datetime(2025, 1, 1)


def test_informative(spark):
    df = spark.createDataFrame([(["A", " a ", "b", None, "", "N/A", "-"],), ([],), (None,), (["none", "/dev/null"],)], "x array<string>")
    assert [r[0] for r in df.select(survivor.informative(F.col("x"))).collect()] == [2, 0, 0, 0]


def test_usable_end(spark):
    rows = [(T, T.replace(day=2)), (T, T), (T, T.replace(day=8)), (T, datetime(2025, 1, 8, 0, 0, 1)), (T, datetime(2024, 12, 31)), (None, T), (T, None)]
    df = spark.createDataFrame(rows, "s timestamp_ntz, e timestamp_ntz")
    assert [r[0] is not None for r in df.select(survivor.usable_end(F.col("s"), F.col("e"))).collect()] == [True, True, True, False, False, False, False]


def test_members(spark):
    c = spark.createDataFrame([(1, "a", "x", 9), (1, "a", "y", 9), (1, "b", None, 9), (None, "a", "x", 9), (2, None, "x", 9), (2, "c", "unlisted", 9)], "cluster_id bigint, episode_id string, channel string, trust bigint")
    t = spark.createDataFrame([("x", 1), ("y", 3), (None, 7)], "channel string, trust bigint")
    assert sorted(map(tuple, survivor.members(c, t).collect())) == [(1, "a", 3), (1, "b", 0), (2, "c", 0)]


def test_survivors(spark):
    rows = [(1, "b", 2, 5), (1, "a", 2, 5), (1, "c", 9, None), (1, "d", 0, 9), (2, "e", 0, 1), (3, "f", 1, None), (3, "f", 1, None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "g bigint, m string, n bigint, t bigint, order string")
    fields = {"most": (F.col("n") > 0, [-F.col("n"), -F.col("t")]), "late": (F.col("t").isNotNull(), [-F.col("t")])}
    got = sorted(map(tuple, survivor.survivors(df, fields, "g", "m").collect()))
    assert got == [(1, "late", "d"), (1, "most", "c"), (2, "late", "e"), (3, "most", "f")]
    assert survivor.survivors(df.limit(0), fields, "g", "m").collect() == []


ROW = "g bigint, f string, v string, at bigint"


def test_currency_without_time_stamps(spark):
    # single is followed by married in two groups; the third has no times; the same words mean nothing in another field
    rows = [(1, "single", 1), (1, "married", 2), (2, "single", 1), (2, "single", 3), (2, "married", 4), (3, "single", None), (3, "single", None), (3, "married", None), (4, "only", None), (5, None, 1), (None, "x", 1)]
    df = spark.createDataFrame([(g, "f", v, at) for g, v, at in rows] + [(3, "other", "single", None), (3, "other", "single", None), (3, "other", "married", None)], ROW)
    learned = survivor.precedence(df, "g", "f", "v", "at")
    assert [tuple(r) for r in learned.collect()] == [("f", "single", "married", 2)]
    got = {(r.g, r.f): r.v for r in survivor.latest_values(df, learned, "g", "f", "v", "at").collect()}
    assert got == {(1, "f"): "married", (2, "f"): "married", (3, "f"): "married", (4, "f"): "only", (3, "other"): "single"}
    assert survivor.precedence(df.limit(0), "g", "f", "v", "at").collect() == []
    assert survivor.latest_values(df.limit(0), learned, "g", "f", "v", "at").collect() == []


def test_chains_without_time_stamps(spark):
    # a..e follow one another in a thousand groups of their own; in the last group only the order of values is known
    rows = [(g, "f", v, t) for g in range(1000) for t, v in enumerate("abcde")] + [(5000, "f", v, None) for v in "abdd"] + [(5001, "f", "e", 7), (5001, "f", "d", None), (5001, "f", "d", None)]
    df = spark.createDataFrame(rows, ROW)
    learned = survivor.precedence(df, "g", "f", "v", "at")
    assert sorted(map(tuple, learned.collect())) == [("f", x, y, 1000) for x, y in zip("abcd", "bcde")]
    got = {r.g: r.v for r in survivor.latest_values(df, learned, "g", "f", "v", "at").filter("g >= 5000").collect()}
    # nothing is known to follow b and d there, and d is more frequent; e follows d
    assert got == {5000: "d", 5001: "e"}


def test_a_cycle_falls_back_to_the_most_frequent(spark):
    learned = spark.createDataFrame([("f", "a", "b", 1), ("f", "b", "a", 1)], "f string, earlier string, later string, n bigint")
    df = spark.createDataFrame([(1, "f", "a", None), (1, "f", "b", None), (1, "f", "b", None)], ROW)
    assert [tuple(r) for r in survivor.latest_values(df, learned, "g", "f", "v", "at").collect()] == [(1, "f", "b")]
