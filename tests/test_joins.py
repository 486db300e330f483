import random

from pyspark.sql import functions as F

from lumora.operators import duplicates, retrieval
from lumora.operators.joins import block_pairs, in_blocks, spread_join


def test_blocks_meet_each_pair_once(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(300)] + [("cold", i) for i in range(5)] + [(None, 1), (None, 2)], "key string, m int")
    left, right = in_blocks(rows, "key", "m", 40)
    pairs = left.join(right.withColumnRenamed("m", "o"), ["key", "_block"]).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("m", "o").alias("d")).collect()
    assert sorted(map(tuple, pairs)) == [("cold", 25, 25), ("hot", 90_000, 90_000)]
    assert left.filter("key = 'hot'").select("_block").distinct().count() == 8


def test_spread_join_gives_what_a_join_gives(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else f"k{i % 3}") for i in range(200)], "id int, k string")
    few = spark.createDataFrame([("k0", 1), ("k1", 2), ("k1", 3), ("k9", 4), (None, 5)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want, got = rows.join(few, "k", how), spread_join(rows, few, ["k"], "id", how)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_components_equal_brute_force_in_chunks(spark, monkeypatch):
    rng = random.Random(7)
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [(f"r{rng.randrange(80):03}", f"r{rng.randrange(80):03}") for _ in range(60)] + [("hub", f"h{i}") for i in range(50)]
    above = {x: x for e in edges for x in e}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for x, y in edges:
        low, high = sorted((top(x), top(y)))
        above[high] = low
    loops = {x for x, y in edges if x == y} - {x for x, y in edges if x != y} - {y for x, y in edges if x != y}
    want = {(x, top(x)) for x in above} - {(x, x) for x in loops}
    df = spark.createDataFrame(edges, "a string, b string").repartition(3)
    assert {tuple(r) for r in duplicates.components(df).collect()} == want
    parts = list(duplicates._stars(iter(spark.createDataFrame(edges, "node string, other string").toArrow().to_batches())))
    assert sum(p.num_rows for p in parts) < len(edges)


def test_many_parts_are_written_as_one(spark):
    parts = []
    for i in range(10):
        retrieval.gather(parts, spark.range(i, i + 1), 4)
    assert len(parts) < 4 and sorted(r.id for r in retrieval.united(parts).collect()) == list(range(10))


def test_pairs_of_blocks_meet_each_pair_once(spark):
    rows = spark.createDataFrame([("hot", i, 2) for i in range(150)] + [("cold", i, 2) for i in range(5)], "key string, m int, weight int")
    met = block_pairs(rows, "key", "m", "weight", 50)
    meet = met.alias("l").join(met.alias("r"), ["key", "i", "j"]).filter("l.m < r.m and (i = j or l.own <> r.own)")
    pairs = meet.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l.m", "r.m").alias("d")).collect()
    assert sorted(map(tuple, pairs)) == [("cold", 10, 10), ("hot", 150 * 149 // 2, 150 * 149 // 2)]
    assert met.filter("key = 'hot'").select("own").distinct().count() == 6
