import random

import numpy as np
from pyspark.sql import functions as F

from lumora.operators import retrieval


def test_text_similarity(spark):
    q = spark.createDataFrame([(1, "fix auth bug"), (2, "database migration"), (3, None), (4, "  ")], "query_id int, text string")
    t = spark.createDataFrame([("a", "fix authentication bug"), ("b", None), ("c", "")], "id string, text string")
    got = retrieval.text_hits(q, t, 5, 0.01).collect()
    assert [(r.query_id, r.id, r.similarity) for r in got] == [(1, "a", 1.0)]


def test_text_hits_equal_brute_force_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    rng = random.Random(2)
    words = ["alpha", "beta", "gam", "gamma", "de", "delta"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    qs, ts = [(i, make(rng.randrange(1, 5))) for i in range(40)], [(f"{i:02}", make(rng.randrange(1, 9))) for i in range(50)]
    want = set()
    for i, q in qs:
        scored = []
        for j, t in ts:
            own = q.split()
            m = sum(w in t for w in own)
            s = m / (len(own) + len(t.split()) - m)
            if m and s >= 0.4:
                scored.append((-s, j))
        want |= {(i, j) for _, j in sorted(scored)[:3]}
    got = retrieval.text_hits(spark.createDataFrame(qs, "query_id int, text string"), spark.createDataFrame(ts, "id string, text string"), 3, 0.4)
    assert {(r.query_id, r.id) for r in got.collect()} == want


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((80, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [1.0]), (102, [0.0] * 8), (103, [float("nan")] * 8)]
    v = spark.createDataFrame(rows, "id int, vector array<double>")
    got = retrieval.vector_hits(v.filter("id < 10 or id > 99").withColumnRenamed("id", "query_id"), v, 4, 8)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(q, int(i)) for q in range(10) for i in np.argsort(-(u @ u[q]))[:4]}
    assert {(r.query_id, r.id) for r in got.collect()} == want


def test_varied_choice(spark):
    hits = spark.createDataFrame([(1, "a", 0.9, "same words"), (1, "b", 0.85, "same words"), (1, "c", 0.6, "others"), (2, "d", 0.1, None), (2, "e", 0.1, None)], "q int, i string, s double, t string")
    got = retrieval.diversified(hits, "q", "i", "s", F.col("t"), 2).collect()
    # ties end at the later one, but for the first pick
    assert sorted((r.q, r.pick, r.i) for r in got) == [(1, 1, "a"), (1, 2, "c"), (2, 1, "d"), (2, 2, "e")]


def test_copies_end_at_the_smaller_id(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 8))
    x[rng.permutation(3000)[:1500]] = x[7]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, vector array<double>").coalesce(1)
    q = spark.createDataFrame([(1, x[7].tolist())], "query_id int, vector array<double>")
    want = [i for i in range(3000) if (x[i] == x[7]).all()][:10]
    assert sorted(r.id for r in retrieval.vector_hits(q, v, 10, 8).collect()) == want


def test_a_hit_beyond_a_thousand_is_picked(spark):
    rows = [(1, f"a{i:04}", 0.9 - i * 1e-5, "same words") for i in range(1200)] + [(1, "z", 0.7, "others")]
    hits = spark.createDataFrame(rows, "q int, i string, s double, t string")
    got = retrieval.diversified(hits, "q", "i", "s", F.col("t"), 3).collect()
    assert sorted((r.pick, r.i) for r in got) == [(1, "a0000"), (2, "z"), (3, "a0001")]
