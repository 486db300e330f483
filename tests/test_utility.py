"""Scores and propagation against values worked out by hand and against literal loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumora.functions.utility import combined, confidence, decay, share, whole_days, wilson
from lumora.operators import propagation, store

SLIM = "id string, project string, started timestamp, ended timestamp, raw_prompt string, intent string, task_type string, tags array<string>, status string, learned double, retrievals bigint, helpful bigint, last_retrieval timestamp"
T0 = datetime(2025, 1, 1)


def episode(id, project="p", start=0, minutes=10, tags=(), status="success", learned=None, n=0, k=0, last=None, task="docs"):
    return (id, project, T0 + timedelta(minutes=start), T0 + timedelta(minutes=start + minutes), "do it", "do it", task, list(tags), status, learned, n, k, last)


@pytest.mark.parametrize("k, n, want", [(0, 0, 0.5), (0, 1, 0), (1, 1, 0.206543), (1, 2, 0.094529), (2, 2, 0.342372), (2, 3, 0.207655), (3, 3, 0.438494), (5, 10, 0.23659), (10, 10, 0.72246)])
def test_wilson(spark, k, n, want):
    assert spark.range(1).select(wilson(F.lit(k), F.lit(n))).first()[0] == pytest.approx(want, abs=1e-6)


def test_scalars(spark):
    r = spark.range(1).select(
        decay(F.lit(30)), decay(F.lit(-3)), combined(F.lit(0.5), F.lit(1.0), 0.7), confidence(F.lit(0)), confidence(F.lit(2)), confidence(F.lit(5)), confidence(F.lit(6)),
        share(F.lit(1), F.lit(0)), whole_days(F.lit(T0 + timedelta(hours=47)), F.lit(T0)), whole_days(F.lit(T0), F.lit(T0 + timedelta(hours=47))),
    ).first()
    assert [round(x, 6) if isinstance(x, float) else x for x in r] == [0.7397, 1.0, 0.85, "untested", "low confidence", "moderate confidence", "high confidence", 0.0, 1, -1]


def test_decay_starts_after_a_day(spark):
    e = spark.createDataFrame([episode(str(d), last=T0 - timedelta(days=d)) for d in (0, 1, 2, 30, 100)], SLIM)
    got = {r.id: (r.decays, round(r.new_learned, 6)) for r in propagation.decayed(e, F.lit(T0)).collect()}
    assert got == {"0": (False, 0.5), "1": (False, 0.495), "2": (True, 0.49005), "30": (True, 0.36985), "100": (True, 0.183016)}


@pytest.mark.parametrize(
    "sources, target, want",
    [([(2, 2, 0.9)], None, 0.477732), ([(10, 10, 0.9)], None, 0.5), ([(10, 10, 1.0)], None, 0.515021), ([(2, 2, 0.9), (10, 10, 1.0)], None, 0.49498), ([(10, 10, 1.0), (2, 2, 0.9)], None, 0.491251), ([(3, 3, 0.8)], 0.1, 0.121572)],
)
def test_similarity_propagation_is_a_fold(spark, sources, target, want):
    # the newest source comes first
    rows = [episode("t", learned=target)] + [episode(f"s{i}", start=1000 - i, n=n, k=k) for i, (k, n, _) in enumerate(sources)]
    edges = spark.createDataFrame([(f"s{i}", "t", s, 1) for i, (_, _, s) in enumerate(sources)] + [("t", "t", 1.0, 1), ("s0", "gone", 1.0, 2)], "source string, target string, similarity double, hit_rank int")
    got = propagation.similarity_propagated(spark.createDataFrame(rows, SLIM), edges).collect()
    assert [(r.id, round(r.new_learned, 6), r.n_sources) for r in got] == [("t", pytest.approx(want, abs=1e-6), len(sources))]


def test_empty_edges(spark):
    e = spark.createDataFrame([episode("a")], SLIM)
    assert propagation.similarity_propagated(e, spark.createDataFrame([], "source string, target string, similarity double, hit_rank int")).collect() == []


def literal_credit(rows):
    """The walk back from each success, as it is told in words."""
    out, rows = {}, sorted(rows, key=lambda r: (r[2], r[0]))
    old = {r[0]: 0.5 if r[9] is None else r[9] for r in rows}
    for i, s in enumerate(rows):
        if s[8] != "success":
            continue
        for j in range(i - 1, -1, -1):
            t = rows[j]
            if s[2] - t[3] > timedelta(hours=1):
                break
            if i - j < 5 and (t[1] == s[1] or set(t[7]) & set(s[7])):
                new = min(1.0, old[t[0]] + 0.9 * (1 - 0.2 * (i - j)) * 0.1)
                if new > old[t[0]] + 0.01:
                    out[t[0]] = round(new, 6)
    return out


def test_time_credit_equals_the_walk(spark, monkeypatch):
    rng = random.Random(3)
    rows = [episode(f"{i:03}", rng.choice("pq"), rng.randrange(4000), rng.randrange(60), rng.sample("abcdef", rng.randrange(3)), rng.choice(["success", "failure"]), rng.choice([None, 0.3, 0.995])) for i in range(300)]
    e = spark.createDataFrame(rows, SLIM)
    want = literal_credit(rows)
    assert {r.id: round(r.new_learned, 6) for r in propagation.time_credited(e).collect()} == want
    # short stretches: what lies behind their ends must be seen all the same
    plain = propagation.stretches
    monkeypatch.setattr(propagation, "stretches", lambda df, keys, ahead: plain(df, keys, ahead, length=7))
    assert {r.id: round(r.new_learned, 6) for r in propagation.time_credited(e).collect()} == want


def test_tags_move_towards_their_average(spark):
    rows = [episode("a", tags=["X"], n=3, k=3, task="docs"), episode("b", tags=["x"], n=3, k=0, task="test"), episode("c", tags=["lone"], n=3, k=0, task="debug")]
    got = propagation.tag_propagated(spark.createDataFrame(rows, SLIM)).collect()
    assert [(r.id, r.tag, round(r.new_learned, 6)) for r in got] == [("b", "x", 0.021925)]


def test_prune_protects_the_helpful(spark):
    rows = [episode("old", start=-60 * 24 * 300), episode("kept", start=-60 * 24 * 300, n=2, k=1), episode("low", learned=0.1), episode("fine", learned=0.4)]
    got = propagation.prunable(spark.createDataFrame(rows, SLIM), F.lit(T0 + timedelta(days=1)), 100, 0.2).collect()
    assert {r.id: (r.pruned, r.reasons) for r in got} == {"old": (True, "age 301 days"), "kept": (False, "age 301 days;low utility"), "low": (True, "low utility"), "fine": (False, "")}


def test_snapshots(spark):
    e = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "id string, n int, s string")
    changed = store.updated(e, spark.createDataFrame([("b", 5), ("z", 9)], "id string, n int"))
    assert sorted(map(tuple, changed.collect())) == [("a", 1, "x"), ("b", 5, None)]
    assert [r.id for r in store.deleted(e, spark.createDataFrame([("a",), ("a",)], "id string")).collect()] == ["b"]
    new = store.upserted(e, spark.createDataFrame([("b", 7, "y"), ("c", 8, "z")], "id string, n int, s string"))
    assert sorted(map(tuple, new.collect())) == [("a", 1, "x"), ("b", 7, "y"), ("c", 8, "z")]
