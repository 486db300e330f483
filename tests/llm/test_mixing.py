from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lumora.llm.mixing import Mix, pfair_slots, weights, window_of

DOCS, PLAN = "doc_id bigint, source string, tokens bigint, slot string", "source string, target_share double, max_repeats bigint"


@pytest.mark.parametrize("shares", [{"a": 1, "b": 1}, {"a": 7, "b": 2, "c": 1}, {"a": 50, "b": 30, "c": 19, "d": 1}, {"a": 1}, {"a": 3, "b": 0}, {"a": 0.123456789, "b": 0.676543211, "c": 0.2}, {"a": 1e-6, "b": 0.999999}])
def test_each_source_stays_within_a_block_of_its_share(shares):
    w, q = weights(shares), 400
    slots = pfair_slots(w, {s: -(-q * x.numerator // x.denominator) for s, x in w.items()})
    assert len({t for s in slots.values() for t in s}) == sum(map(len, slots.values()))
    for s, own in slots.items():
        for i, t in enumerate(own, 1):
            release, deadline = window_of(i, w[s])
            assert release <= t < deadline
        for t in range(q + 1):
            assert abs(sum(x < t for x in own) - w[s] * t) < 1


def test_weights():
    assert weights({"a": 0.25, "b": 0.75, "c": 0.0, "d": None}) == {"a": Fraction(1, 4), "b": Fraction(3, 4)}
    assert weights({}) == {} and weights({"a": 0.0}) == {}


def mix(spark, docs, plan, **more):
    return Mix(spark.createDataFrame([(*d, "clash") for d in docs], DOCS), spark.createDataFrame(plan, PLAN), F.col("tokens"), **more)


def test_shares_and_caps(spark):
    docs = [(i, " Big " if i % 2 else "BIG", 10) for i in range(600)] + [(1000 + i, "small", 10) for i in range(100)] + [(2000 + i, "tiny", 10) for i in range(10)] + [(1, "other", 99), (2, None, 99), (3, "big", 0), (4, "big", None)]
    m = mix(spark, docs, [("big", 0.5, 1), ("Small", 0.4, 4), ("tiny", 0.1, 3), ("none", 0.0, 5)], block_tokens=20)
    assert m.size == 7100
    s = {r.source: r for r in m.shares(m.size).collect()}
    assert (s["big"].mix_tokens, s["big"].most_repeats) == (3550, 1) and (s["Small"].mix_tokens, s["Small"].most_repeats) == (2840, 3)
    assert (s["tiny"].mix_tokens, s["tiny"].most_repeats, s["tiny"].missed_tokens) == (300, 3, 410.0)
    assert [r.source for r in m.unreachable().collect()] == ["tiny"]
    a = m.assignments(m.size).collect()
    assert max(r.repeat_no for r in a) <= 3 and len({(r.doc_id, r.source, r.repeat_no) for r in a}) == len(a)
    # at every slot reached sources are within about a block of their share
    for name, share in (("big", 0.5), ("Small", 0.4)):
        for upto in range(10, 300, 37):
            tokens = sum(r.tokens for r in a if r.source == name and r.slot < upto)
            assert abs(tokens - share * upto * 20) <= 2 * 20


def test_streams_have_no_gaps(spark):
    m = mix(spark, [(i, "a", 1 + i % 7) for i in range(500)], [("a", 1.0, 1)])
    rows = sorted((r.position, r.tokens) for r in m.assignments().collect())
    at = 0
    for position, tokens in rows:
        assert position == at
        at += tokens
    assert at == m.size


def test_empty_and_odd_plans(spark):
    assert mix(spark, [], [("a", 1.0, 1)]).assignments().collect() == []
    assert mix(spark, [(1, "a", 5)], []).shares().collect() == []
    odd = mix(spark, [(1, "a", 5), (1, "a", 5)], [("a", None, None), ("A ", 0.5, 2), (None, 0.5, 1)])
    assert [(r.source, r.target_share, r.source_tokens) for r in odd.shares().collect()] == [("A", 0.5, 10)]


def test_the_largest_mix_is_on_target(spark):
    docs = [(i, "big", 10) for i in range(600)] + [(1000 + i, "small", 7) for i in range(100)] + [(2000 + i, "tiny", 3) for i in range(20)]
    m = mix(spark, docs, [("big", 0.5, 1), ("small", 0.4, 4), ("tiny", 0.1, 3), ("absent", 0.0, 1)], block_tokens=20)
    assert m.reach == 60 * 3 / 0.1 and m.missed().collect() == []
    for r in m.shares().collect():
        assert r.missed_tokens == 0 and abs(r.mix_tokens - r.target_share * m.reach) < 20 and abs(r.actual_share - r.target_share) < 0.02
    # beyond it exactly the blocks behind the supply of 180 tokens are late
    late = m.missed(m.reach * 1.5).collect()
    assert {r.source for r in late} == {"tiny"} and sum(r.missed_tokens for r in late) == pytest.approx(m.reach * 0.15 - 180)


def test_tiny_shares_and_few_slots(spark):
    docs = [(i, "big", 10) for i in range(600)] + [(1000, "tiny", 10)]
    m = mix(spark, docs, [("big", 0.999999, 1), ("tiny", 0.000001, 1)], block_tokens=20)
    a = m.assignments(m.size).collect()
    assert {r.source for r in a} == {"big", "tiny"} and all(r.slot is not None for r in a)
    few = mix(spark, docs, [("big", 0.9, 2), ("tiny", 0.1, 100)], block_tokens=1, max_slots=50)
    got = few.assignments(1000).collect()
    assert max(r.slot for r in got) <= 51 and sum(r.tokens for r in got if r.source == "tiny") == 100
