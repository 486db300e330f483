import itertools
import random
from collections import Counter

import pytest

from lumora.llm.cooccurrence import pair_counts

SCHEMA = "part string, record bigint, item bigint, n string"


def brute(baskets):
    one, two = Counter(), Counter()
    for b in baskets.values():
        one.update(b)
        two.update(itertools.combinations(sorted(b), 2))
    return one, two


def test_equals_brute_force(spark):
    rng = random.Random(8)
    # a third of all records are one and the same basket
    baskets = {i: {1, 2, 3} if i % 3 == 0 else {rng.randrange(12) for _ in range(rng.randrange(0, 5))} for i in range(300)}
    rows = [("p", r, x, "clash") for r, b in baskets.items() for x in b for _ in range(rng.choice([1, 2]))]
    one, two = brute(baskets)
    for support in (1, 5, 20):
        got = pair_counts(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("p", len(baskets))], "part string, n bigint"), support).collect()
        assert {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in got} == {p: (c, one[p[0]], one[p[1]], 300) for p, c in two.items() if c >= support}
        for r in got:
            assert r.lift == pytest.approx(r.n_ab * r.n / (r.n_a * r.n_b))
            assert (r.conviction is None) == (r.n_ab == r.n_a)


def test_parts_nulls_and_empty(spark):
    rows = [("p", 1, 1, ""), ("p", 1, 2, ""), ("q", 1, 1, ""), ("q", 2, 2, ""), (None, 1, 1, ""), (None, 1, 2, ""), ("p", None, 1, ""), ("p", None, 2, ""), ("p", 3, None, ""), ("p", 3, 1, "")]
    sizes = spark.createDataFrame([("p", 2), ("q", 2)], "part string, n bigint")
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r)[:4] for r in pair_counts(df, sizes).collect()] == [("p", 1, 2, 1)]
    assert pair_counts(df.limit(0), sizes).collect() == []
