import random

import pytest

from lumora.llm.canonical import Trie, closest, edits, limit_for, mapped

TAGS = [(1, "rate-limiting", ["throttling"]), (2, "cache-eviction", ["lru"]), (3, "unit-testing", None), (4, "unit-tasting", []), (5, None, ["only alias here"]), (6, "", [None, ""])]


def osa(a, b):
    """Edit distance in which an exchange of neighbours is one edit."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_equals_the_matrix():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(0, 8)))
    paths = {word() for _ in range(200)} - {""}
    trie = Trie()
    for i, p in enumerate(sorted(paths)):
        trie.add(p, 0, i)
    for _ in range(200):
        w = word()
        for limit in (0, 1, 2, 3):
            assert {(d, p) for d, _, _, p in trie.within(w, limit)} == {(d, p) for p in paths if (d := osa(w, p)) <= limit}


def test_edits():
    assert [edits("abc", "abc"), edits("ab", "ba"), edits("ca", "abc"), edits("", "ab")] == [0, 1, 2, 2]


@pytest.mark.parametrize(
    "value, want",
    [
        ("Rate Limiting", 1), ("rate_limitnig", 1), ("limiting, rate", 1), ("THROTTLING", 1), ("ｒａｔｅ-ｌｉｍｉｔｉｎｇ", 1), ("räte-limiting", 1), ("r@te-l1miting", 1), ("the rate limiting", 1),
        ("lru", 2), ("lrv", -1), ("weather", -1), ("only alias here", 5), ("unit-tosting", -1), ("unit-testing", 3), (None, None), ("", None), (" \t ", None), ("🙂", -1), ("x" * 100_000, -1),
    ],
)
def test_closest(value, want):
    assert closest(Trie.of(TAGS), value) == want


def test_limits_grow_with_length():
    assert [limit_for(n) for n in (1, 4, 5, 7, 8, 50)] == [0, 0, 1, 1, 2, 2]


def test_mapped(spark):
    ref = spark.createDataFrame(TAGS, "tag_id bigint, tag string, aliases array<string>")
    values = spark.createDataFrame([(1, "rate limiting", "x"), (1, "rate limiting", "x"), (2, None, "y"), (3, " ", "z"), (4, "nothing", None)], "id int, value string, tag_id string")
    got = sorted((r.id, r.entry_id) for r in mapped(values, "value", ref, "id").collect())
    assert got == [(1, 1), (1, 1), (4, -1)]
    assert mapped(values.limit(0), "value", ref, "id").collect() == []
    assert {r.entry_id for r in mapped(values, "value", ref.limit(0), "id").collect()} == {-1}


def test_long_entries_and_many_words():
    long = "".join(chr(97 + i * i % 26) for i in range(250))
    trie = Trie.of([*TAGS, (7, long, None), (8, "one two three four five", ["alpha beta gamma delta"]), (9, "a very long title of some eight words", None)])
    assert closest(trie, long) == 7 and closest(trie, "x" + long[:-1]) == 7 and closest(trie, long * 2) == -1
    assert closest(trie, "five four three two one") == 8 and closest(trie, "delta-gamma alpha BETA") == 8 and closest(trie, "fourr one five two three") == 8
    assert closest(trie, "the a very long title of some eight words") == 9 and closest(trie, "words eight a long title of some very") == 9


def test_a_hot_value_is_walked_once(spark):
    ref = spark.createDataFrame(TAGS, "tag_id bigint, tag string, aliases array<string>")
    values = spark.createDataFrame([(i, "rate limitng" if i % 3 else f"other {i}") for i in range(3000)], "id int, value string")
    got = {r.id: r.entry_id for r in mapped(values, "value", ref, "id").collect()}
    assert got == {i: 1 if i % 3 else -1 for i in range(3000)}
