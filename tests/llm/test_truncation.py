import random

from lumora.llm.truncation import endings, judged, length_hazards

SCHEMA = "doc_id bigint, text string, source string, n_chars bigint, kind string, word string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 0, "clash", "clash") for i, (t, s) in enumerate(rows)], SCHEMA)


def test_endings(spark):
    cases = [
        ("It is done.", "closed"), ("Done!  \n", "closed"), ("He said \"yes.\"", "closed"), ("これは終わりです。", "closed"), ("fix a typo", "line"), ("List:\n- one\n- two", "line"), ("Head\nSigned-off: me", "line"),
        ("This sentence stops in", "open"), ("Text\n```\ncode", "broken"), ('{"a": [1, 2', "broken"), ('{"a": 1}', "closed"), ("| a | b", "broken"), ("See (the", "broken"), ("Then,", "broken"), ("cut here�", "broken"), ("And so on...", "ellipsis"),
    ]
    got = {r.doc_id: r.kind for r in endings(docs(spark, [(t, "s") for t, _ in cases])).collect()}
    assert [(cases[i][0], got[i]) for i in range(len(cases))] == cases


def test_a_field_limit_is_found(spark):
    rng = random.Random(6)
    words = [w + v for w in ("ba", "cor", "dell", "fi", "golem", "s") for v in ("ka", "mint", "so", "turbo")]
    rows = []
    for _ in range(1500):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(10, 60))).capitalize() + "."
        rows.append((text[:200], "S "))
    long = {i for i, (t, _) in enumerate(rows) if not t.endswith(".")}
    df = docs(spark, rows)
    spikes = {(r.key, r.unit, r.length) for r in length_hazards(endings(df)).collect()}
    assert spikes == {("s", "chars", 200), ("s", "bytes", 200)}
    got = {r.doc_id for r in judged(df).filter("cut").collect()}
    assert len(got & long) >= 0.98 * len(long) and not got - long


def test_blank_repeats_long_and_empty(spark):
    rows = [(None, "a"), ("", "a"), (" \n　", None), ("Whole.", None), ("Whole.", None), ("One that stops in the", "b"), ("One that stops in the", "B "), ("word " * 100_000 + "end.", "a"), ("x" * 300_000, "a"), (" " * 100_000 + "Fine." + " " * 100_000, "a")]
    df = docs(spark, rows)
    got = {r.doc_id: r.cut for r in judged(df).collect()}
    assert set(got) == {3, 4, 5, 6, 7, 8, 9}
    assert got[3] is got[4] is False and got[5] is got[6] is True and got[7] is False and got[9] is False
    assert judged(df.limit(0)).collect() == []


def test_repeats_make_no_ending_usual(spark):
    words = [w + v for w in ("ba", "cor", "dell", "fi", "golem") for v in ("ka", "mint", "so", "turbo")]
    rng = random.Random(4)
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(10, 40))).capitalize() + ".", "s") for _ in range(60)]
    rows += [("One that stops in the", "s")] * 30
    got = {r.doc_id for r in judged(docs(spark, rows)).filter("cut").collect()}
    assert got == set(range(60, 90))


def test_brackets_opened_on_earlier_lines(spark):
    cases = [
        ("He noted (see the list\nbelow. It is done.", "broken"), ("He noted (see the list\nbelow). It is done.", "closed"), ("1) one.\n2) two.", "closed"), ("「これは\n終わり。", "broken"),
        ("Colour \x1b[31mred\x1b[0m.", "closed"), ("an array a[0\nof it all.", "broken"), ("f(x) {\n  g();\nthe end.", "broken"),
    ]
    got = {r.doc_id: r.kind for r in endings(docs(spark, [(t, "s") for t, _ in cases])).collect()}
    assert [(cases[i][0], got[i]) for i in range(len(cases))] == cases


def test_half_words_of_any_length(spark):
    from lumora.llm.truncation import half_words

    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdef") for _ in range(n))
    known = sorted({word(rng.randrange(1, 9)) for _ in range(300)} | {"q" * 500, "z" * 90})
    asked = sorted({w[: rng.randrange(1, len(w) + 1)] for w in known} | {"q" * 200, "zz", "zb", "a" * 300} | {word(rng.randrange(1, 9)) for _ in range(100)})
    rows = [(" ".join(known + known) + " end.", "s")] + [(f"- item {w}", "s") for w in asked]
    df = docs(spark, rows)
    got = {r.word for r in half_words(endings(df), df).collect()}
    inside = set(known) | {"item"}  # once in each of the other texts
    assert got == {w for w in asked if w not in inside and any(k.startswith(w) for k in inside)} and {"q" * 200, "zz"} <= got


def test_hazards_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [("y" * max(1, int(rng.gauss(60, 20))) + str(i) + ".", "s") for i in range(400)] + [(f"{i:03}" + "x" * 47, "s") for i in range(60)]
    ends = endings(docs(spark, rows))
    got = {r.length: (r.n, r.at_risk) for r in length_hazards(ends).filter("unit = 'chars'").collect()}
    lengths = [len(t) for t, _ in rows]
    assert got[50] == (lengths.count(50), sum(x >= 50 for x in lengths))
