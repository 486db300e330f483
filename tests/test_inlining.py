import json
import random

from lumora.operators.inlining import ROOT, inline
from lumora.plans import nested

FULL = {
    "intent": {"rawPrompt": "p", "domain": ["a", None, "b"]},
    "context": {"files_read": "alone.rs", "errors_encountered": {"1": {"message": "m", "attempts": [{"n": 1}, None, {"n": 2}]}, "0": None}},
    "retrieval_history": [],
}


def found(spark, *payloads):
    raw = spark.createDataFrame([(i, p, "clash", "x") for i, p in enumerate(payloads)], "raw_id bigint, payload string, element string, pos string")
    return sorted(map(tuple, nested.found(raw).collect()))


def test_found(spark):
    assert found(spark, json.dumps(FULL)) == [(0, "attempt", 1, 0), (0, "attempt", 1, 2), (0, "domain", -1, 0), (0, "domain", -1, 2), (0, "error", -1, 1), (0, "files_read", -1, 0)]


def test_wrapped_and_key_styles(spark):
    wrapped = {"meta": 1, "data": [{"payload": json.dumps({"intent": {"domain": '["x", "y"]'}, "retrieval-history": [{"wasHelpful": True}]})}]}
    assert found(spark, "﻿" + json.dumps(wrapped), json.dumps(json.dumps({"intent": {"domain": ["z"]}}))) == [(0, "domain", -1, 0), (0, "domain", -1, 1), (0, "retrieval", -1, 0), (1, "domain", -1, 0)]


def test_unreadable(spark):
    assert found(spark, None, "", " ", "{", '{"intent": {"domain": ["a"', "[]", "1", '"text"', '{"other": 1}', "[" * 5000) == []
    assert found(spark) == []


def test_tables_and_foreign_keys(spark):
    raw = spark.createDataFrame([(7, json.dumps(FULL))], "raw_id bigint, payload string")
    got = inline(raw, "raw_id", "payload", nested.EPISODE_KEYS, nested.CHILDREN)
    root = got.table(ROOT).collect()
    assert len(root) == 1 and root[0]["intent.raw_prompt"] == "p"
    errors = got.table("errors_encountered").collect()
    attempts = got.table("attempts").collect()
    assert {a.parent_row_id for a in attempts} == {e.row_id for e in errors} and sorted(a.n for a in attempts) == ["1", "2"]


def test_shared_and_recursive_elements_get_tables(spark):
    doc = {"intent": {"part": {"v": 1, "part": {"v": 2}}}, "context": {"owner": {"name": "a"}}, "reviewer": {"owner": {"name": "b"}}}
    got = inline(spark.createDataFrame([(1, json.dumps(doc))], "id int, t string"), "id", "t", ("intent",))
    assert {"part", "owner"} <= got.plan.tables
    assert sorted(r.v for r in got.table("part").collect()) == ["1", "2"] and sorted(r.name for r in got.table("owner").collect()) == ["a", "b"]


def test_round_trip_of_random_lists(spark):
    rng = random.Random(1)
    docs = [{"intent": {"domain": [rng.choice([None, "x", "y" * 1000]) for _ in range(rng.randrange(6))]}} for _ in range(50)]
    want = sorted((i, "domain", -1, p) for i, d in enumerate(docs) for p, v in enumerate(d["intent"]["domain"]) if v is not None)
    assert found(spark, *map(json.dumps, docs)) == want


def test_one_odd_payload_moves_no_children(spark):
    from lumora.plans.nested import episode_rows, found

    normal = {"id": "a", "intent": {"extracted_intent": "x", "domain": ["t", "u"]}, "context": {"files_read": ["f"], "errors_encountered": [{"message": "m"}, {"attempts": ["p"]}]}}
    odd = [
        {"id": "b", "intent": [{"extracted_intent": "y", "domain": ["t"]}], "context": {}},
        {"id": "b", "intent": {"0": {"extracted_intent": "y", "domain": ["t"]}}, "retrieval_history": [{"context": {"files_read": ["not its own"]}}]},
        {"id": "b", "intent": {"extracted_intent": "y", "domain": ["t"]}, "context": {"errors_encountered": [{}, {"context": {"attempts": ["q"]}}]}},
    ]
    own = {(1, "domain", -1, 0), (1, "domain", -1, 1), (1, "files_read", -1, 0), (1, "error", -1, 0), (1, "error", -1, 1), (1, "attempt", 1, 0)}
    more = [set(), {(2, "retrieval", -1, 0)}, {(2, "error", -1, 0), (2, "error", -1, 1), (2, "attempt", 1, 0)}]
    for o, m in zip(odd, more):
        raw = spark.createDataFrame([(1, json.dumps(normal)), (2, json.dumps(o))], "raw_id bigint, payload string")
        assert sorted(tuple(r) for r in found(raw).collect()) == sorted(own | {(2, "domain", -1, 0)} | m)
        assert sorted((r.raw_id, r.episode_id, r.extracted_intent) for r in episode_rows(raw).collect()) == [(1, "a", "x"), (2, "b", "y")]


def test_any_depth(spark):
    from lumora.operators.inlining import _deep, _dumps

    n = 20_000
    deep = '{"intent": {"domain": ["a"]}, "x": ' + '{"part": ' * n + "1" + "}" * n + ', "y": ' + "[" * n + "2" + "]" * n + "}"
    cut = deep[:-1]
    assert found(spark, deep, cut) == [(0, "domain", -1, 0)]
    raw = spark.createDataFrame([(1, deep)], "raw_id bigint, payload string")
    rows = inline(raw, "raw_id", "payload", nested.EPISODE_KEYS, nested.CHILDREN).rows
    assert rows.filter("element = 'part'").count() == n and rows.agg({"depth": "max"}).first()[0] == n
    assert _dumps(_deep("[" * n + "2" + "]" * n)) == "[" * n + "2" + "]" * n
    long = '{"intent": {"domain": ["a"], "n": ' + "9" * 5000 + "}}"
    assert found(spark, long) == [(0, "domain", -1, 0)]


def test_the_deep_reader_reads_as_json_does():
    from lumora.operators.inlining import _deep

    rng = random.Random(8)

    def value(depth):
        kind = rng.randrange(8 if depth else 6)
        if kind < 6:
            return [None, True, -1.5e-7, 10**20, 'q"\\\n€😀', ""][kind]
        return [value(depth - 1) for _ in range(rng.randrange(4))] if kind == 6 else {f"k{i} \t": value(depth - 1) for i in range(rng.randrange(4))}

    for _ in range(300):
        text = json.dumps(value(5), indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        assert _deep(text) == json.loads(text)
        broken = text[: rng.randrange(len(text))] + rng.choice(["", "]", ",", "}", ":", '"', "1"]) + text[rng.randrange(len(text)) :]
        try:
            want = json.loads(broken)
        except ValueError:
            want = "unreadable"
        try:
            got = _deep(broken)
        except ValueError:
            got = "unreadable"
        assert got == want


def test_labels_of_any_length(spark):
    last = 2**63 - 1
    labels = {"0" * 30 + "2": "a", str(last): "z", "7": "b"}
    assert found(spark, json.dumps({"intent": {"domain": labels}})) == [(0, "domain", -1, 2), (0, "domain", -1, 7), (0, "domain", -1, last)]
    beyond = {"1" * 25: "y", "9" * 6000: "z", "7": "b"}
    assert found(spark, json.dumps({"intent": {"domain": beyond}})) == [(0, "domain", -1, 7), (0, "domain", -1, last - 1), (0, "domain", -1, last)]


def test_tables_written_apart(spark):
    raw = spark.createDataFrame([(7, json.dumps(FULL)), (8, None)], "raw_id bigint, payload string")
    got = inline(raw, "raw_id", "payload", nested.EPISODE_KEYS, nested.CHILDREN, ["errors_encountered", "attempts"]).written()
    assert {r.element for r in got.rows.collect()} == {"errors_encountered", "attempts"}
    assert {a.parent_row_id for a in got.table("attempts").collect()} == {e.row_id for e in got.table("errors_encountered").collect()}
