import base64
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lumora.llm import tokenize


@pytest.fixture(scope="module")
def encoder():
    return tokenize.Encoder.from_file()


@pytest.fixture(scope="module")
def reference():
    with open(tokenize.DEFAULT_VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokenize.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "a", "Hello  world\n\n  x", "it's we'LL", "<|endoftext|>", "日本語のテキスト", "🙂👍🏽", "naïve café", " 　​", "x" * 3000, "0123456789" * 40, "\r\n\t" * 30, "а́б", "�", "\x00\x01"]


def split(flat, counts):
    out, at = [], 0
    for n in counts:
        out.append(flat[at : at + n].tolist())
        at += n
    return out


def test_equals_another_implementation(encoder, reference):
    assert split(*encoder.encode(TEXTS)) == [reference.encode_ordinary(t) for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(encoder, reference, texts):
    assert split(*encoder.encode(texts)) == [reference.encode_ordinary(t) for t in texts]


def test_perfect_hash_has_a_slot_for_each_key():
    rng = random.Random(1)
    items = {rng.randbytes(rng.randrange(1, 9)): i for i in range(5000)}
    h = tokenize.PerfectHash.build(items)
    assert sorted(h.slots) == sorted(items) and h.lookup(list(items)).tolist() == list(items.values())
    assert h.lookup([b"not there at all", b""]).tolist() == [-1, -1]
    assert tokenize.PerfectHash.build({}).lookup([b"x"]).tolist() == [-1]


def test_a_million_letters_without_a_space(encoder, reference):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh") for _ in range(200_000))
    ids, _ = encoder.encode([text])
    assert reference.decode(ids.tolist()) == text
    assert ids[:50].tolist() == reference.encode_ordinary(text[:2000])[:50]


def test_columns(spark):
    df = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "Hello world", "c"), (3, "Hello world", "c")], "doc_id bigint, text string, ids string")
    got = df.select("doc_id", tokenize.token_ids(spark, "text").alias("i"), tokenize.token_counts(spark, "text").alias("n"))
    assert [(r.doc_id, r.i, r.n) for r in got.collect()] == [(1, [], 0), (2, [], 0), (3, [15496, 995], 2), (3, [15496, 995], 2)]
    assert got.limit(0).collect() == [] and got.filter("false").collect() == []
    back = got.select(tokenize.text_of_ids(spark, "i").alias("t"))
    assert [r.t for r in back.collect()] == ["", "", "Hello world", "Hello world"]
