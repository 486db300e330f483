"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Two tiers. Texts are split into pre-tokens by the vocabulary's published pattern; the distinct pre-tokens of a batch are
looked up together in a minimal perfect hash over the vocabulary, which resolves every pre-token that is a vocabulary
entry as it stands. The misses are merged from their bytes with a heap over linked parts (lowest rank first, leftmost
on ties), in O(n log n) for a pre-token of n bytes, so a megabyte without a space is no problem.

The work is one narrow, Arrow-batched column function: no shuffle, whole texts, any number of rows. The vocabulary is
read on the driver and broadcast; its size is checked against ``MAX_VOCABULARY``.

Defined cases: a null or empty text gives an empty list; blank texts give the ids of their white space; text that looks
like a special token is plain text; repeated rows are encoded each; other columns pass through untouched.
"""

from __future__ import annotations

import base64
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern published with the rank files; it splits a text before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_VOCABULARY = 1_000_000
#: Characters worked on at a time and merged pre-tokens remembered by a worker; neither changes any result.
SLICE_CHARS, REMEMBERED = 4_000_000, 500_000

_U = np.uint64


def _mixed(h: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A second hash of ``h`` for each displacement seed."""
    with np.errstate(over="ignore"):
        x = h ^ (seed.astype(_U) * _U(0x9E3779B97F4A7C15))
        x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
        return x ^ (x >> _U(29))


@dataclass
class PerfectHash:
    """Hash and displace: each of n keys has its own slot in 0..n-1. A bucket of one key stores its slot directly."""

    seeds: np.ndarray
    slots: list[bytes]
    values: np.ndarray

    @staticmethod
    def build(items: dict[bytes, int]) -> PerfectHash:
        keys = list(items)
        n, n_buckets = len(keys), max(1, len(keys) // 3)
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], _U)
        buckets: list[list[int]] = [[] for _ in range(n_buckets)]
        for i, b in enumerate((h % _U(n_buckets)).tolist()):
            buckets[b].append(i)
        seeds, taken, slot_of = np.zeros(n_buckets, np.int64), bytearray(n), [0] * n
        order = sorted((b for b in range(n_buckets) if buckets[b]), key=lambda b: -len(buckets[b]))
        block = np.arange(1, 257)
        for b in order:
            own = buckets[b]
            if len(own) == 1:
                break
            start = 0
            while True:
                tries = block + start
                places = _mixed(h[own][None, :], tries[:, None]) % _U(n)
                hit = next((i for i, p in enumerate(places.tolist()) if len(set(p)) == len(p) and not any(taken[x] for x in p)), None)
                if hit is not None:
                    break
                start += len(block)
            seeds[b] = tries[hit]
            for i, p in zip(own, places[hit].tolist()):
                taken[p], slot_of[i] = 1, p
        free = iter([s for s in range(n) if not taken[s]])
        for b in order:
            if len(buckets[b]) == 1:
                slot = next(free)
                seeds[b], slot_of[buckets[b][0]] = -1 - slot, slot
        slots, values = [b""] * n, np.zeros(n, np.int32)
        for i, k in enumerate(keys):
            slots[slot_of[i]], values[slot_of[i]] = k, items[k]
        return PerfectHash(seeds, slots, values)

    def lookup(self, keys: list[bytes]) -> np.ndarray:
        """The value of each key, -1 for one that isn't held."""
        if not keys or not self.slots:
            return np.full(len(keys), -1, np.int32)
        h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), _U, len(keys))
        seed = self.seeds[(h % _U(len(self.seeds))).astype(np.int64)]
        at = np.where(seed < 0, -1 - seed, (_mixed(h, np.maximum(seed, 0)) % _U(len(self.slots))).astype(np.int64))
        slots = self.slots
        same = np.fromiter((slots[i] == k for i, k in zip(at.tolist(), keys)), bool, len(keys))
        return np.where(same, self.values[at], -1).astype(np.int32)


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merging of one pre-token: linked parts, and a heap of the pairs that can merge."""
    n = len(piece)
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = bytearray(b"\1" * n)
    end = lambda i: following[i]  # noqa: E731  a part ends where the next begins
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = following[i]
        if j < n and (r := ranks.get(piece[i : end(j)])) is not None:
            heapq.heappush(heap, (r, i, end(j)))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := following[i]) >= n or end(j) != stop:
            continue
        alive[j] = 0
        following[i] = stop
        if stop < n:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : following[i]]])
        i = following[i]
    return out


class Encoder:
    """The vocabulary as the workers use it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        if len(ranks) > MAX_VOCABULARY:
            raise ValueError(f"a vocabulary of over {MAX_VOCABULARY} entries isn't broadcast")
        self.ranks, self.pattern, self.whole = ranks, pattern, PerfectHash.build(ranks)
        self._split, self._merged = None, {}

    def __getstate__(self):
        return self.ranks, self.pattern, self.whole

    def __setstate__(self, state):
        self.ranks, self.pattern, self.whole = state
        self._split, self._merged = None, {}

    @staticmethod
    def from_file(path: str = DEFAULT_VOCABULARY, pattern: str = PATTERN) -> Encoder:
        with open(path, "rb") as f:
            return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def _of_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the distinct pieces laid end to end, and the number of ids of each."""
        keys = [s.encode() for s in pieces.to_pylist()]
        found = self.whole.lookup(keys)
        lengths = np.ones(len(keys), np.int64)
        misses: dict[int, list[int]] = {}
        for i in np.flatnonzero(found < 0).tolist():
            k = keys[i]
            if (ids := self._merged.get(k)) is None:
                ids = merge_bytes(k, self.ranks)
                if len(k) <= 64:
                    if len(self._merged) >= REMEMBERED:
                        self._merged.clear()
                    self._merged[k] = ids
            misses[i] = ids
            lengths[i] = len(ids)
        starts = np.cumsum(lengths) - lengths
        flat = np.empty(int(lengths.sum()), np.int32)
        flat[starts] = found
        for i, ids in misses.items():
            flat[starts[i] : starts[i] + len(ids)] = ids
        return flat, lengths

    def encode(self, texts: list[str | None], only_counts: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts laid end to end, number of ids of each text)."""
        if self._split is None:
            self._split = regex.compile(self.pattern).findall
        split, values, counts, at = self._split, [], [], 0
        while at < len(texts):
            pieces, per_text, size = [], [], 0
            while at < len(texts) and size < SLICE_CHARS:
                t = texts[at]
                at += 1
                own = split(t) if t else []
                pieces += own
                per_text.append(len(own))
                size += len(t or "")
            coded = pa.array(pieces, pa.large_string()).dictionary_encode()
            which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            flat, lengths = self._of_pieces(coded.dictionary)
            n = lengths[which]
            ends = np.concatenate([[0], np.cumsum(n)])
            bounds = np.concatenate([[0], np.cumsum(per_text)]).astype(np.int64)
            counts.append(np.diff(ends[bounds]))
            if not only_counts:
                starts = (np.cumsum(lengths) - lengths)[which]
                values.append(flat[np.repeat(starts - ends[:-1], n) + np.arange(ends[-1])])
        return np.concatenate([np.empty(0, np.int32), *values]), np.concatenate([np.empty(0, np.int64), *counts])


_loaded: dict[tuple, tuple] = {}


def _shared(spark: SparkSession, path: str):
    """One broadcast of a vocabulary for each application."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _loaded:
        _loaded[key] = (spark.sparkContext.broadcast(Encoder.from_file(path)),)
    return _loaded[key][0]


def token_ids(spark: SparkSession, text: Column | str, path: str = DEFAULT_VOCABULARY) -> Column:
    """The token ids of a text column, without special tokens; an empty list for null and empty texts."""
    shared = _shared(spark, path)

    def ids(texts: pa.Array) -> pa.Array:
        values, counts = shared.value.encode(texts.to_pylist())
        # no text has more ids than bytes, and a batch of strings fewer than 2^31 bytes, so this holds for any batch that can arrive
        if len(values) >= 1 << 31:
            raise ValueError("a batch has too many ids for one list column; lower spark.sql.execution.arrow.maxRecordsPerBatch")
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))

    ids.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(ids, "array<int>")(text)


def token_counts(spark: SparkSession, text: Column | str, path: str = DEFAULT_VOCABULARY) -> Column:
    """How many token ids a text has; 0 for null and empty texts."""
    shared = _shared(spark, path)

    def counts(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.encode(texts.to_pylist(), only_counts=True)[1], pa.int64())

    counts.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(counts, "bigint")(text)


def text_of_ids(spark: SparkSession, ids: Column | str, path: str = DEFAULT_VOCABULARY) -> Column:
    """The text that token ids stand for; the inverse of ``token_ids``."""
    shared = _shared(spark, path)

    def texts(lists: pa.Array) -> pa.Array:
        pieces = {i: b for b, i in shared.value.ranks.items()}
        return pa.array([None if x is None else b"".join(pieces[i] for i in x).decode("utf-8", "replace") for x in lists.to_pylist()], pa.string())

    texts.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(texts, "string")(ids)
