"""What a task does with sets of numbers: the keys that a set is sent to, and the similar ones among sets that meet on a key.

The numbers of a set lie in one order that holds for all sets: the rare ones, by their value, before the FREQUENT ones, by
their rank. Sets that share the rarest number they have in common meet there and are counted there only. Where a key has
many sets, the numbers that many of them hold are counted by a product of matrices of 0 and 1, the others pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Ranks are below this number and fit in 16 bits.
FREQUENT = 30_000
#: Numbers of sets that are looked at together at least, if there are so many.
CHUNK = 200_000
#: Numbers of the sets of a key beyond which it is split into blocks.
BLOCK = 50_000
#: Sets, and their numbers, up to which the sets of a key are few; those of many such keys are counted together.
FEW, FEW_NUMBERS = 32, 4_096
#: Rows of a product and pairs of a batch, at most.
ROWS, BATCH = 512, 50_000


def needed(n: np.ndarray, least: float) -> np.ndarray:
    """How many numbers a similar set shares at least with a set of ``n``."""
    return np.floor(least * n + 1e-9).astype(np.int64) + 1


def keyed(batches: Iterator[pa.RecordBatch], least: float, frequent: np.ndarray, rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(no, numbers) as (key, no, n, rare, often): each set at the rarest of its numbers, as many as a similar set can't lack.

    ``frequent``: the frequent numbers in the order of their values; ``rank``: their places by frequency, the rarest first.
    """
    for batch in batches:
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
        n = batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        at = np.minimum(np.searchsorted(frequent, flat), max(len(frequent) - 1, 0))
        known = frequent[at] == flat if len(frequent) else np.zeros(len(flat), bool)
        number = flat.copy()
        number[known] = rank[at[known]]
        order = np.lexsort((number, known, row))
        number, known = number[order], known[order]
        key = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(n - needed(n, least) + 1, n)
        lists = []
        for which, kind in ((~known, np.int64), (known, np.int16)):
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[which], minlength=len(n)))]).astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(number[which].astype(kind))))
        sent = pa.array(row[key])
        columns = [pa.array(number[key]), batch.column(0).take(sent), pa.array(n[row[key]].astype(np.int32)), *[x.take(sent) for x in lists]]
        yield pa.RecordBatch.from_arrays(columns, ["key", "no", "n", "rare", "often"])


def _together(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places with equal codes; ``code`` is sorted."""
    ends = np.append(np.flatnonzero(code[1:] != code[:-1]) + 1, len(code))
    later = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(code)) - 1
    first = np.repeat(np.arange(len(code)), later)
    return first, first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(later) - later, later)


class _Met:
    """Rows (key, i, j, own, no, rare, often) in the order of their keys: the sets of whole keys."""

    def __init__(self, t: pa.Table, least: float) -> None:
        self.least = least
        column = lambda c: t.column(c).to_numpy()
        key, i, j, self.own = (column(c) for c in ("key", "i", "j", "own"))
        self.no = t.column("no").combine_chunks()
        parts = [t.column(c).combine_chunks() for c in ("rare", "often")]
        lengths = [x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in parts]
        self.n = lengths[0] + lengths[1]
        self.start = np.append(0, np.cumsum(self.n))
        self.flat, before = np.empty(self.start[-1], np.int64), self.start[:-1]
        for x, length in zip(parts, lengths):
            self.flat[np.repeat(before - np.cumsum(length) + length, length) + np.arange(length.sum())] = x.flatten().to_numpy(zero_copy_only=False)
            before = before + length
        self.row = np.repeat(np.arange(len(key)), self.n)
        # sets that share a number rarer than their key are counted there
        rarer = np.arange(len(self.flat)) < np.repeat(np.flatnonzero(self.flat == key[self.row]), self.n)
        self.weight = np.where(rarer, -(self.n.max() + 1.0), 1.0).astype(np.float32)
        self.first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        self.count = np.diff(self.first, append=len(key))
        self.within = i == j
        self.place = np.empty(len(key), np.int64)
        self.place[pc.sort_indices(self.no).to_numpy()] = np.arange(len(key))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of the similar sets, two by two, and how many numbers they share."""
        few = (self.count <= FEW) & (np.add.reduceat(self.n, self.first) <= FEW_NUMBERS)
        yield self._few(np.repeat(np.where(few & (self.count > 1), np.arange(len(few)), -1), self.count))
        for g in np.flatnonzero(~few & (self.count > 1)):
            yield from self._many(np.arange(self.first[g], self.first[g] + self.count[g]))

    def _shared_by_least(self, n: np.ndarray) -> np.ndarray:
        """How many numbers two sets of ``n`` together must share."""
        return np.floor((self.least * n + 1e-9) / (1 + self.least)) + 1

    def _few(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        group = group[self.row]
        used = np.flatnonzero(group >= 0)
        used = used[np.lexsort((self.row[used], self.flat[used], group[used]))]
        new = (np.diff(self.flat[used]) != 0) | (np.diff(group[used]) != 0)
        a, b = _together(np.append(0, np.cumsum(new))[: len(used)])
        p, q, weight = self.row[used[a]], self.row[used[b]], self.weight[used[a]]
        met = self.within[p] | (self.own[p] != self.own[q])
        pair, which = np.unique(p[met] * len(self.n) + q[met], return_inverse=True)
        shared = np.bincount(which, weight[met], len(pair))
        p, q = pair // len(self.n), pair % len(self.n)
        hit = shared >= self._shared_by_least(self.n[p] + self.n[q])
        return p[hit], q[hit], shared[hit]

    def _many(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        within = self.within[rows[0]]
        side = self.own[rows] != self.own[rows].min() if not within else np.zeros(len(rows), bool)
        order = np.lexsort((self.n[rows], side))
        rows, side = rows[order], side[order]
        n, m, left = self.n[rows], len(rows), len(rows) if within else int((~side).sum())
        if left == m and not within:
            return
        at = np.repeat(self.start[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
        row, (values, code, count) = np.repeat(np.arange(m), n), np.unique(self.flat[at], return_inverse=True, return_counts=True)
        weight = np.empty(len(values), np.float32)
        weight[code] = self.weight[at]
        dense = np.flatnonzero((count >= 2) & (count >= m / 16))
        column = np.full(len(values), -1)
        column[dense] = np.arange(len(dense))
        held = column[code] >= 0
        has = np.zeros((m, len(dense)), np.float32)
        has[row[held], column[code[held]]] = 1
        weighed = (has * weight[dense]).T
        rest = np.flatnonzero(~held & (count[code] >= 2))
        rest = rest[np.lexsort((row[rest], code[rest]))]
        a, b = _together(code[rest])
        p, q, w = row[rest[a]], row[rest[b]], weight[code[rest[a]]]
        order = np.argsort(p, kind="stable")
        p, q, w = p[order], q[order], w[order]
        steps = np.append(np.flatnonzero(np.diff(n[:left], prepend=-1)), left)
        for low, high in zip(steps[:-1], steps[1:]):
            for s in range(low, high, ROWS):
                e, base = min(s + ROWS, high), 0 if within else left
                c = max(s, base) if within else base + np.searchsorted(n[base:], self.least * n[s] - 1e-6)
                to = base + np.searchsorted(n[base:], n[s] / self.least + 1e-6)
                if to <= c:
                    continue
                shared = has[s:e] @ weighed[:, c:to]
                some = slice(*np.searchsorted(p, [s, e]))
                inside = (q[some] >= c) & (q[some] < to)
                np.add.at(shared, (p[some][inside] - s, q[some][inside] - c), w[some][inside])
                hit = shared >= self._shared_by_least(n[s] + n[c:to]).astype(np.float32)
                x, y = np.nonzero(np.triu(hit, 1) if within else hit)
                yield rows[s + x], rows[c + y], shared[x, y].astype(np.float64)


def similar(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(key, i, j, own, no, rare, often) in the order of key, i and j as (a, b, similarity), a < b.

    Rows of one key, i and j meet; where i and j differ, only those of different ``own``.
    """
    for t in _whole_keys(batches):
        met = _Met(t, least)
        for p, q, shared in met.pairs():
            similarity = shared / (met.n[p] + met.n[q] - shared)
            more = similarity > least
            p, q, similarity = p[more], q[more], similarity[more]
            swapped = met.place[p] > met.place[q]
            a, b = np.where(swapped, q, p), np.where(swapped, p, q)
            for s in range(0, len(a), BATCH):
                names = [met.no.take(pa.array(x[s : s + BATCH])) for x in (a, b)]
                yield pa.RecordBatch.from_arrays([*names, pa.array(similarity[s : s + BATCH])], ["a", "b", "similarity"])


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in pieces of CHUNK numbers or a little more that end where a key, i, j ends."""
    held, numbers = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        numbers += pc.sum(batch.column(batch.schema.get_field_index("n"))).as_py()
        if numbers >= CHUNK:
            t = pa.Table.from_batches(held)
            ids = [t.column(c).to_numpy() for c in ("key", "i", "j")]
            last = np.flatnonzero(np.logical_or.reduce([x != x[-1] for x in ids]))
            if len(last):
                yield t.slice(0, last[-1] + 1)
                held = t.slice(last[-1] + 1).combine_chunks().to_batches()
                numbers = sum(pc.sum(x.column(x.schema.get_field_index("n"))).as_py() for x in held)
    if held:
        yield pa.Table.from_batches(held)
