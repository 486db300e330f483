"""Finding episodes: by text, by vector, and choosing among the hits."""

from __future__ import annotations

from functools import reduce
from math import ceil

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lumora.functions.text import words
from lumora.session import cut

#: Queries that are compared at a time. More of them make more blocks, never a larger one.
QUERY_BLOCK = 2048


def best(hits: DataFrame, query: str, item: str, score: str, k: int) -> DataFrame:
    """The ``k`` rows of each query with the highest score; ties end at the smaller item."""
    order = Window.partitionBy(query).orderBy(F.desc(score), item)
    return hits.withColumn("hit_rank", F.row_number().over(order)).filter(F.col("hit_rank") <= k)


def united(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def gather(parts: list[DataFrame], part: DataFrame, most: int = 32) -> None:
    """Add ``part``; many parts are written as one, so that no plan grows with their number."""
    parts.append(part)
    if len(parts) >= most:
        parts[:] = [cut(united(parts))]


def text_hits(queries: DataFrame, texts: DataFrame, k: int, least: float) -> DataFrame:
    """(query_id, id, similarity, hit_rank) by shared words.

    ``queries``: (query_id, text), a stated set that meets all rows of ``texts``: (id, text). A word of the query counts
    if it is part of the text anywhere: m of q words, over q + n - m, n the words of the text, no word united with its
    repeats. Null and blank queries find nothing. The queries are broadcast in blocks of QUERY_BLOCK; an automaton finds all
    words of a block in one pass over a text, and a product with the block's table of words gives m for all its queries.
    Each task keeps the best ``k`` of every batch, and only those are shuffled.
    """
    spark, kind, item = queries.sparkSession, dict(queries.dtypes)["query_id"], dict(texts.dtypes)["id"]
    q = queries.select("query_id", words(F.lower("text")).alias("q")).filter(F.size("q") > 0)
    n_blocks = max(1, ceil(q.count() / QUERY_BLOCK))
    t = texts.select("id", F.lower("text").alias("t")).withColumn("n", F.size(words("t"))).filter("n > 0")
    found: list[DataFrame] = []
    for b in range(n_blocks):
        own = q.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b).toArrow()
        lists = own.column("q").to_pylist()
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for ws in lists for w in ws))}
        held = np.zeros((len(vocabulary), len(lists)), np.float32)
        for j, ws in enumerate(lists):
            for w in ws:
                held[vocabulary[w], j] += 1
        shared = spark.sparkContext.broadcast((own.column("query_id").combine_chunks(), list(vocabulary), held))

        def search(batches, shared=shared):
            names, vocabulary, held = shared.value
            nq = held.sum(axis=0)
            automaton = ahocorasick.Automaton()
            for i, w in enumerate(vocabulary):
                automaton.add_word(w, i)
            automaton.make_automaton()
            for batch in batches if vocabulary else ():
                for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                    flags = np.zeros((part.num_rows, len(vocabulary)), np.float32)
                    for i, x in enumerate(part.column(1).to_pylist()):
                        flags[i, list({w for _, w in automaton.iter(x)})] = 1
                    m = (flags @ held).T.astype(np.float64)
                    sims = m / (nq[:, None] + part.column(2).to_numpy(zero_copy_only=False)[None, :] - m)
                    rows, cols = np.nonzero((m > 0) & (sims >= least))
                    s, ids = sims[rows, cols], part.column(0).take(pa.array(cols))
                    # of each query the first k by similarity and id
                    order = np.lexsort((np.array(ids.to_pylist(), dtype=object).astype(str) if pa.types.is_string(ids.type) else ids.to_numpy(zero_copy_only=False), -s, rows))
                    at = rows[order]
                    keep = order[np.arange(len(at)) - np.searchsorted(at, at, "left") < k]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(rows[keep])), ids.take(pa.array(keep)), pa.array(s[keep])], ["query_id", "id", "similarity"])

        part = t.mapInArrow(search, f"query_id {kind}, id {item}, similarity double")
        gather(found, part)
    return best(united(found), "query_id", "id", "similarity", k).select("query_id", "id", "similarity", "hit_rank")


def _matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, unit vectors) of the entries of ``dims`` numbers that are finite and not all zero."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    right = np.flatnonzero(lengths == dims)
    if not len(right):
        return right, np.empty((0, dims))
    x = column.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    good = np.isfinite(x).all(axis=1) & x.any(axis=1)
    x = x[good]
    return right[good], x / np.linalg.norm(x, axis=1, keepdims=True)


def _texts(ids: pa.Array) -> np.ndarray:
    return np.array(ids.to_pylist(), dtype=object).astype(str) if pa.types.is_string(ids.type) else ids.to_numpy(zero_copy_only=False)


class BestOfTask:
    """The ``k`` best items of each query among those that one task has seen: similarity descending, then id.

    ``floor`` is what an item needs to be of use to a query; it rises with the k-th similarity found and never above it.
    """

    def __init__(self, n: int, k: int, least: float, room: int = 500_000):
        self.k, self.room, self.floor, self.n = k, room, np.full(n, least), 0
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, rows: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        keep = s >= self.floor[rows]
        self.held.append((rows[keep], ids[keep], s[keep]))
        self.n += len(self.held[-1][0])
        if self.n > self.room:
            self.reduce()

    def reduce(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        rows, ids, s = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((ids, -s, rows))
        at = rows[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at, "left")
        order, last = order[rank < self.k], order[rank == self.k - 1]
        self.floor[rows[last]] = np.maximum(self.floor[rows[last]], s[last])
        self.held = [(rows[order], ids[order], s[order])]
        self.n = len(order)
        self.room = max(self.room, 2 * self.n)
        return self.held[0]


def vector_hits(queries: DataFrame, vectors: DataFrame, k: int, dims: int, least: float = -1.0) -> DataFrame:
    """(query_id, id, similarity, hit_rank): the exact ``k`` most similar vectors of each query, by cosine.

    ``queries``: (query_id, vector), a stated set; ``vectors``: (id, vector). The queries are broadcast in blocks of
    QUERY_BLOCK rows, each task keeps the best ``k`` of what it sees, and only those are shuffled; ties end at the smaller id. Vectors that are null,
    of another length, not finite or all zero take no part.
    """
    spark, kind = queries.sparkSession, dict(queries.dtypes)["query_id"]
    n_blocks = max(1, ceil(queries.count() / QUERY_BLOCK))
    item = dict(vectors.dtypes)["id"]
    item_type = to_arrow_type(vectors.schema["id"].dataType)
    found: list[DataFrame] = []
    for b in range(n_blocks):
        own = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b).select("query_id", "vector").toArrow()
        right, matrix = _matrix(own.column("vector").combine_chunks(), dims)
        shared = spark.sparkContext.broadcast((own.column("query_id").combine_chunks().take(pa.array(right)), matrix))

        def search(batches, shared=shared):
            names, q = shared.value
            found = BestOfTask(len(q), k, least)
            for batch in batches if len(q) else ():
                for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                    at, x = _matrix(part.column(1), dims)
                    if not len(at):
                        continue
                    ids = _texts(part.column(0).take(pa.array(at)))
                    sims = q @ x.T
                    floor = found.floor
                    if len(at) > k:
                        floor = np.maximum(floor, np.partition(sims, -k, axis=1)[:, -k])
                    # all that are level with the k-th stay; a product's last digits depend on the place, so they are taken again
                    rows, cols = np.nonzero(sims >= (floor - 1e-9)[:, None])
                    for i in range(0, len(rows), 8192):
                        r, c = rows[i : i + 8192], cols[i : i + 8192]
                        found.add(r, ids[c], np.einsum("ij,ij->i", q[r], x[c]))
            rows, ids, s = found.reduce()
            yield pa.RecordBatch.from_arrays([names.take(pa.array(rows)), pa.array(ids.tolist(), item_type), pa.array(s)], ["query_id", "id", "similarity"])

        part = vectors.select("id", "vector").mapInArrow(search, f"query_id {kind}, id {item}, similarity double")
        gather(found, part)
    return best(united(found), "query_id", "id", "similarity", k)


def _jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both).cast("double"))


def diversified(hits: DataFrame, query: str, item: str, score: str, text: Column, limit: int, balance: float = 0.7) -> DataFrame:
    """(query, item, pick): up to ``limit`` hits of each query by maximal marginal relevance.

    The first pick has the highest score. Each further one has the highest ``balance`` * score - (1 - balance) * its
    largest word overlap with the picks before it; ties end at the hit that stands later by score. ``hits`` holds an item
    once for each query. A pick is a maximum over all hits left, taken in part before the shuffle; only picks are gathered.
    """
    none = F.array().cast("array<string>")
    ranked = cut(hits.select(F.col(query).alias("_q"), F.col(item).alias("_i"), F.col(score).cast("double").alias("_s"), F.coalesce(F.array_distinct(words(F.lower(text))), none).alias("_w")))
    own = F.struct(F.col("_i").alias("i"), F.col("_w").alias("w"))
    picks = cut(ranked.groupBy("_q").agg(F.array(F.min_by(own, F.struct(-F.col("_s"), "_i"))).alias("p")))
    for _ in range(limit - 1):
        met = ranked.join(picks.withColumnRenamed("_q", "_k"), F.col("_q").eqNullSafe(F.col("_k"))).filter(~F.exists("p", lambda x: x["i"].eqNullSafe(F.col("_i"))))
        overlap = F.aggregate("p", F.lit(0.0), lambda most, x: F.greatest(most, _jaccard(F.col("_w"), x["w"])))
        value = balance * F.col("_s") - (1 - balance) * overlap
        best_left = met.groupBy("_q").agg(F.max_by(own, F.struct(value.alias("v"), (-F.col("_s")).alias("s"), "_i")).alias("n")).withColumnRenamed("_q", "_k")
        added = picks.join(best_left, F.col("_q").eqNullSafe(F.col("_k")), "left")
        picks = cut(added.select("_q", F.when(F.col("n").isNull(), F.col("p")).otherwise(F.array_append("p", F.col("n"))).alias("p")))
    return picks.select(F.col("_q").alias(query), F.posexplode(F.slice("p", 1, limit)).alias("n", "x")).select(query, F.col("x.i").alias(item), (F.col("n") + 1).alias("pick"))
