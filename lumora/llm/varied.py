"""A varied subset of given size by systematic selection along a Hilbert curve.

The words of each record's text and tags are hashed to signed random features (a projection of its word counts). A word
weighs by the share of all records that hold it, up to ``common``: sessions made alike differ in names and numbers,
which are rare, and share the words that make them alike, so they fall into the same or neighbouring cells. The counts
cover all records; they are kept in a table of BUCKETS hashed words, whose size doesn't grow with the data: a rare word
weighs at least like a share of (rare words of a record) / BUCKETS, below 0.002 for texts of a hundred words. Each feature
is quantised through the normal distribution function, which needs no statistics of the data, and the record gets its
key on the Hilbert curve.

A cell is a stretch of the curve: the leading bits of the key. As many bits are taken as give ``cells_for_one`` times
as many distinct cells as records are wanted, at every size of the data. The *distinct* cells are sorted globally and
numbered, evenly spaced ones are taken and the best record of each is chosen, so a crowded cell counts no more than a
sparse one. If more records are wanted than there are cells, whole levels (the first, second, ... best of every cell)
are taken until the rest fits into one more level, from which evenly spaced cells are taken.

Cells are counted with partial sums, the best records with a partial top-k, the numbering works on range partitions:
nothing passes through one task or the driver but counts.

Defined cases: repeated rows of an id count once; null ids are ignored; null or blank texts without tags share one
cell; at most as many records are returned as there are ids; ties within a cell end at the smaller id; very long texts
are used whole; an empty table gives an empty subset; extra columns pass through untouched.
"""

from __future__ import annotations

from math import erf

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumora.operators.ordering import ranked
from lumora.session import cut

#: Words are counted in so many hashed buckets.
BUCKETS = 1 << 16
_WORD = regex.compile(r"\p{L}+|\p{N}+")


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Keys along the Hilbert curve of integer points (n x dims), by the transposed form of the curve."""
    x = points.astype(np.uint32).copy()
    n, dims = x.shape
    q = np.uint32(1 << (bits - 1))
    while q > 1:
        p = np.uint32(q - 1)
        for i in range(dims):
            high = (x[:, i] & q) != 0
            x[:, 0] = np.where(high, x[:, 0] ^ p, x[:, 0])
            t = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p).astype(np.uint32)
            x[:, 0] ^= t
            x[:, i] ^= t
        q = np.uint32(q >> 1)
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, np.uint32)
    q = np.uint32(1 << (bits - 1))
    while q > 1:
        t = np.where((x[:, dims - 1] & q) != 0, t ^ np.uint32(q - 1), t)
        q = np.uint32(q >> 1)
    x ^= t[:, None]
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> np.uint32(b)) & 1).astype(np.int64)
    return key


_PHI = np.array([0.5 * (1 + erf(z / 1000 / 2**0.5)) for z in range(-6000, 6001)])


def _tokens(text: str | None, tags: list | None) -> dict[str, int]:
    """The words and the tags of a record with their counts; numbers count as one another."""
    own = ["0" if w[0].isdigit() else w for w in _WORD.findall((text or "").casefold())]
    own += ["#" + " ".join(_WORD.findall(x.casefold())) for x in tags or () if x and x.strip()]
    counts: dict[str, int] = {}
    for w in own:
        counts[w] = counts.get(w, 0) + 1
    return counts


def _bucket(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word, seed=99) % BUCKETS


def word_shares(slim: DataFrame, n: int) -> np.ndarray:
    """For each bucket of words the share of records that hold one of them, over all records."""

    def count(batches):
        found = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for t, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[list({_bucket(w) for w in _tokens(t, g)})] += 1
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(found[held])], ["bucket", "n"])

    rows = slim.select("_text", "_tags").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    shares = np.zeros(BUCKETS)
    for r in rows:
        shares[r.bucket] = r.n / max(n, 1)
    return shares


def curve_key(spark: SparkSession, shares: np.ndarray, dims: int = 12, bits: int = 4, common: float = 0.01, tag_weight: float = 0.5) -> Column:
    """The Hilbert key of a record from its ``_text`` and ``_tags``; dims * bits must not exceed 62."""
    if dims * bits > 62:
        raise ValueError("dims * bits must not exceed 62")
    shared = spark.sparkContext.broadcast(np.sqrt(np.minimum(1.0, shares / common)))
    known: dict[str, np.ndarray] = {}

    def direction(word: str) -> np.ndarray:
        """The word's direction, uniform on -1..1, and behind it its weight."""
        if (v := known.get(word)) is None:
            h = np.array([xxhash.xxh3_64_intdigest(word, seed=j) for j in range(dims)], np.uint64)
            weight = shared.value[_bucket(word)] * (tag_weight if word[0] == "#" else 1.0)
            v = np.append((h >> np.uint64(40)).astype(np.float64) / (1 << 23) - 1, weight)
            if len(known) < 200_000:
                known[word] = v
        return v

    def keys(texts: pa.Array, tag_lists: pa.Array) -> pa.Array:
        points = np.zeros((len(texts), dims))
        for i, (t, g) in enumerate(zip(texts.to_pylist(), tag_lists.to_pylist())):
            if counts := _tokens(t, g):
                v = np.array([direction(w) for w in counts])
                weight = v[:, dims] * np.sqrt(np.fromiter(counts.values(), float, len(counts)))
                if (length := np.sqrt((weight * weight).sum() / 3)) > 0:  # a uniform direction has variance 1/3
                    points[i] = weight @ v[:, :dims] / length
        cdf = _PHI[np.clip(points * 1000 + 6000, 0, 12000).astype(np.int64)]
        return pa.array(hilbert_keys(np.minimum(cdf * (1 << bits), (1 << bits) - 1), bits), pa.int64())

    keys.__annotations__ = {"texts": pa.Array, "tag_lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(keys, "bigint")("_text", "_tags")


def varied_subset(records: DataFrame, record: str, text: Column, tags: Column, best: list[Column], size: int, dims: int = 12, bits: int = 4, cells_for_one: int = 8) -> DataFrame:
    """``size`` rows of ``records`` with their ``_cell`` and ``_cell_rank``; ``best``: the order of quality within a cell."""
    spark = records.sparkSession
    named = records.filter(F.col(record).isNotNull())
    parts = F.struct(F.struct(*[b.alias(f"b{i}") for i, b in enumerate(best)]).alias("_best"), text.alias("_text"), tags.alias("_tags"))
    slim = cut(named.select(F.col(record).alias("_id"), parts.alias("p")).groupBy("_id").agg(F.min("p").alias("p")).select("_id", "p.*"))
    n = slim.count()
    keyed = cut(slim.select("_id", "_best", curve_key(spark, word_shares(slim, n), dims, bits).alias("key")))
    # the fewest leading bits that tell enough cells apart, in steps of three
    drops = range(0, dims * bits, 3)
    told = keyed.agg(*[F.approx_count_distinct(F.shiftright("key", s)).alias(f"d{s}") for s in drops]).first()
    drop = max([s for s in drops if told[f"d{s}"] >= cells_for_one * size], default=0)
    slim = keyed.select("_id", "_best", F.shiftright("key", drop).alias("cell"))
    cells = slim.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.n: r.m for r in cells.groupBy("n").agg(F.count(F.lit(1)).alias("m")).collect()}
    level, left = 0, max(0, min(size, sum(n * m for n, m in histogram.items())))
    while left and left >= (at_least := sum(m for n, m in histogram.items() if n > level)):
        left -= at_least
        level += 1
    order = Window.partitionBy("cell").orderBy("_best", "_id")
    top = slim.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= level + 1)
    deep = ranked(cells.filter(F.col("n") > level), ["cell"], "cell_rank")
    m = sum(m for n, m in histogram.items() if n > level) or 1
    # a cell is taken where the running total of left / m passes a whole number
    spaced = F.expr(f"(cell_rank + 1) * {left} div {m} > cell_rank * {left} div {m}")
    extra = deep.filter(spaced).select("cell", "cell_rank")
    chosen = top.filter(F.col("place") == level + 1).join(extra, "cell").select("_id", "cell", "cell_rank")
    if level:
        chosen = chosen.unionByName(top.filter(F.col("place") <= level).select("_id", "cell", F.lit(None).cast("bigint").alias("cell_rank")))
    return named.join(chosen.withColumnRenamed("_id", record).withColumnsRenamed({"cell": "_cell", "cell_rank": "_cell_rank"}), record).dropDuplicates([record])
