"""A mix of sources by target weights, interleaved by Pfair scheduling.

Each source's documents, repeated as often as needed and allowed, form one stream, cut into blocks. Block i of a source
of weight w may run from slot floor((i-1)/w) on and must run before slot ceil(i/w) (i from 1); each slot goes to the
released block with the earliest deadline. As the weights sum to 1, every deadline is met and at each slot each source is
less than one block away from its share. Weights are exact fractions, nothing is rounded. The schedule covers the whole
mix in at most MAX_SLOTS slots and one more for each source: a block has ``block_tokens``, or more where the mix is larger
than so many slots. Nothing is scheduled row by row: a document finds its block by its position, and its slot by the block.

Where a document begins in its source's stream comes from a two-level running sum: sums of salted buckets of each source
first, then within the bucket. There are as many buckets as a bucket of the largest source has documents, so both levels
grow with the root of the table, and a source with a third of all documents is spread over many tasks.

A source whose documents, each repeated ``max_repeats`` times, hold fewer tokens than its share of the mix has nothing to
deliver for its last blocks: they miss their deadlines and ``missed`` holds them. ``reach`` is the largest mix at which no
source with documents misses one; the mix is made at that size unless another is asked for.

Defined cases: source names agree apart from letter case and surrounding white space; rows of the plan that agree are
one (shares added, the higher cap); documents of null or unlisted sources and documents without tokens stay out; a null
share is 0 and a null cap is 0; a source without documents, or with a cap of 0, is reported and bounds no mix; documents
are in hash order of their id, so ties can't arise for unique ids and repeated rows count as separate documents; the
document in which a share ends is taken whole; an empty corpus or plan gives an empty mix.
"""

from __future__ import annotations

from fractions import Fraction
from heapq import heappop, heappush
from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumora.functions.text import folded, trimmed
from lumora.llm.common import bounded_rows
from lumora.session import cut

MAX_SOURCES, MAX_SLOTS = 10_000, 100_000


def weights(shares: dict[str, float]) -> dict[str, Fraction]:
    """The positive shares as exact fractions of their sum."""
    exact = {s: Fraction(repr(float(x))) for s, x in shares.items() if x and x > 0}
    total = sum(exact.values())
    return {s: x / total for s, x in exact.items()}


def window_of(block: int, weight: Fraction) -> tuple[int, int]:
    """Release and deadline of a block (from 1) of a source."""
    return (block - 1) * weight.denominator // weight.numerator, -(-block * weight.denominator // weight.numerator)


def pfair_slots(weight: dict[str, Fraction], blocks: dict[str, int]) -> dict[str, list[int]]:
    """The slot of each source's blocks, earliest deadline first; of equal deadlines the smaller name runs first."""
    waiting: list[tuple[int, str]] = []
    ready: list[tuple[int, str]] = []
    slots: dict[str, list[int]] = {s: [] for s in weight}
    for s in weight:
        if blocks.get(s, 0):
            heappush(waiting, (0, s))
    t = 0
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            s = heappop(waiting)[1]
            heappush(ready, (window_of(len(slots[s]) + 1, weight[s])[1], s))
        s = heappop(ready)[1]
        slots[s].append(t)
        if len(slots[s]) < blocks[s]:
            heappush(waiting, (window_of(len(slots[s]) + 1, weight[s])[0], s))
        t += 1
    return slots


class Mix:
    """``assignments``: where each placed copy of a document stands. ``shares``: what each source reached.

    ``size``: tokens of the whole corpus, that is of the sources in the plan; ``reach``: the largest mix that is on target.
    """

    def __init__(self, documents: DataFrame, plan: DataFrame, tokens: Column, block_tokens: int = 2048, max_slots: int = MAX_SLOTS):
        spark = documents.sparkSession
        slim = documents.select(F.col("doc_id"), folded("source").alias("key"), tokens.cast("bigint").alias("tokens"))
        p = plan.select(trimmed("source").alias("name"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(0)).alias("cap"))
        p = p.filter(F.col("name").isNotNull()).groupBy(F.lower("name").alias("key")).agg(F.min("name").alias("name"), F.sum("share").alias("share"), F.max("cap").alias("cap"))
        self._rows = bounded_rows(p, MAX_SOURCES, "the plan of the mix")
        keys = spark.createDataFrame([(r.key,) for r in self._rows], "key string")
        # written once: the counts, sums and positions below all start from it
        # (the filter follows, as below it Spark would count the tokens twice)
        self._docs = cut(slim.join(F.broadcast(keys), "key").withColumn("h", F.xxhash64("doc_id"))).filter("tokens > 0")
        # one row for each source of the plan
        sums = {r.key: r for r in self._docs.groupBy("key").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
        self._tokens = {r.key: sums[r.key].t if r.key in sums else 0 for r in self._rows}
        self.size = sum(self._tokens.values())
        self._buckets = max(16, isqrt(max((r.n for r in sums.values()), default=0)))
        self._block, self._max_slots, self._spark = block_tokens, max_slots, spark
        self._weights = weights({r.key: r.share for r in self._rows})
        supply = {r.key: max(0, r.cap) * self._tokens[r.key] for r in self._rows}
        bounds = [supply[r.key] / r.share for r in self._rows if r.share > 0 and supply[r.key]]
        self.reach = min([float(self.size), *bounds]) if bounds else 0.0

    def schedule(self, size: float | None = None) -> tuple[DataFrame, int]:
        """One row for each source of the plan, with its demand and the slots of its blocks; and the tokens of a block."""
        size = self.reach if size is None else size
        block = max(self._block, ceil(size / self._max_slots))
        demand = {r.key: max(0.0, r.share) * size for r in self._rows}
        slots = pfair_slots(self._weights, {s: ceil(demand[s] / block) for s in self._weights})
        data = []
        for r in self._rows:
            t, cap = self._tokens[r.key], max(0, r.cap)
            passes = min(cap, ceil(demand[r.key] / t)) if t else 0
            data.append((r.key, r.name, r.share, cap, t, demand[r.key], passes, slots.get(r.key, [])))
        schema = "key string, source string, target_share double, max_repeats bigint, source_tokens bigint, demand double, passes bigint, slots array<bigint>"
        return self._spark.createDataFrame(data, schema), block

    def assignments(self, size: float | None = None) -> DataFrame:
        """doc_id, source, repeat_no (from 0), slot and stream position of every copy; the mix is in order of slot, position."""
        plan, block = self.schedule(size)
        docs = self._docs.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 32), F.lit(self._buckets)))
        sums = docs.groupBy("key", "bucket").agg(F.sum("tokens").alias("t"))
        before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = sums.withColumn("bucket_start", F.coalesce(F.sum("t").over(before), F.lit(0))).drop("t")
        within = Window.partitionBy("key", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        docs = docs.withColumn("inner", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
        # the plan has at most MAX_SOURCES rows and MAX_SLOTS slots
        placed = docs.join(starts, ["key", "bucket"]).join(F.broadcast(plan.filter("passes > 0")), "key")
        copies = placed.withColumn("repeat_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("passes") - 1)))
        copies = copies.withColumn("position", F.col("repeat_no") * F.col("source_tokens") + F.col("bucket_start") + F.col("inner")).filter(F.col("position") < F.col("demand"))
        slot = F.element_at("slots", F.floor(F.col("position") / block).cast("int") + 1)
        return copies.select("doc_id", "source", "tokens", "repeat_no", slot.alias("slot"), "position")

    def missed(self, size: float | None = None) -> DataFrame:
        """(source, block, slot, missed_tokens): blocks whose deadline passes before their source can fill them."""
        plan, block = self.schedule(size)
        blocks = plan.select("source", "demand", (F.col("max_repeats") * F.col("source_tokens")).alias("supply"), F.posexplode("slots").alias("i", "slot"))
        due = F.least(F.col("demand"), (F.col("i") + 1) * F.lit(float(block)))
        late = blocks.withColumns({"block": F.col("i") + 1, "due": due}).filter(F.col("supply") < F.col("due"))
        return late.select("source", "block", "slot", (F.col("due") - F.greatest(F.col("supply").cast("double"), F.col("i") * F.lit(float(block)))).alias("missed_tokens"))

    def shares(self, size: float | None = None) -> DataFrame:
        """For each source of the plan what it holds of the mix, what it could not deliver in time, and the largest mix it can serve."""
        plan, _ = self.schedule(size)
        taken = self.assignments(size).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("repeat_no").alias("last_repeat"), F.count(F.lit(1)).alias("copies"))
        late = self.missed(size).groupBy("source").agg(F.sum("missed_tokens").alias("missed"))
        joined = plan.join(taken, "source", "left").join(late, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
        total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # one row for each source of the plan
        return joined.select(
            "source", "target_share", "max_repeats", "source_tokens", F.coalesce("copies", F.lit(0)).alias("copies"), F.col("tokens").alias("mix_tokens"),
            F.coalesce(F.col("last_repeat") + 1, F.lit(0)).alias("most_repeats"),
            F.when(total > 0, F.round(F.col("tokens") / total, 6)).otherwise(F.lit(0.0)).alias("actual_share"), F.coalesce("missed", F.lit(0.0)).alias("missed_tokens"),
            F.when(F.col("target_share") > 0, F.floor(F.col("max_repeats") * F.col("source_tokens") / F.col("target_share"))).alias("reach_tokens"),
        )

    def unreachable(self, size: float | None = None) -> DataFrame:
        """Sources with blocks that miss their deadline; ``size``: that of the corpus unless another is given."""
        return self.missed(self.size if size is None else size).select("source").distinct()
