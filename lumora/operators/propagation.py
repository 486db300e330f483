"""How learned utility changes: decay, pruning, and three ways in which it spreads between episodes.

Episodes are the slim rows of ``schema.episodes``. No operator reads a clock or writes: each returns what would change.
Columns that are missing a value never change anything: an episode without any time neither decays nor is too old,
an edge to an episode that doesn't exist is ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.functions.text import micros
from lumora.functions.utility import decay, whole_days, wilson
from lumora.operators.ordering import stretches

RATE, DISCOUNT, STEP, LEAST_SIMILARITY, LEAST_CHANGE = 0.01, 0.9, 0.1, 0.5, 0.01
HOUR = 3_600_000_000


def _wilson() -> Column:
    return wilson(F.col("helpful"), F.col("retrievals"))


def decayed(e: DataFrame, now: Column, rate: float = RATE) -> DataFrame:
    """Adds ``days`` since the last activity, ``new_learned`` and whether it ``decays``.

    Decay starts from the Wilson bound each time, so running it twice changes nothing; a first day doesn't count.
    """
    last = F.coalesce("last_retrieval", "ended")
    factor = decay(F.col("days"), rate)
    e = e.withColumn("days", whole_days(now, last))
    return e.withColumns({"new_learned": _wilson() * factor, "decays": F.coalesce(factor < 1 - rate, F.lit(False))})


def prunable(e: DataFrame, now: Column, max_age: int | None = None, min_utility: float | None = None) -> DataFrame:
    """Adds ``short_id``, ``title``, ``reasons`` and ``pruned``: too old or of low utility, and never found helpful."""
    age, utility = whole_days(now, F.col("started")), F.coalesce("learned", _wilson())
    old = F.lit(False) if max_age is None else F.coalesce(age > max_age, F.lit(False))
    low = F.lit(False) if min_utility is None else F.coalesce(utility < min_utility, F.lit(False))
    title = F.when(F.trim("intent") != "", F.trim("intent")).otherwise(F.trim("raw_prompt"))
    reasons = F.concat_ws(";", F.when(old, F.concat(F.lit("age "), age, F.lit(" days"))), F.when(low, F.lit("low utility")))
    return e.withColumns({
        "short_id": F.left("id", F.lit(8)), "title": F.left(title, F.lit(50)), "reasons": reasons, "pruned": (old | low) & (F.col("helpful") == 0),
    })


def _fold(batches: Iterator[pa.RecordBatch], step: float, least: float) -> Iterator[pa.RecordBatch]:
    """One row for each run of equal targets: its value after all its steps, and how many were taken."""
    current, value, taken, seen = None, 0.0, 0, 0

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["id", "new_learned", "n_steps", "n_sources"])

    for batch in batches:
        rows = []
        for target, old, x in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if target != current:
                if current is not None:
                    rows.append((current, value, taken, seen))
                current, value, taken, seen = target, old, 0, 0
            new = min(1.0, max(0.0, value + step * (x - value)))
            seen += 1
            if abs(new - value) > least:
                value, taken = new, taken + 1
        if rows:
            yield out(rows)
    if current is not None:
        yield out([(current, value, taken, seen)])


def sources(e: DataFrame) -> DataFrame:
    """Episodes from which utility spreads: retrieved at least twice and found helpful in over half of the cases."""
    return e.filter((F.col("retrievals") >= 2) & (F.col("helpful") * 2 > F.col("retrievals")))


def similarity_propagated(e: DataFrame, edges: DataFrame, least_similarity: float = LEAST_SIMILARITY, discount: float = DISCOUNT, step: float = STEP, least_change: float = LEAST_CHANGE) -> DataFrame:
    """(id, new_learned, n_steps, n_sources): learned utilities of episodes similar to helpful ones.

    ``edges``: (source, target, similarity, hit_rank), one row for each pair. Only ``sources`` spread. The steps of a target are taken in order (newest source first), each from
    the value that the last one left, so they are a fold and no sum. The rows of a target are sorted by Spark's
    spilling sort and pass one by one; a target with any number of sources needs no memory of its own.
    """
    source = sources(e).select(F.col("id").alias("source"), _wilson().alias("w"), F.col("started").alias("source_started"))
    target = e.select(F.col("id").alias("target"), F.coalesce("learned", F.lit(0.5)).alias("old"))
    hits = edges.filter((F.col("similarity") >= least_similarity) & (F.col("source") != F.col("target"))).join(source, "source").join(target, "target")
    newest = -F.coalesce(micros("source_started"), F.lit(0))
    x = discount * F.col("w") * F.col("similarity")
    slim = hits.select("target", "old", x.alias("x"), newest.alias("newest"), "source", "hit_rank")
    ordered = slim.repartition("target").sortWithinPartitions("target", "newest", "source", "hit_rank").select("target", "old", "x")
    return ordered.mapInArrow(lambda it: _fold(it, step, least_change), "id string, new_learned double, n_steps bigint, n_sources bigint")


def tag_propagated(e: DataFrame, gap: float = 0.1, step: float = STEP) -> DataFrame:
    """(id, tag, new_learned): episodes well below the average of one of their tags move towards it.

    The task type is a tag too; tags of one episode only don't count; of several that qualify the last in the alphabet
    decides. Averages are made with partial sums, rounded so that the order of the sums decides nothing, and meet the
    episodes by an equi-join.
    """
    tags = F.concat(F.transform("tags", F.lower), F.array(F.lower("task_type")))
    long = e.select("id", _wilson().alias("w"), F.explode(tags).alias("tag"))
    average = long.groupBy("tag").agg(F.round(F.avg("w"), 9).alias("mean"), F.count(F.lit(1)).alias("n")).filter("n >= 2").drop("n")
    low = long.distinct().join(average, "tag").filter(F.col("w") < F.col("mean") - gap)
    new = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("w") + step * (F.col("mean") - F.col("w"))))
    return low.groupBy("id").agg(F.max_by(F.struct("tag", new.alias("new")), "tag").alias("t")).select("id", "t.tag", F.col("t.new").alias("new_learned"))


def time_credited(e: DataFrame, gap: int = HOUR, reach: int = 4, discount: float = DISCOUNT, step: float = STEP, least_change: float = LEAST_CHANGE) -> DataFrame:
    """(id, distance, new_learned, n_updates): credit to what came shortly before a success.

    An episode gets credit if one of the ``reach`` rows after it, in order of their start, is a success of the same
    project or with a common tag, and no episode in between ended more than ``gap`` before that success started. Credits don't
    add up: each starts from the stored value, and the farthest success counts. The order is global, so the rows are cut
    into stretches that borrow ``reach`` rows from the next one.
    """
    slim = e.filter(F.col("started").isNotNull()).select(
        "id", "project", "tags", "started", (F.col("status") == "success").alias("success"), micros("started").alias("s"),
        F.coalesce(micros("ended"), micros("started")).alias("t"), F.coalesce("learned", _wilson()).alias("old"),
    )
    rows, w, is_own = stretches(slim, ["started", "id"], reach)
    updates = []
    for k in range(1, reach + 1):
        later = F.lead(F.struct("success", "project", "tags", "s"), k).over(w)
        related = (later["project"] == F.col("project")) | F.arrays_overlap(later["tags"], F.col("tags"))
        near = later["s"] - F.min("t").over(w.rowsBetween(0, k - 1)) <= gap
        new = F.least(F.lit(1.0), F.col("old") + discount * (1 - 0.2 * k) * step)
        hit = F.coalesce(later["success"] & related & near, F.lit(False)) & (new > F.col("old") + least_change)
        updates.append(F.when(hit, F.struct(F.lit(k).alias("k"), new.alias("new"))))
    all_updates = F.array_compact(F.array(*updates))
    got = rows.select("id", is_own.alias("own"), all_updates.alias("u")).filter(F.col("own") & (F.size("u") > 0))
    last = F.element_at("u", -1)
    return got.select("id", last["k"].alias("distance"), last["new"].alias("new_learned"), F.size("u").alias("n_updates"))


def propagated(e: DataFrame, edges: DataFrame, now: Column) -> DataFrame:
    """One snapshot after decay and then similarity propagation: ``learned`` replaced, and ``changed_by`` (null: unchanged)."""
    after = decayed(e, now).withColumn("learned", F.when(F.col("decays"), F.col("new_learned")).otherwise(F.col("learned")))
    spread = similarity_propagated(after, edges).filter("n_steps > 0").select("id", F.col("new_learned").alias("spread"))
    joined = after.join(spread, "id", "left")
    by = F.when(F.col("spread").isNotNull(), F.lit("similarity")).when(F.col("decays"), F.lit("decay"))
    return joined.select(*[F.coalesce("spread", "learned").alias("learned") if c == "learned" else F.col(c) for c in e.columns], by.alias("changed_by"))
