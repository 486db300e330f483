"""The episode store as relations: filters, lookups, listings, statistics, and new snapshots instead of updates in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumora.functions.utility import whole_days, wilson

OUTCOMES = ("success", "partial", "failure")


def project_matches(project: Column, wanted: str, mode: str = "contains") -> Column:
    """``contains`` and ``equal_folded`` ignore letter case, ``equal`` doesn't, ``any`` takes all."""
    if mode == "contains":
        return F.contains(F.lower(project), F.lit(wanted.lower()))
    if mode == "equal_folded":
        return F.lower(project) == wanted.lower()
    if mode == "equal":
        return project == wanted
    if mode == "any":
        return F.lit(True)
    raise ValueError(f"unknown mode {mode}")


def listed(e: DataFrame, project: str | None = None, tag: str | None = None, outcome: str | None = None, limit: int = 10) -> DataFrame:
    """Newest first; filters that are not given, and outcomes that are not known, pass everything."""
    if project:
        e = e.filter(project_matches(F.col("project"), project))
    if tag:
        e = e.filter(F.exists("tags", lambda t: F.contains(F.lower(t), F.lit(tag.lower()))))
    if outcome and outcome.lower() in OUTCOMES:
        e = e.filter(F.col("status") == outcome.lower())
    return e.orderBy(F.desc("started"), "id").limit(limit)


def latest(e: DataFrame) -> DataFrame:
    return e.filter(F.col("started").isNotNull()).orderBy(F.desc("started"), "id").limit(1)


def looks_like_id(c: Column) -> Column:
    return F.trim(c).rlike("^([0-9a-fA-F]{8}|[0-9a-fA-F-]{36})$")


def resolve_prefixes(keys: DataFrame, e: DataFrame, length: int = 8) -> DataFrame:
    """(key, id): the newest episode whose id begins with each key; an equi-join on the shortest prefix, then verified."""
    named = e.select("id", "started", F.left("id", F.lit(length)).alias("p"))
    hits = keys.withColumn("p", F.left("key", F.lit(length))).join(named, "p").filter(F.startswith("id", F.col("key")))
    newest = Window.partitionBy("key").orderBy(F.desc_nulls_last("started"), "id")
    return hits.withColumn("r", F.row_number().over(newest)).filter("r = 1").select("key", "id")


def is_unused(now: Column, days: int = 30) -> Column:
    return (F.col("retrievals") == 0) | F.col("last_retrieval").isNull() | (whole_days(now, F.col("last_retrieval")) > days)


def statistics(e: DataFrame, *by: str) -> DataFrame:
    w = wilson(F.col("helpful"), F.col("retrievals"))
    return e.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in OUTCOMES],
        F.coalesce(F.sum("retrievals"), F.lit(0)).alias("retrievals"), F.coalesce(F.sum("helpful"), F.lit(0)).alias("helpful"), F.round(F.coalesce(F.avg(w), F.lit(0.0)), 6).alias("avg_utility"),
    )


def shortened(c: Column, n: int) -> Column:
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.left(c, F.lit(n - 3)), F.lit("...")))


def icon(status: Column) -> Column:
    return F.when(status == "success", "✅").when(status == "failure", "❌").otherwise("⚠️")


def updated(e: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """A snapshot in which the columns of ``changes`` (one row for each key) replace those of ``e``; unknown keys are ignored."""
    fields = [c for c in changes.columns if c != key]
    new = changes.select(key, F.struct(*fields).alias("_new"))
    joined = e.join(new, key, "left")
    return joined.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in e.columns])


def deleted(e: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """A snapshot without the named rows."""
    return e.join(keys.select(key).distinct(), key, "left_anti")


def upserted(e: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """A snapshot with ``rows`` in place of those of the same key, and added where there are none."""
    return deleted(e, rows, key).unionByName(rows)


def with_feedback(e: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A snapshot after (key, helpful, seq), with the flag of the last retrieval in ``last_helpful`` (null: mixed or none given).

    Keys may be shortened ids. helpful is counted up to the retrievals, the learned utility becomes what the counters say,
    and of several verdicts on an episode the one with the highest ``seq`` stays on its last retrieval.
    """
    names = resolve_prefixes(verdicts.select("key").distinct(), e)
    n = verdicts.join(names, "key").groupBy("id").agg(F.count_if("helpful").alias("plus"), F.max_by("helpful", "seq").alias("last_helpful"))
    joined = e.join(n, "id", "left")
    helpful = F.least(F.col("helpful") + F.coalesce("plus", F.lit(0)), F.col("retrievals"))
    learned = F.when(F.col("plus").isNotNull(), wilson(helpful, F.col("retrievals"))).otherwise(F.col("learned"))
    return joined.withColumns({"learned": learned, "helpful": helpful}).select(*e.columns, "last_helpful")
