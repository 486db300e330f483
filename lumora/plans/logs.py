"""Queries on logs, on records as JSON, and on the logs as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.plans.check import Registry
from lumora.schema import EPISODE
from lumora.session import ensure_checkpoint_dir
from lumora.sources import files
from lumora.streaming import counters
from lumora.tables import table

registered = Registry()
QUERIES, ORACLES = registered.queries, registered.oracles


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Each past search as a line of the log, numbered in order of its time."""
    s = table(spark, d, "search_results").select("search_id", "searched_at", "hit_rank", F.left("id", F.lit(8)).alias("short")).distinct()
    hits = s.groupBy("search_id", "searched_at").agg(F.array_sort(F.collect_list(F.struct("hit_rank", "short"))).alias("h"))
    line = files.log_line(F.col("searched_at").cast("timestamp"), "query", F.concat(F.lit("search\t"), F.col("search_id").cast("string")), F.col("h.short"))
    return hits.select(F.struct("searched_at", "search_id").alias("seq"), line.alias("value"))


@registered("SELECT row_number() OVER (ORDER BY hit_rank, short) - 1 AS pos, short AS id FROM (SELECT DISTINCT hit_rank, left(id, 8) AS short FROM search_results WHERE search_id = (SELECT arg_max(search_id, (searched_at, search_id)) FROM search_results))")
def feedback_last_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids that "last" stands for in a feedback."""
    return files.last_ids(_log(spark, d))


@registered("SELECT strftime(searched_at, '%Y-%m') AS month, count(DISTINCT search_id) AS n_lines, count(DISTINCT (search_id, hit_rank, left(id, 8))) AS n_ids FROM search_results GROUP BY 1")
def log_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Log lines written and read again, by month."""
    lines = _log(spark, d).select(*files.log_fields(F.col("value"))).filter("kind = 'query'")
    return lines.groupBy(F.date_format("at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.size("ids")).alias("n_ids"))


@registered("SELECT id, any_value(project) AS project, len(any_value(context.errors_encountered)) AS n_errors, len(any_value(retrieval_history)) AS n_history, true AS same FROM episodes WHERE id IS NOT NULL GROUP BY id")
def record_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Episodes written as JSON documents and parsed again by the fixed schema."""
    e = table(spark, d, "episodes").filter("id is not null").dropDuplicates(["id"])
    e = e.select(*[F.col(f.name).cast(f.dataType) for f in EPISODE.fields])
    both = e.select(F.struct(*e.columns).alias("a"), F.from_json(F.to_json(F.struct(*e.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}), EPISODE).alias("b"))
    same = F.to_json("a") == F.to_json("b")
    return both.select("b.id", "b.project", F.nullif(F.size("b.context.errors_encountered"), F.lit(-1)).alias("n_errors"), F.nullif(F.size("b.retrieval_history"), F.lit(-1)).alias("n_history"), same.alias("same"))


@registered("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM (SELECT DISTINCT retrieval_id, ts FROM retrievals WHERE ts IS NOT NULL) GROUP BY 1")
def stream_daily_retrievals(spark: SparkSession, d: str) -> DataFrame:
    """Retrievals of each day: final days from the log as a stream, and those that may still change from the log as it is."""
    log = counters.log_stream(spark, f"{d}/retrievals.parquet")
    final = counters.drained(counters.daily_counts(log, "retrieval_id"), f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}")
    rows = table(spark, d, "retrievals").filter("ts is not null").select("retrieval_id", "ts").distinct()
    now = rows.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return final.unionByName(now.join(final.select("day"), "day", "left_anti"))
