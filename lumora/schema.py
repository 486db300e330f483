"""The episode record and its slim view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumora.tables import table

_S, _L = T.StringType(), T.LongType()
_tests = T.StructType([T.StructField(n, _L) for n in ("passed", "failed", "skipped")])
EPISODE = T.StructType([
    T.StructField("id", _S), T.StructField("timestamp_start", T.TimestampType()), T.StructField("timestamp_end", T.TimestampType()), T.StructField("project", _S),
    T.StructField("intent", T.StructType([T.StructField("raw_prompt", _S), T.StructField("extracted_intent", _S), T.StructField("task_type", _S), T.StructField("domain", T.ArrayType(_S))])),
    T.StructField("context", T.StructType([
        *[T.StructField(n, T.ArrayType(_S)) for n in ("files_read", "files_modified", "tools_invoked")],
        T.StructField("errors_encountered", T.ArrayType(T.StructType([T.StructField("error_type", _S), T.StructField("message", _S), T.StructField("resolved", T.BooleanType()), T.StructField("resolution", _S)]))),
    ])),
    T.StructField("outcome", T.StructType([T.StructField("status", _S), T.StructField("tests_before", _tests), T.StructField("tests_after", _tests), T.StructField("commit_sha", _S), T.StructField("pr_number", _L)])),
    T.StructField("utility", T.StructType([T.StructField("score", T.DoubleType()), T.StructField("retrieval_count", _L), T.StructField("helpful_count", _L)])),
    T.StructField("retrieval_history", T.ArrayType(T.StructType([T.StructField("timestamp", T.TimestampType()), T.StructField("project", _S), T.StructField("task_description", _S), T.StructField("was_helpful", T.BooleanType())]))),
])

#: The moment that ages are measured from in the registered queries; operators take it as a parameter.
AS_OF = "2025-06-30 00:00:00"


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One slim row for each id: identical copies united, counters made consistent, null lists and entries dropped.

    The flat columns are taken before the copies are united, so that only those a query uses are read and shuffled.
    helpful never exceeds retrievals, so that a utility is always a number; lists keep their order and repeats.
    """
    e = table(spark, sf_dir, "episodes").filter(F.col("id").isNotNull())
    n = F.greatest(F.coalesce("utility.retrieval_count", F.lit(0)), F.lit(0))
    entries = lambda c: F.coalesce(F.array_compact(c), F.array().cast("array<string>"))
    return e.select(
        "id", "project",
        F.col("timestamp_start").cast("timestamp").alias("started"), F.col("timestamp_end").cast("timestamp").alias("ended"),
        F.coalesce("intent.raw_prompt", F.lit("")).alias("raw_prompt"), F.coalesce("intent.extracted_intent", F.lit("")).alias("intent"),
        F.coalesce("intent.task_type", F.lit("unknown")).alias("task_type"), entries("intent.domain").alias("tags"),
        entries("context.files_read").alias("files_read"), entries("context.files_modified").alias("files"), entries("context.tools_invoked").alias("tools"),
        F.coalesce(F.array_compact("context.errors_encountered"), F.array().cast(EPISODE["context"].dataType["errors_encountered"].dataType)).alias("errors"),
        F.coalesce("outcome.status", F.lit("partial")).alias("status"), F.col("utility.score").alias("learned"),
        n.alias("retrievals"), F.least(F.greatest(F.coalesce("utility.helpful_count", F.lit(0)), F.lit(0)), n).alias("helpful"),
        F.array_max(F.col("retrieval_history.timestamp")).cast("timestamp").alias("last_retrieval"),
    ).dropDuplicates(["id"])


#: The same view for the SQL checks.
EPISODES_SQL = """ep AS (
  SELECT id, any_value(project) AS project, any_value(timestamp_start) AS started, any_value(timestamp_end) AS ended,
    coalesce(any_value(intent.raw_prompt), '') AS raw_prompt, coalesce(any_value(intent.extracted_intent), '') AS intent,
    coalesce(any_value(intent.task_type), 'unknown') AS task_type,
    coalesce(list_filter(any_value(intent.domain), lambda x: x IS NOT NULL), []) AS tags,
    coalesce(list_filter(any_value(context.files_modified), lambda x: x IS NOT NULL), []) AS files,
    coalesce(list_filter(any_value(context.tools_invoked), lambda x: x IS NOT NULL), []) AS tools,
    coalesce(list_filter(any_value(context.errors_encountered), lambda x: x IS NOT NULL), []) AS errors,
    coalesce(any_value(outcome.status), 'partial') AS status, any_value(utility.score) AS learned,
    greatest(coalesce(any_value(utility.retrieval_count), 0), 0) AS retrievals,
    least(greatest(coalesce(any_value(utility.helpful_count), 0), 0), greatest(coalesce(any_value(utility.retrieval_count), 0), 0)) AS helpful,
    list_max(list_transform(any_value(retrieval_history), lambda h: h.timestamp)) AS last_retrieval
  FROM episodes WHERE id IS NOT NULL GROUP BY id)"""
