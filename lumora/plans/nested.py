"""Queries of problem 1: captured payloads as flat tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.operators.inlining import ROOT, Inlined, inline
from lumora.tables import table

#: An episode is told by these parts; its lists are declared, so that they repeat however few payloads are seen.
EPISODE_KEYS = ("intent", "context", "retrieval_history")
CHILDREN = {
    "domain": "domain",
    "files_read": "files_read",
    "files_modified": "files_modified",
    "tools_invoked": "tools_invoked",
    "errors_encountered": "error",
    "attempts": "attempt",
    "retrieval_history": "retrieval",
}
#: Where a child belongs: an ``attempts`` list counts only below an error, the others below the episode itself.
PARENTS = {"attempts": "errors_encountered"}
#: Parts of the episode around its children; whether they are inlined depends on all payloads, where a child belongs does not.
WRAPPERS = ("intent", "context")


def inlined_episodes(raw: DataFrame, keep: Iterable[str] | None = None, paths: Iterable[str] = ()) -> Inlined:
    return inline(raw, "raw_id", "payload", EPISODE_KEYS, CHILDREN, keep, WRAPPERS, paths)


def found(raw: DataFrame) -> DataFrame:
    rows = inlined_episodes(raw, CHILDREN).rows
    name = F.create_map(*[F.lit(x) for kv in CHILDREN.items() for x in kv])[F.col("element")]
    parent = F.create_map(*[F.lit(x) for kv in PARENTS.items() for x in kv])[F.col("element")]
    own = F.when(parent.isNull(), F.col("depth") == 0).otherwise((F.col("depth") == 1) & (F.col("owner_element") == parent))
    return rows.filter(own).select(F.col("doc_id").alias("raw_id"), name.alias("child"), F.when(F.col("depth") == 0, F.lit(-1).cast("bigint")).otherwise(F.col("owner_pos")).alias("parent_pos"), "pos")


def root_columns(raw: DataFrame, wanted: list[str]) -> DataFrame:
    """doc_id and the values at the ``wanted`` paths of each record, wherever the plan put them; the first of several counts."""

    def above(path: str) -> list[str]:
        parts = path.split(".")
        return [".".join(parts[:i]) for i in range(1, len(parts) + 1)]

    elements = {p for c in wanted for p in c.split(".")}
    rows = inlined_episodes(raw, {ROOT, *elements}, wanted).rows
    values = []
    for c in wanted:
        value = F.when(F.col("path") == c, F.col("value")).when(F.col("path") == "", F.col("attributes")[c])
        for p in above(c)[:-1]:
            value = value.when(F.col("path") == p, F.col("attributes")[c.removeprefix(f"{p}.")])
        values.append(F.min_by(value, F.when(value.isNotNull(), F.col("row_id"))).alias(c))
    return rows.filter("path is not null").groupBy("doc_id").agg(*values)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(table(spark, sf_dir, "raw_episodes"))


def p1_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root table: one row for each readable payload, singletons inlined."""
    return episode_rows(table(spark, sf_dir, "raw_episodes"))


def episode_rows(raw: DataFrame) -> DataFrame:
    want = {
        "id": "episode_id", "project": "project", "timestamp_start": "timestamp_start", "timestamp_end": "timestamp_end",
        "intent.extracted_intent": "extracted_intent", "intent.task_type": "task_type", "outcome.status": "status",
        "outcome.tests_after.passed": "tests_after_passed", "utility.retrieval_count": "retrieval_count",
    }
    t = root_columns(raw, list(want))
    return t.select(F.col("doc_id").alias("raw_id"), *[F.col(f"`{c}`").alias(a) for c, a in want.items()])


def p1_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors with the number of attempts that hang below each, joined over the foreign key."""
    got = inlined_episodes(table(spark, sf_dir, "raw_episodes"), ["errors_encountered", "attempts"]).written()
    errors, attempts = got.table("errors_encountered"), got.table("attempts")
    column = lambda c: F.col(c) if c in errors.columns else F.lit(None).cast("string")
    n = attempts.groupBy("doc_id", F.col("parent_row_id").alias("row_id")).agg(F.count(F.lit(1)).alias("n_attempts"))
    return errors.join(n, ["doc_id", "row_id"], "left").select(
        F.col("doc_id").alias("raw_id"), "pos", column("error_type").alias("error_type"), column("message").alias("message"),
        F.coalesce("n_attempts", F.lit(0)).alias("n_attempts"),
    )


def p1_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables that the plan makes, with their row counts and number of parents."""
    rows = inlined_episodes(table(spark, sf_dir, "raw_episodes")).rows
    return rows.groupBy("element", "parent_element").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("doc_id").alias("n_records"))


QUERIES = {"p1_found": p1_found, "p1_episodes": p1_episodes, "p1_errors": p1_errors, "p1_schema": p1_schema}
