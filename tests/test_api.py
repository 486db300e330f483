import datetime

import pytest
from pyspark.sql import functions as F

from lumora.api import Memory
from lumora.operators import duplicates, store
from lumora.schema import episodes

SLIM = (
    "id string, project string, started timestamp, ended timestamp, raw_prompt string, intent string, task_type string, tags array<string>, files_read array<string>, files array<string>, tools array<string>, "
    "errors array<struct<error_type: string, message: string, resolved: boolean, resolution: string>>, status string, learned double, retrievals bigint, helpful bigint, last_retrieval timestamp"
)


def row(id_, project="p", day=1, intent="x", tags=(), files=(), errors=(), status="success", task="docs", retrievals=0, helpful=0):
    at = datetime.datetime(2025, 1, day, tzinfo=datetime.timezone.utc)
    return (id_, project, at, at, intent, intent, task, list(tags), [], list(files), [], [("runtime", m, True, None) for m in errors], status, None, retrievals, helpful, None)


def test_a_small_project_finds_its_vectors(spark):
    rows = [row(f"big{i}", "big", intent="fix the login bug") for i in range(40)] + [row("small", "small", intent="fix the login bug")]
    e = spark.createDataFrame(rows, SLIM)
    v = spark.createDataFrame([(r[0], [1.0, 0.0 if r[0] != "small" else 0.1]) for r in rows], "id string, vector array<float>")
    q = spark.createDataFrame([(1, "fix login", [1.0, 0.0]), (2, "fix the login bug", [-1.0, 0.0]), (3, "nothing alike", None)], "query_id int, text string, vector array<float>")
    m = Memory(e, "2025-06-30 00:00:00")
    assert [(r.query_id, r.id) for r in m.retrieve_by_vector(q.select("query_id", "vector"), v, project="SMALL", dims=2).collect()] == [(1, "small")]
    # the second query's vector finds nothing, its words do
    assert sorted((r.query_id, r.id) for r in m.retrieve(q, v, project="small", dims=2).collect()) == [(1, "small"), (2, "small")]


def test_feedback_keeps_the_last_verdict(spark):
    e = spark.createDataFrame([row("aaaaaaaa-1", retrievals=3), row("bbbbbbbb-1", retrievals=1), row("cccccccc-1")], SLIM)
    v = spark.createDataFrame([("aaaaaaaa", True, 1), ("aaaaaaaa-1", False, 3), ("aaaaaaaa-1", True, 2), ("bbbbbbbb-1", True, 1), ("bbbbbbbb-1", None, 2), ("zzzzzzzz", True, 1)], "key string, helpful boolean, seq int")
    got = {r.id[0]: (r.helpful, r.last_helpful, None if r.learned is None else round(r.learned, 6)) for r in store.with_feedback(e, v).collect()}
    assert got == {"a": (2, False, 0.207655), "b": (1, None, 0.206543), "c": (0, None, None)}


def test_captures_are_merged(spark):
    stored = spark.createDataFrame([row("s", day=1, intent="old", tags=["a", "b"], files=["f"], errors=["e1"], retrievals=5, helpful=2), row("other", day=2, tags=["z"])], SLIM)
    new = spark.createDataFrame([row("n2", day=9, intent="newest", tags=["c", "a"], files=["g", "f"], errors=["e1", "e3"], status="failure", task="test"), row("n1", day=8, intent="new", tags=["d"], errors=["e2"]), row("n3", day=7, intent="alone")], SLIM).withColumnRenamed("id", "new_id")
    match = spark.createDataFrame([("n1", "s"), ("n2", "s")], "new_id string, id string")
    got = {r.id: r for r in duplicates.merged_captures(stored, new, match).collect()}
    s = got["s"]
    assert set(got) == {"s", "other", "n3"} and got["other"].tags == ["z"]
    assert (s.intent, s.task_type, s.status, s.ended.day, s.tags, s.files, [e.message for e in s.errors], s.retrievals, s.helpful, s.started.day) == ("newest", "test", "failure", 9, ["a", "b", "d", "c"], ["f", "g"], ["e1", "e2", "e1", "e3"], 5, 2, 1)


@pytest.mark.parametrize("columns, read", [
    (["task_type"], "struct<id:string,intent:struct<task_type:string>>"), (["status"], "struct<id:string,outcome:struct<status:string>>"), (["tags"], "struct<id:string,intent:struct<domain:array<string>>>"),
    (["project"], "struct<id:string,project:string>"), (["retrievals"], "struct<id:string,utility:struct<retrieval_count:bigint>>"),
])
def test_only_what_is_used_is_read(spark, sf, columns, read):
    plan = episodes(spark, sf).groupBy(*columns).agg(F.count(F.lit(1)))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert f"ReadSchema: {read}" in plan


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from lumora.session import ensure_checkpoint_dir

    class Fake:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    class Session:
        sparkContext, conf = Fake(), {}  # noqa: N815

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())
