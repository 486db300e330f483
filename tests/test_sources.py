import json
import subprocess

from pyspark.sql import functions as F

from lumora.api import Memory
from lumora.schema import AS_OF, EPISODE, episodes
from lumora.sources import files
from lumora.streaming import counters
from lumora.tables import table


def test_documents_of_episodes(spark, tmp_path):
    day = tmp_path / "2025-01-01"
    day.mkdir()
    good = {"id": "a", "timestamp_start": "2025-01-01T00:00:00Z", "timestamp_end": "2025-01-01T01:00:00Z", "project": "p", "intent": {"domain": ["x"]}}
    (day / "session-a.json").write_text(json.dumps(good, indent=1))
    (day / "session-b.json").write_text('{"id": "b", ')
    (day / "session-c.json").write_text(json.dumps(good | {"id": "c", "project": None}))
    got = files.read_episode_files(spark, str(tmp_path)).collect()
    assert [(r.id, r.intent.domain, r.retrieval_history) for r in got] == [("a", ["x"], None)]


def test_written_episodes_come_back(spark, sf, tmp_path):
    e = table(spark, sf, "episodes").dropDuplicates(["id"])
    files.write_episodes(e, str(tmp_path / "e"))
    back = files.read_episodes(spark, str(tmp_path / "e"))
    assert back.count() == e.count() and "date" in back.columns
    plan = back.filter("date = '2024-05-01'").select("id")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_log(spark, tmp_path):
    line = spark.range(1).select(files.log_line(F.timestamp_seconds(F.lit(5)), "query", F.lit("a\tb"), F.array(F.lit("x"), F.lit("y"))).alias("value"))
    assert line.first()[0] == "1970-01-01T00:00:05.000000Z\tquery:a b\tids:x,y"
    r = line.select(*files.log_fields(F.col("value"))).first()
    assert (r.kind, r.text, r.ids) == ("query", "a b", ["x", "y"])
    lines = spark.createDataFrame([(1, "t\tquery:q\tids:a"), (2, "t\tfeedback:mixed\tids: b, ,c"), (3, "nothing")], "seq int, value string")
    assert [r.id for r in files.last_ids(lines).orderBy("pos").collect()] == ["b", "c"]
    assert files.last_ids(lines.filter("seq = 3")).collect() == []


def test_work_tree_and_newest_file(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    assert files.work_tree(spark, str(tmp_path)).first().files == []
    git("init", "-q")
    (tmp_path / "a.txt").write_text("1\n")
    git("add", "."), git("commit", "-qm", "x")
    (tmp_path / "a.txt").write_text("2\n")
    (tmp_path / "s.jsonl").write_text("{}")
    r = files.work_tree(spark, str(tmp_path)).first()
    assert r.files == ["a.txt", "s.jsonl"] and len(r.head) == 8 and "+2" in r.diff
    assert files.newest_file(spark, str(tmp_path)).first().path.endswith("s.jsonl")


def test_settings(tmp_path):
    assert files.Settings.read(tmp_path / "none") == files.Settings()
    (tmp_path / "c.toml").write_text("[retrieval]\nutility_weight = 0.5\nother = 1\n")
    s = files.Settings.read(tmp_path / "c.toml")
    assert (s.utility_weight, s.default_limit, s.extra) == (0.5, 3, {"other": 1})
    s.write(tmp_path / "d.toml")
    assert files.Settings.read(tmp_path / "d.toml") == s


def test_counters_from_a_stream(spark, sf, tmp_path):
    log, at = str(tmp_path / "log"), {"n": 0}
    r = table(spark, sf, "retrievals").filter("episode_id is not null").select("episode_id", F.col("ts").cast("timestamp").alias("ts"))

    def read():
        return spark.read.schema("episode_id string, n bigint, last timestamp").parquet(f"{tmp_path}/c{at['n']}")

    def save(df):
        df.write.parquet(f"{tmp_path}/c{at['n'] + 1}")
        at["n"] += 1

    spark.createDataFrame([], "episode_id string, n bigint, last timestamp").write.parquet(f"{tmp_path}/c0")
    for part in r.randomSplit([0.5, 0.5], seed=1):
        part.write.mode("append").parquet(log)
        counters.keep_counters(counters.log_stream(spark, log), read, save, f"{tmp_path}/state").awaitTermination()
    want = {(x.episode_id, x.n) for x in r.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {(x.episode_id, x.n) for x in read().collect()} == want and at["n"] == 2


def test_memory(spark, sf):
    m = Memory(episodes(spark, sf), AS_OF)
    assert m.list(5).count() == 5 and m.stats().first().n == m.episodes.count() and m.status().first().n_unused > 0
    first = m.list(1).first()
    assert m.show("latest").first().document.startswith("# Episode: ") and m.show(first.id[:8]).first().id == first.id
    loose = Memory(m.episodes, AS_OF, files.Settings(min_similarity=0.1))
    got = loose.retrieve_by_text(spark.createDataFrame([(1, first.raw_prompt)], "query_id int, text string"))
    assert 0 < got.count() <= 3
    after = m.feedback(spark.createDataFrame([(first.id[:8], True), ("nothing", True)], "id string, helpful boolean"))
    assert after.filter("id = '%s'" % first.id).first().helpful == min(first.helpful + 1, first.retrievals)
    assert m.retrieved(table(spark, sf, "retrievals")).agg(F.sum("retrievals")).first()[0] > m.episodes.agg(F.sum("retrievals")).first()[0]
    assert m.propagate(temporal=True).count() == m.episodes.count()
    pruned = m.prune(max_age=100)
    assert m.without(pruned).count() == m.episodes.count() - pruned.count()
    assert m.review().count() >= 1
    assert set(EPISODE.fieldNames()) == set(table(spark, sf, "episodes").columns)
