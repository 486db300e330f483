"""Statistics, filters, listings and utilities over episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumora.functions.utility import WILSON_SQL, combined, confidence, decay, share, whole_days, wilson
from lumora.operators import store
from lumora.operators.propagation import decayed, prunable
from lumora.plans.check import Registry
from lumora.schema import AS_OF, episodes
from lumora.tables import table

registered = Registry()
QUERIES, ORACLES = registered.queries, registered.oracles


def _w() -> Column:
    return wilson(F.col("helpful"), F.col("retrievals"))


def _now() -> Column:
    return F.lit(AS_OF).cast("timestamp")

NOW_SQL = f"TIMESTAMP '{AS_OF}'"


def _days_sql(t: str) -> str:
    return f"trunc((epoch_us({NOW_SQL}) - epoch_us({t})) / 86400000000.0)"


@registered(f"SELECT id, round({WILSON_SQL}, 6) AS utility, CASE WHEN retrievals = 0 THEN 'untested' WHEN retrievals <= 2 THEN 'low confidence' WHEN retrievals <= 5 THEN 'moderate confidence' ELSE 'high confidence' END AS confidence, retrievals FROM ep ORDER BY {WILSON_SQL} DESC, id LIMIT 10", episodes=True)
def utility_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """The ten most useful episodes."""
    scored = episodes(spark, d).select("id", F.round(_w(), 6).alias("utility"), confidence(F.col("retrievals")).alias("confidence"), "retrievals", _w().alias("w"))
    return scored.orderBy(F.desc("w"), "id").limit(10).drop("w")


@registered(f"SELECT id, helpful, retrievals, round({WILSON_SQL}, 6) AS wilson FROM ep", episodes=True)
def wilson_by_episode(spark: SparkSession, d: str) -> DataFrame:
    return episodes(spark, d).select("id", "helpful", "retrievals", F.round(_w(), 6).alias("wilson"))


_STATS_SQL = f"count(*) AS n, count_if(status = 'success') AS n_success, count_if(status = 'partial') AS n_partial, count_if(status = 'failure') AS n_failure, sum(retrievals)::BIGINT AS retrievals, sum(helpful)::BIGINT AS helpful, round(avg({WILSON_SQL}), 6) AS avg_utility"


@registered(f"SELECT {_STATS_SQL} FROM ep", episodes=True)
def store_stats(spark: SparkSession, d: str) -> DataFrame:
    return store.statistics(episodes(spark, d))


@registered(f"SELECT project, {_STATS_SQL}, round(count_if(status = 'success') / count(*)::DOUBLE, 6) AS success_rate, round(CASE WHEN sum(retrievals) > 0 THEN sum(helpful)/sum(retrievals)::DOUBLE ELSE 0 END, 6) AS feedback_rate FROM ep GROUP BY project", episodes=True)
def stats_by_project(spark: SparkSession, d: str) -> DataFrame:
    s = store.statistics(episodes(spark, d), "project")
    return s.withColumns({"success_rate": F.round(share(F.col("n_success"), F.col("n")), 6), "feedback_rate": F.round(share(F.col("helpful"), F.col("retrievals")), 6)})


@registered("SELECT status, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS percent FROM ep GROUP BY status", episodes=True)
def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    n = episodes(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    # one row for each status
    total = n.agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total), F.lit(True)).select("status", "n", F.round(F.col("n") * 100 / F.col("total"), 4).alias("percent"))


@registered("SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM ep) GROUP BY tag ORDER BY n DESC, tag LIMIT 10", episodes=True)
def top_tags(spark: SparkSession, d: str) -> DataFrame:
    tags = episodes(spark, d).select(F.explode("tags").alias("tag"))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(10)


@registered("SELECT task_type, count(*) AS n FROM ep GROUP BY task_type", episodes=True)
def task_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return episodes(spark, d).groupBy("task_type").agg(F.count(F.lit(1)).alias("n"))


@registered("SELECT count(DISTINCT project) AS n_projects, string_agg(DISTINCT project, ',' ORDER BY project) AS projects FROM ep", episodes=True)
def distinct_projects(spark: SparkSession, d: str) -> DataFrame:
    p = episodes(spark, d).select("project").distinct()
    return p.agg(F.count("project").alias("n_projects"), F.array_join(F.array_sort(F.collect_list("project")), ",").alias("projects"))


@registered("SELECT id, project, status FROM ep WHERE contains(lower(project), 'kiln') AND len(list_filter(tags, lambda t: contains(lower(t), 'test'))) > 0 AND status = 'success' ORDER BY started DESC, id LIMIT 25", episodes=True)
def list_filtered(spark: SparkSession, d: str) -> DataFrame:
    got = store.listed(episodes(spark, d), project="KILN", tag="test", outcome="success", limit=25)
    return got.select("id", "project", "status")


@registered("SELECT id, status FROM ep WHERE contains(lower(project), 'loom') ORDER BY started DESC, id LIMIT 40", episodes=True)
def list_unknown_outcome(spark: SparkSession, d: str) -> DataFrame:
    """An outcome that isn't known filters nothing."""
    return store.listed(episodes(spark, d), project="loom", outcome="whatever", limit=40).select("id", "status")


@registered("SELECT project, count_if(contains(lower(project), 'indigo')) AS n_contains, count_if(lower(project) = 'indigo-kiln') AS n_equal_folded, count_if(project = 'indigo-kiln') AS n_equal, count(*) AS n_any FROM ep GROUP BY project", episodes=True)
def project_match_modes(spark: SparkSession, d: str) -> DataFrame:
    """The four ways in which an episode's project is matched."""
    e = episodes(spark, d)
    hits = {f"n_{m}": F.count_if(store.project_matches(F.col("project"), p, m)) for m, p in (("contains", "Indigo"), ("equal_folded", "Indigo-Kiln"), ("equal", "indigo-kiln"), ("any", ""))}
    return e.groupBy("project").agg(*[c.alias(n) for n, c in hits.items()])


@registered("SELECT id, project, status FROM ep WHERE started IS NOT NULL ORDER BY started DESC, id LIMIT 1", episodes=True)
def latest_episode(spark: SparkSession, d: str) -> DataFrame:
    return store.latest(episodes(spark, d)).select("id", "project", "status")


@registered("AND short AS (SELECT DISTINCT episode_id AS key FROM feedback WHERE length(episode_id) = 8) SELECT key, id FROM (SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY started DESC NULLS LAST, id) AS r FROM short JOIN ep ON left(id, 8) = key) WHERE r = 1", episodes=True)
def lookup_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Ids shortened to eight characters, resolved to the newest episode that begins with them."""
    keys = table(spark, d, "feedback").select(F.col("episode_id").alias("key")).filter(F.length("key") == 8).distinct()
    return store.resolve_prefixes(keys, episodes(spark, d))


@registered("SELECT episode_id, regexp_matches(trim(episode_id), '^([0-9a-fA-F]{8}|[0-9a-fA-F-]{36})$') AS is_id, count(*) AS n FROM (SELECT DISTINCT * FROM feedback) GROUP BY episode_id")
def id_shape(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "feedback").distinct().groupBy("episode_id").agg(F.count(F.lit(1)).alias("n"))
    return f.select("episode_id", store.looks_like_id(F.col("episode_id")).alias("is_id"), "n")


@registered(
    f"""SELECT count(*) AS n, {_days_sql('max(started)')}::BIGINT AS days_since_capture,
  count_if(last_retrieval IS NULL OR retrievals = 0 OR {_days_sql('last_retrieval')} > 30) AS n_unused, count_if({WILSON_SQL} > 0.4) AS n_high_value,
  round(avg({WILSON_SQL}), 6) AS avg_utility, round(CASE WHEN sum(retrievals) > 0 THEN sum(helpful) / sum(retrievals)::DOUBLE ELSE 0 END, 6) AS feedback_rate,
  {_days_sql('max(started)')} > 7 AS hint_capture, count_if(last_retrieval IS NULL OR retrievals = 0 OR {_days_sql('last_retrieval')} > 30) > count(*) // 2 AS hint_unused,
  CASE WHEN sum(retrievals) > 0 THEN sum(helpful) / sum(retrievals)::DOUBLE ELSE 0 END < 0.2 AND sum(retrievals) > 5 AS hint_feedback, avg({WILSON_SQL}) < 0.3 AND sum(retrievals) > 0 AS hint_utility, count_if({WILSON_SQL} > 0.4) = 0 AS hint_no_high_value
FROM ep WHERE lower(project) = 'indigo-kiln'""",
    episodes=True,
)
def memory_status(spark: SparkSession, d: str) -> DataFrame:
    e = episodes(spark, d).filter(store.project_matches(F.col("project"), "Indigo-Kiln", "equal_folded"))
    unused = F.count_if(store.is_unused(_now()))
    since = whole_days(_now(), F.max("started"))
    rate, used, high = share(F.sum("helpful"), F.sum("retrievals")), F.coalesce(F.sum("retrievals"), F.lit(0)), F.count_if(_w() > 0.4)
    return e.agg(
        F.count(F.lit(1)).alias("n"), since.alias("days_since_capture"), unused.alias("n_unused"), high.alias("n_high_value"),
        F.round(F.coalesce(F.avg(_w()), F.lit(0.0)), 6).alias("avg_utility"), F.round(rate, 6).alias("feedback_rate"),
        (since > 7).alias("hint_capture"), (unused > F.floor(F.count(F.lit(1)) / 2)).alias("hint_unused"),
        ((rate < 0.2) & (used > 5)).alias("hint_feedback"), ((F.avg(_w()) < 0.3) & (used > 0)).alias("hint_utility"), (high == 0).alias("hint_no_high_value"),
    )


@registered(f"SELECT id, {_days_sql('last_retrieval')}::BIGINT AS idle_days FROM ep WHERE retrievals = 0 OR last_retrieval IS NULL OR {_days_sql('last_retrieval')} > 30", episodes=True)
def unused_memories(spark: SparkSession, d: str) -> DataFrame:
    return episodes(spark, d).filter(store.is_unused(_now())).select("id", whole_days(_now(), F.col("last_retrieval")).alias("idle_days"))


@registered(f"SELECT id, {_days_sql('started')}::BIGINT AS age_days, round({WILSON_SQL}, 6) AS wilson FROM ep WHERE {_days_sql('started')} > 30 AND {WILSON_SQL} < 0.2", episodes=True)
def stale_memories(spark: SparkSession, d: str) -> DataFrame:
    age = whole_days(_now(), F.col("started"))
    return episodes(spark, d).filter((age > 30) & (_w() < 0.2)).select("id", age.alias("age_days"), F.round(_w(), 6).alias("wilson"))


@registered(f"SELECT id, round({WILSON_SQL}, 6) AS wilson, retrievals = 0 AS untested FROM ep WHERE {WILSON_SQL} > 0.4", episodes=True)
def high_value(spark: SparkSession, d: str) -> DataFrame:
    return episodes(spark, d).filter(_w() > 0.4).select("id", F.round(_w(), 6).alias("wilson"), (F.col("retrievals") == 0).alias("untested"))


_LAST = "coalesce(last_retrieval, ended)"
_FACTOR = f"pow(0.99, greatest({_days_sql(_LAST)}, 0))"


@registered(f"SELECT id, {_days_sql(_LAST)}::BIGINT AS days, round({WILSON_SQL} * {_FACTOR}, 6) AS learned FROM ep WHERE {_LAST} IS NOT NULL AND {_FACTOR} < 0.99", episodes=True)
def utility_decay(spark: SparkSession, d: str) -> DataFrame:
    return decayed(episodes(spark, d), _now()).filter("decays").select("id", "days", F.round("new_learned", 6).alias("learned"))


@registered(f"SELECT count(*) AS n_decayed, round(coalesce(sum({WILSON_SQL} * {_FACTOR} - {WILSON_SQL}), 0), 4) AS total_change FROM ep WHERE {_LAST} IS NOT NULL AND {_FACTOR} < 0.99", episodes=True)
def decay_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = decayed(episodes(spark, d), _now()).filter("decays")
    return e.agg(F.count(F.lit(1)).alias("n_decayed"), F.round(F.coalesce(F.sum(F.col("new_learned") - _w()), F.lit(0.0)), 4).alias("total_change"))


_PRUNE = f"({_days_sql('started')} > 200 OR coalesce(learned, {WILSON_SQL}) < 0.3) AND helpful = 0"


@registered(
    f"""SELECT id, left(id, 8) AS short_id, CASE WHEN trim(intent) <> '' THEN left(trim(intent), 50) ELSE left(trim(raw_prompt), 50) END AS title,
  concat_ws(';', CASE WHEN {_days_sql('started')} > 200 THEN 'age ' || {_days_sql('started')}::BIGINT || ' days' END, CASE WHEN coalesce(learned, {WILSON_SQL}) < 0.3 THEN 'low utility' END) AS reasons
FROM ep WHERE {_PRUNE}""",
    episodes=True,
)
def prune_candidates(spark: SparkSession, d: str) -> DataFrame:
    return prunable(episodes(spark, d), _now(), max_age=200, min_utility=0.3).filter("pruned").select("id", "short_id", "title", "reasons")


@registered(f"SELECT count(*) AS n, count_if({_PRUNE}) AS n_pruned, count_if(NOT coalesce({_PRUNE}, false)) AS n_retained FROM ep", episodes=True)
def prune_retained(spark: SparkSession, d: str) -> DataFrame:
    p = prunable(episodes(spark, d), _now(), max_age=200, min_utility=0.3)
    return p.agg(F.count(F.lit(1)).alias("n"), F.count_if("pruned").alias("n_pruned"), F.count_if(~F.col("pruned")).alias("n_retained"))


@registered(
    """AND r AS (SELECT episode_id, count(*) AS n, max(ts) AS last_ts FROM (SELECT DISTINCT retrieval_id, episode_id, ts FROM retrievals) GROUP BY episode_id)
SELECT id, coalesce(n, 0) AS n_logged, retrievals AS n_stored, strftime(last_ts, '%Y-%m-%d') AS last_day FROM ep LEFT JOIN r ON r.episode_id = ep.id""",
    episodes=True,
)
def retrieval_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters from the append-only log beside the stored ones; the log is counted before it meets the episodes."""
    log = table(spark, d, "retrievals").select("retrieval_id", "episode_id", "ts").distinct()
    n = log.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))
    e = episodes(spark, d).select("id", F.col("retrievals").alias("n_stored"))
    return e.join(n, e.id == n.episode_id, "left").select("id", F.coalesce("n", F.lit(0)).alias("n_logged"), "n_stored", F.date_format("last_ts", "yyyy-MM-dd").alias("last_day"))


@registered(
    """AND f AS (SELECT DISTINCT feedback_id, episode_id, ts, helpful FROM feedback), keys AS (SELECT DISTINCT episode_id AS key FROM f),
named AS (SELECT key, id FROM (SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY started DESC NULLS LAST, id) AS r FROM keys JOIN ep ON left(id, 8) = left(key, 8) AND starts_with(id, key)) WHERE r = 1)
SELECT id, count(*) AS n_feedback, count_if(coalesce(helpful, false)) AS n_helpful, count_if(helpful IS NULL) AS n_mixed, arg_max(CASE WHEN helpful THEN 'helpful' WHEN helpful IS NULL THEN 'mixed' ELSE 'not helpful' END, (ts, feedback_id)) AS last_verdict
FROM f JOIN named ON f.episode_id = named.key GROUP BY id""",
    episodes=True,
)
def feedback_apply(spark: SparkSession, d: str) -> DataFrame:
    """Feedback by episode; shortened ids are resolved first."""
    f = table(spark, d, "feedback").select("feedback_id", "episode_id", "ts", "helpful").distinct()
    named = store.resolve_prefixes(f.select(F.col("episode_id").alias("key")).distinct(), episodes(spark, d))
    verdict = F.when(F.col("helpful"), "helpful").when(F.col("helpful").isNull(), "mixed").otherwise("not helpful")
    return f.join(named, f.episode_id == named.key).groupBy("id").agg(
        F.count(F.lit(1)).alias("n_feedback"), F.count_if("helpful").alias("n_helpful"), F.count_if(F.col("helpful").isNull()).alias("n_mixed"),
        F.max_by(verdict, F.struct("ts", "feedback_id")).alias("last_verdict"),
    )


@registered(
    f"""AND f AS (SELECT DISTINCT feedback_id, episode_id, ts, helpful FROM feedback), keys AS (SELECT DISTINCT episode_id AS key FROM f),
named AS (SELECT key, id FROM (SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY started DESC NULLS LAST, id) AS r FROM keys JOIN ep ON left(id, 8) = left(key, 8) AND starts_with(id, key)) WHERE r = 1),
n AS (SELECT id, count_if(coalesce(f.helpful, false)) AS plus, first(CASE WHEN f.helpful THEN 'helpful' WHEN NOT f.helpful THEN 'not helpful' END ORDER BY ts DESC, feedback_id DESC) AS flag FROM f JOIN named ON f.episode_id = named.key GROUP BY id),
u AS (SELECT ep.id, ep.learned, n.id IS NOT NULL AS given, least(ep.helpful + coalesce(plus, 0), ep.retrievals) AS helpful, ep.retrievals, flag FROM ep LEFT JOIN n USING (id))
SELECT id, helpful, round(CASE WHEN given THEN {WILSON_SQL} ELSE learned END, 6) AS learned, flag AS last_flag FROM u""",
    episodes=True,
)
def feedback_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The store after all feedback: helpful counted, learned set from the counters, the last verdict on the last retrieval."""
    f = table(spark, d, "feedback").select("feedback_id", F.col("episode_id").alias("key"), "ts", "helpful").distinct()
    e = store.with_feedback(episodes(spark, d), f.select("key", "helpful", F.struct("ts", "feedback_id").alias("seq")))
    flag = F.when(F.col("last_helpful"), "helpful").when(~F.col("last_helpful"), "not helpful")
    return e.select("id", "helpful", F.round("learned", 6).alias("learned"), flag.alias("last_flag"))


@registered(f"SELECT v.episode_id AS id, round(coalesce(learned, {WILSON_SQL}), 6) AS utility FROM (SELECT DISTINCT episode_id FROM vectors) v JOIN ep ON v.episode_id = ep.id", episodes=True)
def sync_utility(spark: SparkSession, d: str) -> DataFrame:
    """The utility that the index should hold: learned where there is one."""
    v = table(spark, d, "vectors").select(F.col("episode_id").alias("id")).distinct()
    return v.join(episodes(spark, d), "id").select("id", F.round(F.coalesce("learned", _w()), 6).alias("utility"))


@registered(f"SELECT s.search_id, s.id, round(0.3 * s.similarity_score::DOUBLE + 0.7 * {WILSON_SQL}, 5) AS combined, row_number() OVER (PARTITION BY s.search_id ORDER BY round(0.3 * s.similarity_score::DOUBLE + 0.7 * {WILSON_SQL}, 9) DESC, s.id) AS new_rank FROM (SELECT DISTINCT search_id, id, similarity_score FROM search_results WHERE similarity_score >= 0.5) s JOIN ep ON s.id = ep.id", episodes=True)
def rerank_logged_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits of earlier searches that still exist, ranked again by similarity and utility."""
    hits = table(spark, d, "search_results").filter(F.col("similarity_score") >= 0.5).select("search_id", "id", "similarity_score").distinct()
    c = combined(F.col("similarity_score").cast("double"), _w(), 0.7)
    order = Window.partitionBy("search_id").orderBy(F.desc(F.round(c, 9)), "id")
    return hits.join(episodes(spark, d), "id").select("search_id", "id", F.round(c, 5).alias("combined"), F.row_number().over(order).alias("new_rank"))


@registered("SELECT id, strftime(started, '%Y-%m-%d') AS day, CASE WHEN length(project) <= 15 THEN project ELSE left(project, 12) || '...' END AS project, CASE WHEN length(intent) <= 40 THEN intent ELSE left(intent, 37) || '...' END AS title, CASE status WHEN 'success' THEN '✅' WHEN 'failure' THEN '❌' ELSE '⚠️' END AS icon, retrievals AS n FROM ep", episodes=True)
def list_rows(spark: SparkSession, d: str) -> DataFrame:
    e = episodes(spark, d)
    return e.select(
        "id", F.date_format("started", "yyyy-MM-dd").alias("day"), store.shortened(F.col("project"), 15).alias("project"), store.shortened(F.col("intent"), 40).alias("title"),
        store.icon(F.col("status")).alias("icon"), F.col("retrievals").alias("n"),
    )


@registered("SELECT strftime(started, '%Y-%m-%d') AS day, count(*) AS n, min(id) AS first_id FROM ep GROUP BY 1", episodes=True)
def date_partitions(spark: SparkSession, d: str) -> DataFrame:
    """What each date directory of the store would hold."""
    return episodes(spark, d).groupBy(F.date_format("started", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@registered("SELECT id, e.error_type AS error_type, count(*) AS n, count_if(e.resolved) AS n_resolved, count_if(e.resolution IS NOT NULL) AS n_resolution FROM (SELECT id, unnest(errors) AS e FROM ep) GROUP BY id, e.error_type", episodes=True)
def errors_by_type(spark: SparkSession, d: str) -> DataFrame:
    e = episodes(spark, d).select("id", F.explode("errors").alias("e")).select("id", "e.*")
    return e.groupBy("id", "error_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("resolved").alias("n_resolved"), F.count("resolution").alias("n_resolution"))


@registered("SELECT id, list_aggregate(list_transform(list_filter(errors, lambda e: e.resolved), lambda e: coalesce(e.message, ''))[1:2], 'string_agg', ' / ') AS resolved FROM ep WHERE len(list_filter(errors, lambda e: e.resolved)) > 0", episodes=True)
def resolved_errors(spark: SparkSession, d: str) -> DataFrame:
    """The first two resolved errors of each episode that has any."""
    hit = F.filter("errors", lambda e: e["resolved"])
    text = F.array_join(F.slice(F.transform(hit, lambda e: F.coalesce(e["message"], F.lit(""))), 1, 2), " / ")
    return episodes(spark, d).filter(F.size(hit) > 0).select("id", text.alias("resolved"))


@registered("SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total, round(max(value), 6) AS largest FROM events GROUP BY user_id, event_type")
def event_counters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max("value"), 6).alias("largest"))
