"""Queries on how utility spreads between episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.functions.utility import WILSON_SQL
from lumora.operators import propagation
from lumora.operators.neighbours import nearest
from lumora.plans.check import Registry
from lumora.schema import AS_OF, episodes
from lumora.tables import table

registered = Registry()
QUERIES, ORACLES = registered.queries, registered.oracles
#: Numbers in a vector of the vectors table.
EPISODE_WIDTH = 384


def edges(spark: SparkSession, d: str) -> DataFrame:
    """The similarity graph that past searches left behind, one row for each pair."""
    s = table(spark, d, "search_results").filter("similarity_score is not null")
    pairs = s.groupBy(F.col("query_episode_id").alias("source"), F.col("id").alias("target"))
    return pairs.agg(F.max(F.col("similarity_score").cast("double")).alias("similarity"), F.min("hit_rank").alias("hit_rank"))


def near_episodes(spark: SparkSession, d: str, k: int, least: float, asking: DataFrame | None = None) -> DataFrame:
    """(source, target, similarity, hit_rank): the k most similar existing episodes of each (or of those ``asking``), over all rows of ``vectors``."""
    known = table(spark, d, "episodes").select("id")
    v = table(spark, d, "vectors").select("episode_id", "vector", "indexed_at")
    return nearest(v, "episode_id", "vector", "indexed_at", k, least, EPISODE_WIDTH, known, asking).select(F.col("episode_id").alias("source"), F.col("neighbour").alias("target"), "similarity", "hit_rank")


def near_sql(k: int, least: float) -> str:
    """``near`` by comparing all with all."""
    latest = "coalesce(indexed_at, TIMESTAMP '1900-01-01')"
    return f"""lv AS (SELECT id, list_transform(v, lambda x: x::DOUBLE) AS v FROM (SELECT episode_id AS id, arg_max(vector, {latest}) AS v, arg_max(len(vector), {latest}) AS w FROM vectors WHERE episode_id IN (SELECT id FROM episodes WHERE id IS NOT NULL) GROUP BY 1) WHERE w = {EPISODE_WIDTH}),
uv AS (SELECT id, v FROM lv WHERE len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = {EPISODE_WIDTH} AND len(list_filter(v, lambda x: x <> 0)) > 0),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY similarity DESC, target) AS hit_rank FROM (SELECT a.id AS source, b.id AS target, list_cosine_similarity(a.v, b.v) AS similarity FROM uv a JOIN uv b ON a.id <> b.id) WHERE similarity >= {least}) WHERE hit_rank <= {k})"""


@registered(f"WITH {near_sql(10, -1)} SELECT source, target, round(similarity, 5) AS similarity, hit_rank FROM near")
def knn_join(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar other episodes of every episode."""
    return near_episodes(spark, d, 10, -1.0).withColumn("similarity", F.round("similarity", 5))


_EDGES = "edges AS (SELECT query_episode_id AS source, id AS target, max(similarity_score::DOUBLE) AS similarity, min(hit_rank) AS hit_rank FROM search_results WHERE similarity_score IS NOT NULL GROUP BY ALL)"

_EXACT_EDGES = near_sql(9, 0.5) + ", edges AS (SELECT source, target, similarity, hit_rank FROM near)"


def _spread_sql(old: str) -> str:
    return f"""hits AS (
  SELECT g.target, coalesce({old}, 0.5) AS old, 0.9 * s.w * g.similarity AS x, -coalesce(epoch_us(s.started), 0) AS newest, g.source, g.hit_rank
  FROM edges g JOIN (SELECT id, started, {WILSON_SQL} AS w FROM ep WHERE retrievals >= 2 AND helpful * 2 > retrievals) s ON g.source = s.id JOIN ep t ON g.target = t.id
  WHERE g.similarity >= 0.5 AND g.source <> g.target),
lists AS (SELECT target, any_value(old) AS old, list(x ORDER BY newest, source, hit_rank) AS xs FROM hits GROUP BY target),
spread AS (SELECT target AS id, len(xs) AS n_sources,
  list_reduce(list_prepend(old, xs), lambda a, x: CASE WHEN abs(greatest(0.0, least(1.0, a + 0.1 * (x - a))) - a) > 0.01 THEN greatest(0.0, least(1.0, a + 0.1 * (x - a))) ELSE a END) AS new FROM lists)"""


@registered(f"AND {_EDGES}, {_spread_sql('t.learned')} SELECT id, round(new, 6) AS learned, n_sources FROM spread", episodes=True)
def bellman_propagation(spark: SparkSession, d: str) -> DataFrame:
    got = propagation.similarity_propagated(episodes(spark, d), edges(spark, d))
    return got.select("id", F.round("new_learned", 6).alias("learned"), "n_sources")


@registered(
    f"""AND {_EXACT_EDGES}, {_spread_sql('t.learned')} SELECT id, round(new, 6) AS learned, n_sources FROM spread""",
    episodes=True,
)
def bellman_propagation_knn(spark: SparkSession, d: str) -> DataFrame:
    """Propagation to the nine nearest of each episode (the ten of the reference hold the episode itself), whoever searched before."""
    e = episodes(spark, d)
    got = propagation.similarity_propagated(e, near_episodes(spark, d, 9, propagation.LEAST_SIMILARITY, propagation.sources(e).select("id")))
    return got.select("id", F.round("new_learned", 6).alias("learned"), "n_sources")


@registered(
    f"""AND long AS (SELECT id, {WILSON_SQL} AS w, unnest(list_append(list_transform(tags, lambda t: lower(t)), lower(task_type))) AS tag FROM ep),
a AS (SELECT tag, round(avg(w), 9) AS mean FROM long GROUP BY tag HAVING count(*) >= 2)
SELECT id, max(tag) AS tag, round(arg_max(greatest(0.0, least(1.0, w + 0.1 * (mean - w))), tag), 6) AS learned FROM long JOIN a USING (tag) WHERE w < mean - 0.1 GROUP BY id""",
    episodes=True,
)
def tag_propagation(spark: SparkSession, d: str) -> DataFrame:
    got = propagation.tag_propagated(episodes(spark, d))
    return got.select("id", "tag", F.round("new_learned", 6).alias("learned"))


def _hit_sql(k: int) -> str:
    return f"""coalesce(lead(status, {k}) OVER o = 'success' AND (lead(project, {k}) OVER o = project OR list_has_any(lead(tags, {k}) OVER o, tags))
  AND lead(s, {k}) OVER o - min(t) OVER (ORDER BY started, id ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) <= 3600000000, false)
  AND least(1.0, old + {0.9 * (1 - 0.2 * k) * 0.1!r}) > old + 0.01 AS h{k}"""


@registered(
    f"""AND r AS (SELECT *, epoch_us(started) AS s, coalesce(epoch_us(ended), epoch_us(started)) AS t, coalesce(learned, {WILSON_SQL}) AS old FROM ep WHERE started IS NOT NULL),
h AS (SELECT id, old, {', '.join(_hit_sql(k) for k in (1, 2, 3, 4))} FROM r WINDOW o AS (ORDER BY started, id)),
l AS (SELECT *, CASE WHEN h4 THEN 4 WHEN h3 THEN 3 WHEN h2 THEN 2 WHEN h1 THEN 1 END AS distance FROM h)
SELECT id, distance, round(least(1.0, old + 0.09 * (1 - 0.2 * distance)), 6) AS learned, (h1::INT + h2::INT + h3::INT + h4::INT) AS n_updates FROM l WHERE distance IS NOT NULL""",
    episodes=True,
)
def temporal_credit(spark: SparkSession, d: str) -> DataFrame:
    got = propagation.time_credited(episodes(spark, d))
    return got.select("id", "distance", F.round("new_learned", 6).alias("learned"), "n_updates")


_DAYS = f"trunc((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(coalesce(last_retrieval, ended))) / 86400000000.0)"
_DECAYED = f"(CASE WHEN pow(0.99, greatest({_DAYS}, 0)) < 0.99 THEN {WILSON_SQL} * pow(0.99, greatest({_DAYS}, 0)) ELSE learned END)"


def _summary_sql(edges: str) -> str:
    return f"""AND {edges}, decay AS (SELECT id, coalesce(pow(0.99, greatest({_DAYS}, 0)) < 0.99, false) AS decays, {_DECAYED} AS after FROM ep),
{_spread_sql('(SELECT after FROM decay WHERE decay.id = t.id)')}
SELECT CASE WHEN spread.id IS NOT NULL AND abs(new - coalesce(after, 0.5)) > 0 THEN 'similarity' WHEN decays THEN 'decay' END AS changed_by, count(*) AS n,
  count_if(coalesce(CASE WHEN spread.id IS NOT NULL AND abs(new - coalesce(after, 0.5)) > 0 THEN new END, after) IS NOT NULL) AS n_learned
FROM decay LEFT JOIN spread USING (id) GROUP BY 1"""


@registered(_summary_sql(_EDGES), episodes=True)
def propagation_summary(spark: SparkSession, d: str) -> DataFrame:
    """What one run of the whole propagation would change, and how many episodes hold a learned utility after it."""
    after = propagation.propagated(episodes(spark, d), edges(spark, d), F.lit(AS_OF).cast("timestamp"))
    return after.groupBy("changed_by").agg(F.count(F.lit(1)).alias("n"), F.count("learned").alias("n_learned"))


@registered(_summary_sql(_EXACT_EDGES), episodes=True)
def propagation_summary_knn(spark: SparkSession, d: str) -> DataFrame:
    """The same over the nine nearest of each episode."""
    e = episodes(spark, d)
    after = propagation.propagated(e, near_episodes(spark, d, 9, propagation.LEAST_SIMILARITY, propagation.sources(e).select("id")), F.lit(AS_OF).cast("timestamp"))
    return after.groupBy("changed_by").agg(F.count(F.lit(1)).alias("n"), F.count("learned").alias("n_learned"))
