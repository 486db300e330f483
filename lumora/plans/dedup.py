"""Queries on duplicates: pairs, clusters and their consolidation, and the upsert of captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumora.functions import render
from lumora.functions.utility import WILSON_SQL, whole_days, wilson
from lumora.operators import duplicates, store
from lumora.operators.inlining import ROOT
from lumora.plans.capture import EMBEDDED_SQL
from lumora.plans.check import Registry
from lumora.plans.learning import edges, near_episodes, near_sql
from lumora.plans.nested import inlined_episodes
from lumora.schema import AS_OF, episodes
from lumora.session import cut
from lumora.tables import table

registered = Registry()
QUERIES, ORACLES = registered.queries, registered.oracles
_WORDS = "list_sort(list_distinct(list_filter(string_split_regex(lower(intent), '[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{3000}]+'), lambda w: w <> '')))"
_CLASSES = f"named AS (SELECT id, task_type AS part, {_WORDS} AS w FROM ep WHERE len({_WORDS}) > 0), sets AS (SELECT part, w, min(id) AS rep, count(*) AS n FROM named GROUP BY ALL)"
_PAIRS = """pairs AS (SELECT a.rep AS a, b.rep AS b, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) - i AS u FROM sets a JOIN sets b ON a.part = b.part AND a.rep < b.rep
  WHERE least(len(a.w), len(b.w)) > 0.6 * greatest(len(a.w), len(b.w)))"""


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return episodes(spark, d).select("id", F.col("task_type").alias("part"), F.col("intent").alias("text"))


@registered(f"AND {_CLASSES}, {_PAIRS} SELECT a AS id_a, b AS id_b, round(i / u::DOUBLE, 6) AS similarity FROM pairs WHERE i / u::DOUBLE > 0.6", episodes=True)
def dup_pairs_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of distinct intents of one task type with over 0.6 of their words in common; copies stand behind their smallest id."""
    named = duplicates.word_classes(_texts(spark, d))
    # words hold no blanks, so a set is written as one text, which is shorter than a list
    sets = cut(named.groupBy("part", F.array_join("w", " ").alias("text")).agg(F.min("id").alias("no"))).withColumn("w", F.split("text", " "))
    return duplicates.similar_sets(sets).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), F.round("similarity", 6).alias("similarity"))


@registered(
    f"""WITH RECURSIVE __EP__, {_CLASSES}, {_PAIRS}, links AS (SELECT a, b FROM pairs WHERE i / u::DOUBLE > 0.6 UNION ALL SELECT b, a FROM pairs WHERE i / u::DOUBLE > 0.6),
reach AS (SELECT rep AS a, rep AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
labels AS (SELECT a, min(b) AS g FROM reach GROUP BY a), degree AS (SELECT a, count(*) AS n_links FROM links GROUP BY a),
m AS (SELECT named.id, labels.g, coalesce(n_links, 0) AS n_links FROM named JOIN sets USING (part, w) JOIN labels ON labels.a = sets.rep LEFT JOIN degree ON degree.a = sets.rep)
SELECT id, min(id) OVER (PARTITION BY g) AS cluster, n_links FROM m QUALIFY count(*) OVER (PARTITION BY g) >= 2"""
)
def dup_clusters(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.clusters(_texts(spark, d))


@registered("SELECT least(query_episode_id, id) AS id_a, greatest(query_episode_id, id) AS id_b, round(max(similarity_score::DOUBLE), 5) AS similarity FROM search_results WHERE similarity_score >= 0.85 AND query_episode_id <> id AND query_episode_id IN (SELECT id FROM episodes) AND id IN (SELECT id FROM episodes) GROUP BY ALL")
def dup_pairs_vector(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of existing episodes that a past search found at least 0.85 alike, in either direction; ``dup_pairs_knn`` finds all."""
    near = edges(spark, d).filter((F.col("similarity") >= 0.85) & (F.col("source") != F.col("target")))
    known = table(spark, d, "episodes").select("id").distinct()
    near = near.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    return near.groupBy(F.least("source", "target").alias("id_a"), F.greatest("source", "target").alias("id_b")).agg(F.round(F.max("similarity"), 5).alias("similarity"))


@registered(f"WITH {near_sql(5, 0.85)} SELECT least(source, target) AS id_a, greatest(source, target) AS id_b, round(max(similarity), 5) AS similarity FROM near GROUP BY ALL")
def dup_pairs_knn(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of existing episodes at least 0.85 alike of which one is among the five most similar of the other, over all vectors."""
    near = near_episodes(spark, d, 5, 0.85)
    return near.groupBy(F.least("source", "target").alias("id_a"), F.greatest("source", "target").alias("id_b")).agg(F.round(F.max("similarity"), 5).alias("similarity"))


_LABELS = """links AS (SELECT a, b FROM near UNION SELECT b, a FROM near), reach AS (SELECT a, a AS b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a), labels AS (SELECT a AS id, min(b) AS cluster FROM reach GROUP BY a)"""
_COMPONENTS = f"""near AS (SELECT DISTINCT query_episode_id AS a, id AS b FROM search_results WHERE similarity_score >= 0.85 AND query_episode_id <> id AND query_episode_id IN (SELECT id FROM ep) AND id IN (SELECT id FROM ep)),
{_LABELS}"""
_EXACT_PAIRS = near_sql(5, 0.85)
_EXACT_COMPONENTS = f"""{_EXACT_PAIRS.replace("near AS (", "top AS (")}, near AS (SELECT source AS a, target AS b FROM top),
{_LABELS}"""


def _clusters(pairs: DataFrame) -> DataFrame:
    return duplicates.components(pairs, "id_a", "id_b").select(F.col("node").alias("id"), F.col("component").alias("cluster"))


@registered(f"WITH RECURSIVE __EP__, {_COMPONENTS} SELECT id, cluster FROM labels")
def vector_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(dup_pairs_vector(spark, d))


@registered(f"WITH RECURSIVE __EP__, {_EXACT_COMPONENTS} SELECT id, cluster FROM labels")
def clusters_knn(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(dup_pairs_knn(spark, d))


def _united(kind: str, expression: str) -> str:
    return f"{kind} AS (SELECT cluster, string_agg(x, '|' ORDER BY p) AS {kind} FROM (SELECT cluster, x, min((-coalesce(epoch_us(ended), 0), id, i)) AS p FROM (SELECT cluster, ended, id, unnest({expression}) AS x, generate_subscripts({expression}, 1) AS i FROM rows_) GROUP BY cluster, x) GROUP BY cluster)"


def _consolidate_sql(components: str) -> str:
    return f"""WITH RECURSIVE __EP__, {components}, rows_ AS (SELECT ep.*, cluster FROM ep JOIN labels USING (id)),
{_united('tags', 'tags')}, {_united('files', 'files')}, {_united('errors', "list_transform(errors, lambda e: coalesce(e.message, ''))")}
SELECT r.cluster, arg_min(r.id, (-coalesce(epoch_us(r.ended), 0), r.id)) AS base_id, count(*) AS n_members, coalesce(any_value(t.tags), '') AS tags, coalesce(any_value(f.files), '') AS files, coalesce(any_value(e.errors), '') AS errors,
  arg_min(r.retrievals, (-coalesce(epoch_us(r.ended), 0), r.id)) AS retrievals, max(r.helpful) AS helpful
FROM rows_ r LEFT JOIN tags t USING (cluster) LEFT JOIN files f USING (cluster) LEFT JOIN errors e USING (cluster) GROUP BY r.cluster"""


@registered(_consolidate_sql(_COMPONENTS))
def cluster_consolidate(spark: SparkSession, d: str) -> DataFrame:
    """What would remain of each cluster."""
    return _consolidated(spark, d, vector_clusters(spark, d))


@registered(_consolidate_sql(_EXACT_COMPONENTS))
def consolidate_knn(spark: SparkSession, d: str) -> DataFrame:
    return _consolidated(spark, d, clusters_knn(spark, d))


@registered(f"""WITH RECURSIVE __EP__, {_COMPONENTS}, rows_ AS (SELECT ep.*, cluster FROM ep JOIN labels USING (id)),
x AS (SELECT cluster, id, ended, 'tags' AS kind, unnest(tags) AS entry, generate_subscripts(tags, 1) - 1 AS pos FROM rows_ UNION ALL SELECT cluster, id, ended, 'files', unnest(files), generate_subscripts(files, 1) - 1 FROM rows_
  UNION ALL SELECT cluster, id, ended, 'errors', unnest(list_transform(errors, lambda e: coalesce(e.message, ''))), generate_subscripts(errors, 1) - 1 FROM rows_)
SELECT cluster, kind, entry, id AS from_id, pos FROM x QUALIFY row_number() OVER (PARTITION BY cluster, kind, entry ORDER BY -coalesce(epoch_us(ended), 0), id, pos) = 1""")
def consolidate_entries(spark: SparkSession, d: str) -> DataFrame:
    """The united entries of each cluster as rows."""
    return duplicates.consolidated_entries(episodes(spark, d), vector_clusters(spark, d))


def _consolidated(spark: SparkSession, d: str, members: DataFrame) -> DataFrame:
    got = duplicates.consolidated(episodes(spark, d), members)
    return got.select("cluster", "base_id", "n_members", *[F.array_join(c, "|").alias(c) for c in ("tags", "files", "errors")], "retrievals", "helpful")


@registered(f"WITH RECURSIVE __EP__, {_COMPONENTS} SELECT count(*) AS n_members, count(DISTINCT cluster) AS n_clusters, (SELECT count(*) FROM ep) AS n_episodes FROM labels")
def review_analyze(spark: SparkSession, d: str) -> DataFrame:
    return _analyzed(spark, d, vector_clusters(spark, d))


@registered(f"WITH RECURSIVE __EP__, {_EXACT_COMPONENTS} SELECT count(*) AS n_members, count(DISTINCT cluster) AS n_clusters, (SELECT count(*) FROM ep) AS n_episodes FROM labels")
def review_analyze_knn(spark: SparkSession, d: str) -> DataFrame:
    return _analyzed(spark, d, clusters_knn(spark, d))


def _analyzed(spark: SparkSession, d: str, members: DataFrame) -> DataFrame:
    c = members.agg(F.count(F.lit(1)).alias("n_members"), F.countDistinct("cluster").alias("n_clusters"))
    # one row on either side
    return c.join(F.broadcast(episodes(spark, d).agg(F.count(F.lit(1)).alias("n_episodes"))), F.lit(True))


@registered(f"WITH RECURSIVE __EP__, {_COMPONENTS}, c AS (SELECT cluster, count(*) AS n FROM labels GROUP BY cluster ORDER BY n DESC, cluster LIMIT 5) SELECT cluster, n, id, row_number() OVER (PARTITION BY cluster ORDER BY id) AS place, n - 3 AS more FROM c JOIN labels USING (cluster) QUALIFY place <= 3")
def review_display(spark: SparkSession, d: str) -> DataFrame:
    """The five largest clusters with three members each, and how many more there are."""
    return _displayed(vector_clusters(spark, d))


@registered(f"WITH RECURSIVE __EP__, {_EXACT_COMPONENTS}, c AS (SELECT cluster, count(*) AS n FROM labels GROUP BY cluster ORDER BY n DESC, cluster LIMIT 5) SELECT cluster, n, id, row_number() OVER (PARTITION BY cluster ORDER BY id) AS place, n - 3 AS more FROM c JOIN labels USING (cluster) QUALIFY place <= 3")
def review_display_knn(spark: SparkSession, d: str) -> DataFrame:
    return _displayed(clusters_knn(spark, d))


def _displayed(members: DataFrame) -> DataFrame:
    largest = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cluster").limit(5)
    place = F.row_number().over(Window.partitionBy("cluster").orderBy("id"))
    # five rows
    shown = members.join(F.broadcast(largest), "cluster").withColumn("place", place).filter("place <= 3")
    return shown.select("cluster", "n", "id", "place", (F.col("n") - 3).alias("more"))


@registered(f"SELECT id, round({WILSON_SQL}, 6) AS wilson, retrievals = 0 AS never_retrieved FROM ep WHERE trunc((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(started)) / 86400000000.0) > 30 AND {WILSON_SQL} < 0.2 AND helpful = 0", episodes=True)
def review_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """Stale episodes that no one found helpful, which a cleanup would delete."""
    w = wilson(F.col("helpful"), F.col("retrievals"))
    stale = episodes(spark, d).filter((whole_days(F.lit(AS_OF).cast("timestamp"), F.col("started")) > 30) & (w < 0.2) & (F.col("helpful") == 0))
    return stale.select("id", F.round(w, 6).alias("wilson"), (F.col("retrievals") == 0).alias("never_retrieved"))


def _late(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Episodes of the last weeks as new captures, and those before them as the store."""
    e = episodes(spark, d)
    return e.filter("started >= timestamp '2025-06-01'").withColumnRenamed("id", "new_id"), e.filter("started < timestamp '2025-06-01'")


@registered(
    """AND n AS (SELECT id AS new_id, lower(project) AS p, task_type, unnest(list_distinct(list_transform(tags, lambda t: lower(t)))) AS tag FROM ep WHERE started >= TIMESTAMP '2025-06-01'),
s AS (SELECT id, started, lower(project) AS p, task_type, unnest(list_distinct(list_transform(tags, lambda t: lower(t)))) AS tag FROM ep WHERE started < TIMESTAMP '2025-06-01')
SELECT new_id, id, shared FROM (SELECT new_id, id, started, count(*) AS shared FROM n JOIN s USING (p, task_type, tag) GROUP BY ALL HAVING count(*) >= 3) QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY started DESC, id) = 1""",
    episodes=True,
)
def tag_consolidate(spark: SparkSession, d: str) -> DataFrame:
    """Captures of the last month and the stored episode that each would be merged into, by three common tags."""
    new, stored = _late(spark, d)
    return duplicates.same_work(new, stored)


_SHOWN_END = "coalesce(strftime(ended, '%Y-%m-%d %H:%M:%S'), 'none')"
_MATCH = """nt AS (SELECT id AS new_id, lower(project) AS p, task_type, unnest(list_distinct(list_transform(tags, lambda t: lower(t)))) AS tag FROM ep WHERE started >= TIMESTAMP '2025-06-01'),
st AS (SELECT id, started, lower(project) AS p, task_type, unnest(list_distinct(list_transform(tags, lambda t: lower(t)))) AS tag FROM ep WHERE started < TIMESTAMP '2025-06-01'),
mt AS (SELECT new_id, id FROM (SELECT new_id, id, started, count(*) AS shared FROM nt JOIN st USING (p, task_type, tag) GROUP BY ALL HAVING count(*) >= 3) QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY started DESC, id) = 1),
hits AS (SELECT mt.id AS target, n.*, epoch_us(n.started) AS t FROM mt JOIN ep n ON n.id = mt.new_id),
parts AS (SELECT id AS target, 0 AS late, 0 AS t, '' AS nid, tags, files, list_transform(errors, lambda e: coalesce(e.message, '')) AS errors FROM ep WHERE id IN (SELECT id FROM mt) UNION ALL SELECT target, 1, t, id, tags, files, list_transform(errors, lambda e: coalesce(e.message, '')) FROM hits)"""


def _merged_sql(kind: str) -> str:
    return f"m_{kind} AS (SELECT target, string_agg(x, '|' ORDER BY p) AS {kind} FROM (SELECT target, x, min((late, t, nid, i)) AS p FROM (SELECT target, late, t, nid, unnest({kind}) AS x, generate_subscripts({kind}, 1) AS i FROM parts) GROUP BY target, x) GROUP BY target)"


@registered(
    f"""AND {_MATCH}, {_merged_sql('tags')}, {_merged_sql('files')},
m_errors AS (SELECT target, string_agg(x, '|' ORDER BY late, t, nid, i) AS errors FROM (SELECT target, late, t, nid, unnest(errors) AS x, generate_subscripts(errors, 1) AS i FROM parts) GROUP BY target),
last AS (SELECT target, arg_max(intent, (t, id)) AS intent, arg_max(task_type, (t, id)) AS task_type, arg_max(status, (t, id)) AS status, arg_max({_SHOWN_END}, (t, id)) AS ended FROM hits GROUP BY target)
SELECT s.id, coalesce(l.intent, s.intent) AS intent, coalesce(l.task_type, s.task_type) AS task_type, coalesce(l.status, s.status) AS status, coalesce(l.ended, coalesce(strftime(s.ended, '%Y-%m-%d %H:%M:%S'), 'none')) AS ended,
  coalesce(mt.tags, array_to_string(s.tags, '|')) AS tags, coalesce(mf.files, array_to_string(s.files, '|')) AS files, coalesce(me.errors, array_to_string(list_transform(s.errors, lambda e: coalesce(e.message, '')), '|')) AS errors, s.retrievals, s.helpful
FROM ep s LEFT JOIN last l ON l.target = s.id LEFT JOIN m_tags mt ON mt.target = s.id LEFT JOIN m_files mf ON mf.target = s.id LEFT JOIN m_errors me ON me.target = s.id
WHERE s.started < TIMESTAMP '2025-06-01' OR (s.started >= TIMESTAMP '2025-06-01' AND s.id NOT IN (SELECT new_id FROM mt))""",
    episodes=True,
)
def capture_merge(spark: SparkSession, d: str) -> DataFrame:
    """The store after the captures of the last month came in: merged into the episode of the same work, or added."""
    new, stored = _late(spark, d)
    match = duplicates.same_work(new, stored).select("new_id", "id")
    got = duplicates.merged_captures(stored, new, match)
    messages = F.transform("errors", lambda e: F.coalesce(e["message"], F.lit("")))
    return got.select(
        "id", "intent", "task_type", "status", F.coalesce(F.date_format("ended", "yyyy-MM-dd HH:mm:ss"), F.lit("none")).alias("ended"),
        F.array_join("tags", "|").alias("tags"), F.array_join("files", "|").alias("files"), F.array_join(messages, "|").alias("errors"), "retrievals", "helpful",
    )


@registered(
    """SELECT coalesce(e.project, 'none') AS project, count(*) AS n, count_if(v.episode_id IS NULL) AS n_missing FROM (SELECT id, any_value(project) AS project FROM episodes WHERE id IS NOT NULL GROUP BY id) e
LEFT JOIN (SELECT DISTINCT episode_id FROM vectors) v ON v.episode_id = e.id GROUP BY 1"""
)
def index_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Episodes that an incremental index run would still have to add, by project."""
    e = episodes(spark, d).select("id", F.coalesce("project", F.lit("none")).alias("project"))
    missing = e.join(table(spark, d, "vectors").select(F.col("episode_id").alias("id")).distinct(), "id", "left_anti")
    n = e.groupBy("project").agg(F.count(F.lit(1)).alias("n"))
    return n.join(missing.groupBy("project").agg(F.count(F.lit(1)).alias("m")), "project", "left").select("project", "n", F.coalesce("m", F.lit(0)).alias("n_missing"))


@registered("SELECT count(*) AS n_rows, count(DISTINCT episode_id) AS n_items, count(DISTINCT CASE WHEN episode_id NOT IN (SELECT id FROM episodes WHERE id IS NOT NULL) THEN episode_id END) AS n_orphans, max(len(vector)) AS width FROM vectors")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vectors").select("episode_id", F.size("vector").alias("width"))
    e = table(spark, d, "episodes").select(F.col("id").alias("episode_id"), F.lit(True).alias("known")).filter("episode_id is not null").distinct()
    j = v.join(e, "episode_id", "left")
    return j.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("episode_id").alias("n_items"), F.countDistinct(F.when(F.col("known").isNull(), F.col("episode_id"))).alias("n_orphans"), F.max("width").alias("width"))


@registered("SELECT id, retrievals + coalesce(n, 0) AS retrievals, status FROM ep LEFT JOIN (SELECT episode_id, count(*) AS n FROM (SELECT DISTINCT retrieval_id, episode_id FROM retrievals WHERE ts >= TIMESTAMP '2025-06-01') GROUP BY 1) r ON r.episode_id = ep.id", episodes=True)
def snapshot_update(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot with the retrievals of the last month added to the counters."""
    e = episodes(spark, d).select("id", "retrievals", "status")
    log = table(spark, d, "retrievals").filter("ts >= timestamp '2025-06-01'").select("retrieval_id", "episode_id").distinct()
    n = log.groupBy(F.col("episode_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return store.updated(e, e.join(n, "id").select("id", (F.col("retrievals") + F.col("n")).alias("retrievals")))


@registered("SELECT id, status FROM ep WHERE id NOT IN (SELECT episode_id FROM duplicate_clusters WHERE episode_id IS NOT NULL)", episodes=True)
def snapshot_delete(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot without the episodes that are known captures of one session."""
    gone = table(spark, d, "duplicate_clusters").filter("episode_id is not null").select(F.col("episode_id").alias("id"))
    return store.deleted(episodes(spark, d).select("id", "status"), gone)


@registered()
def capture_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The store after the raw captures came in: newer rows replace those of the same id, others are added."""
    t = inlined_episodes(table(spark, d, "raw_episodes")).table(ROOT)
    raw = table(spark, d, "raw_episodes").select(F.col("raw_id").alias("doc_id"), "received_at")
    column = lambda c: F.col(f"`{c}`") if c in t.columns else F.lit(None).cast("string")
    new = t.join(raw, "doc_id").select(column("id").alias("id"), column("project").alias("project"), column("outcome.status").alias("status"), "received_at", "doc_id").filter("id is not null")
    new = new.groupBy("id").agg(F.max_by(F.struct("project", "status"), F.struct("received_at", "doc_id")).alias("r")).select("id", "r.*", F.lit("capture").alias("origin"))
    stored = episodes(spark, d).select("id", "project", "status", F.lit("store").alias("origin"))
    return store.upserted(stored, new)


@registered(
    f"""AND v AS (SELECT DISTINCT episode_id FROM vectors WHERE episode_id IS NOT NULL) SELECT id AS episode_id, project, task_type, epoch_us(started) // 1000000 AS timestamp, round({WILSON_SQL}, 6) AS utility_score, retrievals AS retrieval_count, helpful AS helpful_count
FROM ep WHERE id NOT IN (SELECT episode_id FROM v)""",
    episodes=True,
)
def index_increment(spark: SparkSession, d: str) -> DataFrame:
    """The rows that an incremental index run adds; a rebuild adds ``index_metadata`` of all episodes."""
    known = table(spark, d, "vectors").select(F.col("episode_id").alias("id")).distinct()
    return _index_rows(episodes(spark, d).join(known, "id", "left_anti")).drop("intent_text")


def _index_rows(e: DataFrame) -> DataFrame:
    fields = render.index_metadata()
    return e.select(*[c.alias(name) for name, c in fields.items()]).withColumn("utility_score", F.round("utility_score", 6))


@registered(f"SELECT id AS episode_id, project, task_type, md5(t) AS text_digest, epoch_us(started) // 1000000 AS timestamp, round({WILSON_SQL}, 6) AS utility_score, retrievals AS retrieval_count, helpful AS helpful_count FROM ep JOIN (SELECT id, {EMBEDDED_SQL} AS t FROM ep) USING (id)", episodes=True)
def index_metadata(spark: SparkSession, d: str) -> DataFrame:
    """What the index holds beside each vector, the embedded text as its digest."""
    rows = _index_rows(episodes(spark, d))
    return rows.withColumn("text_digest", F.md5("intent_text")).drop("intent_text")
