"""Queries that search: by words, by vectors, and over the hits of earlier searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.functions.utility import WILSON_SQL, combined, wilson
from lumora.operators import retrieval
from lumora.plans.check import Registry
from lumora.schema import episodes
from lumora.tables import table

registered = Registry()
#: Numbers in a vector of the embeddings table.
WIDTH = 64
QUERIES, ORACLES = registered.queries, registered.oracles


def _w() -> Column:
    return wilson(F.col("helpful"), F.col("retrievals"))
_WORDS = "list_filter(string_split_regex(lower({}), '[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]+'), lambda w: w <> '')"


@registered(
    f"""AND q AS (SELECT retrieval_id AS query_id, {_WORDS.format('any_value(task_description)')} AS q FROM retrievals WHERE retrieval_id % 100 = 0 AND task_description IS NOT NULL GROUP BY retrieval_id),
t AS (SELECT id, lower(concat_ws(' ', intent, array_to_string(tags, ' '))) AS t, len({_WORDS.format("concat_ws(' ', intent, array_to_string(tags, ' '))")}) AS n FROM ep),
p AS (SELECT query_id, id, len(q) AS nq, n, len(list_filter(q, lambda w: contains(t, w))) AS m FROM q, t WHERE len(q) > 0 AND len(q) >= 0.4 * n),
s AS (SELECT query_id, id, m / (nq + n - m)::DOUBLE AS similarity FROM p WHERE m > 0)
SELECT query_id, id, round(similarity, 6) AS similarity, r AS hit_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS r FROM s WHERE similarity >= 0.4) WHERE r <= 5""",
    episodes=True,
)
def text_similarity_topk(spark: SparkSession, d: str) -> DataFrame:
    """Tasks that memories were once looked up for (every hundredth), searched again by words in all episodes."""
    r = table(spark, d, "retrievals").filter((F.col("retrieval_id") % 100 == 0) & F.col("task_description").isNotNull())
    queries = r.groupBy(F.col("retrieval_id").alias("query_id")).agg(F.any_value("task_description").alias("text"))
    texts = episodes(spark, d).select("id", F.concat_ws(" ", F.col("intent"), F.array_join("tags", " ")).alias("text"))
    hits = retrieval.text_hits(queries, texts, k=5, least=0.4)
    return hits.withColumn("similarity", F.round("similarity", 6))


_COSINE = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@registered(f"SELECT query_id, id, round(s, 5) AS similarity, r AS hit_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COSINE} AS s FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)) WHERE r <= 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar vectors of every hundredth, itself included as in an index lookup."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = v.filter(F.col("id") % 100 == 0).withColumnRenamed("id", "query_id")
    return retrieval.vector_hits(queries, v, 10, WIDTH).withColumn("similarity", F.round("similarity", 5))


@registered(f"SELECT query_id, id, round(s, 5) AS similarity, r AS hit_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COSINE} AS s FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND b.label = 3)) WHERE r <= 5")
def vector_topk_project(spark: SparkSession, d: str) -> DataFrame:
    """Search within one project: the filter reaches the scan, so every query finds its five."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    queries = v.filter(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "vector")
    return retrieval.vector_hits(queries, v.filter("label = 3"), 5, WIDTH).withColumn("similarity", F.round("similarity", 5))


@registered(f"SELECT query_id, id, round(s, 5) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, b.label, a.label AS wanted, {_COSINE} AS s FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)) WHERE r <= 15 AND label = wanted")
def vector_post_filter(spark: SparkSession, d: str) -> DataFrame:
    """Search first and filter after: three times as many hits are fetched, of which those of the query's project stay."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    queries = v.filter(F.col("id") % 100 == 0)
    hits = retrieval.vector_hits(queries.select(F.col("id").alias("query_id"), "vector"), v, 15, WIDTH)
    labels = v.select("id", "label")
    wanted = queries.select(F.col("id").alias("query_id"), F.col("label").alias("wanted"))
    return hits.join(labels, "id").join(wanted, "query_id").filter("label = wanted").select("query_id", "id", F.round("similarity", 5).alias("similarity"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Hits of past searches of at least 0.3 that still exist, with the score that combines similarity and utility."""
    hits = table(spark, d, "search_results").filter("similarity_score >= 0.3")
    hits = hits.groupBy("search_id", "id").agg(F.max(F.col("similarity_score").cast("double")).alias("similarity"))
    c = combined(F.col("similarity"), _w(), 0.7)
    e = episodes(spark, d).select("id", "helpful", "retrievals", F.concat_ws(" ", F.col("raw_prompt"), F.array_join("tags", " "), F.array_join("files", " ")).alias("text"))
    return hits.join(e, "id").select("search_id", "id", "similarity", c.alias("score"), F.round(c, 9).alias("combined"), "text")


_SCORED = f"""scored AS (SELECT s.search_id, ep.id, s.similarity, (1 - 0.7::DOUBLE) * s.similarity + 0.7::DOUBLE * {WILSON_SQL} AS score, round(score, 9) AS combined,
    list_distinct({_WORDS.format("concat_ws(' ', raw_prompt, array_to_string(tags, ' '), array_to_string(files, ' '))")}) AS w
  FROM (SELECT search_id, id, max(similarity_score::DOUBLE) AS similarity FROM search_results WHERE similarity_score >= 0.3 GROUP BY ALL) s JOIN ep ON s.id = ep.id)"""


@registered(f"AND {_SCORED} SELECT search_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY search_id ORDER BY combined DESC, id) AS hit_rank FROM scored QUALIFY hit_rank <= 3", episodes=True)
def retrieve_scored(spark: SparkSession, d: str) -> DataFrame:
    """The three best hits of each search by the combined score."""
    got = retrieval.best(_scored(spark, d), "search_id", "id", "combined", 3)
    return got.select("search_id", "id", F.round("score", 6).alias("score"), "hit_rank")


def _overlap(a: str, b: str) -> str:
    both = f"len(list_intersect({a}.w, {b}.w))"
    return f"CASE WHEN len({a}.w) = 0 OR len({b}.w) = 0 THEN 0.0 ELSE {both} / (len({a}.w) + len({b}.w) - {both})::DOUBLE END"


@registered(
    f"""AND {_SCORED}, c AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY combined DESC, id) AS pos FROM scored),
p1 AS (SELECT * FROM c WHERE pos = 1),
p2 AS (SELECT * EXCLUDE (o, v) FROM (SELECT c.*, {_overlap('c', 'p1')} AS o, 0.7::DOUBLE * c.combined - (1 - 0.7::DOUBLE) * o AS v FROM c JOIN p1 USING (search_id) WHERE c.pos <> 1) QUALIFY row_number() OVER (PARTITION BY search_id ORDER BY v DESC, pos DESC) = 1),
p3 AS (SELECT search_id, id FROM (SELECT c.*, greatest({_overlap('c', 'p1')}, {_overlap('c', 'p2')}) AS o, 0.7::DOUBLE * c.combined - (1 - 0.7::DOUBLE) * o AS v FROM c JOIN p1 USING (search_id) JOIN p2 USING (search_id) WHERE c.pos <> 1 AND c.pos <> p2.pos) QUALIFY row_number() OVER (PARTITION BY search_id ORDER BY v DESC, pos DESC) = 1)
SELECT search_id, id, 1 AS pick FROM p1 UNION ALL SELECT search_id, id, 2 FROM p2 UNION ALL SELECT search_id, id, 3 FROM p3""",
    episodes=True,
)
def mmr_select(spark: SparkSession, d: str) -> DataFrame:
    """Three hits of each search, varied by maximal marginal relevance."""
    return retrieval.diversified(_scored(spark, d), "search_id", "id", "combined", F.col("text"), 3)
