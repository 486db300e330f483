"""Queries of the problems on training data, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.functions.text import folded, is_blank, micros, plain_path, trimmed
from lumora.llm import survivor
from lumora.llm.canonical import mapped
from lumora.llm.common import bounded_broadcast
from lumora.llm.cooccurrence import pair_counts
from lumora.llm.mixing import Mix
from lumora.llm.neighbours import neighbours
from lumora.llm.tokenize import text_of_ids, token_counts, token_ids
from lumora.llm.truncation import endings, judged, length_hazards
from lumora.llm.varied import varied_subset
from lumora.session import cut
from lumora.tables import table

LIFT_OVER, PAIR_SUPPORT = 3, 5


def _episodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "episodes")


# -- 2: freely typed tags


def _entered_tags(spark: SparkSession, d: str) -> DataFrame:
    """Each episode's distinct entries that are not blank and no canonical tag as they stand, with the tag they mean."""
    tags = table(spark, d, "domain_tags")
    e = _episodes(spark, d).select(F.col("id").alias("episode_id"), F.explode("intent.domain").alias("entered"))
    e = e.filter(F.col("episode_id").isNotNull() & ~is_blank("entered"))
    canonical = bounded_broadcast(tags.select(F.col("tag").alias("entered")))
    odd = e.join(canonical, "entered", "left_anti").select("episode_id", "entered").distinct()
    return mapped(odd, "entered", tags.select("tag_id", "tag", "aliases"), "episode_id", "tag_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _entered_tags(spark, d).select("episode_id", "entered", "tag_id")


def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The report of entries that mean no tag, with the number of episodes that hold them."""
    e = p2_found(spark, d).filter(F.col("tag_id") == -1)
    return e.groupBy(folded("entered").alias("entered")).agg(F.count(F.lit(1)).alias("n_episodes"))


# -- 3: best representatives

LIST_FIELDS = {"domain": "domain", "files_modified": "files_modified", "errors_encountered": "messages"}


def _members(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The members of each cluster with the four fields of their episodes, those of the lists cleaned."""
    m = survivor.members(table(spark, d, "duplicate_clusters"), table(spark, d, "capture_channels"))
    e = _episodes(spark, d).filter(F.col("id").isNotNull()).select(
        F.col("id").alias("episode_id"),
        survivor.informative_entries(F.col("intent.domain")).alias("domain"),
        survivor.informative_entries(F.col("context.files_modified")).alias("files_modified"),
        survivor.informative_entries(F.col("context.errors_encountered.message")).alias("messages"),
        survivor.usable_end(F.col("timestamp_start"), F.col("timestamp_end")).alias("ended"),
    )
    # only members are kept before repeated rows of an episode are united
    e = e.join(m.select("episode_id").distinct(), "episode_id", "left_semi")
    return m, e


def _captures(spark: SparkSession, d: str) -> DataFrame:
    m, e = _members(spark, d)
    counts = e.select("episode_id", *[F.coalesce(F.size(c), F.lit(0)).alias(c) for c in LIST_FIELDS.values()], "ended")
    return m.join(counts.distinct(), "episode_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    trust, ended = -F.col("trust"), -micros("ended")
    fields = {name: (F.col(c) > 0, [-F.col(c), trust, ended]) for name, c in LIST_FIELDS.items()}
    fields["timestamp_end"] = (F.col("ended").isNotNull(), [ended, trust])
    return survivor.survivors(_captures(spark, d), fields, "cluster_id", "episode_id")


def p3_current(spark: SparkSession, d: str) -> DataFrame:
    """The most current entry of each field of each cluster, by time stamps and, where they are missing, by learned precedence."""
    m, e = _members(spark, d)
    entry = lambda name, values, at: F.transform(values, lambda x: F.struct(F.lit(name).alias("field_name"), x.alias("value"), at.alias("at")))
    at = micros("ended")
    lists = [F.coalesce(entry(name, F.col(c), at), F.array().cast("array<struct<field_name: string, value: string, at: bigint>>")) for name, c in LIST_FIELDS.items()]
    end = entry("timestamp_end", F.array_compact(F.array(F.date_format("ended", "yyyy-MM-dd HH:mm:ss.SSSSSS"))), at)
    # repeated rows of an episode give equal entries
    long = e.select("episode_id", F.explode(F.concat(*lists, end)).alias("x")).select("episode_id", "x.*").distinct()
    rows = cut(m.select("cluster_id", "episode_id").join(long, "episode_id"))
    # ends are their own time stamps, nothing is learned from them
    learned = survivor.precedence(rows.filter(F.col("field_name") != "timestamp_end"), "cluster_id", "field_name", "value", "at")
    return survivor.latest_values(rows, learned, "cluster_id", "field_name", "value", "at")


# -- 4: items that appear together


def _tag_items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = _episodes(spark, d).select("id", "intent.domain").filter(F.col("id").isNotNull())
    tags = table(spark, d, "domain_tags").select(F.lower("tag").alias("entry"), F.col("tag_id").alias("item"))
    items = e.select("id", F.explode(F.transform("domain", folded)).alias("entry")).join(bounded_broadcast(tags), "entry")
    sizes = e.agg(F.countDistinct("id").alias("n")).select(F.lit("tag").alias("part"), "n")
    return items.select(F.lit("tag").alias("part"), F.col("id").alias("record"), "item"), sizes


def _file_items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = _episodes(spark, d).select("id", F.lower("project").alias("part"), "context.files_modified").filter(F.col("id").isNotNull())
    files = table(spark, d, "project_files").select(F.lower("project").alias("part"), "path", F.col("file_id").alias("item"))
    entries = e.select("id", "part", F.explode("files_modified").alias("f")).select("id", "part", plain_path(F.col("f"), F.col("part")).alias("path"))
    items = entries.join(bounded_broadcast(files), ["part", "path"])
    part = F.concat(F.lit("file "), F.col("part")).alias("part")
    return items.select(part, F.col("id").alias("record"), "item"), e.groupBy(part).agg(F.countDistinct("id").alias("n"))


def _pairs(spark: SparkSession, d: str, min_support: int = PAIR_SUPPORT) -> DataFrame:
    """Tags over all episodes and files within each project, counted in one go."""
    (tags, all_episodes), (files, by_project) = _tag_items(spark, d), _file_items(spark, d)
    got = pair_counts(tags.unionByName(files), all_episodes.unionByName(by_project), min_support)
    kind, project = F.substring_index("part", " ", 1), F.when(F.col("part") != "tag", F.expr("substring(part, 6)"))
    return got.select(kind.alias("item_kind"), project.alias("project"), *[c for c in got.columns if c != "part"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    over = F.col("n_ab") * F.col("n") > LIFT_OVER * F.col("n_a") * F.col("n_b")
    return _pairs(spark, d).filter(over).select("item_kind", "item_a", "item_b")


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of items that occurs, with its scores."""
    # ratios of small numbers end in halves too often to leave their rounding to each engine
    six = lambda c: (F.floor(F.col(c) * 1_000_000 + 0.5) / 1_000_000).alias(c)
    return _pairs(spark, d, 1).select("item_kind", "project", "item_a", "item_b", "n_ab", six("lift"), six("conviction"))


# -- 5: a varied subset


def p5_subset(spark: SparkSession, d: str, share: float = 0.01) -> DataFrame:
    """1 % of the episodes, varied in intent and tags; of alike ones the most helpful and most complete."""
    e = _episodes(spark, d).select("id", "project", F.col("intent.extracted_intent").alias("extracted_intent"), F.col("intent.domain").alias("domain"), "utility", "timestamp_start")
    n = e.select("id").distinct().count()
    best = [
        is_blank("extracted_intent"),
        -F.coalesce(F.least("utility.helpful_count", "utility.retrieval_count"), F.lit(0)),
        -F.coalesce(micros("timestamp_start"), F.lit(0)),
    ]
    got = varied_subset(e, "id", F.col("extracted_intent"), F.col("domain"), best, -(-n * int(share * 10_000) // 10_000))
    return got.select("id", "project", trimmed("extracted_intent").alias("extracted_intent"), F.col("_cell").alias("cell"), F.col("_cell_rank").alias("cell_rank"))


def p5_variety(spark: SparkSession, d: str, share: float = 0.01, common: float = 0.001) -> DataFrame:
    """How much of all episodes and of the subset the eight largest groups of alike intents hold.

    Alike are intents with the same words among those that at least ``common`` of all episodes hold, numbers being one word.
    """
    e = _episodes(spark, d).filter("id is not null").select("id", F.coalesce("intent.extracted_intent", F.lit("")).alias("text")).groupBy("id").agg(F.min("text").alias("text"))
    e = cut(e.select("id", F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower("text"), r"\p{N}+", "0"), r"[^\p{L}0]+"), lambda w: w != "")).alias("ws")))
    n = e.count()
    words = e.select("id", F.explode("ws").alias("w"))
    usual = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= common * n).select("w")  # bounded by the words of an intent / common
    alike = words.join(F.broadcast(usual), "w").groupBy("id").agg(F.array_sort(F.collect_set("w")).alias("ws")).select("id", F.xxhash64("ws").alias("g"))
    chosen = p5_subset(spark, d, share).select("id", F.lit(1).alias("chosen"))
    groups = alike.join(chosen, "id", "left").groupBy("g").agg(F.count(F.lit(1)).alias("n_episodes"), F.count("chosen").alias("n_chosen"))
    top = groups.orderBy(F.desc("n_episodes"), "g").limit(8)
    size = -(-n * int(share * 10_000) // 10_000)
    return top.select("n_episodes", "n_chosen", F.round(F.col("n_episodes") / n, 6).alias("share_of_all"), F.round(F.col("n_chosen") / max(size, 1), 6).alias("share_of_subset"))


# -- 6: most similar vectors


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours(table(spark, d, "vectors"), "episode_id", "vector", "indexed_at", k=5, min_similarity=0.85)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    n = _neighbours(spark, d)
    return n.select(F.least("episode_id", "neighbour").alias("episode_a"), F.greatest("episode_id", "neighbour").alias("episode_b")).distinct()


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d).select("episode_id", "neighbour", "hit_rank", F.round("similarity", 4).alias("similarity_score"))


# -- 7: token ids


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", token_ids(spark, "text").alias("ids"))


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents and tokens of each source as it is written."""
    t = table(spark, d, "documents").select("source", "n_chars", token_counts(spark, "text").alias("t"))
    return t.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("t").alias("n_tokens"), F.round(F.sum("n_chars") / F.sum("t"), 4).alias("chars_per_token"))


def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """For each document whether decoding its ids gives back its text, byte for byte."""
    t = table(spark, d, "documents").select("doc_id", "text", token_ids(spark, "text").alias("ids"))
    return t.select("doc_id", (text_of_ids(spark, "ids") == F.coalesce("text", F.lit(""))).alias("same"))


# -- 8: mixing by weights


def _mix(spark: SparkSession, d: str) -> Mix:
    return Mix(table(spark, d, "documents"), table(spark, d, "mix_plan"), token_counts(spark, "text"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose blocks miss their deadlines in the schedule of a mix as large as the corpus."""
    return _mix(spark, d).unreachable()


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of the largest mix that is on target, and what bounds it."""
    return _mix(spark, d).shares()


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).assignments()


# -- 9: texts cut off


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return judged(table(spark, d, "documents")).filter("cut").select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates, and how many of its cut texts stand at a field limit."""
    j = judged(table(spark, d, "documents"))
    n_cut = F.count_if("cut")
    return j.groupBy(F.col("key").alias("source")).agg(
        F.count(F.lit(1)).alias("n_texts"), n_cut.alias("n_cut"), F.count_if(F.col("cut") & F.col("at_limit")).alias("n_at_limit"), F.round(n_cut / F.count(F.lit(1)), 6).alias("cut_rate")
    )


def p9_limits(spark: SparkSession, d: str) -> DataFrame:
    """Lengths at which texts of a source end more often than at the lengths around."""
    h = length_hazards(endings(table(spark, d, "documents")))
    return h.select(F.col("key").alias("source"), "unit", "length", "n", F.round("expected", 4).alias("expected"), "at_risk")


QUERIES = {q.__name__: q for q in (p2_found, p2_unmatched, p3_found, p3_current, p4_found, p4_pairs, p5_subset, p5_variety, p6_found, p6_neighbours, p7_ids, p7_counts, p7_roundtrip, p8_found, p8_shares, p8_mix, p9_found, p9_rates, p9_limits)}
_STAND_INS = ", ".join(f"'{x}'" for x in ["", *survivor.STAND_INS])
_TRIM = "regexp_replace({}, '^[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]+|[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]+$', '', 'g')"


def _entries_sql(entries: str) -> str:
    return f"list_filter(list_distinct(list_transform({entries}, lambda x: lower({_TRIM.format('x')}))), lambda x: x NOT IN ({_STAND_INS}))"


def _informative_sql(entries: str) -> str:
    return f"coalesce(len({_entries_sql(entries)}), 0)"


_USABLE = "CASE WHEN timestamp_end >= timestamp_start AND timestamp_end <= timestamp_start + INTERVAL 7 DAY THEN epoch_us(timestamp_end) END"


_PATH = """list_reduce(list_prepend('', list_filter(string_split(replace({0}, chr(92), '/'), '/'), lambda s: s NOT IN ('', '.'))),
  lambda a, s: CASE WHEN s = '..' AND a <> '' AND NOT regexp_matches(a, '(^|/)\\.\\.$') THEN regexp_replace(a, '(^|/)[^/]*$', '') WHEN a = '' THEN s ELSE a || '/' || s END)"""
_PAIRS_SQL = f"""WITH e AS (SELECT id, lower(any_value(project)) AS p, any_value(intent.domain) AS tags, any_value(context.files_modified) AS files FROM episodes WHERE id IS NOT NULL GROUP BY id),
t AS (SELECT DISTINCT 'tag' AS part, id, tag_id AS item FROM (SELECT id, lower({_TRIM.format('unnest(tags)')}) AS x FROM e) JOIN domain_tags ON lower(tag) = x),
w AS (SELECT id, p, {_TRIM.format('unnest(files)')} AS f FROM e),
g AS (SELECT id, p, starts_with(f, '/') OR starts_with(f, chr(92)) AS absolute, {_PATH.format('f')} AS f FROM w WHERE f IS NOT NULL),
h AS (SELECT id, p, CASE WHEN absolute AND starts_with(lower(f), 'workspace/' || p || '/') THEN substr(f, length(p) + 12) WHEN absolute THEN '/' || f ELSE f END AS f FROM g),
i AS (FROM t UNION ALL SELECT DISTINCT 'file ' || p, id, file_id FROM h JOIN project_files x ON lower(x.project) = p AND x.path = f),
n AS (SELECT 'tag' AS part, count(*) AS n FROM e UNION ALL SELECT 'file ' || p, count(*) FROM e WHERE p IS NOT NULL GROUP BY p),
s AS (SELECT part, item, count(*) AS c FROM i GROUP BY ALL),
ab AS (SELECT a.part, a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM i a JOIN i b ON a.part = b.part AND a.id = b.id AND a.item < b.item GROUP BY ALL),
scored AS (SELECT ab.*, x.c AS n_a, y.c AS n_b, n FROM ab JOIN s x ON x.part = ab.part AND x.item = item_a JOIN s y ON y.part = ab.part AND y.item = item_b JOIN n ON n.part = ab.part)
"""

#: Problems whose answer SQL can express on whole tables; the others are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "p3_found": f"""WITH m AS (SELECT cluster_id, episode_id, max(coalesce(trust, 0)) AS trust FROM duplicate_clusters LEFT JOIN capture_channels USING (channel) WHERE cluster_id IS NOT NULL AND episode_id IS NOT NULL GROUP BY ALL),
e AS (SELECT id AS episode_id, {_informative_sql('any_value(intent.domain)')} AS d, {_informative_sql('any_value(context.files_modified)')} AS f, {_informative_sql('list_transform(any_value(context.errors_encountered), lambda x: x.message)')} AS r,
  any_value(CASE WHEN timestamp_end >= timestamp_start AND timestamp_end <= timestamp_start + INTERVAL 7 DAY THEN epoch_us(timestamp_end) END) AS t FROM episodes WHERE id IS NOT NULL GROUP BY id),
j AS (SELECT * FROM m JOIN e USING (episode_id)),
l AS (SELECT cluster_id, 'domain' AS field_name, episode_id, d AS n, trust, t FROM j WHERE d > 0 UNION ALL SELECT cluster_id, 'files_modified', episode_id, f, trust, t FROM j WHERE f > 0
  UNION ALL SELECT cluster_id, 'errors_encountered', episode_id, r, trust, t FROM j WHERE r > 0 UNION ALL SELECT cluster_id, 'timestamp_end', episode_id, t, trust, t FROM j WHERE t IS NOT NULL)
SELECT cluster_id, field_name, episode_id FROM l QUALIFY row_number() OVER (PARTITION BY cluster_id, field_name ORDER BY n DESC, trust DESC, t DESC NULLS LAST, episode_id) = 1""",
    "p3_current": f"""WITH m AS (SELECT DISTINCT cluster_id, episode_id FROM duplicate_clusters WHERE cluster_id IS NOT NULL),
e AS (SELECT id AS episode_id, any_value(intent.domain) AS d, any_value(context.files_modified) AS f, list_transform(any_value(context.errors_encountered), lambda x: x.message) AS r, any_value({_USABLE}) AS ts FROM episodes WHERE id IS NOT NULL GROUP BY id),
l AS (SELECT episode_id, ts, 'domain' AS field_name, unnest({_entries_sql('d')}) AS value FROM e UNION ALL SELECT episode_id, ts, 'files_modified', unnest({_entries_sql('f')}) FROM e
  UNION ALL SELECT episode_id, ts, 'errors_encountered', unnest({_entries_sql('r')}) FROM e UNION ALL SELECT episode_id, ts, 'timestamp_end', strftime(make_timestamp(ts), '%Y-%m-%d %H:%M:%S.%f') FROM e WHERE ts IS NOT NULL),
x AS (SELECT cluster_id, field_name, value, ts FROM m JOIN l USING (episode_id)),
s AS (SELECT field_name, value AS earlier, lead(value) OVER w AS later, ts, lead(ts) OVER w AS next_at FROM (SELECT DISTINCT * FROM x WHERE ts IS NOT NULL AND field_name <> 'timestamp_end') WINDOW w AS (PARTITION BY cluster_id, field_name ORDER BY ts, value)),
c AS (SELECT field_name, earlier, later, count(*) AS n FROM s WHERE next_at > ts AND later <> earlier GROUP BY ALL),
p AS (SELECT a.field_name, a.earlier, a.later FROM c a LEFT JOIN c b ON a.field_name = b.field_name AND a.earlier = b.later AND a.later = b.earlier WHERE a.n > coalesce(b.n, 0)),
v AS (SELECT cluster_id, field_name, value, max(ts) AS ts, count(*) AS n FROM x GROUP BY ALL),
t AS (SELECT *, coalesce(ts < max(ts) OVER (PARTITION BY cluster_id, field_name), false) AS by_time FROM v),
u AS (SELECT DISTINCT a.cluster_id, a.field_name, a.value FROM v a JOIN p ON p.field_name = a.field_name AND p.earlier = a.value JOIN v b ON b.cluster_id = a.cluster_id AND b.field_name = a.field_name AND b.value = p.later WHERE a.ts IS NULL OR b.ts IS NULL)
SELECT cluster_id, field_name, value FROM t LEFT JOIN (SELECT *, true AS by_rule FROM u) USING (cluster_id, field_name, value) QUALIFY row_number() OVER (PARTITION BY cluster_id, field_name ORDER BY by_time OR coalesce(by_rule, false), n DESC, value) = 1""",
    "p4_found": _PAIRS_SQL + f"SELECT split_part(part, ' ', 1) AS item_kind, item_a, item_b FROM scored WHERE n_ab >= {PAIR_SUPPORT} AND n_ab * n > {LIFT_OVER} * n_a * n_b",
    "p4_pairs": _PAIRS_SQL
    + """SELECT split_part(part, ' ', 1) AS item_kind, nullif(substr(part, 6), '') AS project, item_a, item_b, n_ab, floor(n_ab * n / (n_a * n_b)::DOUBLE * 1000000 + 0.5) / 1000000 AS lift,
  floor(CASE WHEN n_ab < n_a THEN (1 - n_b / n::DOUBLE) / (1 - n_ab / n_a::DOUBLE) END * 1000000 + 0.5) / 1000000 AS conviction FROM scored""",
    "p6_found": """WITH v AS (SELECT episode_id AS id, list_transform(v, lambda x: x::DOUBLE) AS v FROM (SELECT episode_id, arg_max(vector, coalesce(indexed_at, TIMESTAMP '1900-01-01')) AS v, arg_max(len(vector), coalesce(indexed_at, TIMESTAMP '1900-01-01')) AS w FROM vectors WHERE episode_id IS NOT NULL GROUP BY 1) WHERE w = 384),
u AS (SELECT id, v FROM v WHERE len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = 384 AND len(list_filter(v, lambda x: x <> 0)) > 0),
s AS (SELECT a.id AS x, b.id AS y, list_cosine_similarity(a.v, b.v) AS s FROM u a JOIN u b ON a.id <> b.id),
k AS (SELECT x, y FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY s DESC, y) AS r FROM s WHERE s >= 0.85) WHERE r <= 5)
SELECT DISTINCT least(x, y) AS episode_a, greatest(x, y) AS episode_b FROM k""",
}
