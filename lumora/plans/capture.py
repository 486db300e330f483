"""Queries that read transcripts and write documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.functions import capture, render
from lumora.functions.utility import WILSON_SQL, wilson
from lumora.plans.check import Registry
from lumora.schema import episodes
from lumora.sources.files import diff_name
from lumora.tables import table

registered = Registry()
QUERIES, ORACLES = registered.queries, registered.oracles


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text").filter("text is not null")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _first_of(rules: list[tuple[str, list[str]]], text: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({text}, {_q(w)})' for w in ws)} THEN {_q(kind)}" for kind, ws in rules) + " ELSE 'unknown' END"


@registered(f"SELECT doc_id, {_first_of(capture.TASK_WORDS, 'lower(text)')} AS task_type FROM documents WHERE text IS NOT NULL")
def classify_task_type(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", capture.task_type(F.col("text")).alias("task_type"))


_TAGGED = "lower(concat_ws(' ', raw_prompt, array_to_string(files, ' ')))"


@registered(f"SELECT id, array_to_string(list_sort(list_distinct(list_filter([{', '.join(f'CASE WHEN contains({_TAGGED}, {_q(w)}) THEN {_q(t)} END' for w, t in capture.TAG_WORDS)}], lambda x: x IS NOT NULL))), ',') AS tags FROM ep", episodes=True)
def domain_tags(spark: SparkSession, d: str) -> DataFrame:
    return episodes(spark, d).select("id", F.array_join(capture.domain_tags(F.col("raw_prompt"), F.col("files")), ",").alias("tags"))


def _signs(words: list[str]) -> str:
    return " + ".join(f"contains(lower(text), {_q(w)})::INT" for w in words)


@registered(f"SELECT doc_id, CASE WHEN g > b THEN 'success' WHEN b > g THEN 'failure' ELSE 'partial' END AS outcome FROM (SELECT doc_id, {_signs(capture.SUCCESS_WORDS)} AS g, {_signs(capture.FAILURE_WORDS)} AS b FROM documents WHERE text IS NOT NULL)")
def outcome_from_text(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", capture.outcome(F.col("text")).alias("outcome"))


_PROMPTS = [r"(?i)\AHuman:\s*([^\n]+?)(?:\n\n|\nAssistant:|\z)", r"(?i)\AUser:\s*([^\n]+?)(?:\n\n|\nAssistant:|\z)", r"(?i)\A>\s*([^\n]+?)(?:\n\n|\z)"]


@registered(
    f"SELECT doc_id, coalesce({', '.join(f'nullif(trim(regexp_extract(text, {_q(p)}, 1)), {_q('')})' for p in _PROMPTS)}, list_filter(string_split_regex(text, '\\r?\\n'), lambda x: trim(x) <> '')[1], '') AS prompt FROM documents WHERE text IS NOT NULL"
)
def first_prompt(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", capture.first_prompt(F.col("text")).alias("prompt"))


def _all_sql(patterns: list[str], group: int) -> str:
    return "list_concat(" * (len(patterns) - 1) + f"regexp_extract_all(text, {_q(patterns[0])}, {group})" + "".join(f", regexp_extract_all(text, {_q(p)}, {group}))" for p in patterns[1:])


@registered(f"SELECT doc_id, unnest(list_distinct({_all_sql(capture.READ_PATTERNS, 1)})) AS path FROM documents WHERE text IS NOT NULL")
def file_reads(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", F.explode(capture.file_reads(F.col("text"))).alias("path"))


@registered(f"SELECT doc_id, unnest(list_distinct(list_transform({_all_sql(capture.TOOL_PATTERNS, 0)}, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')))) AS call FROM documents WHERE text IS NOT NULL")
def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", F.explode(capture.tool_calls(F.col("text"))).alias("call"))


@registered(f"SELECT doc_id, regexp_replace(m, '^\\s+|\\s+$', '', 'g') AS message, (contains(text, 'fixed') OR contains(text, 'resolved') OR contains(text, 'success')) AS resolved, count(*) AS n FROM (SELECT doc_id, text, unnest({_all_sql([p.replace('(.+?)', '([^' + chr(92) + 'n' + chr(92) + 'r]+?)') for p in capture.ERROR_PATTERNS], 1)}) AS m FROM documents WHERE text IS NOT NULL) GROUP BY ALL")
def transcript_errors(spark: SparkSession, d: str) -> DataFrame:
    e = _texts(spark, d).select("doc_id", F.explode(capture.errors(F.col("text"))).alias("e")).select("doc_id", "e.*")
    return e.groupBy("doc_id", "message", "resolved").agg(F.count(F.lit(1)).alias("n"))


@registered("SELECT id, CASE WHEN strlen(f) <= 100 THEN trim(f) ELSE trim(left(f, 97)) || '...' END AS intent FROM (SELECT id, string_split(raw_prompt, '.')[1] AS f FROM ep)", episodes=True)
def simple_intent(spark: SparkSession, d: str) -> DataFrame:
    return episodes(spark, d).select("id", capture.simple_intent(F.col("raw_prompt")).alias("intent"))


def _named_sql(names: dict[str, str], c: str, default: str) -> str:
    return f"CASE lower(trim({c})) " + " ".join(f"WHEN {_q(a)} THEN {_q(n)}" for a, n in names.items()) + f" ELSE {default} END"


@registered(f"SELECT task_type, status, {_named_sql(capture.TASK_NAMES, 'task_type', _q('unknown'))} AS task, {_named_sql(capture.OUTCOME_NAMES, 'status', _q('partial'))} AS outcome, count(*) AS n FROM ep GROUP BY ALL", episodes=True)
def alias_parse(spark: SparkSession, d: str) -> DataFrame:
    e = episodes(spark, d).select("task_type", "status", capture.named(F.col("task_type"), capture.TASK_NAMES, "unknown").alias("task"), capture.named(F.col("status"), capture.OUTCOME_NAMES, "partial").alias("outcome"))
    return e.groupBy("task_type", "status", "task", "outcome").agg(F.count(F.lit(1)).alias("n"))


_ICON = "CASE status WHEN 'success' THEN '✅' WHEN 'failure' THEN '❌' ELSE '⚠️' END || ' ' || status"
_LIST = "'{0}: ' || array_to_string({1}, ', ')"
_MESSAGES, _RESOLUTIONS = "list_transform(errors, lambda e: coalesce(e.message, ''))", "list_filter(list_transform(errors, lambda e: e.resolution), lambda r: r IS NOT NULL)"


EMBEDDED_SQL = f"""concat_ws(' | ', nullif(raw_prompt, ''), nullif(intent, ''), 'task type: ' || task_type, CASE WHEN len(tags) > 0 THEN {_LIST.format('tags', 'tags')} END,
  CASE WHEN len(files) > 0 THEN {_LIST.format('files', 'files')} END, CASE WHEN len(tools) > 0 THEN {_LIST.format('tools', 'tools')} END, CASE WHEN len(errors) > 0 THEN {_LIST.format('errors', _MESSAGES)} END,
  CASE WHEN len({_RESOLUTIONS}) > 0 THEN {_LIST.format('resolutions', _RESOLUTIONS)} END, 'outcome: ' || {_ICON})"""


@registered(f"SELECT id, {EMBEDDED_SQL} AS text FROM ep", episodes=True)
def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    return episodes(spark, d).select("id", render.embedding_text().alias("text"))


def _bullets_sql(c: str) -> str:
    return f"CASE WHEN len({c}) = 0 THEN '- None\n' ELSE '- ' || array_to_string({c}, '\n- ') || '\n' END"


@registered(
    f"""SELECT id, '# Episode: ' || CASE WHEN intent <> '' THEN intent ELSE raw_prompt END || '\n\n**ID**: ' || left(id, 8) || '\n**Date**: ' || coalesce(strftime(started, '%Y-%m-%d %H:%M:%S UTC'), '') || '\n**Project**: ' || coalesce(project, '')
  || '\n**Outcome**: ' || {_ICON} || '\n\n## Intent\n\n' || raw_prompt || '\n\n## Context\n\n### Files Read\n' || {_bullets_sql('fr')} || '\n### Files Modified\n' || {_bullets_sql('files')} || '\n### Commands/Tools Used\n' || {_bullets_sql('tools')} || '\n'
  || CASE WHEN len(errors) > 0 THEN '## Errors → Resolutions\n\n| Error | Resolution |\n|-------|------------|\n' || array_to_string(list_transform(errors, lambda e: '| ' || coalesce(e.message, '') || ' | ' || coalesce(e.resolution, 'unresolved') || ' |\n'), '') || '\n' ELSE '' END
  || '## Tags\n\n' || array_to_string(tags, ', ') || '\n\n' AS document
FROM ep JOIN (SELECT id, coalesce(list_filter(any_value(context.files_read), lambda x: x IS NOT NULL), []) AS fr FROM episodes WHERE id IS NOT NULL GROUP BY id) USING (id)""",
    episodes=True,
)
def episode_markdown(spark: SparkSession, d: str) -> DataFrame:
    return episodes(spark, d).select("id", render.markdown().alias("document"))


@registered("SELECT id, left(id, 8) AS short_id, nullif(trim(project), '') AS project, status AS outcome, nullif(trim(array_to_string(tags, ', '), ' \t\n\r'), '') AS tags FROM ep", episodes=True)
def markdown_read_back(spark: SparkSession, d: str) -> DataFrame:
    """Documents read back into fields; what a document holds survives the round trip."""
    m = episodes(spark, d).select("id", render.markdown().alias("m"))
    status = F.lower(render.field_of(F.col("m"), "Outcome"))
    outcome = F.when(F.contains(status, F.lit("success")), "success").when(F.contains(status, F.lit("failure")), "failure").otherwise("partial")
    tags = F.nullif(F.regexp_replace(render.section_of(F.col("m"), "Tags"), r"^\s+|\s+$", ""), F.lit(""))
    return m.select("id", render.field_of(F.col("m"), "ID").alias("short_id"), render.field_of(F.col("m"), "Project").alias("project"), outcome.alias("outcome"), tags.alias("tags"))


@registered("SELECT raw_id, json_valid(payload) AS valid, coalesce(CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.intent.task_type') END, 'unknown') AS task_type FROM raw_episodes WHERE payload IS NOT NULL")
def llm_json_parse(spark: SparkSession, d: str) -> DataFrame:
    """JSON answers read by fixed paths, with a default where a field or the whole is missing."""
    j = F.try_parse_json("payload")
    p = table(spark, d, "raw_episodes").filter("payload is not null")
    return p.select("raw_id", j.isNotNull().alias("valid"), F.coalesce(F.get_json_object("payload", "$.intent.task_type"), F.lit("unknown")).alias("task_type"))


_SEEN_SQL = "CASE WHEN json_valid(payload) THEN payload ELSE '{}' END"


def _text_sql(path: str) -> str:
    return f"CASE WHEN json_type({_SEEN_SQL}, '{path}') = 'VARCHAR' THEN json_extract_string({_SEEN_SQL}, '{path}') END"


@registered(
    f"""SELECT raw_id, coalesce({_text_sql('$.intent.extracted_intent')}, '') AS summary, {_named_sql(capture.TASK_NAMES, f"coalesce({_text_sql('$.intent.task_type')}, 'unknown')", _q('unknown'))} AS task_type,
  CASE WHEN json_type({_SEEN_SQL}, '$.intent.domain') = 'ARRAY' THEN coalesce(array_to_string(list_transform(list_filter(json_extract({_SEEN_SQL}, '$.intent.domain[*]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: json_extract_string(x, '$')), '|'), '') ELSE '' END AS tags,
  '' AS entities, CASE WHEN json_type({_SEEN_SQL}, '$.utility.retrieval_count') IN ('UBIGINT', 'BIGINT') AND json_extract({_SEEN_SQL}, '$.utility.retrieval_count')::BIGINT >= 0 THEN json_extract({_SEEN_SQL}, '$.utility.retrieval_count')::BIGINT % 256 ELSE 3 END::INT AS complexity
FROM raw_episodes WHERE payload IS NOT NULL"""
)
def answer_fields(spark: SparkSession, d: str) -> DataFrame:
    """The fields of a model's answer with their defaults, read from the captures' JSON under the names it uses."""
    fields = capture.answer_fields(F.col("payload"), "$.intent.extracted_intent", "$.intent.task_type", "$.intent.domain", "$.intent.entities", "$.utility.retrieval_count")
    got = table(spark, d, "raw_episodes").filter("payload is not null").select("raw_id", *[c.alias(n) for n, c in fields.items()])
    return got.withColumns({"tags": F.array_join("tags", "|"), "entities": F.array_join("entities", "|")})


@registered(
    f"""WITH e AS (SELECT raw_id, CASE WHEN json_type({_SEEN_SQL}, '$.context.errors_encountered') = 'ARRAY' THEN json_extract({_SEEN_SQL}, '$.context.errors_encountered[*]') END AS es FROM raw_episodes WHERE payload IS NOT NULL),
x AS (SELECT raw_id, unnest(es) AS x FROM e)
SELECT raw_id, 'runtime' AS error_type, json_extract_string(x, '$.message') AS message, coalesce(json_type(x, '$.resolution') = 'VARCHAR', false) AS resolved,
  CASE WHEN json_type(x, '$.resolution') = 'VARCHAR' THEN json_extract_string(x, '$.resolution') END AS resolution, count(*) AS n
FROM x WHERE json_type(x, '$.message') = 'VARCHAR' GROUP BY ALL"""
)
def error_arguments(spark: SparkSession, d: str) -> DataFrame:
    """Errors as a capture's arguments name them."""
    e = capture.error_arguments(F.col("payload"), "$.context.errors_encountered", "$.message", "$.resolution")
    got = table(spark, d, "raw_episodes").filter("payload is not null").select("raw_id", F.explode(e).alias("e")).select("raw_id", "e.*")
    return got.groupBy("raw_id", "error_type", "message", "resolved", "resolution").agg(F.count(F.lit(1)).alias("n"))


@registered(
    f"""SELECT task_type, status, CASE WHEN task_type IN ({', '.join(_q(t) for t in dict.fromkeys(capture.TASK_NAMES.values()))}) THEN task_type ELSE 'unknown' END AS task,
  CASE WHEN status IN ({', '.join(_q(t) for t in dict.fromkeys(capture.OUTCOME_NAMES.values()))}) THEN status ELSE 'partial' END AS outcome, count(*) AS n FROM ep GROUP BY ALL""",
    episodes=True,
)
def strict_parse(spark: SparkSession, d: str) -> DataFrame:
    """Types and outcomes that count only as they are written, letter for letter."""
    task = capture.strict(F.col("task_type"), list(dict.fromkeys(capture.TASK_NAMES.values())), "unknown")
    outcome = capture.strict(F.col("status"), list(dict.fromkeys(capture.OUTCOME_NAMES.values())), "partial")
    return episodes(spark, d).select("task_type", "status", task.alias("task"), outcome.alias("outcome")).groupBy("task_type", "status", "task", "outcome").agg(F.count(F.lit(1)).alias("n"))


def _prompt_sql() -> str:
    return f"coalesce({', '.join(f'nullif(trim(regexp_extract(text, {_q(p)}, 1)), {_q('')})' for p in _PROMPTS)}, list_filter(string_split_regex(text, '\\r?\\n'), lambda x: trim(x) <> '')[1], '')"


@registered(
    f"""WITH t AS (SELECT doc_id, text, project, captured_at, {_prompt_sql()} AS prompt FROM documents WHERE text IS NOT NULL),
f AS (SELECT *, string_split(prompt, '.')[1] AS f, list_sort(list_distinct(list_filter([{', '.join(f"CASE WHEN contains(lower(prompt || ' '), {_q(w)}) THEN {_q(t)} END" for w, t in capture.TAG_WORDS)}], lambda x: x IS NOT NULL))) AS tags FROM t)
SELECT doc_id, project, strftime(captured_at, '%Y-%m-%d') AS day, md5(prompt) AS prompt_digest, md5(CASE WHEN strlen(f) <= 100 THEN trim(f) ELSE trim(left(f, 97)) || '...' END) AS intent_digest, {_first_of(capture.TASK_WORDS, 'lower(prompt)')} AS task_type, array_to_string(tags, ',') AS tags,
  len(list_distinct({_all_sql(capture.READ_PATTERNS, 1)})) AS n_files_read, len(list_distinct(list_transform({_all_sql(capture.TOOL_PATTERNS, 0)}, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')))) AS n_tools,
  len({_all_sql([p.replace('(.+?)', '([^' + chr(92) + 'n' + chr(92) + 'r]+?)') for p in capture.ERROR_PATTERNS], 1)}) AS n_errors,
  CASE WHEN {_signs(capture.SUCCESS_WORDS)} > {_signs(capture.FAILURE_WORDS)} THEN 'success' WHEN {_signs(capture.FAILURE_WORDS)} > {_signs(capture.SUCCESS_WORDS)} THEN 'failure' ELSE 'partial' END AS status
FROM f"""
)
def capture_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Each document captured as an episode: prompt, intent, type, tags, files, tools, errors and outcome together."""
    t = table(spark, d, "documents").filter("text is not null")
    e = t.select("doc_id", "project", F.date_format("captured_at", "yyyy-MM-dd").alias("day"), *[c.alias(n) for n, c in capture.episode_of(F.col("text"), F.array().cast("array<string>")).items()])
    return e.select(
        "doc_id", "project", "day", F.md5("raw_prompt").alias("prompt_digest"), F.md5("intent").alias("intent_digest"), "task_type", F.array_join("tags", ",").alias("tags"),
        F.size("files_read").alias("n_files_read"), F.size("tools").alias("n_tools"), F.size("errors").alias("n_errors"), "status",
    )


@registered("SELECT doc_id, CASE WHEN strlen(text) <= 10000 THEN text ELSE left(text, 5000) || chr(10) || chr(10) || '[...truncated...]' || chr(10) || chr(10) || right(text, 4000) END AS sent FROM documents WHERE text IS NOT NULL")
def session_for_model(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts as they would be handed to a model, long ones shortened in the middle."""
    return _texts(spark, d).select("doc_id", capture.shortened_session(F.col("text")).alias("sent"))


@registered("SELECT strftime(started, '%Y-%m-%d') AS date, id, 'session-' || left(id, 8) || '.diff' AS name FROM ep", episodes=True)
def diff_names(spark: SparkSession, d: str) -> DataFrame:
    """Where the diff of each episode is kept: by date of start, under a short id."""
    return episodes(spark, d).select(F.date_format("started", "yyyy-MM-dd").alias("date"), "id", diff_name(F.col("id")).alias("name"))


@registered(
    f"""AND s AS (SELECT search_id, id, max(similarity_score::DOUBLE) AS similarity FROM search_results WHERE similarity_score >= 0.3 GROUP BY ALL),
scored AS (SELECT s.search_id, ep.id, (1 - 0.7::DOUBLE) * similarity + 0.7::DOUBLE * {WILSON_SQL} AS score FROM s JOIN ep ON s.id = ep.id)
SELECT search_id, row_number() OVER (PARTITION BY search_id ORDER BY round(score, 9) DESC, id) AS hit_rank, '{{"id":"' || id || '","score":' || round(score, 6) || '}}' AS json FROM scored QUALIFY hit_rank <= 3""",
    episodes=True,
)
def result_json(spark: SparkSession, d: str) -> DataFrame:
    """Scored hits as JSON lines."""
    from lumora.plans.search import retrieve_scored

    got = retrieve_scored(spark, d)
    return got.select("search_id", "hit_rank", F.to_json(F.struct("id", "score")).alias("json"))


_RESOLVED = "list_transform(list_filter(errors, lambda e: e.resolved), lambda e: '  - ' || coalesce(e.message, ''))[1:3]"


_SOLVED = "list_transform(list_filter(errors, lambda e: e.resolved)[1:2], lambda e: concat_ws(chr(10), '     - ' || coalesce(e.message, ''), '       Resolution: ' || e.resolution))"
_HITS = f"""s AS (SELECT search_id, id, max(similarity_score::DOUBLE) AS similarity FROM search_results WHERE similarity_score >= 0.3 GROUP BY ALL),
r AS (SELECT s.search_id, s.similarity, {WILSON_SQL} AS w, ep.*, row_number() OVER (PARTITION BY search_id ORDER BY round((1 - 0.7::DOUBLE) * similarity + 0.7::DOUBLE * {WILSON_SQL}, 9) DESC, ep.id) AS n FROM s JOIN ep ON s.id = ep.id)"""


@registered(
    f"""AND {_HITS}
SELECT search_id, n AS hit_rank, concat_ws(chr(10), n || '. **' || CASE WHEN intent <> '' THEN intent ELSE raw_prompt END || '**', '   - ID: ' || left(id, 8), '   - Project: ' || coalesce(project, ''), '   - Type: ' || task_type, '   - Outcome: ' || {_ICON},
  '   - Relevance: ' || round(similarity * 100)::INT || '% similarity, ' || round(w * 100)::INT || '% utility (' || CASE WHEN retrievals = 0 THEN 'untested' WHEN retrievals <= 2 THEN 'low confidence' WHEN retrievals <= 5 THEN 'moderate confidence' ELSE 'high confidence' END || ', ' || retrievals || ' retrievals)',
  CASE WHEN len(files) > 0 THEN '   - Files: ' || array_to_string(files, ', ') END, CASE WHEN len(tags) > 0 THEN '   - Tags: ' || array_to_string(tags, ', ') END,
  CASE WHEN len({_SOLVED}) > 0 THEN '   - Errors resolved:' || chr(10) || array_to_string({_SOLVED}, chr(10)) END) AS text FROM r WHERE n <= 3""",
    episodes=True,
)
def result_text(spark: SparkSession, d: str) -> DataFrame:
    """The three best hits of each search as a list, with the resolutions of two errors."""
    return _shown(spark, d, render.server_hit)


@registered(
    f"""AND s AS (SELECT search_id, id, max(similarity_score::DOUBLE) AS similarity FROM search_results WHERE similarity_score >= 0.3 GROUP BY ALL),
r AS (SELECT s.search_id, s.similarity, {WILSON_SQL} AS w, ep.*, row_number() OVER (PARTITION BY search_id ORDER BY round((1 - 0.7::DOUBLE) * similarity + 0.7::DOUBLE * {WILSON_SQL}, 9) DESC, ep.id) AS n FROM s JOIN ep ON s.id = ep.id)
SELECT search_id, n AS hit_rank, concat_ws('
', '### ' || n || '. ' || CASE WHEN intent <> '' THEN intent ELSE raw_prompt END, '**When**: ' || strftime(started, '%Y-%m-%d %H:%M UTC'), '**Project**: ' || coalesce(project, ''), '**Outcome**: ' || {_ICON},
  '**Relevance**: ' || round(similarity * 100)::INT || '% similarity, ' || round(w * 100)::INT || '% utility (' || CASE WHEN retrievals = 0 THEN 'untested' WHEN retrievals <= 2 THEN 'low confidence' WHEN retrievals <= 5 THEN 'moderate confidence' ELSE 'high confidence' END || ', ' || retrievals || ' retrievals)',
  CASE WHEN len(files) > 0 THEN '**Files involved**: ' || array_to_string(files, ', ') END, CASE WHEN len(tags) > 0 THEN '**Tags**: ' || array_to_string(tags, ', ') END,
  CASE WHEN len({_RESOLVED}) > 0 THEN '**Errors resolved**:
' || array_to_string({_RESOLVED}, '
') END) AS text FROM r WHERE n <= 3""",
    episodes=True,
)
def result_markdown(spark: SparkSession, d: str) -> DataFrame:
    """The three best hits of each search as text."""
    return _shown(spark, d, render.hit_text)


def _shown(spark: SparkSession, d: str, form: Callable[..., Column]) -> DataFrame:
    from lumora.plans.search import retrieve_scored

    hits = table(spark, d, "search_results").filter("similarity_score >= 0.3").groupBy("search_id", "id").agg(F.max(F.col("similarity_score").cast("double")).alias("similarity"))
    top = retrieve_scored(spark, d).select("search_id", "id", "hit_rank").join(hits, ["search_id", "id"]).join(episodes(spark, d), "id")
    return top.select("search_id", "hit_rank", form(F.col("hit_rank"), F.col("similarity"), wilson(F.col("helpful"), F.col("retrievals"))).alias("text"))
