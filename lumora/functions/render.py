"""Episodes as text: the document of an episode, the text that is embedded, and reading a document back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumora.functions.utility import confidence, wilson
from lumora.operators.store import icon


def _bullets(c: str) -> Column:
    return F.when(F.size(c) == 0, "- None\n").otherwise(F.concat(F.lit("- "), F.array_join(c, "\n- "), F.lit("\n")))


def status_label(status: Column) -> Column:
    return F.concat(icon(status), F.lit(" "), status)


def markdown() -> Column:
    """The document of a slim episode row."""
    title = F.when(F.col("intent") != "", F.col("intent")).otherwise(F.col("raw_prompt"))
    rows = F.array_join(F.transform("errors", lambda e: F.concat(F.lit("| "), F.coalesce(e["message"], F.lit("")), F.lit(" | "), F.coalesce(e["resolution"], F.lit("unresolved")), F.lit(" |\n"))), "")
    table = F.when(F.size("errors") > 0, F.concat(F.lit("## Errors → Resolutions\n\n| Error | Resolution |\n|-------|------------|\n"), rows, F.lit("\n"))).otherwise("")
    return F.concat(
        F.lit("# Episode: "), title, F.lit("\n\n**ID**: "), F.left("id", F.lit(8)), F.lit("\n**Date**: "), F.coalesce(F.date_format("started", "yyyy-MM-dd HH:mm:ss 'UTC'"), F.lit("")),
        F.lit("\n**Project**: "), F.coalesce("project", F.lit("")), F.lit("\n**Outcome**: "), status_label(F.col("status")), F.lit("\n\n## Intent\n\n"), F.col("raw_prompt"), F.lit("\n\n## Context\n\n### Files Read\n"), _bullets("files_read"),
        F.lit("\n### Files Modified\n"), _bullets("files"), F.lit("\n### Commands/Tools Used\n"), _bullets("tools"), F.lit("\n"), table, F.lit("## Tags\n\n"), F.array_join("tags", ", "), F.lit("\n\n"),
    )


def field_of(document: Column, name: str) -> Column:
    """What follows a bold field's name on the first line that begins with it."""
    return F.nullif(F.regexp_extract(document, rf"(?m)^\*\*{name}\*\*:[ \t]*(.*?)[ \t]*$", 1), F.lit(""))


def section_of(document: Column, name: str) -> Column:
    """The text below a heading, up to the next one of its level."""
    return F.nullif(F.regexp_extract(document, rf"(?sm)^## {name}[^\n]*\n(.*?)(?=^## |\z)", 1), F.lit(""))


def embedding_text() -> Column:
    """The text that an episode is embedded by; parts that are empty are left out."""
    joined = lambda label, c, size: F.when(size > 0, F.concat(F.lit(f"{label}: "), F.array_join(c, ", ")))
    messages = F.transform("errors", lambda e: F.coalesce(e["message"], F.lit("")))
    resolutions = F.array_compact(F.transform("errors", lambda e: e["resolution"]))
    return F.concat_ws(
        " | ", F.when(F.col("raw_prompt") != "", F.col("raw_prompt")), F.when(F.col("intent") != "", F.col("intent")), F.concat(F.lit("task type: "), F.col("task_type")),
        joined("tags", F.col("tags"), F.size("tags")), joined("files", F.col("files"), F.size("files")), joined("tools", F.col("tools"), F.size("tools")),
        joined("errors", messages, F.size("errors")), joined("resolutions", resolutions, F.size(resolutions)), F.concat(F.lit("outcome: "), status_label(F.col("status"))),
    )


def server_hit(rank: Column, similarity: Column, utility: Column, most_errors: int = 2) -> Column:
    """A hit as an entry of a list of results, with up to ``most_errors`` resolved errors and how they were resolved."""
    title = F.when(F.col("intent") != "", F.col("intent")).otherwise(F.col("raw_prompt"))
    percent = lambda c: F.round(c * 100).cast("int").cast("string")
    line = lambda label, c: F.concat(F.lit(f"   - {label}: "), c)
    solved = F.transform(F.slice(F.filter("errors", lambda e: e["resolved"]), 1, most_errors), lambda e: F.concat_ws("\n", F.concat(F.lit("     - "), F.coalesce(e["message"], F.lit(""))), F.concat(F.lit("       Resolution: "), e["resolution"])))
    relevance = F.concat(percent(similarity), F.lit("% similarity, "), percent(utility), F.lit("% utility ("), confidence(F.col("retrievals")), F.lit(", "), F.col("retrievals").cast("string"), F.lit(" retrievals)"))
    return F.concat_ws(
        "\n", F.concat(rank.cast("string"), F.lit(". **"), title, F.lit("**")), line("ID", F.left("id", F.lit(8))), line("Project", F.coalesce("project", F.lit(""))), line("Type", F.col("task_type")),
        line("Outcome", status_label(F.col("status"))), line("Relevance", relevance), F.when(F.size("files") > 0, line("Files", F.array_join("files", ", "))),
        F.when(F.size("tags") > 0, line("Tags", F.array_join("tags", ", "))), F.when(F.size(solved) > 0, F.concat(F.lit("   - Errors resolved:\n"), F.array_join(solved, "\n"))),
    )


def index_metadata() -> dict[str, Column]:
    """What an index holds beside the vector of a slim episode row."""
    return {
        "episode_id": F.col("id"), "project": F.col("project"), "task_type": F.col("task_type"), "intent_text": embedding_text(), "timestamp": F.unix_seconds("started"),
        "utility_score": wilson(F.col("helpful"), F.col("retrievals")), "retrieval_count": F.col("retrievals"), "helpful_count": F.col("helpful"),
    }


def hit_text(rank: Column, similarity: Column, utility: Column, most_errors: int = 3) -> Column:
    """A hit as a section of a result: when, how relevant, and up to ``most_errors`` errors that were resolved."""
    title = F.when(F.col("intent") != "", F.col("intent")).otherwise(F.col("raw_prompt"))
    percent = lambda c: F.round(c * 100).cast("int").cast("string")
    line = lambda label, c: F.concat(F.lit(f"**{label}**: "), c)
    resolved = F.slice(F.transform(F.filter("errors", lambda e: e["resolved"]), lambda e: F.concat(F.lit("  - "), F.coalesce(e["message"], F.lit("")))), 1, most_errors)
    relevance = F.concat(percent(similarity), F.lit("% similarity, "), percent(utility), F.lit("% utility ("), confidence(F.col("retrievals")), F.lit(", "), F.col("retrievals").cast("string"), F.lit(" retrievals)"))
    return F.concat_ws(
        "\n", F.concat(F.lit("### "), rank.cast("string"), F.lit(". "), title), line("When", F.date_format("started", "yyyy-MM-dd HH:mm 'UTC'")), line("Project", F.coalesce("project", F.lit(""))),
        line("Outcome", status_label(F.col("status"))), line("Relevance", relevance), F.when(F.size("files") > 0, line("Files involved", F.array_join("files", ", "))),
        F.when(F.size("tags") > 0, line("Tags", F.array_join("tags", ", "))), F.when(F.size(resolved) > 0, F.concat(F.lit("**Errors resolved**:\n"), F.array_join(resolved, "\n"))),
    )
