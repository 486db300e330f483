"""What a session's transcript tells: its kind, its tags, its outcome, files, tools and errors. All on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns that decide results. Order matters where a rule says "first".
TASK_WORDS = [
    ("bugfix", ["fix", "bug", "broken"]),
    ("test", ["test", "spec"]),
    ("refactor", ["refactor", "clean", "improve"]),
    ("docs", ["doc", "readme", "comment"]),
    ("debug", ["debug", "investigate", "why"]),
    ("setup", ["setup", "install", "config"]),
    ("research", ["research", "explore", "learn"]),
    ("feature", ["add", "implement", "create", "build", "feature"]),
]
TAG_WORDS = [
    ("rust", "rust"), ("python", "python"), ("javascript", "javascript"), ("typescript", "typescript"),
    (".rs", "rust"), (".py", "python"), (".js", "javascript"), (".ts", "typescript"),
    ("react", "react"), ("vue", "vue"), ("angular", "angular"), ("async", "async"), ("api", "api"),
    ("database", "database"), ("sql", "sql"), ("test", "testing"), ("cli", "cli"), ("web", "web"), ("ui", "ui"),
    ("auth", "auth"), ("security", "security"), ("performance", "performance"), ("docker", "docker"), ("ci", "ci-cd"),
    ("deploy", "deployment"),
]
SUCCESS_WORDS = ["tests pass", "all tests pass", "successfully", "completed successfully", "build successful", "✅"]
FAILURE_WORDS = ["failed", "error", "tests fail", "build failed", "❌", "panic"]
RESOLVED_WORDS = ["fixed", "resolved", "success"]
TASK_NAMES = {
    "bugfix": "bugfix", "bug": "bugfix", "fix": "bugfix", "feature": "feature", "feat": "feature", "refactor": "refactor", "refactoring": "refactor",
    "test": "test", "testing": "test", "docs": "docs", "documentation": "docs", "research": "research", "debug": "debug", "debugging": "debug",
    "setup": "setup", "config": "setup", "configuration": "setup",
}
OUTCOME_NAMES = {
    "success": "success", "complete": "success", "done": "success", "partial": "partial", "incomplete": "partial", "failure": "failure", "failed": "failure",
}
VERDICT_NAMES = {
    "helpful": "helpful", "yes": "helpful", "y": "helpful", "1": "helpful", "good": "helpful",
    "not-helpful": "not helpful", "unhelpful": "not helpful", "no": "not helpful", "n": "not helpful", "0": "not helpful", "bad": "not helpful",
    "mixed": "mixed", "partial": "mixed", "skip": "mixed",
}
_PATH = r"([a-zA-Z0-9_\-./]+\.[a-zA-Z0-9]+)"
READ_PATTERNS = [r"(?:Read|Reading|read|reading)\s+[`'\"]?" + _PATH + r"[`'\"]?", r"(?:file|File)\s+[`'\"]?" + _PATH + r"[`'\"]?", r"(?:cat|less|head|tail)\s+" + _PATH]
TOOL_PATTERNS = [r"(?:Running|Executing|run|exec):\s*[`'\"]?([a-zA-Z0-9_\-]+)", r"(?:cargo|npm|yarn|pip|python|node|git)\s+([a-zA-Z0-9_\-]+)", r"(?:\$|>)\s*([a-zA-Z0-9_\-]+)\s"]
ERROR_PATTERNS = [r"(?i)error(?:\[E\d+\])?:\s*(.+?)(?:\n|$)", r"(?i)failed:\s*(.+?)(?:\n|$)", r"(?i)exception:\s*(.+?)(?:\n|$)", r"(?i)panic:\s*(.+?)(?:\n|$)"]
PROMPT_PATTERNS = [r"(?iud)^Human:\s*(.+?)(?:\n\n|\nAssistant:|\z)", r"(?iud)^User:\s*(.+?)(?:\n\n|\nAssistant:|\z)", r"(?iud)^>\s*(.+?)(?:\n\n|\z)"]


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def task_type(prompt: Column) -> Column:
    """The first kind of task one of whose words is part of the prompt."""
    low = F.lower(prompt)
    return F.coalesce(*[F.when(_any(low, w), F.lit(kind)) for kind, w in TASK_WORDS], F.lit("unknown"))


def domain_tags(prompt: Column, files: Column) -> Column:
    """Sorted tags whose words are part of the prompt or of a path."""
    text = F.lower(F.concat_ws(" ", F.coalesce(prompt, F.lit("")), F.array_join(files, " ")))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(text, F.lit(w)), F.lit(tag)) for w, tag in TAG_WORDS]))))


def outcome(text: Column) -> Column:
    """Which kind of signs there are more of; partial where neither prevails."""
    low = F.lower(text)
    n = lambda words: reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") for w in words])
    good, bad = n(SUCCESS_WORDS), n(FAILURE_WORDS)
    return F.when(good > bad, "success").when(bad > good, "failure").otherwise("partial")


def first_prompt(text: Column) -> Column:
    """The first turn of a transcript, or else its first line that isn't blank."""
    matches = [F.regexp_extract(text, p, 1) for p in PROMPT_PATTERNS]
    line = F.try_element_at(F.filter(F.split(text, "\r?\n"), lambda x: F.trim(x) != ""), F.lit(1))
    return F.coalesce(*[F.when(m != "", F.regexp_replace(m, r"(?U)^\s+|\s+$", "")) for m in matches], line, F.lit(""))


def _all(text: Column, patterns: list[str], group: int) -> Column:
    return F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(group)) for p in patterns])


def file_reads(text: Column) -> Column:
    return F.array_sort(F.array_distinct(_all(text, READ_PATTERNS, 1)))


def tool_calls(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(_all(text, TOOL_PATTERNS, 0), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))))


def errors(text: Column) -> Column:
    """Messages in the order of the patterns and then of the text, repeats kept; resolved if the text speaks of success anywhere."""
    resolved = _any(text, RESOLVED_WORDS)
    return F.transform(_all(text, ERROR_PATTERNS, 1), lambda m: F.struct(F.lit("unknown").alias("error_type"), F.regexp_replace(m, r"^\s+|\s+$", "").alias("message"), resolved.alias("resolved"), F.lit(None).cast("string").alias("resolution")))


def simple_intent(prompt: Column) -> Column:
    """The first sentence, cut to 97 characters and dots if it has over 100 bytes."""
    first = F.substring_index(prompt, ".", 1)
    return F.when(F.octet_length(first) <= 100, F.trim(first)).otherwise(F.concat(F.trim(F.left(first, F.lit(97))), F.lit("...")))


def project_of(path: Column) -> Column:
    """The last part of a directory's path, or unknown."""
    last = F.try_element_at(F.filter(F.split(path, "/"), lambda x: x != ""), F.lit(-1))
    return F.coalesce(last, F.lit("unknown"))


def named(c: Column, names: dict[str, str], default: str | None) -> Column:
    """The canonical name of an alias, ignoring letter case."""
    low = F.lower(F.trim(c))
    groups: dict[str, list[str]] = {}
    for alias, name in names.items():
        groups.setdefault(name, []).append(alias)
    return F.coalesce(*[F.when(low.isin(*aliases), F.lit(name)) for name, aliases in groups.items()], F.lit(default))


def strict(c: Column, names: list[str], default: str) -> Column:
    """The name as it stands if it is one of ``names``, letter for letter."""
    return F.when(c.isin(*names), c).otherwise(F.lit(default))


def episode_of(text: Column, files: Column) -> dict[str, Column]:
    """The columns of an episode that a transcript gives, with the files its work tree showed as modified."""
    prompt = first_prompt(text)
    return {
        "raw_prompt": prompt, "intent": simple_intent(prompt), "task_type": task_type(prompt), "tags": domain_tags(prompt, files), "files_read": file_reads(text),
        "files": files, "tools": tool_calls(text), "errors": errors(text), "status": outcome(text),
    }


def _strings(answer: Column, path: str) -> Column:
    """The strings of a list in an answer; other entries are dropped, anything but a list is an empty one."""
    entries = F.try_variant_get(answer, path, "array<variant>")
    texts = F.transform(F.filter(entries, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.variant_get(x, "$", "string"))
    return F.coalesce(texts, F.array().cast("array<string>"))


def _string(answer: Column, path: str) -> Column:
    """A text in an answer, null for anything else."""
    found = F.try_variant_get(answer, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.variant_get(found, "$", "string"))


def answer_fields(json: Column, summary: str = "$.summary", kind: str = "$.task_type", tags: str = "$.tags", entities: str = "$.entities", complexity: str = "$.complexity") -> dict[str, Column]:
    """The fields of a model's answer, with a default for each that is missing or of another kind; complexity is one byte."""
    a = F.try_parse_json(json)
    n = F.try_variant_get(a, complexity, "variant")
    whole = F.when(F.schema_of_variant(n) == "BIGINT", F.try_variant_get(a, complexity, "bigint"))
    return {
        "summary": F.coalesce(_string(a, summary), F.lit("")), "task_type": named(F.coalesce(_string(a, kind), F.lit("unknown")), TASK_NAMES, "unknown"),
        "tags": _strings(a, tags), "entities": _strings(a, entities), "complexity": F.coalesce(F.when(whole >= 0, whole % 256), F.lit(3)).cast("int"),
    }


def error_arguments(json: Column, path: str = "$.errors_resolved", message: str = "$.error", resolution: str = "$.resolution") -> Column:
    """Errors named in the arguments of a capture: entries without a text for the error are dropped, resolved are those with a resolution."""
    entries = F.filter(F.try_variant_get(F.try_parse_json(json), path, "array<variant>"), lambda x: _string(x, message).isNotNull())
    made = F.transform(entries, lambda x: F.struct(F.lit("runtime").alias("error_type"), _string(x, message).alias("message"), _string(x, resolution).isNotNull().alias("resolved"), _string(x, resolution).alias("resolution")))
    return F.coalesce(made, F.array().cast("array<struct<error_type: string, message: string, resolved: boolean, resolution: string>>"))


def shortened_session(text: Column, most: int = 10_000, head: int = 5_000, tail: int = 4_000) -> Column:
    """A long transcript as its beginning and its end, as it is handed to a model."""
    # measured in bytes, cut by characters, so that no character is cut in two
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit("\n\n[...truncated...]\n\n"), F.right(text, F.lit(tail))))
