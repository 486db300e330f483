import pytest
from pyspark.sql import functions as F

from lumora.functions import capture as c
from lumora.functions.text import plain_path, trimmed, words


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize("text, want", [("fix the bug", "bugfix"), ("add new feature", "feature"), ("write tests", "test"), ("refactor code", "refactor"), ("use docker", "docs"), ("", "unknown"), (None, "unknown")])
def test_task_type(spark, text, want):
    assert one(spark, c.task_type(F.col("t")), t=text) == want


@pytest.mark.parametrize("text, want", [("All tests pass!", "success"), ("Build failed with errors", "failure"), ("so so", "partial"), ("successfully failed", "partial")])
def test_outcome(spark, text, want):
    assert one(spark, c.outcome(F.col("t")), t=text) == want


@pytest.mark.parametrize(
    "text, want",
    [("Human: fix it\n\nAssistant: yes", "fix it"), ("user: go\nAssistant: no", "go"), ("> quoted\n\nrest", "quoted"), ("\n  \nplain\nmore", "plain"), ("User: two\nlines\n\nx", "User: two"), ("", "")],
)
def test_first_prompt(spark, text, want):
    assert one(spark, c.first_prompt(F.col("t")), t=text) == want


def test_lists(spark):
    text = "Reading `src/a.rs` then cat b.txt and File 'c.py'\n$ cargo test \nRunning: pytest\nerror[E12]: bad thing \nFAILED: x\nnow fixed"
    assert one(spark, c.file_reads(F.col("t")), t=text) == ["b.txt", "c.py", "src/a.rs"]
    assert one(spark, c.tool_calls(F.col("t")), t=text) == ["$ cargo", "Running: pytest", "cargo test"]
    assert [(e.message, e.resolved) for e in one(spark, c.errors(F.col("t")), t=text)] == [("bad thing", True), ("x", True)]
    assert one(spark, c.domain_tags(F.col("p"), F.col("f")), p="Build the API", f=["x.rs"]) == ["api", "rust", "ui"]


def test_names_and_cuts(spark):
    assert one(spark, c.named(F.col("t"), c.TASK_NAMES, "unknown"), t=" Feat ") == "feature"
    assert one(spark, c.named(F.col("t"), c.VERDICT_NAMES, None), t="Y") == "helpful"
    assert one(spark, c.named(F.col("t"), c.VERDICT_NAMES, None), t="perhaps") is None
    assert one(spark, c.simple_intent(F.col("t")), t="Do it. Then that") == "Do it"
    assert one(spark, c.simple_intent(F.col("t")), t="x" * 150) == "x" * 97 + "..."
    assert one(spark, c.project_of(F.col("t")), t="/home/me/work/") == "work"
    assert one(spark, c.project_of(F.col("t")), t="/") == "unknown"
    long = one(spark, c.shortened_session(F.col("t")), t="a" * 9000 + "b" * 9000)
    assert len(long) < 9100 and long.startswith("a" * 5000) and long.endswith("b" * 4000)


@pytest.mark.parametrize(
    "path, want",
    [("src/a.rs", "src/a.rs"), (" ./src//b/../a.rs\n", "src/a.rs"), (".\\src\\a.rs", "src/a.rs"), ("/workspace/P/src/a.rs", "src/a.rs"), ("/etc/x", "/etc/x"), ("../x", "../x"), ("", "")],
)
def test_plain_path(spark, path, want):
    assert one(spark, plain_path(F.col("t"), F.lit("p")), t=path) == want


def test_white_space(spark):
    assert one(spark, trimmed(F.col("t")), t="  a b　") == "a b"
    assert one(spark, words(F.col("t")), t="  a  b　c") == ["a", "b", "c"]
