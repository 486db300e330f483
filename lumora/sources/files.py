"""Where episodes, transcripts and logs come from and go to."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.schema import EPISODE

REQUIRED = ("id", "timestamp_start", "timestamp_end", "project")


def read_episode_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each JSON document below ``path``/<date>/; what can't be read, or lacks a required field, is left out.

    The schema is given, never inferred, so only the columns asked for are parsed; the date of the folder prunes files.
    """
    raw = spark.read.schema(EPISODE).option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", False).json(f"{path}/*/*.json")
    return raw.dropna(subset=list(REQUIRED))


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    """Episodes written by ``write_episodes``; a filter on ``date`` reads only its folders."""
    return spark.read.parquet(path)


def write_episodes(e: DataFrame, path: str, mode: str = "append", form: str = "parquet") -> None:
    """Episodes in folders by their date of start; ``form`` parquet, or json for one document a line."""
    dated = e.withColumn("date", F.date_format("timestamp_start", "yyyy-MM-dd"))
    # rows of a date come together first, so that a task doesn't write a small file into every folder
    dated.repartition("date", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode(mode).partitionBy("date").format(form).save(path)


def write_documents(rows: DataFrame, path: str, mode: str = "append") -> None:
    """(id, document) as text, one folder for each first character of the id."""
    rows.select(F.col("document").alias("value"), F.left("id", F.lit(1)).alias("shelf")).write.mode(mode).partitionBy("shelf").option("lineSep", "\u0000").text(path)


def write_diffs(rows: DataFrame, path: str, mode: str = "append") -> None:
    """(id, started, diff) by date of start; ``name`` is what the file of an episode's diff would be called."""
    dated = rows.select(F.date_format("started", "yyyy-MM-dd").alias("date"), diff_name(F.col("id")).alias("name"), "id", "diff").filter(F.col("diff").isNotNull())
    dated.repartition("date", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode(mode).partitionBy("date").parquet(path)


def diff_name(id_: Column) -> Column:
    return F.concat(F.lit("session-"), F.left(id_, F.lit(8)), F.lit(".diff"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def newest_file(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """(path, modified) of the file changed last; contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", F.col("modificationTime").alias("modified"))
    return found.orderBy(F.desc("modified"), "path").limit(1)


# -- the log of retrievals and feedback: time, what happened, ids


def log_line(at: Column, what: str, text: Column, ids: Column) -> Column:
    """``what`` is query or feedback; tabs in the text become blanks, as tabs part the fields."""
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return F.concat_ws("\t", stamp, F.concat(F.lit(f"{what}:"), F.replace(text, F.lit("\t"), F.lit(" "))), F.concat(F.lit("ids:"), F.array_join(ids, ",")))


def log_fields(line: Column) -> list[Column]:
    """at, kind, text and ids of a line; the ids begin after the first ``ids:``, wherever that stands."""
    parts = F.split(line, "\t", 3)
    what, rest = F.try_element_at(parts, F.lit(2)), F.when(F.contains(line, F.lit("ids:")), F.substr(line, F.locate("ids:", line) + 4))
    ids = F.filter(F.transform(F.split(rest, ","), lambda x: F.trim(x)), lambda x: x != "")
    return [
        F.try_to_timestamp(F.element_at(parts, 1)).alias("at"), F.substring_index(what, ":", 1).alias("kind"),
        F.when(F.contains(what, F.lit(":")), F.substr(what, F.locate(":", what) + 1)).alias("text"), ids.alias("ids"),
    ]


def last_ids(lines: DataFrame) -> DataFrame:
    """The ids of the latest line that has any; ``lines``: (seq, value)."""
    with_ids = lines.filter(F.contains("value", F.lit("ids:")))
    last = with_ids.agg(F.max_by("value", "seq").alias("value"))
    return last.select(log_fields(F.col("value"))[3]).select(F.posexplode("ids").alias("pos", "id"))


# -- a work tree, read by the host that runs the driver


def _git(folder: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, check=False)
    return done.stdout if done.returncode == 0 else ""


def work_tree(spark: SparkSession, folder: str) -> DataFrame:
    """One row: the modified and new paths of a work tree, its short head and its diff; empty where there is none."""
    lines = _git(folder, "status", "--porcelain=v1", "--untracked-files=all").splitlines()
    changed = sorted({x[3:].split(" -> ")[-1].strip('"') for x in lines if x and "D" not in x[:2]})
    row = (changed, _git(folder, "rev-parse", "HEAD")[:8] or None, _git(folder, "diff") + _git(folder, "diff", "--cached"))
    return spark.createDataFrame([row], "files array<string>, head string, diff string")


# -- settings


@dataclass(frozen=True)
class Settings:
    """What can be set; unknown keys are ignored and missing ones keep their default."""

    utility_weight: float = 0.7
    min_similarity: float = 0.5
    default_limit: int = 3
    decay_rate: float = 0.01
    discount_factor: float = 0.9
    learning_rate: float = 0.1
    propagation_threshold: float = 0.5
    extra: dict = field(default_factory=dict, compare=False)

    @staticmethod
    def read(path: str | Path) -> Settings:
        import tomllib

        p = Path(path)
        if not p.exists():
            return Settings()
        flat: dict = {}
        for key, value in tomllib.loads(p.read_text()).items():
            flat |= value if isinstance(value, dict) else {key: value}
        known = {f.name for f in fields(Settings)} - {"extra"}
        return Settings(**{k: v for k, v in flat.items() if k in known}, extra={k: v for k, v in flat.items() if k not in known})

    def write(self, path: str | Path) -> None:
        Path(path).write_text("".join(f"{f.name} = {getattr(self, f.name)!r}\n" for f in fields(self) if f.name != "extra"))
