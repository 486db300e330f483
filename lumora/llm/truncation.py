"""Texts that were cut off on their way into the store.

1. *Lengths.* For each source and unit (characters, bytes) the discrete hazard of a text ending at a length is the
   number of distinct texts of that length over those at least as long. Window functions give the hazard of the
   neighbouring lengths; a Poisson tail tests each length against them, and the tests are held to a false-discovery
   rate (Benjamini-Hochberg). Lengths that stand out, and at which a good part of the endings is incomplete on its own
   evidence, are field limits.
2. *Endings.* ``broken``: a replacement character, a fence, bracket (on whichever line) or JSON value left open, a heading
   or label without content, a path without its extension. ``closed``: a closing mark or a symbol. ``line``: a form that needs no closing
   mark (list item, table row, trailer, quote, one-line remark or commit, and last lines usual for the source).
   ``open``: running text without a closing mark.
3. *Verdict.* broken and open endings are cut. A line is cut if its last word isn't known from the inside of any text
   while a known word begins with it; if it differs from the last lines of a source that all but always ends in the
   same few; or if it stands at a field limit. An ellipsis is cut at a field limit only.

All counts cover all texts; words and shapes are counted with partial sums before their shuffles, and hot words are
joined on distinct values only.

Defined cases: null and blank texts are no cases; null sources form one group; sources that differ in letter case and
surrounding white space are one; white space after a text is not part of its ending; exact repeats get the same verdict
and count once in the hazards and in what endings are usual; very long texts are examined whole; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumora.functions.text import folded, is_blank
from lumora.llm.common import spread_join
from lumora.session import cut

_TERMINAL = r"[.!?。！？؟।]"
_CLOSED = rf"{_TERMINAL}[\"”’»'\)\]\}}*_`」』）]*(?:\s*[\p{{So}}\p{{Sk}}️‍]+)?$|[\p{{So}}️]$|[\"”»」』）]$|```$"
_FORMS = r"^(?:[-*•+] |\d+[.)] |> |-- |\[[ xX]\] |\|.*\|$)"
_TRAILER = r"^\p{L}[\p{L} _-]{0,30}: [^\s,]+(?:, [^\s,]+)*$"
_SPEAKER = r"^(?:User|Assistant|System|Human): "
#: Brackets that a complete text closes again.
BRACKETS = ["()", "[]", "{}", "（）", "「」", "『』", "【】"]
_DANGLING = r"^ *(?:#{1,6}(?: .*)?|[-*•>|]|\p{L}+:)$|[,;:(\[{“«&+=<\\]$|(?:^|\s)[-–—]$|/[^/\s.]+\.$|(?:^|[\s,(])(?:[\w.-]+/)+[\w-]*$"


def _body(text: str) -> Column:
    """A text without the white space after it; texts that end in none are left alone, a run is tried once from its start."""
    ends_blank = F.right(text, F.lit(1)).rlike(r"[\s\p{Z}\p{Cf}]")
    return F.when(ends_blank, F.regexp_replace(text, r"(?<![\s\p{Z}\p{Cf}])[\s\p{Z}\p{Cf}]+\z", "")).otherwise(F.col(text))


def _count(text: Column, piece: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)


def _brackets(text: Column) -> Column:
    """The brackets of a text alone; colour codes hold none."""
    bare = F.when(F.contains(text, F.lit("\x1b")), F.regexp_replace(text, r"\x1b\[[0-9;]*[A-Za-z]", "")).otherwise(text)
    both = "".join(F"\\{c}" for c in "".join(BRACKETS))
    return F.when(text.rlike(f"[{both}]"), F.regexp_replace(bare, f"[^{both}]+", "")).otherwise(F.lit(""))


def _left_open(brackets: Column) -> Column:
    """Whether some kind of bracket is opened more often than it is closed."""
    return reduce(lambda a, b: a | b, [F.regexp_count(brackets, F.lit(f"\\{o}")) > F.regexp_count(brackets, F.lit(f"\\{c}")) for o, c in BRACKETS])


def _word(token: Column) -> Column:
    """A token without the punctuation around it; null for numbers and the like."""
    w = F.lower(F.regexp_replace(token, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.when(w.rlike(r"\p{L}"), w)


def endings(documents: DataFrame) -> DataFrame:
    """doc_id, source key, lengths, the form of each ending, its last line's shape and last word."""
    d = documents.filter(~is_blank("text")).select("doc_id", F.coalesce(folded("source"), F.lit("")).alias("key"), "text")
    # the lines are found in the text without the white space that follows it
    d = d.select("*", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("h"), _body("text").alias("body"))
    d = d.withColumns({"last": F.substring_index(F.substring_index("body", "\n", -1), "\r", -1), "brackets": _brackets(F.col("body"))})
    # what is anchored at the end and can't span lines is looked for in the last line only
    b, last = F.col("body"), F.col("last")
    looks_json = b.rlike(r"^\s*[\[{]\s*[\"\[{]")
    table = last.rlike(r"^\|") & ~last.rlike(r"\|$")
    # an odd number of fences leaves one open
    fence = F.contains(b, F.lit("```")) & (_count(b, "```") % 2 == 1)
    broken = F.endswith(b, F.lit("\ufffd")) | fence | (looks_json & F.try_parse_json(b).isNull()) | table | ((F.col("brackets") != "") & _left_open(F.col("brackets"))) | last.rlike(_DANGLING)
    ellipsis = last.rlike(r"(?:…|\.\.\.)$")
    one_line = (b == last) & last.rlike(r"^[^\p{Lu}]") & ~last.rlike(rf"{_TERMINAL}\s")
    form = last.rlike(_FORMS) | (last.rlike(_TRAILER) & ~last.rlike(_SPEAKER)) | one_line
    kind = F.when(broken, "broken").when(ellipsis, "ellipsis").when(last.rlike(_CLOSED) | (last.rlike(r"\)$") & ~looks_json) | (looks_json & last.rlike(r"[\]}]$")), "closed").when(form, "line").otherwise("open")
    shape = F.xxhash64(F.regexp_replace(last, r"\d+", "0"))
    return d.select("doc_id", "key", "chars", "bytes", "h", kind.alias("kind"), shape.alias("shape"), _word(F.element_at(F.split("last", r"\s+"), -1)).alias("word"))


def _inner_words(documents: DataFrame) -> DataFrame:
    """(word, n): how often each word stands inside a text, its last word left out."""
    tokens = F.split(_body("text"), r"\s+")
    token = documents.filter(~is_blank("text")).select(tokens.alias("ts")).select(F.explode(F.slice("ts", F.lit(1), F.size("ts") - 1)).alias("t"))
    # equal tokens are counted before their punctuation is taken off
    counted = token.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(_word(F.col("t")).alias("word"), "n").filter("word is not null")


def half_words(ends: DataFrame, documents: DataFrame, least: int = 2) -> DataFrame:
    """Last words not known from the inside of texts, with which a known word begins.

    Words of a common beginning are neighbours in the order of words, so it is enough to look at the known word that
    comes next. Distinct words are sorted in range partitions; where none follows within a partition it is the first one
    of those behind it, and there is one row for each partition to tell.
    """
    last = ends.filter((F.col("kind") == "line") & F.col("word").isNotNull()).select("word", F.lit(0).alias("n"), F.lit(True).alias("asked"))
    words = _inner_words(documents).withColumn("asked", F.lit(False)).unionByName(last).groupBy("word").agg((F.sum("n") >= least).alias("known"), F.max("asked").alias("asked"))
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(words.filter("known or asked").repartitionByRange(n, "word").select("word", "known", "asked", F.spark_partition_id().alias("part")))
    known = F.when(F.col("known"), F.col("word"))
    behind = Window.partitionBy("part").orderBy(F.desc("word")).rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("part").agg(F.min(known).alias("first"))
    rest = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    starts = parts.select("part", F.last("first", ignorenulls=True).over(rest).alias("first"))
    following = placed.withColumn("following", F.last(known, ignorenulls=True).over(behind)).filter("asked and not known")
    following = following.join(F.broadcast(starts), "part").select("word", F.coalesce("following", "first").alias("following"))
    return following.filter(F.startswith("following", F.col("word"))).select("word")


def _log_tail(observed: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """log P(X >= observed) for Poisson counts, by the bound of its leading term and its geometric rest."""
    out = np.zeros(len(observed))
    for i, (k, m) in enumerate(zip(observed.tolist(), expected.tolist())):
        if k > m:
            out[i] = min(0.0, k * log(m) - m - lgamma(k + 1) - log(1 - m / (k + 1)))
    return out


def length_hazards(ends: DataFrame, reach: int = 12, rate: float = 0.01, least_ratio: float = 3.0) -> DataFrame:
    """Lengths of each source and unit whose hazard stands out from its neighbours', under false-discovery control."""
    one = ends.dropDuplicates(["key", "h"])
    units = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length"))))
    n = one.select("key", units.alias("u")).select("key", "u.*").groupBy("key", "unit", "length").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("key", "unit").orderBy("length")
    # those at least as long are all but the shorter ones: a running sum, linear in the lengths that occur
    shorter = F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = n.withColumn("at_risk", F.sum("n").over(Window.partitionBy("key", "unit")) - shorter)
    near = near.withColumn("hazard", F.col("n") / F.col("at_risk"))
    around = F.sum("hazard").over(by.rangeBetween(-reach, reach)) - F.col("hazard")
    # half a text is added, so that a length without neighbours has an expectation; lengths that don't occur count as 0
    hazard = (around + 0.5 / F.col("at_risk")) / (2 * reach)
    near = near.withColumn("expected", hazard * F.col("at_risk"))

    def tail(observed: pa.Array, expected: pa.Array) -> pa.Array:
        return pa.array(_log_tail(observed.to_numpy(zero_copy_only=False).astype(float), np.maximum(expected.to_numpy(zero_copy_only=False), 1e-9)))

    tail.__annotations__ = {"observed": pa.Array, "expected": pa.Array, "return": pa.Array}
    tested = near.withColumn("log_p", F.arrow_udf(tail, "double")("n", "expected"))
    # one row for each length that occurs: slim, and bounded by the longest text
    total = Window.partitionBy("key", "unit")
    ranks = tested.withColumn("m", F.count(F.lit(1)).over(total)).withColumn("r", F.row_number().over(total.orderBy("log_p", "length")))
    passed = ranks.withColumn("ok", F.col("log_p") <= F.log(F.lit(rate) * F.col("r") / F.col("m")))
    passed = passed.withColumn("last_ok", F.max(F.when(F.col("ok"), F.col("r"))).over(total))
    return passed.filter((F.col("r") <= F.col("last_ok")) & (F.col("n") >= 3) & (F.col("n") >= least_ratio * F.col("expected"))).select("key", "unit", "length", "n", "expected", "at_risk")


def judged(documents: DataFrame, least_incomplete: float = 0.3, usual_share: float = 0.02, fixed_share: float = 0.6) -> DataFrame:
    """doc_id, key, kind, at_limit and ``cut`` of each text that isn't blank."""
    ends = cut(endings(documents))
    halves = half_words(ends, documents).withColumn("half", F.lit(True))
    # distinct last words and shapes are few for each source; the documents meet them by hash
    one = ends.dropDuplicates(["key", "h"])  # exact repeats make no ending usual
    shapes = one.groupBy("key", "shape").agg(F.count(F.lit(1)).alias("n_shape"))
    sizes = shapes.groupBy("key").agg(F.sum("n_shape").alias("n_key"))
    # at most 1 / usual_share shapes of a source
    usual = shapes.join(sizes, "key").filter((F.col("n_shape") >= 3) & (F.col("n_shape") >= usual_share * F.col("n_key")))
    # what is usual at the end of some source is usual for texts whose source isn't known
    anywhere = usual.filter(F.col("key") != "").groupBy("shape").agg(F.max("n_shape").alias("n_shape")).withColumn("key", F.lit("")).withColumn("n_key", F.lit(None).cast("bigint"))
    lines = ends.filter(F.col("kind").isin("line", "open")).select("key", "shape").distinct().join(usual.unionByName(anywhere).select("key", "shape").distinct(), ["key", "shape"]).withColumn("usual", F.lit(True))
    fixed = usual.join(lines, ["key", "shape"], "left_semi").groupBy("key").agg((F.sum("n_shape") / F.max("n_key")).alias("s")).filter(F.col("s") >= fixed_share).select("key", F.lit(True).alias("fixed"))
    seen = spread_join(spread_join(spread_join(ends, halves, ["word"], "doc_id", "left"), lines, ["key", "shape"], "doc_id", "left"), fixed, ["key"], "doc_id", "left")
    is_usual, is_half = F.coalesce("usual", F.lit(False)), F.coalesce("half", F.lit(False)) & (F.col("kind") == "line")
    # what a text's own ending tells, before any length is looked at
    own = (F.col("kind") == "broken") | ((F.col("kind") == "open") & ~is_usual) | ((F.col("kind") == "line") & ~is_usual & (is_half | F.coalesce("fixed", F.lit(False))))
    seen = cut(seen.select("doc_id", "key", "chars", "bytes", "kind", is_usual.alias("usual"), own.alias("own")))
    spikes = length_hazards(ends)
    loose = F.avg((F.col("own") | (F.col("kind") == "ellipsis")).cast("double"))

    def limits(unit: str) -> DataFrame:
        """Lengths that stand out and at which a good part of the endings is incomplete on its own evidence."""
        share = seen.groupBy("key", unit).agg(loose.alias("share")).filter(F.col("share") >= least_incomplete)
        at = spikes.filter(F.col("unit") == unit).select("key", F.col("length").alias(unit))
        return share.join(at, ["key", unit], "left_semi").select("key", unit, F.lit(True).alias(f"{unit}_limit"))

    with_limits = spread_join(spread_join(seen, limits("chars"), ["key", "chars"], "doc_id", "left"), limits("bytes"), ["key", "bytes"], "doc_id", "left")
    at_limit = F.coalesce("chars_limit", F.lit(False)) | F.coalesce("bytes_limit", F.lit(False))
    late = at_limit & F.col("kind").isin("line", "ellipsis") & ~F.col("usual")
    return with_limits.select("doc_id", "key", "kind", "chars", at_limit.alias("at_limit"), (F.col("own") | late).alias("cut"))
