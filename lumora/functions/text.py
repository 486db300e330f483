"""Text helpers on columns, all evaluated inside Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(c: Column | str) -> Column:
    """Without surrounding white space in Unicode's sense (no-break spaces too).

    A run of white space is tried from its start only, so that a text of very many blanks takes linear time.
    """
    return F.regexp_replace(c, r"(?U)\A\s+|(?<!\s)\s+\z", "")


def folded(c: Column | str) -> Column:
    """Equal for texts that differ only in letter case and surrounding white space."""
    return F.lower(trimmed(c))


def is_blank(c: Column | str) -> Column:
    """Null or white space only; a text is looked through up to its first character that isn't blank."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | ~c.rlike(r"(?U)\S")


def words(c: Column | str) -> Column:
    """White-space separated words (Unicode white space), without empty ones."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def plain_path(path: Column, project: Column) -> Column:
    """A path in its plain form relative to its project.

    Back slashes, doubled separators, ``.`` and ``..`` steps and the prefix ``/workspace/<project>/`` are resolved.
    A path that climbs out of the project keeps its leading ``..``; an absolute path elsewhere keeps its leading slash.
    """
    p = F.replace(trimmed(path), F.lit("\\"), F.lit("/"))
    steps = F.aggregate(
        F.filter(F.split(p, "/"), lambda s: (s != "") & (s != ".")),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            (s == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != ".."),
            F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
        ).otherwise(F.array_append(acc, s)),
    )
    plain = F.array_join(steps, "/")
    home = F.concat(F.lit("workspace/"), F.lower(project), F.lit("/"))
    inside = F.startswith(p, F.lit("/")) & F.startswith(F.lower(plain), home)
    return F.when(inside, F.substr(plain, F.length(home) + 1)).when(F.startswith(p, F.lit("/")), F.concat(F.lit("/"), plain)).otherwise(plain)


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a time stamp with or without zone (without: in the session's zone)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))
