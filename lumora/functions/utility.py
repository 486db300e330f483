"""Scores on columns: the Wilson bound, decay, combination and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumora.functions.text import micros

Z = 1.96
DAY = 86_400_000_000


def wilson(helpful: Column, n: Column) -> Column:
    """Lower bound of the share of helpful retrievals; 0.5 without any retrieval."""
    k, m = helpful.cast("double"), n.cast("double")
    p = k / F.nullif(m, F.lit(0.0))
    bound = (p + Z * Z / (2 * m) - Z * F.sqrt((p * (1 - p) + Z * Z / (4 * m)) / m)) / (1 + Z * Z / m)
    # rounding can leave the bound a hair below 0
    return F.when(n > 0, F.greatest(bound, F.lit(0.0))).otherwise(F.lit(0.5))


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole periods of 24 hours between two moments, rounded toward zero."""
    gap = (micros(later) - micros(earlier)) / DAY
    return F.when(gap >= 0, F.floor(gap)).otherwise(F.ceil(gap)).cast("bigint")


def decay(days: Column, rate: float = 0.01) -> Column:
    return F.pow(F.lit(1 - rate), F.greatest(days, F.lit(0)))


def combined(similarity: Column, utility: Column, weight: float) -> Column:
    return (1 - weight) * similarity + weight * utility


def confidence(n: Column) -> Column:
    return F.when(n == 0, "untested").when(n <= 2, "low confidence").when(n <= 5, "moderate confidence").otherwise("high confidence")


def share(part: Column, total: Column) -> Column:
    """part / total, 0 where there is nothing."""
    return F.when(total > 0, part / F.nullif(total.cast("double"), F.lit(0.0))).otherwise(F.lit(0.0))


#: ``wilson`` over columns helpful and retrievals, for the SQL checks.
WILSON_SQL = (
    "(CASE WHEN retrievals > 0 THEN greatest(0.0, (helpful/retrievals::DOUBLE + 3.8416/(2.0*retrievals) - 1.96*sqrt((helpful/retrievals::DOUBLE*(1-helpful/retrievals::DOUBLE)"
    " + 3.8416/(4.0*retrievals))/retrievals)) / (1 + 3.8416/retrievals)) ELSE 0.5 END)"
)
