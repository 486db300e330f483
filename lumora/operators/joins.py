"""Joins that hold where a key is hot or a side is small only as long as the data are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.session import cut

#: A side is broadcast up to this many rows; beyond it Spark joins by shuffle.
MAX_BROADCAST_ROWS = 100_000


def bounded_broadcast(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def spread_join(rows: DataFrame, few: DataFrame, keys: list[str], by: str, how: str = "inner", spread: int = 16) -> DataFrame:
    """``rows`` joined with ``few`` on ``keys``, a hot key (null ones too) spread over ``spread`` tasks by a digest of ``by``.

    ``few`` is sent ``spread`` times, so it is meant for tables with few rows for each key.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(spread)).cast("int"))
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def in_blocks(rows: DataFrame, key: str, member: str, most: int = 2_000) -> tuple[DataFrame, DataFrame]:
    """Two sides of a self join on (``key``, ``_block``) in which a key with over ``most`` rows is split over many tasks.

    The first side lies in one block of its key, the second in all of them, so each pair of rows meets once. Hot keys
    number at most one in ``most`` rows.
    """
    hot = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_n")).filter("_n > 1")
    hot = cut(hot)
    sized = rows.join(bounded_broadcast(hot), key, "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    left = sized.withColumn("_block", F.pmod(F.xxhash64(member), F.col("_n")).cast("int")).drop("_n")
    right = sized.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    return left, right


def block_pairs(rows: DataFrame, key: str, member: str, weight: str, most: int) -> DataFrame:
    """``rows`` with ``i``, ``j`` and ``own``, so that rows of one key meet in groups of a bounded size and each pair once.

    Rows of a key whose ``weight`` sums up to over ``most`` lie in blocks, ``own`` is a row's. Within a group of one key, i
    and j, all rows meet where i = j, and those of different ``own`` where not. A row is sent as often as its key has
    blocks. Hot keys number at most one in ``most`` of the whole weight.
    """
    hot = cut(rows.groupBy(key).agg(F.ceil(F.sum(weight) / most).cast("int").alias("_n")).filter("_n > 1"))
    sized = rows.join(bounded_broadcast(hot), key, "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    own = sized.withColumn("own", F.pmod(F.xxhash64(member), F.col("_n")).cast("int"))
    met = own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return met.withColumns({"i": F.least("own", "_o"), "j": F.greatest("own", "_o")}).drop("_n", "_o")
