"""Global order without one task that sees all rows, and windows over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumora.session import cut


def ranked(df: DataFrame, keys: list[str], rank: str = "rank") -> DataFrame:
    """``df`` with the 0-based global rank of each row by ``keys`` (unique together).

    Range partitions are sorted on their own; only the number of rows of each partition goes through the driver.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # an id of this kind holds the partition in its upper bits and the row within it in the lower 33
    placed = cut(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn(rank, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(rank), 33)
    counts = {r.p: r.n for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for p in sorted(counts):
        offsets.append((p, total - (p << 33)))
        total += counts[p]
    schema = T.StructType([T.StructField("_p", T.LongType()), T.StructField("_o", T.LongType())])
    # one row for each partition
    starts = F.broadcast(spark.createDataFrame(offsets, schema))
    return placed.withColumn("_p", part).join(starts, "_p").withColumn(rank, F.col(rank) + F.col("_o")).drop("_p", "_o")


def stretches(df: DataFrame, keys: list[str], ahead: int, length: int = 50_000) -> tuple[DataFrame, WindowSpec, Column]:
    """``df`` cut into stretches of the global order, each with the ``ahead`` rows that follow it.

    Returns the rows, a window over a stretch, and the condition that a row belongs to its stretch and isn't one of the
    borrowed rows behind it. A ``lead`` of up to ``ahead`` rows sees the same as in one window over all rows.
    """
    if ahead >= length:
        raise ValueError("a stretch must be longer than what it borrows")
    own = F.floor(F.col("_rank") / length)
    borrowed = F.when((F.col("_rank") % length < ahead) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    cut_up = ranked(df, keys, "_rank").withColumn("_stretch", F.explode(borrowed))
    return cut_up, Window.partitionBy("_stretch").orderBy("_rank"), own == F.col("_stretch")
