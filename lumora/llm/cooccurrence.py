"""Pairs of items that occur together, by basket collapsing.

Each record's items become one sorted, deduplicated array. Equal arrays are collapsed into one basket with a weight, so
a basket that holds a third of all records is enumerated once. Items below the support threshold leave the baskets
first (a pair can't be more frequent than its items), which collapses them further; rows of an item that very many
baskets hold are spread by basket. Pairs are enumerated within the
distinct baskets only, weighted, and summed with map-side partial sums before the shuffle.

Scores: lift = n_ab * n / (n_a * n_b); conviction(a -> b) = (1 - p_b) / (1 - n_ab / n_a), null where it is infinite.

Defined cases: null items and null records' groups don't count; repeated items count once for each record; repeated
rows of one record are united; records without items count in n; an empty input gives no pairs; the smaller item comes
first; ties need no order as every pair is returned. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.operators.joins import spread_join


def pair_counts(items: DataFrame, sizes: DataFrame, min_support: int = 1) -> DataFrame:
    """Counts and scores of pairs.

    ``items``: (part, record, item), one row for each item of a record, repeats allowed; pairs are formed within a
    part. ``sizes``: (part, n), the number of records of each part, those without items included.
    Returns part, item_a, item_b, n_ab, n_a, n_b, n, lift, conviction.
    """
    known = items.filter(F.col("part").isNotNull() & F.col("record").isNotNull() & F.col("item").isNotNull())
    baskets = known.groupBy("part", "record").agg(F.array_sort(F.collect_set("item")).alias("basket"))
    weighted = baskets.groupBy("part", "basket").agg(F.count(F.lit(1)).alias("w"))
    single = weighted.select("part", "w", F.explode("basket").alias("item")).groupBy("part", "item").agg(F.sum("w").alias("n_item"))
    frequent = single.filter(F.col("n_item") >= min_support)
    # back to one row for each item of a distinct basket, without the rare ones, and collapsed once more
    numbered = weighted.filter(F.size("basket") > 1).withColumn("b", F.xxhash64("basket", F.lit(1))).withColumn("b2", F.xxhash64("basket", F.lit(2)))
    kept = (
        numbered.select("part", "b", "b2", "w", F.explode("basket").alias("item"))
        .transform(lambda d: spread_join(d, frequent.select("part", "item"), ["part", "item"], "b", "left_semi"))
        .groupBy("part", "b", "b2", "w")
        .agg(F.array_sort(F.collect_list("item")).alias("basket"))
        .groupBy("part", "basket")
        .agg(F.sum("w").alias("w"))
    )
    first = kept.select("part", "w", "basket", F.posexplode("basket").alias("i", "item_a"))
    pairs = first.select("part", "w", "item_a", F.explode(F.slice("basket", F.col("i") + 2, F.size("basket"))).alias("item_b"))
    together = pairs.groupBy("part", "item_a", "item_b").agg(F.sum("w").alias("n_ab")).filter(F.col("n_ab") >= min_support)
    a = frequent.select("part", F.col("item").alias("item_a"), F.col("n_item").alias("n_a"))
    b = frequent.select("part", F.col("item").alias("item_b"), F.col("n_item").alias("n_b"))
    scored = spread_join(spread_join(together, a, ["part", "item_a"], "item_b"), b, ["part", "item_b"], "item_a")
    scored = spread_join(scored, sizes, ["part"], "item_a")
    miss = 1 - F.col("n_ab") / F.col("n_a")
    return scored.select(
        "part", "item_a", "item_b", "n_ab", "n_a", "n_b", "n",
        (F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))).alias("lift"),
        F.when(miss > 0, (1 - F.col("n_b") / F.col("n")) / miss).alias("conviction"),
    )
