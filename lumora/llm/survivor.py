"""One surviving value for each field of each group of duplicate records.

``survivors`` chooses the member whose value of a field survives: members without a usable value never do; of the
others the one that comes first by an explicit order (most complete, most trusted, latest, smallest id). The choice is
an associative minimum over one struct for each member and field, so partial results are combined before the shuffle
and a group with a third of all records is never held by one task.

``precedence`` and ``latest_values`` reason about currency where time stamps are missing. From the members that have
usable time stamps the transitions of a field's values (earlier value, value at the next time in the same group) are
counted over all groups; ``u`` precedes ``v`` if u is followed by v more often than v by u. Within a group a value is
dominated if another value of the group comes later by an explicit time stamp or, where either lacks one, by the learned
precedence. The values left are the topologically latest; of several the most frequent, then the smallest, is taken.
Only pairs that the precedence table holds are formed, never all pairs of a group. The rows of all groups are ordered in
one global order that is cut into stretches, so a group of any size is spread over many tasks.

Defined cases: null groups and members are ignored; repeated member rows count once with their highest trust; members
without a record are ignored; a group without a usable value gives no row; ties end at the smaller id; a cycle in the
learned precedence dominates all its values, then the most frequent value of the group is taken; empty inputs give
empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.functions.text import folded
from lumora.llm.common import bounded_broadcast, spread_join
from lumora.operators.ordering import stretches
from lumora.session import cut

#: Entries that merely stand for "nothing here".
STAND_INS = ["-", "--", "n/a", "na", "none", "(none)", "null", "nil", "tbd", "/dev/null"]


def informative_entries(entries: Column) -> Column:
    """The distinct informative entries of a list, without letter case and surrounding white space."""
    plain = F.array_distinct(F.transform(entries, folded))
    return F.filter(plain, lambda x: x.isNotNull() & (x != "") & ~x.isin(STAND_INS))


def informative(entries: Column) -> Column:
    """How many distinct informative entries a list holds."""
    return F.coalesce(F.size(informative_entries(entries)), F.lit(0))


def usable_end(start: Column, end: Column, days: int = 7) -> Column:
    """``end`` if it isn't before ``start`` nor more than ``days`` after it, else null."""
    return F.when((end >= start) & (end <= start + F.make_dt_interval(F.lit(days))), end)


def members(clusters: DataFrame, trust: DataFrame) -> DataFrame:
    """(cluster_id, episode_id, trust) once each; unlisted and null channels have trust 0."""
    listed = trust.groupBy("channel").agg(F.max("trust").alias("trust"))
    known = clusters.filter(F.col("cluster_id").isNotNull() & F.col("episode_id").isNotNull())
    joined = known.select("cluster_id", "episode_id", "channel").join(bounded_broadcast(listed), "channel", "left")
    return joined.groupBy("cluster_id", "episode_id").agg(F.max(F.coalesce("trust", F.lit(0))).alias("trust"))


def survivors(candidates: DataFrame, fields: dict[str, tuple[Column, list[Column]]], group: str, member: str) -> DataFrame:
    """(group, field_name, member) of the surviving value.

    ``fields``: for each name whether a member's value is usable, and the order of the usable ones, each column
    ascending with nulls last; the smaller member id ends ties.
    """
    types: list[list[str]] = []
    rows = []
    for name, (usable, order) in fields.items():
        # nulls last: a flag before each value
        flat = [x for c in order for x in (c.isNull(), F.coalesce(c.cast("bigint"), F.lit(0)))]
        types.append(flat)
        rows.append((name, usable, flat))
    longest = max(map(len, types))
    entries = [
        F.when(usable, F.struct(F.lit(name).alias("field_name"), F.array([x.cast("bigint") for x in flat] + [F.lit(0).cast("bigint")] * (longest - len(flat))).alias("order")))
        for name, usable, flat in rows
    ]
    long = candidates.select(group, member, F.explode(F.array_compact(F.array(*entries))).alias("e")).select(group, member, "e.*")
    best = long.groupBy(group, "field_name").agg(F.min(F.struct("order", F.col(member).alias("m"))).alias("best"))
    return best.select(group, "field_name", F.col("best.m").alias(member))


def precedence(stamped: DataFrame, group: str, field: str, value: str, at: str) -> DataFrame:
    """(field, earlier, later, n): value transitions that are more frequent than their reverse, from rows with a time stamp."""
    usable = stamped.filter(F.col(at).isNotNull() & F.col(value).isNotNull() & F.col(group).isNotNull())
    # equal rows are one, which also keeps a group of many copies small
    rows, w, own = stretches(usable.select(F.col(group).alias("_g"), F.col(field).alias("_f"), F.col(at).alias("_t"), F.col(value).alias("_v")).distinct(), ["_g", "_f", "_t", "_v"], 1)
    nxt = F.lead(F.struct("_g", "_f", "_t", "_v")).over(w)
    steps = rows.select("_g", "_f", "_t", "_v", own.alias("own"), nxt.alias("x")).filter("own and x._g = _g and x._f = _f and x._t > _t and x._v <> _v")
    counts = steps.groupBy(F.col("_f").alias(field), F.col("_v").alias("earlier"), F.col("x._v").alias("later")).agg(F.count(F.lit(1)).alias("n"))
    back = counts.select(field, F.col("later").alias("earlier"), F.col("earlier").alias("later"), F.col("n").alias("back"))
    return counts.join(back, [field, "earlier", "later"], "left").filter(F.col("n") > F.coalesce("back", F.lit(0))).select(field, "earlier", "later", "n")


def latest_values(rows: DataFrame, learned: DataFrame, group: str, field: str, value: str, at: str) -> DataFrame:
    """(group, field, value) of the topologically latest value of each group's field; ``rows`` may lack time stamps."""
    known = rows.filter(F.col(group).isNotNull() & F.col(value).isNotNull())
    values = cut(known.groupBy(group, field, value).agg(F.max(at).alias("at"), F.count(F.lit(1)).alias("n")))
    newest = values.groupBy(group, field).agg(F.max("at").alias("newest"))
    timed = spread_join(values, newest, [group, field], value)
    by_time = timed.filter(F.col("at") < F.col("newest")).select(group, field, value)
    # rules meet the values without a time stamp by value; a frequent value is spread by its groups
    rules, open_ = bounded_broadcast(learned.drop("n")), values.filter(F.col("at").isNull()).select(group, field, value)
    successors = spread_join(open_.withColumnRenamed(value, "earlier"), rules, [field, "earlier"], group)
    predecessors = spread_join(open_.withColumnRenamed(value, "later"), rules, [field, "later"], group)
    # both values of a rule have to be there
    there = values.select(group, field, value)
    met = successors.join(there.withColumnRenamed(value, "later"), [group, field, "later"]).select(group, field, F.col("earlier").alias(value))
    met = met.unionByName(predecessors.select(group, field, F.col("earlier").alias(value)).join(there, [group, field, value]))
    dominated = by_time.unionByName(met).distinct().withColumn("dominated", F.lit(True))
    best = values.join(dominated, [group, field, value], "left").groupBy(group, field).agg(F.min(F.struct(F.coalesce("dominated", F.lit(False)), -F.col("n"), F.col(value).alias("v"))).alias("best"))
    return best.select(group, field, F.col("best.v").alias(value))
