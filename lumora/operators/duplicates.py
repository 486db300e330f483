"""Episodes that tell of the same work: pairs, connected groups, and what remains of a group."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import count
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumora.functions.text import words
from lumora.operators import overlaps
from lumora.operators.joins import block_pairs
from lumora.session import cut

#: Edges that a task connects at a time.
CHUNK = 200_000
#: Edges that one task connects when chunks have made them few.
IN_ONE = 500_000


def word_classes(e: DataFrame) -> DataFrame:
    """(id, part, class): the class is a digest of the part and the set of words; members of a class are copies."""
    w = F.array_sort(F.array_distinct(words(F.lower("text"))))
    return e.select("id", "part", w.alias("w")).filter(F.size("w") > 0).withColumn("class", F.sha2(F.to_json(F.struct("part", "w")), 256))


def similar_sets(sets: DataFrame, least: float = 0.6) -> DataFrame:
    """(a, b, similarity), a < b: distinct word sets within a part whose Jaccard similarity exceeds ``least``.

    ``sets``: (no, part, w), ``no`` a name of any ordered type. Exact, without meeting all pairs: the words of a set are
    ordered, rare ones first, and two similar sets share one of the first words of either (how many follows from
    ``least``). A set is sent to those words and there compared with the others (``overlaps``), so pairs aren't shuffled. A
    pair that meets on several words is taken at the rarest it shares only. A word to which very many sets are sent is
    split into blocks. What travels is short: words are numbers of 64 bits, of 16 for the frequent ones.
    """
    if least <= 0:
        raise ValueError("sets that share nothing don't meet")
    sets = sets.filter("part is not null")
    words_of = sets.select("part", F.explode("w").alias("x"))
    total = sets.agg(F.sum(F.size("w"))).first()[0] or 0
    often = max(2, ceil(total / overlaps.FREQUENT))
    for seed in count():
        # a number belongs to one word of one part, or another seed is taken; ranks are numbers too
        number = partial(F.xxhash64, F.lit(seed), "part")
        counted = words_of.select(number("x").alias("h"), F.xxhash64("x", "part", F.lit(seed)).alias("o")).groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("o").alias("low"), F.max("o").alias("high"))
        clash = (F.col("low") != F.col("high")) | F.col("h").between(0, overlaps.FREQUENT)
        # no more than FREQUENT words are frequent
        known = counted.filter((F.col("df") >= often) | clash).select("h", "df", clash.alias("clash")).collect()
        if not any(r.clash for r in known):
            break
    known.sort(key=lambda r: r.h)
    frequent, df = np.array([r.h for r in known], np.int64), np.array([r.df for r in known], np.int64)
    rank = np.empty(len(df), np.int64)
    rank[np.lexsort((frequent, df))] = np.arange(len(df))
    kind = dict(sets.dtypes)["no"]
    numbered = sets.select("no", F.transform("w", lambda x: number(x)).alias("numbers"))
    schema = f"key long, no {kind}, n int, rare array<long>, often array<short>"
    keys = numbered.mapInArrow(lambda batches: overlaps.keyed(batches, least, frequent, rank), schema)
    # what a key costs grows faster than its sets, so there are more tasks than otherwise
    tasks = 4 * int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = block_pairs(keys, "key", "no", "n", overlaps.BLOCK).repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return met.mapInArrow(lambda batches: overlaps.similar(batches, least), f"a {kind}, b {kind}, similarity double")


def _stars(batches: Iterator[pa.RecordBatch], chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """(node, other) edges as stars: each node of a chunk with the smallest node that the chunk connects it to."""
    above: dict = {}
    read = 0

    def top(x):
        while (y := above.setdefault(x, x)) != x:
            above[x] = x = above[y]
        return x

    def stars(schema: pa.Schema) -> pa.RecordBatch:
        ends = [(x, t) for x in list(above) if (t := top(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in ends], schema.field(i).type) for i in range(2)], ["node", "other"])

    schema = None
    for batch in batches:
        schema = batch.schema
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            low, high = sorted((top(x), top(y)))
            above[high] = low
        read += batch.num_rows
        if read >= chunk:
            yield stars(schema)
            above.clear()
            read = 0
    if read:
        yield stars(schema)


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node of each connected group.

    First each task replaces the edges it reads, CHUNK at a time, by a star around the smallest node of each group that they
    connect: as many groups, by fewer edges and shorter ways. As long as that makes them fewer by a quarter at least, it is
    done again with the edges of several chunks together; up to IN_ONE edges are connected by one task, and that is all.
    Many rounds would cost the driver memory for each of their jobs. Edges that stay more go on: in each round every node takes the smallest label among
    its neighbours' and its own, then the label of its label, so long chains take a logarithmic number of rounds. Each round
    is written to the shared folder; only a count of changes reaches the driver. Minima are formed with partial results, so
    a node with very many edges is no bottleneck.
    """
    kind = dict(edges.dtypes)[a]
    stars = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).filter("node <> other").mapInArrow(_stars, f"node {kind}, other {kind}")
    stars, before = cut(stars), float("inf")
    while (n := stars.count()) <= 0.75 * before:
        parts, before, most = ceil(n / IN_ONE) or 1, n, IN_ONE
        stars = cut(stars.repartition(parts).mapInArrow(lambda batches: _stars(batches, 2 * most), f"node {kind}, other {kind}"))
        if parts == 1:
            roots = stars.select("other").distinct()
            return stars.withColumnRenamed("other", "component").unionByName(roots.select(F.col("other").alias("node"), F.col("other").alias("component")))
    both = cut(stars.unionByName(stars.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    labels = cut(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component")))
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("component", "near").alias("next"), F.col("component").alias("before"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        new = cut(lower.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("component"), "before"))
        moved = new.filter("component <> before").limit(1).count()
        labels = new.select("node", "component")
        if not moved:
            return labels
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def clusters(e: DataFrame, least: float = 0.6) -> DataFrame:
    """(id, cluster, n_links): episodes in groups of two or more, by word sets of ``text`` within a ``part``.

    Copies are linked through their class and not expanded into pairs; ``n_links`` counts the other classes that a
    class is similar to. The cluster is named by its smallest id.
    """
    named = cut(word_classes(e).select("id", "part", "class", "w"))
    # pairs are formed of numbers, which are shorter than digests
    sets = cut(named.groupBy("class").agg(F.first("part").alias("part"), F.first("w").alias("w")).withColumn("no", F.monotonically_increasing_id()))
    pairs = cut(similar_sets(sets.select("no", "part", "w"), least).select("a", "b"))
    groups = components(pairs).withColumnRenamed("node", "no")
    links = pairs.select(F.explode(F.array("a", "b")).alias("no")).groupBy("no").agg(F.count(F.lit(1)).alias("n_links"))
    linked = sets.select("class", "no").join(groups, "no", "left").join(links, "no", "left")
    members = named.select("id", "class").join(linked, "class")
    members = members.select("id", F.coalesce("component", "no").alias("g"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    sizes = members.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("cluster")).filter("n >= 2")
    return members.join(sizes, "g").select("id", "cluster", "n_links")


def _newest() -> Column:
    return F.struct((-F.coalesce(F.unix_micros("ended"), F.lit(0))).alias("t"), F.col("id").alias("id"))


def _placed(kind: str, c: Column) -> Column:
    return F.transform(c, lambda x, i: F.struct(F.lit(kind).alias("kind"), x.alias("x"), i.alias("i")))


def _entries(e: DataFrame, membership: DataFrame) -> DataFrame:
    """(cluster, kind, x, p): each distinct entry of a cluster with its first place, by partial minima over the cluster's rows."""
    messages = F.transform("errors", lambda x: F.coalesce(x["message"], F.lit("")))
    entries = F.flatten(F.array(_placed("tags", F.col("tags")), _placed("files", F.col("files")), _placed("errors", messages)))
    rows = e.join(membership.select("id", "cluster"), "id").select("cluster", _newest().alias("o"), F.explode(entries).alias("n"))
    return rows.groupBy("cluster", "n.kind", "n.x").agg(F.min(F.struct("o", "n.i")).alias("p"))


def consolidated_entries(e: DataFrame, membership: DataFrame) -> DataFrame:
    """(cluster, kind, entry, from_id, pos): the united tags, files and error messages of each cluster as rows, of any number.

    An entry comes from the newest episode that holds it (ties: the smaller id), at its first place there.
    """
    return _entries(e, membership).select("cluster", "kind", F.col("x").alias("entry"), F.col("p.o.id").alias("from_id"), F.col("p.i").alias("pos"))


def consolidated(e: DataFrame, membership: DataFrame) -> DataFrame:
    """One row for each cluster: its newest episode, with the tags, files and error messages of all united.

    ``membership``: (id, cluster). The newest comes first, then the others from new to old; an entry keeps its first
    place. This is the form for display: the lists of a cluster stand in one row, as an episode's do in its record;
    ``consolidated_entries`` gives them as rows. The counter of the base stays, helpful is the largest.
    """
    rows = e.join(membership.select("id", "cluster"), "id").withColumn("o", _newest())
    base = rows.groupBy("cluster").agg(F.min("o").alias("first"), F.max("helpful").alias("helpful"), F.count(F.lit(1)).alias("n_members"))
    kinds = ("tags", "files", "errors")
    lists = _entries(e, membership).groupBy("cluster").agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("p", "x")))).alias(k) for k in kinds])
    merged = base.join(lists, "cluster", "left")
    kept = e.select(F.col("id").alias("base_id"), "retrievals", "intent")
    return merged.join(kept, F.col("first.id") == F.col("base_id")).select(
        "cluster", "base_id", "intent", "n_members", *[F.coalesce(F.col(f"{k}.x"), F.array().cast("array<string>")).alias(k) for k in kinds], "retrievals", "helpful",
    )


def same_work(new: DataFrame, e: DataFrame, least: int = 3) -> DataFrame:
    """(new_id, id, shared): the newest stored episode of the same project and task type that has ``least`` tags in common.

    ``new``: (new_id, project, task_type, tags). Tags are matched on the pair of task type and tag, ignoring letter
    case, and counted before a pair of episodes is formed further.
    """
    tag = lambda: F.explode(F.array_distinct(F.transform("tags", F.lower)))
    n = new.select("new_id", F.lower("project").alias("p"), "task_type", tag().alias("tag"))
    s = e.select("id", "started", F.lower("project").alias("p"), "task_type", tag().alias("tag"))
    shared = n.join(s, ["p", "task_type", "tag"]).groupBy("new_id", "id", "started").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least)
    order = Window.partitionBy("new_id").orderBy(F.desc_nulls_last("started"), "id")
    return shared.withColumn("r", F.row_number().over(order)).filter("r = 1").select("new_id", "id", "shared")


def merged_captures(stored: DataFrame, new: DataFrame, match: DataFrame) -> DataFrame:
    """A snapshot of ``stored`` after the captures ``new`` came in: those in ``match`` refine an episode, others are added.

    ``stored``: slim rows; ``new``: the same with ``new_id`` for id; ``match``: (new_id, id), a capture once. The newest
    capture's text, task type, outcome and end hold. Tags and files are united, the stored ones first and then those of the
    captures by their start; errors are appended, repeats too. Counters and the learned utility stay. A null start is the
    earliest. The lists of one episode end in one row, as in the record itself.
    """
    own = stored.join(match.select("id").distinct(), "id", "left_semi")
    hits = new.join(match.select("new_id", "id"), "new_id")
    at = F.struct(F.lit(1).alias("late"), F.coalesce(F.unix_micros("started"), F.lit(-(1 << 62))).alias("t"), F.col("new_id").alias("n"))
    last = hits.groupBy("id").agg(F.max_by(F.struct("raw_prompt", "intent", "task_type", "status", "ended"), at).alias("last"))
    before = F.struct(F.lit(0).alias("late"), F.lit(0).cast("bigint").alias("t"), F.lit("").alias("n"))
    lists = ("tags", "files", "errors")
    rows = own.select("id", *lists, before.alias("o")).unionByName(hits.select("id", *lists, at.alias("o")))
    named = F.flatten(F.array(_placed("tags", F.col("tags")), _placed("files", F.col("files"))))
    single = rows.select("id", "o", F.explode(named).alias("e")).groupBy("id", "e.kind", "e.x").agg(F.min(F.struct("o", "e.i")).alias("p"))
    united = single.groupBy("id").agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("p", "x")))).alias(f"{k}_") for k in ("tags", "files")])
    errors = rows.select("id", "o", F.posexplode("errors").alias("i", "x")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("o", "i", "x"))).alias("errors_"))
    joined = stored.join(last, "id", "left").join(united, "id", "left").join(errors, "id", "left")
    found = F.col("last").isNotNull()
    taken = {c: F.when(found, F.col(f"last.{c}")).otherwise(F.col(c)) for c in ("raw_prompt", "intent", "task_type", "status", "ended")}
    taken |= {c: F.when(found & F.col(f"{c}_").isNotNull(), F.col(f"{c}_.x")).otherwise(F.col(c)) for c in lists}
    after = joined.select(*[taken[c].alias(c) if c in taken else F.col(c) for c in stored.columns])
    return after.unionByName(new.join(match.select("new_id"), "new_id", "left_anti").withColumnRenamed("new_id", "id"))
