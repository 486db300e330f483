import random

from lumora.operators import duplicates


def brute(texts, least):
    sets = [(i, p, frozenset(t.lower().split())) for i, p, t in texts]
    return {(a[0], b[0]) for a in sets for b in sets if a[0] < b[0] and a[1] == b[1] and a[2] and b[2] and len(a[2] & b[2]) > least * len(a[2] | b[2])}


def groups(pairs, ids):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_clusters_equal_brute_force(spark):
    rng = random.Random(5)
    # few words, so that short sets, sets of three to five words and hot words all come up
    texts = [(f"{i:03}", rng.choice("ab"), " ".join(rng.choice(["the", "of", *"abcdefgh"]) for _ in range(rng.randrange(0, 9)))) for i in range(250)]
    # sets about the length from which they meet in another way
    base = [[f"w{i}{j}" for j in range(24)] for i in range(6)]
    texts += [(f"l{i:03}", "a", " ".join(rng.sample(rng.choice(base), rng.randrange(11, 25)) + rng.sample("abcd", 2))) for i in range(150)]
    texts += [(f"x{i:02}", "a", "the same words again") for i in range(60)]
    for least in (0.6, 0.8):
        got = {r.id: r.cluster for r in duplicates.clusters(spark.createDataFrame(texts, "id string, part string, text string"), least).collect()}
        label = groups(brute(texts, least), [i for i, _, _ in texts])
        sizes = {}
        for g in label.values():
            sizes[g] = sizes.get(g, 0) + 1
        assert got == {i: g for i, g in label.items() if sizes[g] > 1}


def test_long_chain_is_one_component(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in duplicates.components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 500: 500, 501: 500}


def test_empty(spark):
    none = spark.createDataFrame([], "id string, part string, text string")
    assert duplicates.clusters(none).collect() == []
    assert duplicates.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_consolidation_keeps_order_and_newest(spark):
    e = spark.createDataFrame(
        [("old", 4, ["y", "z"], ["f"], 1, 4), ("new", 9, ["x", "y"], [], 7, 1)], "id string, t int, tags array<string>, files array<string>, retrievals bigint, helpful bigint"
    ).selectExpr("*", "timestamp_seconds(t) AS ended", "'' AS intent", "cast(array() AS array<struct<error_type:string,message:string,resolved:boolean,resolution:string>>) AS errors")
    got = duplicates.consolidated(e, spark.createDataFrame([("old", "c"), ("new", "c")], "id string, cluster string")).collect()
    assert [(r.base_id, r.tags, r.files, r.errors, r.retrievals, r.helpful) for r in got] == [("new", ["x", "y", "z"], ["f"], [], 7, 4)]


def test_same_work_needs_common_tags(spark):
    schema = "new_id string, project string, task_type string, tags array<string>"
    new = spark.createDataFrame([("n", "P", "docs", ["A", "b", "c", "c"]), ("m", "P", "test", ["a", "b", "c"])], schema)
    stored = spark.createDataFrame([("s", "p", "docs", ["a", "B", "c"]), ("t", "p", "docs", ["a", "b"])], "id string, project string, task_type string, tags array<string>").selectExpr("*", "timestamp_seconds(1) AS started")
    assert [tuple(r) for r in duplicates.same_work(new, stored).collect()] == [("n", "s", 3)]


def test_components_by_chunks_and_by_rounds(spark, monkeypatch):
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)]
    want = {i: g for i, g in groups(edges, range(600)).items() if any(i in e and e[0] != e[1] for e in edges)}
    df = spark.createDataFrame(edges, "a long, b long")
    jobs = {}
    for most in (500_000, 90, 4):
        monkeypatch.setattr(duplicates, "IN_ONE", most)
        spark.sparkContext.setJobGroup(f"components {most}", "")
        assert {r.node: r.component for r in duplicates.components(df).collect()} == want
        jobs[most] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components {most}"))
    # few edges take no rounds
    assert jobs[500_000] <= 10 < jobs[4]


def test_a_pair_comes_once_though_it_meets_often(spark):
    sets = [(i, "a", [f"w{j}" for j in range(n)] + [f"own{i}"] * extra) for i, (n, extra) in enumerate([(3, 1), (4, 0), (4, 1), (9, 1), (10, 0), (19, 0), (20, 0), (21, 1), (26, 1)])]
    got = [(r.a, r.b, round(r.similarity, 6)) for r in duplicates.similar_sets(spark.createDataFrame(sets, "no long, part string, w array<string>")).collect()]
    share = lambda x, y: len({*x} & {*y}) / len({*x} | {*y})
    assert sorted(got) == [(a, b, round(s, 6)) for a, _, x in sets for b, _, y in sets if a < b and (s := share(x, y)) > 0.6]


def shuffled(spark, run):
    """Bytes that the stages of ``run`` write for others to read."""
    context = spark.sparkContext._jsc.sc()

    def stages():
        context.listenerBus().waitUntilEmpty(30_000)
        every = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return {every.apply(i).stageId(): every.apply(i).shuffleWriteBytes() for i in range(every.size())}

    before = stages()
    run()
    return sum(n for k, n in stages().items() if k not in before)


def test_sets_are_sent_to_few_words(spark):
    rng = random.Random(3)
    topics = [[f"topic{i}{j}" for j in range(3)] for i in range(20)]
    rows = [(f"{i:036}", "a", [f"m{i % 1500}", f"v{i}", *rng.choice(topics), "find", "out", "why", "in", "the"]) for i in range(3000)]
    sets = spark.createDataFrame(rows, "no string, part string, w array<string>")
    got = []
    sent = shuffled(spark, lambda: got.extend(duplicates.similar_sets(sets).collect()))
    assert len(got) == len({(r.a, r.b) for r in got}) > 100_000
    # the name, the words and a key four times, and little more
    assert sent < 700 * len(rows)


def test_similar_sets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(duplicates.overlaps, "BLOCK", 150)
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(12)]
    texts = {(p, frozenset(rng.sample(pool, rng.randrange(1, 9)))) for p in "ab" for _ in range(150)}
    rows = [(i, p, sorted(w)) for i, (p, w) in enumerate(sorted(texts, key=lambda x: (x[0], sorted(x[1]))))] + [(9999, None, ["w1"]), (9998, None, ["w1", "w2"])]
    got = [(r.a, r.b, r.similarity) for r in duplicates.similar_sets(spark.createDataFrame(rows, "no long, part string, w array<string>"), 0.5).collect()]
    share = lambda x, y: len({*x} & {*y}) / len({*x} | {*y})
    assert sorted(got) == [(a, b, share(x, y)) for a, p, x in rows for b, q, y in rows if a < b and p and p == q and share(x, y) > 0.5]
