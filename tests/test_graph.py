import random

import pytest

from palimpsest.operators import graph


def dag(rng, n, ghosts=3):
    """Long chains with branches, merges and ghost parents; n0 is a root."""
    edges = []
    for i in range(1, n):
        first = i - 1 if rng.random() < 0.8 else rng.randrange(i)
        edges.append((f"n{i}", f"n{first}"))
        if rng.random() < 0.15:
            edges.append((f"n{i}", rng.choice([f"n{rng.randrange(i)}", f"ghost{rng.randrange(ghosts)}"])))
    return edges


def above(edges):
    up = {}
    for c, p in edges:
        up.setdefault(c, set()).add(p)

    def walk(x):
        seen, todo = {x}, [x]
        while todo:
            for p in up.get(todo.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        return seen

    return walk, up


@pytest.fixture(scope="module")
def case(spark):
    edges = dag(random.Random(8), 70)
    rows = [(c, p, 0) for c, p in edges] + [(*edges[3], 1), (None, "n1", 0), ("n2", None, 0)]
    return edges, spark.createDataFrame(rows, "child string, parent string, ord int")


@pytest.mark.parametrize("core_limit", [10**6, 0])
def test_ancestors(spark, case, core_limit):
    edges, df = case
    walk, _ = above(edges)
    tips = ["n69", "n40", "n41", "ghost0", "unknown", "n0", None, "n69"]
    got = [tuple(r) for r in graph.ancestors(df, spark.createDataFrame([(t,) for t in tips], "tip string"), core_limit).collect()]
    assert len(got) == len(set(got)) and set(got) == {(t, x) for t in tips if t for x in walk(t)}


@pytest.mark.parametrize("core_limit", [10**6, 0])
def test_counts_and_levels(spark, case, core_limit):
    edges, df = case
    walk, up = above(edges)
    names = sorted({x for e in edges for x in e})
    nodes = spark.createDataFrame([(x,) for x in [*names, "lone", None]], "node string")
    got = {r.node: r.n_ancestors for r in graph.ancestor_counts(df, nodes, core_limit).collect()}
    assert got == {x: len(walk(x)) for x in [*names, "lone"]}

    def level(x):
        return max((level(p) + 1 for p in up.get(x, ())), default=0)

    assert {r.node: r.level for r in graph.levels(df, nodes, core_limit).collect()} == {x: level(x) for x in [*names, "lone"]}


@pytest.mark.parametrize("core_limit", [10**6, 0])
def test_common_ancestors(spark, case, core_limit):
    edges, df = case
    walk, up = above(edges)
    rng = random.Random(2)
    pairs = [(f"n{rng.randrange(70)}", f"n{rng.randrange(70)}") for _ in range(25)] + [("n69", "ghost0"), ("n5", "n5"), ("x", "y"), ("x", "x"), (None, "n1")]
    got = {tuple(r) for r in graph.common_ancestors(df, spark.createDataFrame(pairs, "a string, b string"), core_limit).collect()}
    want = set()
    for a, b in pairs:
        if a and b:
            both = walk(a) & walk(b)
            want |= {(a, b, x) for x in both if not any(x in up.get(y, ()) for y in both)}
    assert got == want


@pytest.mark.parametrize("core_limit", [10**6, 0])
def test_cycles(spark, core_limit):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "d"), ("s", "s"), ("t", "s"), ("r", "q")], "child string, parent string")
    nodes = spark.createDataFrame([(x,) for x in "abcdestrq"], "node string")
    assert {r.node: r.level for r in graph.levels(e, nodes, core_limit).collect()} == {**dict.fromkeys("abcdest"), "q": 0, "r": 1}
    got = {tuple(r) for r in graph.ancestors(e, spark.createDataFrame([("e",), ("b",), ("t",)], "tip string"), core_limit).collect()}
    assert got == {("e", x) for x in "edabc"} | {("b", x) for x in "abc"} | {("t", "t"), ("t", "s")}
    none = e.limit(0)
    assert graph.levels(none, nodes.limit(0), core_limit).count() == 0 and graph.ancestors(none, nodes.limit(0).withColumnRenamed("node", "tip"), core_limit).count() == 0


def test_rounds_on_a_chain(spark, monkeypatch):
    """A chain of 100 000 nodes takes rounds in proportion to the logarithm of its length."""
    calls = []
    monkeypatch.setattr(graph, "durable", lambda df, durable=graph.durable: (calls.append(1), durable(df))[1])
    from pyspark.sql import functions as F

    e = spark.range(1, 100_000).select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent"))
    lv = graph.levels(e, spark.range(100_000).withColumnRenamed("id", "node"))
    assert lv.where("level = node").count() == 100_000 and len(calls) < 30


@pytest.mark.parametrize("small", [10**6, 0])
def test_ancestors_in_batches_and_blocks(spark, monkeypatch, small):
    """More tips than a mask has bits, chains of several blocks, two components and a cycle, with and without broadcast names."""
    monkeypatch.setattr(graph, "BLOCK", 2)
    monkeypatch.setattr(graph, "TIPS", small)
    one = dag(random.Random(3), 150)
    edges = one + [(f"x{c}", f"x{p}") for c, p in one] + [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("d", "c1"), ("n0", "g9"), ("g9", "g8"), ("g8", "g7")]
    walk, _ = above(edges)
    tips = sorted({x for e in edges for x in e})
    df = spark.createDataFrame(edges, "child string, parent string")
    got = [tuple(r) for r in graph.ancestors(df, spark.createDataFrame([(t,) for t in tips], "tip string")).collect()]
    assert len(tips) > 256 and len(got) == len(set(got)) and set(got) == {(t, x) for t in tips for x in walk(t)}


def test_pairs_are_not_shuffled(spark):
    """Rows written to shuffles follow the graph, not the pairs of tips and ancestors."""
    edges = [(f"n{i}", f"n{i - k}") for i in range(1, 2000) for k in (1, 2) if i >= k] + [(f"t{i}", f"n{1999 - i % 50}") for i in range(300)]
    df = spark.createDataFrame(edges, "child string, parent string").localCheckpoint()
    tips = spark.createDataFrame([(f"t{i}",) for i in range(300)], "tip string")

    def written():
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        none = sc._jvm.java.util.ArrayList()
        stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    last = max(written())
    pairs = graph.ancestors(df, tips)
    pairs.write.format("noop").mode("overwrite").save()
    shuffled = sum(k for i, k in written().items() if i > last)
    n = pairs.count()
    assert n == sum(2000 - i % 50 + 1 for i in range(300)) and 0 < shuffled < n / 2
