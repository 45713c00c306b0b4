"""Ancestry in revision graphs given as edges (child, parent, ord): closures, orders, heads.

Histories are long and thin, so unary chains are contracted first, by pointer doubling in a
number of rounds that grows with the logarithm of the longest chain. What is left, the core
of merges and branches, is sent to all tasks as integer arrays if it has at most CORE edges;
each task then answers many tips at once by bit masks. A larger core is walked by rounds of
joins with durable tables between them, to the same results.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.plans.durable import durable, release
from palimpsest.plans.skew import salted_join, small_join

COMPACT = 8  # rounds after which the pieces of a growing or shrinking table are written anew
SMALL = 1_000_000  # frontier rows below which no key can overload a task
CORE = 2_000_000  # edges of a contracted core that are sent to all tasks: 32 MB
TIPS = 200_000  # tips whose names are sent to all tasks
BLOCK = 1024  # places of a chain that one task spells out for all tips


def clean_edges(edges: DataFrame) -> DataFrame:
    """(child, parent), each once, without nulls."""
    return edges.select("child", "parent").where("child IS NOT NULL AND parent IS NOT NULL").distinct()


def chains(edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Durable (node, chain, place) and (chain, up): unary chains and the edges between them.

    A node hangs on its parent's chain if it has no other parent and the parent no other
    child. ``chain`` is the chain's oldest node, ``place`` the number of links below it, so
    edges lead from a chain's oldest node to the youngest of another. Nodes on unary cycles
    are chains of their own.
    """
    e = durable(clean_edges(edges))
    here = e.select(F.col("child").alias("node")).unionAll(e.select(F.col("parent").alias("node")))
    if nodes is not None:
        here = here.unionAll(nodes.where("node IS NOT NULL").select("node"))
    single = lambda c: e.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(c)
    links = e.join(single("child"), "child", "left_semi").join(single("parent"), "parent", "left_semi")
    links = here.distinct().join(links.withColumnRenamed("child", "node"), "node", "left")
    member = chain_depths(links.select(F.col("node").alias("key"), "parent", F.lit(0).alias("size")))
    member = durable(member.select(F.col("key").alias("node"), F.coalesce("root", "key").alias("chain"), F.coalesce("depth", F.lit(0)).alias("place")))
    ends = member.select(F.col("node").alias("child"), F.col("chain"), "place")
    upper = member.select(F.col("node").alias("parent"), F.col("chain").alias("up"))
    ring = F.col("chain") != F.col("up")
    core = e.join(ends, "child").join(upper, "parent").where(ring | (F.col("place") == 0)).select("chain", "up").distinct()
    core = durable(core)
    release(e)
    return member, core


class Core:
    """A contracted graph as arrays: sorted 64-bit ids, and for each the ids it leads up to."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.ids = np.unique(np.concatenate([low, high]))
        a, b = np.searchsorted(self.ids, low), np.searchsorted(self.ids, high)
        order = np.argsort(a, kind="stable")
        self.up = b[order].astype(np.int32)
        self.start = np.searchsorted(a[order], np.arange(len(self.ids) + 1)).astype(np.int64)

    def at(self, ids: np.ndarray) -> np.ndarray:
        """Positions of ids; -1 where the graph lacks them."""
        if not len(self.ids):
            return np.full(len(ids), -1)
        i = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[i] == ids, i, -1)

    def edges_of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into nodes, parent) of all edges that leave the nodes."""
        n = self.start[nodes + 1] - self.start[nodes]
        src = np.repeat(np.arange(len(nodes)), n)
        return src, self.up[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[nodes], n)]

    def parts(self) -> np.ndarray:
        """A number for each node, the same for all of its component: the lowest position there."""
        low, high = np.repeat(np.arange(len(self.ids)), np.diff(self.start)), self.up
        part = np.arange(len(self.ids))
        while True:
            a, b = part[low], part[high]
            new = part.copy()
            np.minimum.at(new, a, b)
            np.minimum.at(new, b, a)
            while (new[new] != new).any():
                new = new[new]
            if (new == part).all():
                return part
            part = new

    def reach(self, tips: np.ndarray) -> np.ndarray:
        """Bit k of each node's mask: whether it lies above tip k (at most 64; the tip itself only by a cycle)."""
        mask = np.zeros(len(self.ids), np.uint64)
        step = np.zeros(len(self.ids), np.uint64)
        np.bitwise_or.at(step, tips[tips >= 0], np.uint64(1) << np.flatnonzero(tips >= 0).astype(np.uint64))
        now = np.unique(tips[tips >= 0])
        while len(now):
            src, up = self.edges_of(now)
            bits = step[now][src]
            step[now] = 0
            fresh = bits & ~mask[up]
            np.bitwise_or.at(step, up, fresh)
            now = np.unique(up[fresh != 0])
            mask[now] |= step[now]
        return mask


def _core(edges: DataFrame, most: int) -> tuple[Core | None, int]:
    """The core's arrays on the driver, or None if it has more than ``most`` edges."""
    n = edges.limit(most + 1).count()
    if n > most:
        return None, n
    t = edges.select(F.xxhash64("chain").alias("a"), F.xxhash64("up").alias("b")).toArrow()  # two integers an edge, at most ``most``
    return Core(*(t.column(c).to_numpy() for c in "ab")), n


def _answers(core: Core, spark, tips: DataFrame, out: str, make) -> DataFrame:
    """Runs ``make(core, ids of up to 64 tips)`` over the batches of (id, ...) rows."""
    held = spark.sparkContext.broadcast(core)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                yield from make(held.value, b.slice(lo, 64))

    return tips.mapInArrow(run, out)


def _ranked(core: Core, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(t, part): the component that each chain lies in; -1 where the core lacks the chain."""
    at = core.at(b.column(0).to_numpy())
    part = np.full(len(at), -1)
    part[at >= 0] = core.part[at[at >= 0]]
    yield pa.record_batch([b.column(0), pa.array(part)], ["t", "part"])


def _masks(core: Core, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(batch, a, block, mask): every block of the chains above the tips (batch, lane, t); bit ``lane`` tells whether it lies above that tip."""
    batch, lane, tips = (b.column(c).to_numpy() for c in range(3))
    for k in np.unique(batch):
        own = batch == k
        at = np.full(64, -1)
        at[lane[own]] = core.at(tips[own])
        mask = core.reach(at)
        hit = np.flatnonzero(mask)
        n = core.blocks[hit]
        block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = np.repeat(hit, n)
        yield pa.record_batch([pa.array(np.full(len(hit), k)), pa.array(core.ids[hit]), pa.array(block), pa.array(mask[hit].view(np.int64))], ["batch", "a", "block", "mask"])


def ancestors(edges: DataFrame, tips: DataFrame, core_limit: int = CORE) -> DataFrame:
    """(tip, node): every tip with itself and all that it descends from; repeated tips collapse.

    Parents without edges of their own (ghosts) are nodes; null tips are ignored. The result
    has a row for each pair, so its size is the sum of the tips' ancestries. Pairs come out
    once by construction. From a core of at most ``core_limit`` edges they are spelt out by
    the last step, from masks of 64 tips, and never shuffled; only above TIPS tips (chain,
    mask) rows meet the tips' names in one more shuffle.
    """
    spark = edges.sparkSession
    cores = spark.sparkContext.defaultParallelism
    asked = durable(tips.where("tip IS NOT NULL").select("tip").distinct())
    # names are replaced by numbers, which take a fraction of the disk in the rounds of contraction
    real = edges.where("child IS NOT NULL AND parent IS NOT NULL")
    every = real.select(F.col("child").alias("node")).unionAll(real.select(F.col("parent").alias("node"))).unionAll(asked.select(F.col("tip").alias("node")))
    names = durable(every.distinct().withColumn("id", F.monotonically_increasing_id())).hint("merge")  # its size is a guess from files: never broadcast
    ends = [names.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id")) for c in ("child", "parent")]
    numbers = real.select("child", "parent").join(ends[0], "child").join(ends[1], "parent").select(F.col("child_id").alias("child"), F.col("parent_id").alias("parent"))
    member, core = chains(numbers, names.select(F.col("id").alias("node")))
    member = member.withColumnRenamed("node", "id").join(names, "id").select("node", "chain", "place")
    placed = durable(asked.join(member.select(F.col("node").alias("tip"), "chain", "place"), "tip"))
    within = placed.join(member.withColumnRenamed("place", "p"), "chain").where("p <= place").select("tip", "node")
    graph, _ = _core(core, core_limit)
    # a cycle leads back into the tip's own chain, of which the younger nodes are left
    if graph is not None:
        graph.part = graph.parts()
        ids = placed.select(F.xxhash64("chain").alias("id")).distinct().repartition(cores)
        ranked = placed.withColumn("t", F.xxhash64("chain")).join(_answers(graph, spark, ids, "t bigint, part bigint", _ranked), "t")
        numbered = ranked.repartitionByRange(cores, "part", "t").sortWithinPartitions("part", "t").withColumn("i", F.monotonically_increasing_id())
        numbered = durable(numbered.select(F.shiftright("i", 6).alias("batch"), (F.col("i") % 64).alias("lane"), "tip", "t", "place"))
        graph.blocks = _blocks(graph, member)
        masks = _answers(graph, spark, numbered.select("batch", "lane", "t"), "batch bigint, a bigint, block bigint, mask bigint", _masks)
        n = max(3 * cores, int(spark.conf.get("spark.sql.shuffle.partitions")))  # given, for small tables become many pairs
        here = member.select("node", F.col("place").alias("p"), F.xxhash64("chain").alias("a"), F.expr(f"place div {BLOCK}").alias("block"))
        met = masks.repartition(n, "a", "block").join(here.repartition(n, "a", "block").hint("merge"), ["a", "block"])
        lanes = numbered.select("batch", F.expr("shiftleft(1L, CAST(lane AS INT))").alias("bit"), "tip", "t", "place")
        whole = small_join(met, lanes, ["batch"], ["node"], most=TIPS).where("(mask & bit) <> 0 AND (a <> t OR p > place)").select("tip", "node")
    else:
        far = _walked(core, placed.select("chain").distinct())
        whole = placed.join(far, "chain").join(member.select("node", F.col("place").alias("p"), F.col("chain").alias("up")), "up").where("chain <> up OR p > place").select("tip", "node")
    return within.unionByName(whole)


def _blocks(core: Core, member: DataFrame) -> np.ndarray:
    """The number of blocks of BLOCK places that each chain of the core takes; one row for BLOCK nodes at most reaches the driver."""
    n = np.ones(len(core.ids), np.int64)
    t = member.groupBy("chain").agg(F.expr(f"max(place) div {BLOCK} + 1").alias("n")).where("n > 1").select(F.xxhash64("chain").alias("id"), "n").toArrow()
    at = core.at(t.column("id").to_numpy())
    n[at[at >= 0]] = t.column("n").to_numpy()[at >= 0]
    return n


def _walked(core: DataFrame, starts: DataFrame) -> DataFrame:
    """(chain, up): all chains above each start, by rounds of joins."""
    step = core.select(F.col("chain").alias("at"), "up")
    frontier = durable(starts.join(core, "chain").select("chain", "up").distinct())
    seen, rounds, n = frontier, 0, frontier.count()
    while n:
        at = frontier.withColumnRenamed("up", "at")
        up = at.join(step, "at") if n < SMALL else salted_join(at, step, ["at"], ["chain"], "inner")
        frontier = durable(up.select("chain", "up").distinct().join(seen, ["chain", "up"], "left_anti"))
        rounds, n = rounds + 1, frontier.count()
        seen = seen.unionByName(frontier)
        if rounds % COMPACT == 0:
            seen = durable(seen)
    return seen


def ancestor_counts(edges: DataFrame, nodes: DataFrame, core_limit: int = CORE) -> DataFrame:
    """(node, n_ancestors): the number of nodes above each node, itself and ghosts included, for all nodes.

    Chains count as wholes: a node has what lies above its chain and the chain's part up to itself.
    """
    member, core = chains(edges, nodes)
    sizes = member.groupBy("chain").agg(F.count(F.lit(1)).alias("n"))
    graph, _ = _core(core, core_limit)
    if graph is None or sizes.limit(core_limit + 1).count() > core_limit:
        far = _walked(core, sizes.select("chain")).where("chain <> up")
        above = far.join(sizes.withColumnRenamed("chain", "up"), "up").groupBy("chain").agg(F.sum("n").alias("n_above"))
    else:
        got = sizes.select(F.xxhash64("chain").alias("id"), "n").toArrow()  # two integers a chain, at most core_limit
        weight = dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist()))
        w = np.array([weight.get(i, 0) for i in graph.ids.tolist()], np.int64)
        graph.weight = w

        def totals(core: Core, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            tips = b.column(0).to_numpy()
            at = core.at(tips)
            mask = core.reach(at)
            total = []
            for k in range(len(tips)):
                hit = (mask >> np.uint64(k)) & np.uint64(1) == 1
                if at[k] >= 0:
                    hit[at[k]] = False
                total.append(int(core.weight[hit].sum()))
            yield pa.record_batch([pa.array(tips), pa.array(total, pa.int64())], ["t", "n_above"])

        spark = edges.sparkSession
        ids = sizes.select(F.xxhash64("chain").alias("id")).repartition(spark.sparkContext.defaultParallelism)
        above = sizes.withColumn("t", F.xxhash64("chain")).join(_answers(graph, spark, ids, "t bigint, n_above bigint", totals), "t").select("chain", "n_above")
    out = member.join(above, "chain", "left").select("node", (F.col("place") + 1 + F.coalesce("n_above", F.lit(0))).alias("n_ancestors"))
    return out.join(nodes.select("node").distinct(), "node", "left_semi")


def missing_ancestors(edges: DataFrame, nodes: DataFrame, tips: DataFrame) -> DataFrame:
    """Ancestors that no node row exists for, each once."""
    return ancestors(edges, tips).select("node").distinct().join(nodes.select("node"), "node", "left_anti")


def levels(edges: DataFrame, nodes: DataFrame, core_limit: int = CORE) -> DataFrame:
    """(node, level): longest way from a root; parents outside the nodes are ignored.

    Chains are settled as wholes: a chain's oldest node lies one above the highest of the
    nodes it leads to, its members follow by place. Nodes on or below cycles never settle and
    get a null level. Null nodes are ignored.
    """
    real = durable(nodes.where("node IS NOT NULL").select("node").distinct())
    inner = clean_edges(edges).join(real.withColumnRenamed("node", "parent"), "parent", "left_semi").join(real.withColumnRenamed("node", "child"), "child", "left_semi")
    member, core = chains(inner, real)
    length = member.groupBy("chain").agg((F.max("place") + 1).cast("bigint").alias("n"))
    if core.limit(core_limit + 1).count() <= core_limit and length.limit(core_limit + 1).count() <= core_limit:
        rows = length.select(F.lit(0).alias("g"), F.xxhash64("chain").alias("a"), F.lit(None).cast("bigint").alias("b"), "n")
        rows = rows.unionAll(core.select(F.lit(0).alias("g"), F.xxhash64("chain").alias("a"), F.xxhash64("up").alias("b"), F.lit(0).cast("bigint").alias("n")))
        settled = rows.groupBy("g").applyInArrow(_settled, "t bigint, base bigint")  # one task: at most 2 * core_limit rows of integers
        base = length.select("chain", F.xxhash64("chain").alias("t")).join(settled, "t").select("chain", "base")
    else:
        base = _settled_rounds(core, length)
    return member.join(base, "chain", "left").select("node", (F.col("base") + F.col("place")).cast("int").alias("level"))


def _settled(t: pa.Table) -> pa.Table:
    """Level of each chain's oldest node; chains on or below cycles are left out."""
    head = t.column("b").is_null().to_numpy()
    a, b, n = (t.column(c).fill_null(0).to_numpy() for c in ("a", "b", "n"))
    ids, size = a[head], n[head]
    order = np.argsort(ids)
    ids, size = ids[order], size[order]
    low, high = (np.searchsorted(ids, x[~head]) for x in (a, b))
    down = np.argsort(high, kind="stable")
    start, child = np.searchsorted(high[down], np.arange(len(ids) + 1)), low[down]
    waits, base = np.bincount(low, minlength=len(ids)), np.zeros(len(ids), np.int64)
    done, now = np.zeros(len(ids), bool), np.flatnonzero(waits == 0)
    while len(now):
        done[now] = True
        k = start[now + 1] - start[now]
        src = np.repeat(now, k)
        to = child[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(start[now], k)]
        np.maximum.at(base, to, base[src] + size[src])
        np.subtract.at(waits, to, 1)
        to = np.unique(to)
        now = to[waits[to] == 0]
    return pa.table({"t": ids[done], "base": base[done]})


def _settled_rounds(core: DataFrame, length: DataFrame) -> DataFrame:
    """``_settled`` by rounds of joins: each settles the chains that wait for no other any more."""
    waits = core.groupBy("chain").agg(F.count(F.lit(1)).alias("waits"))
    rest = durable(length.join(waits, "chain", "left").select("chain", "n", F.coalesce("waits", F.lit(0)).alias("waits"), F.lit(0).cast("bigint").alias("base")))
    done, k = rest.where("waits = 0").select("chain", "base"), 0
    while not (ready := rest.where("waits = 0")).isEmpty():
        k += 1
        met = core.join(ready.select(F.col("chain").alias("up"), (F.col("base") + F.col("n")).alias("top")), "up").groupBy("chain").agg(F.count(F.lit(1)).alias("met"), F.max("top").alias("top"))
        rest = durable(rest.where("waits > 0").join(met, "chain", "left").select("chain", "n", (F.col("waits") - F.coalesce("met", F.lit(0))).alias("waits"), F.greatest("base", "top").alias("base")))
        done = done.unionByName(rest.where("waits = 0").select("chain", "base"))
        if k % COMPACT == 0:
            done = durable(done)
    return done


def topological(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level): ordered by level, then node, every node follows its parents; no sort is forced on the caller."""
    return levels(edges, nodes)


def heads(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that are no other node's ancestor: in a closed set, those that are no parent."""
    inside = edges.join(nodes.select(F.col("node").alias("child")), "child", "left_semi")
    return nodes.select("node").distinct().join(inside.select(F.col("parent").alias("node")), "node", "left_anti")


def _heads_of_both(core: Core, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Common chains of each pair that no other common chain leads up to; a pair shares a mask's bits."""
    x, y = (core.at(b.column(k).to_numpy()) for k in (0, 1))
    one = np.uint64(1)

    def closed(tips):
        mask = core.reach(tips)
        own = tips >= 0
        np.bitwise_or.at(mask, tips[own], one << np.flatnonzero(own).astype(np.uint64))
        return mask

    both = closed(x) & closed(y)
    nodes = np.flatnonzero(both)
    src, up = core.edges_of(nodes)
    covered = np.zeros(len(core.ids), np.uint64)
    np.bitwise_or.at(covered, up, both[nodes][src])
    top = both & ~covered
    for k in range(len(x)):
        hit = core.ids[(top >> np.uint64(k)) & one == 1]
        yield pa.record_batch([pa.array(np.full(len(hit), b.column(0)[k].as_py())), pa.array(np.full(len(hit), b.column(1)[k].as_py())), pa.array(hit)], ["x", "y", "top"])


def common_ancestors(edges: DataFrame, pairs: DataFrame, core_limit: int = CORE) -> DataFrame:
    """(a, b, lca): for each pair the common ancestors that are above no other common ancestor.

    A node counts among its own ancestors; pairs without a common one give no row. The graph
    must be acyclic. Ancestries are compared chain by chain: inside a common chain the older
    of the two entries is meant, which is the youngest node unless one of the pair lies there.
    """
    spark = edges.sparkSession
    want = pairs.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct()
    tips = want.select(F.col("a").alias("node")).unionAll(want.select(F.col("b").alias("node")))
    member, core = chains(edges, tips)
    placed = want.join(member.select(F.col("node").alias("a"), F.col("chain").alias("ca"), F.col("place").alias("pa")), "a")
    placed = durable(placed.join(member.select(F.col("node").alias("b"), F.col("chain").alias("cb"), F.col("place").alias("pb")), "b"))
    length = member.groupBy("chain").agg(F.max("place").alias("youngest"))
    graph, n = _core(core, core_limit)
    if graph is not None:
        # chains without any edge are unknown to the core; a loop makes them known without leading anywhere
        lone = placed.select(F.col("ca").alias("chain")).unionAll(placed.select(F.col("cb").alias("chain"))).distinct()
        ids = placed.select(F.xxhash64("ca").alias("x"), F.xxhash64("cb").alias("y")).distinct().repartition(spark.sparkContext.defaultParallelism)
        tops = _answers(graph, spark, ids, "x bigint, y bigint, top bigint", _heads_of_both)
        got = placed.withColumn("x", F.xxhash64("ca")).withColumn("y", F.xxhash64("cb")).join(tops, ["x", "y"]).join(length.withColumn("top", F.xxhash64("chain")), "top").drop("x", "y", "top")
        same = placed.where("ca = cb").join(lone.join(core.select("chain").unionAll(core.select(F.col("up").alias("chain"))), "chain", "left_anti").withColumnRenamed("chain", "ca"), "ca").join(length, F.col("chain") == F.col("ca"))
        got = got.select("a", "b", "ca", "pa", "cb", "pb", "chain", "youngest").unionByName(same.select("a", "b", "ca", "pa", "cb", "pb", "chain", "youngest"))
    else:
        starts = placed.select(F.col("ca").alias("chain")).unionAll(placed.select(F.col("cb").alias("chain"))).distinct()
        far = durable(_walked(core, starts).unionByName(starts.select("chain", F.col("chain").alias("up"))).distinct())
        both = durable(placed.join(far.select(F.col("chain").alias("ca"), "up"), "ca").join(far.select(F.col("chain").alias("cb"), "up"), ["cb", "up"]))
        over = both.select("a", "b", F.col("up").alias("chain")).join(core, "chain").select("a", "b", "up")
        got = both.join(over, ["a", "b", "up"], "left_anti").withColumnRenamed("up", "chain").join(length, "chain")
    at = F.least(F.when(F.col("chain") == F.col("ca"), F.col("pa")), F.when(F.col("chain") == F.col("cb"), F.col("pb")), F.col("youngest"))
    found = got.select("a", "b", "chain", at.alias("place"))
    return found.join(member, ["chain", "place"]).select("a", "b", F.col("node").alias("lca")).distinct()


def unique_ancestors(edges: DataFrame, tip, base) -> DataFrame:
    """Ancestors of one tip that are none of the base's."""
    spark = edges.sparkSession
    kind = edges.schema["child"].dataType.simpleString()
    up = ancestors(edges, spark.createDataFrame([(tip,), (base,)], f"tip {kind}"))
    return up.where(F.col("tip") == tip).select("node").join(up.where(F.col("tip") == base).select("node"), "node", "left_anti")


def pruned(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """What is left when nodes without parents inside the set are removed again and again: the cyclic core and below."""
    return levels(edges, nodes).where("level IS NULL").select("node")


def chain_depths(links: DataFrame) -> DataFrame:
    """(key, root, depth, total): for rows (key, parent, size) in chains, by pointer doubling.

    ``total`` adds the sizes from the key to its root. A parent without row ends the chain;
    rounds grow with the logarithm of the longest chain. Keys that a cycle keeps from any
    root have a null root, depth and total.
    """
    known = links.select(F.col("key").alias("parent"), F.lit(1).alias("known"))
    t = links.join(known, "parent", "left").select("key", F.when(F.col("known").isNotNull(), F.col("parent")).alias("up"), F.col("size").cast("double").alias("total"), F.col("key").alias("root"), F.lit(0).alias("depth"))
    t = durable(t.select("key", "up", "total", F.when(F.col("up").isNull(), F.col("key")).alias("root"), F.when(F.col("up").isNotNull(), 1).otherwise(0).alias("depth")))
    settled = -1
    for _ in range(48):  # chains of up to 2**48 links; what is left then runs in a cycle
        # total covers key..just below up; jumping over up adds up's own stretch
        u = t.select(F.col("key").alias("up"), F.col("up").alias("up2"), F.col("total").alias("t2"), F.col("root").alias("r2"), F.col("depth").alias("d2"))
        n = t.join(u, "up", "left").select(
            "key", F.when(F.col("up").isNotNull(), F.col("up2")).alias("up"),
            (F.col("total") + F.when(F.col("up").isNotNull(), F.col("t2")).otherwise(0.0)).alias("total"), F.coalesce("root", "r2").alias("root"),
            F.when(F.col("up").isNull(), F.col("depth")).otherwise(F.col("depth") + F.col("d2")).alias("depth"),
        )
        old, t = t, durable(n)
        release(old)
        if t.where("up IS NOT NULL").isEmpty():
            break
        if t.join(t.where("up IS NULL").select(F.col("key").alias("up")), "up", "left_semi").isEmpty() and t.where("up IS NULL OR root IS NOT NULL").count() == settled:
            break
        settled = t.where("up IS NULL OR root IS NOT NULL").count()
    ends = F.col("up").isNull()
    return t.select("key", F.when(ends, F.col("root")).alias("root"), F.when(ends, F.col("depth")).alias("depth"), F.when(ends, F.col("total")).alias("total"))


def storage_decision(chain: DataFrame, max_chain: int = 200) -> DataFrame:
    """Whether a text is kept as delta: its chain is short enough and smaller than its full text.

    ``chain`` has key, depth, total (delta sizes down to the full text) and full_size.
    """
    delta = (F.col("depth") <= max_chain) & (F.col("full_size") > F.col("total"))
    return chain.withColumn("as_delta", delta)


def recursive_common_ancestor(edges: DataFrame, a, b, most: int = 64) -> list:
    """Common ancestors of a and b, then of those, until one is left: the layers from first to last.

    The driver sees only the ancestors of each layer, at most ``most``; more raise an error.
    """
    spark, kind = edges.sparkSession, edges.schema["child"].dataType.simpleString()
    layers, pair = [], [a, b]
    while len(pair) > 1:
        pairs = [(x, y) for i, x in enumerate(pair) for y in pair[i + 1 :]]
        found = common_ancestors(edges, spark.createDataFrame(pairs, f"a {kind}, b {kind}")).select("lca").distinct().limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"more than {most} common ancestors")
        nxt = sorted(r["lca"] for r in found)
        if not nxt or nxt == sorted(pair):
            return [*layers, nxt] if nxt else layers
        layers.append(nxt)
        pair = nxt
    return layers


def snapshot_places(chain: DataFrame, interval: int) -> DataFrame:
    """Which keys of chains (key, root, depth) to store whole so that no chain is longer than ``interval``."""
    return chain.withColumn("whole", (F.col("depth") % interval) == 0)


def by_ancestors(parents: dict[str, list[str]], interval: int) -> list[str]:
    """Versions to store whole so that none is built from more than ``interval`` others.

    Walked parents first, each version counts the versions it would be built from, back to
    the last whole ones; one that exceeds the interval is stored whole and starts afresh.
    """
    waits = {v: sum(p in parents for p in {*ps}) for v, ps in parents.items()}
    children: dict[str, list[str]] = {}
    for v, ps in parents.items():
        for p in {*ps} & parents.keys():
            children.setdefault(p, []).append(v)
    ready, built, whole = sorted(v for v, n in waits.items() if not n), {}, []
    while ready:
        v = ready.pop()
        own = {*parents[v]} & parents.keys()
        need = own.union(*(built[p] for p in own))
        if not own or len(need) > interval:
            whole.append(v)
            need = set()
        built[v] = need
        for c in children.get(v, ()):
            waits[c] -= 1
            if not waits[c]:
                ready.append(c)
    return sorted(whole)


def build_ranking(parents: dict[str, list[str]], whole: set[str]) -> list[str]:
    """Versions by how much storing them whole would spare, the most first; ties by name.

    A version's worth is the number of versions it would no longer be built from times that
    of the versions built from it; each choice takes both out of what is left.
    """
    order, seen = [], set()
    for v in sorted(parents):
        stack = [v]
        while stack:
            x = stack[-1]
            todo = [p for p in parents[x] if p in parents and p not in seen]
            if x in seen or not todo:
                stack.pop()
                if x not in seen:
                    seen.add(x)
                    order.append(x)
            else:
                stack.extend(todo)
    avoids: dict[str, set[str]] = {}
    for v in order:
        own = [p for p in parents[v] if p in parents]
        avoids[v] = set() if v in whole else set(own).union(*(avoids[p] for p in own))
    users = {v: {u for u in order if v in avoids[u]} for v in order}
    out, left = [], set(order)
    while left:
        best = max(sorted(left, reverse=True), key=lambda v: len(avoids[v]) * len(users[v]))
        left.remove(best)
        out.append(best)
        spared, by = avoids[best].copy(), users[best].copy()
        for u in by:
            avoids[u] -= spared
        for v in spared:
            users[v] -= by
    return out


def snapshot_selection(edges: DataFrame, nodes: DataFrame, by: str, interval: int) -> DataFrame:
    """(by, node): versions of each file's graph to store whole, by the number of versions they are built from.

    ``nodes`` has (by, node), ``edges`` (by, child, parent); a task holds the graph of one file.
    """
    rows = nodes.select(by, F.col("node").alias("child"), F.lit(None).cast("string").alias("parent")).unionByName(edges.select(by, "child", "parent"))

    def run(key, pdf):
        parents: dict[str, list[str]] = {}
        for c, p in zip(pdf["child"], pdf["parent"]):
            parents.setdefault(c, [])
            if p is not None and p == p:
                parents[c].append(p)
        got = by_ancestors(parents, interval)
        return pd.DataFrame({by: [key[0]] * len(got), "node": got})

    return rows.groupBy(by).applyInPandas(run, f"{by} {nodes.schema[by].dataType.simpleString()}, node string")


def size_ranking(sizes: DataFrame) -> DataFrame:
    """Keys by what storing them as a delta saves: full_size - delta_size, largest first, ties by key."""
    return sizes.select("key", (F.col("full_size") - F.col("delta_size")).alias("saved")).orderBy(F.col("saved").desc(), "key")


def compression_order(edges: DataFrame, nodes: DataFrame, prefix: str) -> DataFrame:
    """Nodes by prefix, and inside a prefix children before parents: (prefix, node, place)."""
    lv = levels(edges, nodes).join(nodes.select("node", prefix).distinct(), "node")
    w = W.partitionBy(prefix).orderBy(F.col("level").desc(), "node")
    return lv.select(prefix, "node", F.row_number().over(w).alias("place"))


def union_weaves(a: DataFrame, b: DataFrame) -> DataFrame:
    """(version, parents, sha1) of two stores: parents are united, different texts raise when read."""
    both = a.select("version", "parents", "sha1").unionByName(b.select("version", "parents", "sha1"))
    one = both.groupBy("version").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("parents")))).alias("parents"), F.min("sha1").alias("lo"), F.max("sha1").alias("hi"))
    return one.select("version", "parents", F.when(F.col("lo") != F.col("hi"), F.raise_error(F.lit("texts differ"))).otherwise(F.col("lo")).alias("sha1"))
