"""Parent-child links to full hierarchies by tree contraction.

Rounds alternately rake leaves into their parents and compress unary chains (an
independent set, chosen by coin) until only roots and self loops remain; every removal is
recorded. Undoing the records in reverse gives root, depth, path and descendants. A core
that never empties is a cycle. Snapshots of up to LIMIT rows are contracted in numpy, many
at a time; larger ones are contracted by DataFrame joins until at most LIMIT live nodes
are left, and that core is finished in numpy.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.plans.durable import durable, release

LIMIT = 400_000  # rows of one snapshot that a single task contracts
CHUNK = 60_000  # rows gathered before whole snapshots are contracted together
OK, ON_CYCLE, BELOW_CYCLE, DETACHED = range(4)
STATES = ["ok", "on_cycle", "below_cycle", "detached"]


@dataclass
class Contraction:
    parent: np.ndarray
    acc: np.ndarray  # rows below and at the node that reached it so far
    extra: np.ndarray  # rows to add to what the node hands to its parent
    log: list = field(default_factory=list)  # (nodes, their parents then, only children or None, the children's extra then)
    core: np.ndarray = None

    def run(self) -> "Contraction":
        p, acc, extra = self.parent.copy(), self.acc, self.extra
        live = np.flatnonzero(p >= 0)
        kids = np.bincount(p[live], minlength=len(p))
        only = np.zeros(len(p), np.int64)
        coin = np.zeros(len(p), bool)
        rng = np.random.default_rng(1)
        while len(live) and (p[live] != live).any():
            raked = kids[live] == 0
            leaf = live[raked]
            if len(leaf):
                up = p[leaf]
                self.log.append((leaf, up, None, None))
                np.add.at(acc, up, acc[leaf] + extra[leaf])
                np.subtract.at(kids, up, 1)
                live = live[~raked]
            only[p[live]] = live
            coin[live] = (kids[live] == 1) & (p[live] != live) & (rng.random(len(live)) < 0.5)
            cut = coin[live] & ~coin[p[live]]
            v = live[cut]
            coin[live] = False
            if len(v):
                c, up = only[v], p[v]
                self.log.append((v, up, c, extra[c]))
                extra[c] += acc[v] + extra[v]
                p[c] = up
                live = live[~cut]
        self.core = live
        return self

    def sums(self, weight: np.ndarray) -> np.ndarray:
        """For each node the sum of weights on the way up to its root or core node."""
        w = weight.copy()
        for v, _, c, _ in self.log:
            if c is not None:
                w[c] += w[v]
        out = np.zeros_like(w)
        for v, up, _, _ in reversed(self.log):
            out[v] = out[up] + w[v]
        return out

    def paths(self, label: list[str], top: list[str]) -> list[str]:
        seg, out = list(label), list(top)
        for v, _, c, _ in self.log:
            if c is not None:
                for a, b in zip(v.tolist(), c.tolist()):
                    seg[b] = f"{seg[a]}/{seg[b]}"
        for v, up, _, _ in reversed(self.log):
            for a, b in zip(v.tolist(), up.tolist()):
                out[a] = f"{out[b]}/{seg[a]}"
        return out

    def expand(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """root, rows at and below, whether the node lies on a cycle."""
        root, total, on = np.arange(len(self.parent)), self.acc.copy(), np.zeros(len(self.parent), bool)
        on[self.core] = True
        for v, up, c, extra in reversed(self.log):
            root[v] = root[up]
            if c is not None:
                total[v] = self.acc[v] + total[c] + extra
                on[v] = on[c]
        return root, total, on


def preorder(parent: np.ndarray, total: np.ndarray, done: Contraction, order: np.ndarray) -> np.ndarray:
    """Place of each node in a depth-first walk of its tree; siblings come in ``order``."""
    i = np.lexsort((order, parent))
    before = np.cumsum(total[i]) - total[i]
    first = np.r_[True, parent[i][1:] != parent[i][:-1]] if len(i) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))
    off = np.zeros(len(parent), np.int64)
    off[i] = before - before[start] + 1
    return done.sums(off)


def _link(node: np.ndarray, up: np.ndarray, has_up: np.ndarray, is_head: np.ndarray, name: pa.ChunkedArray | None = None):
    """Distinct nodes: row of each, parent position or -1, root flag.

    Of rows that disagree, the one of least parent hash counts (no parent before any), then
    of least name (null before any).
    """
    order = np.lexsort((up, has_up, is_head, node))
    ids = node[order]
    keep = np.r_[True, ids[1:] != ids[:-1]] if len(ids) else np.zeros(0, bool)
    pick, run = order[keep], np.cumsum(keep) - 1
    if name is not None and not keep.all():
        first = pick[run]
        tied = ~keep & (up[order] == up[first]) & (has_up[order] == has_up[first]) & (is_head[order] == is_head[first])
        rank = lambda i: ((x := name[int(i)].as_py()) is not None, x or "")
        for k in np.flatnonzero(tied).tolist():
            if rank(order[k]) < rank(pick[run[k]]):
                pick[run[k]] = order[k]
    ids = ids[keep]
    roots = np.unique(node[is_head])
    root = np.isin(ids, roots)
    at = np.searchsorted(ids, up[pick])
    at[at == len(ids)] = 0
    known = has_up[pick] & ~is_head[pick] & ~root & (len(ids) > 0)
    if len(ids):
        known &= ids[at] == up[pick]
    return pick, np.where(known, at, -1), root


def _states(done: Contraction, root: np.ndarray, on: np.ndarray, is_root: np.ndarray) -> np.ndarray:
    core = np.zeros(len(root), bool)
    core[done.core] = True
    return np.where(on, ON_CYCLE, np.where(core[root], BELOW_CYCLE, np.where(is_root[root], OK, DETACHED)))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole snapshots, at least CHUNK rows each; the input is sorted by snapshot."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= CHUNK:
            t = pa.Table.from_batches(held)
            s = t.column("tree").to_numpy()
            cut = int(np.searchsorted(s, s[-1]))
            if cut:
                yield t.slice(0, cut)
                held, rows = t.slice(cut).to_batches(), t.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def _solve(t: pa.Table, full: bool) -> pa.Table:
    node, up = t.column("node").to_numpy(), t.column("up").to_numpy()
    has_up, is_head = t.column("has_up").to_numpy(), t.column("is_head").to_numpy()
    pick, parent, is_root = _link(node, up, has_up, is_head, t.column("name") if full else None)
    done = Contraction(parent, np.ones(len(parent), np.int64), np.zeros(len(parent), np.int64)).run()
    root, total, on = done.expand()
    state = _states(done, root, on, is_root)
    names = np.array(STATES, object)
    entry = ~is_head[pick]
    if not full:
        case = np.flatnonzero(entry & (state != OK))
        got = t.select(["snapshot", "file_id"]).take(pa.array(pick[case]))
        return pa.table({"snapshot": got.column(0), "file_id": got.column(1), "state": pa.array(names[state[case]], pa.string())})
    label = [x or "" for x in t.column("name").take(pa.array(pick)).to_pylist()]
    ids = t.column("file_id").take(pa.array(pick)).to_pylist()
    place = np.empty(len(pick), np.int64)
    place[pc.sort_indices(t.column("file_id").take(pa.array(pick))).to_numpy()] = np.arange(len(pick))
    depth, pre = done.sums(np.ones(len(parent), np.int64)), preorder(parent, total, done, place)
    top = ["" if r else x for r, x in zip(is_root, label)]
    path = done.paths(label, top)
    cyclic = (state == ON_CYCLE) | (state == BELOW_CYCLE)
    case = np.flatnonzero(entry)
    null = cyclic[case]
    masked = lambda a: pa.array(a[case], pa.int64(), mask=null)
    root_ids = pa.array([ids[r] for r in root[case].tolist()], pa.string())
    return pa.table({
        "snapshot": t.column("snapshot").take(pa.array(pick[case])),
        "file_id": t.column("file_id").take(pa.array(pick[case])),
        "state": pa.array(names[state[case]], pa.string()),
        "root": pa.array(np.where(null, None, np.array(root_ids.to_pylist(), object)), pa.string()),
        "depth": masked(depth),
        "path": pa.array([None if z else (path[i] or "/") for i, z in zip(case.tolist(), null.tolist())], pa.string()),
        "n_descendants": pa.array(total[case] - 1, pa.int64(), mask=state[case] == ON_CYCLE),
        "first_place": masked(pre),
    })


_FOUND = "snapshot string, file_id string, state string"
_FULL = _FOUND + ", root string, depth bigint, path string, n_descendants bigint, first_place bigint"


def _rows(entry: DataFrame, inventory: DataFrame, full: bool) -> DataFrame:
    name = [F.col("name")] if full else []
    nodes = entry.where("snapshot IS NOT NULL AND file_id IS NOT NULL").select("snapshot", "file_id", "parent_id", *name, F.lit(False).alias("is_head"))
    none = [F.lit(None).cast("string").alias("name")] if full else []
    heads = inventory.where("snapshot IS NOT NULL AND root_id IS NOT NULL").select("snapshot", F.col("root_id").alias("file_id"), F.lit(None).cast("string").alias("parent_id"), *none, F.lit(True).alias("is_head")).distinct()
    return nodes.unionAll(heads)


def _small(rows: DataFrame, full: bool) -> DataFrame:
    placed = rows.repartition("snapshot").withColumn("tree", F.xxhash64("snapshot")).sortWithinPartitions("tree")
    keyed = placed.select(
        "snapshot", "file_id", *(["name"] if full else []), "is_head", "tree",
        F.xxhash64("snapshot", "file_id").alias("node"), F.xxhash64("snapshot", F.coalesce("parent_id", F.lit(""))).alias("up"), F.col("parent_id").isNotNull().alias("has_up"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches):
            yield from _solve(t, full).to_batches(max_chunksize=32768)

    return keyed.mapInArrow(run, _FULL if full else _FOUND)


def hierarchy(entry: DataFrame, inventory: DataFrame, full: bool = True, limit: int = LIMIT) -> DataFrame:
    """One row per entry: state, and with ``full`` root, depth, path, n_descendants, first_place.

    state: ok (leads to the snapshot's root_id), on_cycle, below_cycle, or detached (ends at
    another entry without parent or at an id without entry). Paths join names by ``/`` below
    the root, which is ``/``; null names count as empty. Descendants of a node are the rows
    of its snapshot and root whose first_place lies in the n_descendants places after its own;
    siblings come by file_id.
    root, depth, path and first_place are null on and below cycles, n_descendants on cycles.
    Rows without snapshot or file_id are ignored, repeated rows count once (of those that
    disagree the one of least parent hash, then of least name), a snapshot without head has no ok entries. Without ``full`` only entries that are not ok are returned.
    """
    rows = _rows(entry, inventory, full)
    big = rows.groupBy("snapshot").count().where(F.col("count") > limit).select("snapshot")
    if big.isEmpty():
        return _small(rows, full)
    big = durable(big)
    return _small(rows.join(big, "snapshot", "left_anti"), full).unionByName(_large(rows.join(big, "snapshot", "left_semi"), full, limit))


def _core(pdf: pd.DataFrame) -> pd.DataFrame:
    """Finishes the live core of one large snapshot; parents that are no longer live are ends."""
    ids = pdf["v"].to_numpy(object)
    place = {x: i for i, x in enumerate(ids)}
    parent = np.array([-1 if z else place[x] for x, z in zip(pdf["p"], pdf["end"])], np.int64)
    done = Contraction(parent, pdf["acc"].to_numpy(np.int64).copy(), pdf["extra"].to_numpy(np.int64).copy()).run()
    root, total, on = done.expand()
    state = _states(done, root, on, pdf["is_root"].to_numpy(bool))
    seg = pdf["seg"].tolist()
    top = ["" if r else s for r, s in zip(pdf["is_root"], seg)]
    return pd.DataFrame({
        "s": pdf["s"], "v": ids, "r": ids[root], "depth": done.sums(np.where(pdf["end"], 0, pdf["w"]).astype(np.int64)),
        "path": done.paths(seg, top), "total": total, "state": state.astype(np.int32),
    })


def _places(first: DataFrame, done: DataFrame) -> DataFrame:
    """first_place as ``preorder`` gives it: rows below earlier siblings plus one, summed on the way up by pointer doubling."""
    t = first.select("s", "v", "p", "end").join(done.where(~F.col("state").isin(ON_CYCLE, BELOW_CYCLE)).select("s", "v", "total"), ["s", "v"])
    earlier = W.partitionBy("s", "p").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    inner = t.where("NOT end").select("s", "v", F.col("p").alias("up"), (F.coalesce(F.sum("total").over(earlier), F.lit(0)) + 1).alias("place"))
    ends = t.where("end").select("s", "v", F.lit(None).cast("string").alias("up"), F.lit(0).cast("bigint").alias("place"))
    t = durable(ends.unionByName(inner))
    while not t.where("up IS NOT NULL").isEmpty():
        u = t.select("s", F.col("v").alias("up"), F.col("up").alias("up2"), F.col("place").alias("place2"))
        on = t.where("up IS NOT NULL").join(u, ["s", "up"]).select("s", "v", F.col("up2").alias("up"), (F.col("place") + F.col("place2")).alias("place"))
        t = durable(t.where("up IS NULL").unionByName(on))
    return t.select("s", "v", "place")


def _large(rows: DataFrame, full: bool, limit: int) -> DataFrame:
    name = F.col("name") if full else F.lit("")
    row = F.struct(F.col("parent_id").isNotNull(), F.xxhash64("snapshot", F.coalesce("parent_id", F.lit(""))), name.alias("seg"), F.col("parent_id").alias("p"))
    heads = rows.where("is_head").select(F.col("snapshot").alias("s"), F.col("file_id").alias("v")).distinct().withColumn("is_root", F.lit(True))
    nodes = rows.where("NOT is_head").groupBy(F.col("snapshot").alias("s"), F.col("file_id").alias("v")).agg(F.min(row).alias("r")).select("s", "v", "r.p", "r.seg")
    nodes = nodes.join(heads, ["s", "v"], "full").withColumn("is_root", F.coalesce("is_root", F.lit(False)))
    known = nodes.select("s", F.col("v").alias("p"), F.lit(True).alias("known"))
    first = durable(nodes.join(known, ["s", "p"], "left").select(
        "s", "v", "p", F.coalesce("seg", F.lit("")).alias("seg"), "is_root", (F.col("is_root") | F.col("known").isNull()).alias("end"),
        F.lit(1).cast("bigint").alias("w"), F.lit(1).cast("bigint").alias("acc"), F.lit(0).cast("bigint").alias("extra"),
    ))
    # a live node is a leaf, finished, a candidate, or has a live child: cycles alone have one child each and shrink to self loops
    live, log, ended, k = first, [], [], 0
    while (live.groupBy("s").count().agg(F.max("count")).first()[0] or 0) > limit:
        k += 1
        coin = lambda v: F.pmod(F.xxhash64("s", v, F.lit(k)), F.lit(2)) == 1
        kids = live.where("NOT end").groupBy("s", F.col("p").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        seen = durable(live.join(kids, ["s", "v"], "left").withColumn("n", F.coalesce("n", F.lit(0))))
        leaf = F.expr("NOT end AND n = 0")
        log.append(durable(seen.where(leaf).select("s", "v", "p", "w", "seg", "acc", F.lit(None).cast("string").alias("c"), F.lit(None).cast("bigint").alias("was"))))
        gain = seen.where(leaf).groupBy("s", F.col("p").alias("v")).agg(F.sum(F.col("acc") + F.col("extra")).alias("gain"), F.count(F.lit(1)).alias("lost"))
        left = seen.where(~leaf).join(gain, ["s", "v"], "left").withColumn("acc", F.col("acc") + F.coalesce("gain", F.lit(0))).withColumn("n", F.col("n") - F.coalesce("lost", F.lit(0)))
        left = durable(left.drop("gain", "lost"))
        over = F.expr("end AND n = 0 OR NOT end AND p = v AND n = 1")
        state = F.when(~F.col("end"), ON_CYCLE).when(F.col("is_root"), OK).otherwise(DETACHED)
        top = F.when(F.col("is_root"), "").otherwise(F.col("seg"))
        ended.append(durable(left.where(over).select("s", "v", F.col("v").alias("r"), F.lit(0).cast("bigint").alias("depth"), top.alias("path"), F.col("acc").alias("total"), state.alias("state"))))
        left = durable(left.where(~over).withColumn("cand", ~F.col("end") & (F.col("n") == 1) & (F.col("p") != F.col("v")) & coin("v")))
        blocked = left.where("cand").select("s", F.col("v").alias("p"), F.lit(True).alias("up_cand"))
        cut = durable(left.where("cand").join(blocked, ["s", "p"], "left").where("up_cand IS NULL").select("s", "v", F.col("p").alias("p2"), F.col("w").alias("w2"), F.col("seg").alias("seg2"), F.col("acc").alias("acc2"), F.col("extra").alias("extra2")))
        kept = left.join(cut.select("s", "v"), ["s", "v"], "left_anti").drop("n", "cand")
        moved = durable(kept.join(cut.withColumnRenamed("v", "p"), ["s", "p"], "left"))
        log.append(durable(moved.where("p2 IS NOT NULL AND NOT end").select("s", F.col("p").alias("v"), F.col("p2").alias("p"), F.col("w2").alias("w"), F.col("seg2").alias("seg"), F.col("acc2").alias("acc"), F.col("v").alias("c"), F.col("extra").alias("was"))))
        hit = F.expr("p2 IS NOT NULL AND NOT end")
        live = durable(moved.select(
            "s", "v", F.when(hit, F.col("p2")).otherwise(F.col("p")).alias("p"),
            F.when(hit, F.concat("seg2", F.lit("/"), "seg")).otherwise(F.col("seg")).alias("seg"), "is_root", "end",
            F.when(hit, F.col("w") + F.col("w2")).otherwise(F.col("w")).alias("w"), "acc",
            F.when(hit, F.col("extra") + F.col("acc2") + F.col("extra2")).otherwise(F.col("extra")).alias("extra"),
        ))
    done = durable(live.groupBy("s").applyInPandas(_core, "s string, v string, r string, depth bigint, path string, total bigint, state int"))
    for part in ended:
        done = done.unionByName(part)
    for step in reversed(log):
        up = done.select("s", F.col("v").alias("p"), "r", F.col("depth").alias("d0"), F.col("path").alias("path0"), F.col("state").alias("s0"))
        below = done.select("s", F.col("v").alias("c"), F.col("total").alias("t1"), F.col("state").alias("s1"))
        back = step.join(up, ["s", "p"]).join(below, ["s", "c"], "left")
        state = F.when(F.col("s0") == ON_CYCLE, F.when(F.col("s1") == ON_CYCLE, ON_CYCLE).otherwise(BELOW_CYCLE)).otherwise(F.col("s0"))
        back = back.select("s", "v", "r", (F.col("d0") + F.col("w")).alias("depth"), F.concat("path0", F.lit("/"), "seg").alias("path"), (F.col("acc") + F.coalesce(F.col("t1") + F.col("was"), F.lit(0))).alias("total"), state.alias("state"))
        done = durable(done.unionByName(back))
    entries = rows.where("NOT is_head").select(F.col("snapshot").alias("s"), F.col("file_id").alias("v")).distinct()
    out = done.join(entries, ["s", "v"], "left_semi")
    named = F.element_at(F.array(*map(F.lit, STATES)), F.col("state") + 1).alias("state")
    if not full:
        return out.where(F.col("state") != OK).select(F.col("s").alias("snapshot"), F.col("v").alias("file_id"), named)
    out = out.join(_places(first, done), ["s", "v"], "left")
    acyclic = ~F.col("state").isin(ON_CYCLE, BELOW_CYCLE)
    return out.select(
        F.col("s").alias("snapshot"), F.col("v").alias("file_id"), named, F.when(acyclic, F.col("r")).alias("root"), F.when(acyclic, F.col("depth")).alias("depth"),
        F.when(acyclic, F.when(F.col("path") == "", "/").otherwise(F.col("path"))).alias("path"), F.when(F.col("state") != ON_CYCLE, F.col("total") - 1).alias("n_descendants"),
        F.col("place").alias("first_place"),
    )


def ancestor_ids(entry: DataFrame, inventory: DataFrame) -> DataFrame:
    """(snapshot, file_id, ancestors): ids from the parent up to the root or end, for entries not on or below cycles.

    Pointer doubling: each round a list takes on that of its last id, so rounds grow with the
    logarithm of the depth. The lists' sizes are the depths.
    """
    acyclic = hierarchy(entry, inventory).where("state IN ('ok', 'detached')").select(F.col("snapshot").alias("s"), F.col("file_id").alias("v"), F.col("depth"))
    row = F.struct(F.col("parent_id").isNotNull(), F.xxhash64("snapshot", F.coalesce("parent_id", F.lit(""))), F.col("parent_id").alias("p"))
    e = entry.where("snapshot IS NOT NULL AND file_id IS NOT NULL").groupBy(F.col("snapshot").alias("s"), F.col("file_id").alias("v")).agg(F.min(row).alias("r"))
    t = e.join(acyclic, ["s", "v"]).select("s", "v", F.when(F.col("depth") > 0, F.col("r.p")).alias("up"))
    t = durable(t.select("s", "v", "up", F.when(F.col("up").isNull(), F.array().cast("array<string>")).otherwise(F.array("up")).alias("ids")))
    while not t.where("up IS NOT NULL").isEmpty():
        u = t.select("s", F.col("v").alias("up"), F.col("up").alias("up2"), F.col("ids").alias("ids2"))
        # a root id without entry has no list of its own
        step = t.where("up IS NOT NULL").join(u, ["s", "up"], "left").select("s", "v", F.col("up2").alias("up"), F.concat("ids", F.coalesce("ids2", F.array().cast("array<string>"))).alias("ids"))
        old, t = t, durable(t.where("up IS NULL").unionByName(step))
        release(old)
    return t.select(F.col("s").alias("snapshot"), F.col("v").alias("file_id"), F.col("ids").alias("ancestors"))


def descendants(entry: DataFrame, inventory: DataFrame) -> DataFrame:
    """Pairs (snapshot, file_id, descendant) of entries: every ancestor of each entry that is not on or below a cycle.

    The size is the sum of all depths; ``hierarchy`` gives the same as intervals of places.
    """
    pairs = ancestor_ids(entry, inventory).select("snapshot", F.explode("ancestors").alias("file_id"), F.col("file_id").alias("descendant"))
    return pairs.join(entry.select("snapshot", "file_id"), ["snapshot", "file_id"], "left_semi")
