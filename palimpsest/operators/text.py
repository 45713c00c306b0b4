"""Texts as lines: scans, deltas, matching blocks, multi-parent diffs, annotation, weave and merge plans.

Whole-table scans are expressions. Line matching is sequential and runs in Arrow batches,
one pair of texts a row, so nothing is collected beyond one row.
"""

import hashlib
from bisect import bisect_left
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import scalars

BLOCKS = "array<struct<a:int,b:int,n:int>>"
PLAN = "array<struct<state:string,line:string>>"


def line_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, line) of every line; the last gets a line feed if it lacks one."""
    rows = docs.select(key, F.posexplode(scalars.lines(F.col(text))).alias("pos", "line"))
    return rows.withColumn("line", F.when(F.col("line").endswith("\n"), F.col("line")).otherwise(F.concat("line", F.lit("\n"))))


def line_stats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    parts = scalars.lines(F.col(text))
    return docs.select(key, F.coalesce(F.size(parts), F.lit(0)).alias("n_lines"), F.sha1(F.coalesce(F.col(text), F.lit(""))).alias("sha1"), F.coalesce(F.octet_length(text), F.lit(0)).alias("n_bytes"), F.coalesce((F.length(text) > 0) & ~F.col(text).endswith("\n"), F.lit(False)).alias("no_eol"))


def shared_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """line hash, documents and occurrences of each distinct line: the basis of line matching."""
    return line_scan(docs, key, text).groupBy(F.sha1("line").alias("line_sha1")).agg(F.count_distinct(key).alias("n_docs"), F.count(F.lit(1)).alias("n"))


def by_content(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Deduplicated store: the content key of each distinct text, its first holder and number of holders."""
    t = docs.where(F.col(text).isNotNull())
    return t.groupBy(scalars.content_key(F.col(text)).alias("content_key")).agg(F.min(key).alias("first_key"), F.count(F.lit(1)).alias("n_keys"), F.max(F.octet_length(text)).alias("n_bytes"))


def apply_line_delta(base: Column, hunks: Column) -> Column:
    """A line delta (start, end, lines) applied to an array of lines, without leaving the JVM."""
    zero = F.struct(F.lit(0).alias("off"), base.alias("l"))

    def step(acc, h):
        grown = F.size(h["lines"]) - (h["end"] - h["start"])
        head = F.slice(acc["l"], F.lit(1), h["start"] + acc["off"])
        tail = F.slice(acc["l"], h["end"] + acc["off"] + 1, F.size(acc["l"]))
        return F.struct((acc["off"] + grown).alias("off"), F.concat(head, h["lines"], tail).alias("l"))

    return F.aggregate(hunks, zero, step)["l"]


def matching_blocks(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """Runs of equal lines by patience: lines unique on both sides fix the frame, gaps are filled by recursion."""
    out: list[tuple[int, int, int]] = []

    def emit(i: int, j: int, n: int) -> None:
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + n)
        elif n:
            out.append((i, j, n))

    stack = [(0, len(a), 0, len(b), None)]
    while stack:
        a0, a1, b0, b1, match = stack.pop()
        if match is not None:
            emit(*match)
            continue
        head = 0
        while a0 + head < a1 and b0 + head < b1 and a[a0 + head] == b[b0 + head]:
            head += 1
        if head:
            emit(a0, b0, head)
            a0, b0 = a0 + head, b0 + head
        tail = 0
        while a0 < a1 - tail and b0 < b1 - tail and a[a1 - tail - 1] == b[b1 - tail - 1]:
            tail += 1
        a1, b1 = a1 - tail, b1 - tail
        todo = [(a1, a1 + tail, b1, b1 + tail, (a1, b1, tail))] if tail else []
        frame = _unique_chain(a, a0, a1, b, b0, b1)
        if frame:
            parts, pa, pb = [], a0, b0
            for i, j in frame:
                parts += [(pa, i, pb, j, None), (0, 0, 0, 0, (i, j, 1))]
                pa, pb = i + 1, j + 1
            todo = [*parts, (pa, a1, pb, b1, None), *todo]
        stack.extend(reversed(todo))
    return out


def _unique_chain(a, a0, a1, b, b0, b1) -> list[tuple[int, int]]:
    """Longest increasing chain of lines that occur once on each side."""
    seen: dict[str, int] = {}
    for i in range(a0, a1):
        seen[a[i]] = -1 if a[i] in seen else i
    places: dict[str, int] = {}
    for j in range(b0, b1):
        if seen.get(b[j], -1) >= 0:
            places[b[j]] = -1 if b[j] in places else j
    pairs = sorted((j, seen[x]) for x, j in places.items() if j >= 0)
    tops: list[int] = []
    piles: list[tuple[int, int, object]] = []
    for j, i in pairs:
        k = bisect_left(tops, i)
        node = (i, j, piles[k - 1] if k else None)
        if k == len(tops):
            tops.append(i)
            piles.append(node)
        else:
            tops[k], piles[k] = i, node
    out, node = [], piles[-1] if piles else None
    while node:
        out.append((node[0], node[1]))
        node = node[2]
    return out[::-1]


def line_delta(a: list[str], b: list[str]) -> list[tuple[int, int, list[str]]]:
    out, pa, pb = [], 0, 0
    for i, j, n in [*matching_blocks(a, b), (len(a), len(b), 0)]:
        if i > pa or j > pb:
            out.append((pa, i, b[pb:j]))
        pa, pb = i + n, j + n
    return out


def line_delta_column(a: Column, b: Column) -> Column:
    @F.pandas_udf("array<struct<start:int,end:int,lines:array<string>>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else [{"start": s, "end": e, "lines": x} for s, e, x in line_delta(list(p), list(q))] for p, q in zip(a, b)])

    return run(a, b)


def multi_parent_diff(parents: list[list[str]], lines: list[str]) -> list[tuple]:
    """('new', lines) and ('parent', number, parent_pos, child_pos, n) hunks; the longest run wins, ties the lowest parent."""
    blocks = [matching_blocks(p, lines) for p in parents]
    out, new, at = [], [], 0
    while at < len(lines):
        best = (0, 0, 0)
        for k, bs in enumerate(blocks):
            for i, j, n in bs:
                if j <= at < j + n and j + n - at > best[0]:
                    best = (j + n - at, k, i + at - j)
        if best[0]:
            if new:
                out.append(("new", new))
                new = []
            out.append(("parent", best[1], best[2], at, best[0]))
            at += best[0]
        else:
            new.append(lines[at])
            at += 1
    return [*out, ("new", new)] if new else out


def apply_multi_parent(parents: list[list[str]], hunks: list[tuple]) -> list[str]:
    out: list[str] = []
    for h in hunks:
        out += h[1] if h[0] == "new" else parents[h[1]][h[2] : h[2] + h[4]]
    return out


def annotate(versions: list[tuple[str, list[str], list[str]]]) -> dict[str, list[tuple[str, ...]]]:
    """Origins of each line for versions (id, parent ids, lines) given parents first.

    The first parent's origins are copied over matching lines; a later parent replaces
    origins that are still the version's own, and where both differ the sorted union stands.
    """
    texts = {v: lines for v, _, lines in versions}
    known: dict[str, list[tuple[str, ...]]] = {}
    for v, parents, lines in versions:
        own = [(v,)] * len(lines)
        for k, p in enumerate(x for x in parents if x in known):
            for i, j, n in matching_blocks(texts[p], lines):
                for d in range(n):
                    theirs = known[p][i + d]
                    if k == 0 or own[j + d] == (v,):
                        own[j + d] = theirs
                    elif own[j + d] != theirs:
                        own[j + d] = tuple(sorted({*own[j + d], *theirs}))
        known[v] = own
    return known


def merge_plan(base: list[str], a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """(state, line) of a three-way merge: unchanged, killed-a, killed-b, killed-both, new-a, new-b."""
    in_a = {i + d: j + d for i, j, n in matching_blocks(base, a) for d in range(n)}
    in_b = {i + d: j + d for i, j, n in matching_blocks(base, b) for d in range(n)}
    out, pa, pb = [], 0, 0
    for i, line in enumerate(base):
        ja, jb = in_a.get(i), in_b.get(i)
        if ja is not None:
            out += [("new-a", x) for x in a[pa:ja]]
            pa = ja + 1
        if jb is not None:
            out += [("new-b", x) for x in b[pb:jb]]
            pb = jb + 1
        out.append(("unchanged" if ja is not None and jb is not None else "killed-b" if ja is not None else "killed-a" if jb is not None else "killed-both", line))
    return [*out, *(("new-a", x) for x in a[pa:]), *(("new-b", x) for x in b[pb:])]


def plan_base(plan: list[tuple[str, str]]) -> list[str]:
    return [x for s, x in plan if s in ("unchanged", "killed-a", "killed-b", "killed-both")]


#: fixed values: for each state of a plan line, whether a's text holds it, b's text holds it, a changed there, b changed there
SIDES = {
    "unchanged": (1, 1, 0, 0), "killed-a": (0, 1, 1, 0), "killed-b": (1, 0, 0, 1), "killed-both": (0, 0, 1, 1), "new-a": (1, 0, 1, 0), "new-b": (0, 1, 0, 1),
    "conflicted-a": (1, 0, 1, 1), "conflicted-b": (0, 1, 1, 1),
}


def merged_segments(plan: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, segment, a, b, lines, conflict): plan lines (key, pos, state, line) cut at the lines that both sides keep.

    A segment is one kept line or all lines between two kept ones. Its result is a's text if
    only a changed it or both agree, b's if only b did; else lines is null and conflict true.
    Lines of other states belong to neither side. Segments without any line are left out.
    """
    side = F.create_map(*[x for k, v in SIDES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    order = W.partitionBy(key).orderBy("pos")
    kept = (F.col("state") == "unchanged").cast("int")
    # every kept line takes an odd number, the lines between two kept ones the even number between
    numbered = plan.withColumn("segment", 2 * F.sum(kept).over(order) - kept).withColumn("s", F.coalesce(F.try_element_at(side, F.col("state")), F.array(*[F.lit(0)] * 4)))
    text_of = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("s")[k] == 1, F.struct("pos", "line")))), lambda x: x["line"])
    seg = numbered.groupBy(key, "segment").agg(text_of(0).alias("a"), text_of(1).alias("b"), F.max(F.col("s")[2]).alias("ca"), F.max(F.col("s")[3]).alias("cb"))
    one = F.when(F.col("cb") == 0, F.col("a")).when((F.col("ca") == 0) | (F.col("a") == F.col("b")), F.col("b"))
    return seg.withColumn("lines", one).select(key, "segment", "a", "b", "lines", F.col("lines").isNull().alias("conflict")).where("size(a) + size(b) > 0")


def merged_texts(plan: DataFrame, key: str = "doc_id", a: str = "<<<<<<< \n", mid: str = "=======\n", b: str = ">>>>>>> \n") -> DataFrame:
    """(key, text, n_conflicts) of each plan: segments in order, conflicts between markers."""
    marked = F.concat(F.array(F.lit(a)), F.col("a"), F.array(F.lit(mid)), F.col("b"), F.array(F.lit(b)))
    seg = merged_segments(plan, key).select(key, "segment", F.when(F.col("conflict"), marked).otherwise(F.col("lines")).alias("out"), F.col("conflict").cast("int").alias("c"))
    whole = F.array_sort(F.collect_list(F.struct("segment", "out")))
    return seg.groupBy(key).agg(F.array_join(F.flatten(F.transform(whole, lambda x: x["out"])), "").alias("text"), F.sum("c").alias("n_conflicts"))


def plan_groups(plan: list[tuple[str, str]]) -> list[tuple[list[str], ...]]:
    """The segments of one short plan: (lines,), or (a lines, b lines) for a conflict."""
    out = []
    number = accumulate((s == "unchanged" for s, _ in plan), initial=0)
    for _, part in groupby(zip(number, plan), key=lambda x: (x[0], x[1][0] == "unchanged")):
        rows = [(SIDES.get(state, (0, 0, 0, 0)), line) for _, (state, line) in part]
        texts = [[line for s, line in rows if s[k]] for k in (0, 1)]
        changed = {k for k in (0, 1) for s, _ in rows if s[2 + k]}
        merged = texts[:1] if changed <= {0} or texts[0] == texts[1] else texts[1:] if changed == {1} else texts
        if any(merged):
            out.append(tuple(merged))
    return out


#: fixed values: what becomes of a plan's lines about b that another plan with another b has too; None drops a line
CANCELLED = {"new-b": None, "killed-b": "unchanged"}


def plan_difference(plan: list[tuple[str, str]], other: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """A merge plan without the changes of b that ``other`` makes too; both plans have the same a."""
    shared = {j + d for _, j, n in matching_blocks(other, plan) for d in range(n)}
    states = ((CANCELLED.get(s, s) if k in shared else s, x) for k, (s, x) in enumerate(plan))
    return [(s, x) for s, x in states if s is not None]


def two_way_plan(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """(state, line) of a merge without a base: lines of both are unchanged, all others conflict."""
    out, pa, pb = [], 0, 0
    for i, j, n in [*matching_blocks(a, b), (len(a), len(b), 0)]:
        out += [("conflicted-a", x) for x in a[pa:i]] + [("conflicted-b", x) for x in b[pb:j]] + [("unchanged", x) for x in a[i : i + n]]
        pa, pb = i + n, j + n
    return out


def two_way_column(a: Column, b: Column) -> Column:
    @F.pandas_udf(PLAN)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"state": s, "line": x} for s, x in two_way_plan(list(p), list(q))] for p, q in zip(a, b)])

    return run(a, b)


def reduced(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """``merged_segments`` with each conflict cut down to what really differs: its sides are merged once more without a base."""
    whole = segments.where("NOT conflict").select(key, "segment", F.lit(0).cast("bigint").alias("part"), "a", "b", "lines", "conflict")
    wide = segments.where("conflict").select(F.struct(key, "segment").alias("k"), F.posexplode(two_way_column(F.col("a"), F.col("b"))).alias("pos", "x")).select("k", "pos", "x.state", "x.line")
    cut = merged_segments(wide, "k").select(F.col(f"k.{key}").alias(key), F.col("k.segment").alias("s0"), F.col("segment").alias("part"), "a", "b", "lines", "conflict")
    return whole.unionByName(cut.withColumnRenamed("s0", "segment"))


def lca_plan(a: list[str], b: list[str], lcas: list[list[str]]) -> list[tuple[str, str]]:
    """(state, line) of a merge over several common ancestors.

    A line of one side only is new there if some ancestor lacks it, killed by the other side
    if some has it, and conflicted if both hold.
    """
    def shared(x: list[str], other: list[str]) -> set[int]:
        return {i + d for i, _, n in matching_blocks(x, other) for d in range(n)}

    have = {"a": [shared(a, o) for o in lcas], "b": [shared(b, o) for o in lcas]}
    other = {"a": "b", "b": "a"}

    def state(side: str, i: int) -> str:
        old = sum(i in h for h in have[side])
        return f"new-{side}" if not old else f"killed-{other[side]}" if old == len(lcas) else f"conflicted-{side}"

    out, pa, pb = [], 0, 0
    for i, j, n in [*matching_blocks(a, b), (len(a), len(b), 0)]:
        out += [(state("a", k), a[k]) for k in range(pa, i)] + [(state("b", k), b[k]) for k in range(pb, j)] + [("unchanged", x) for x in a[i : i + n]]
        pa, pb = i + n, j + n
    return out


def lca_plan_column(a: Column, b: Column, lcas: Column) -> Column:
    @F.pandas_udf(PLAN)
    def run(a: pd.Series, b: pd.Series, lcas: pd.Series) -> pd.Series:
        return pd.Series([[{"state": s, "line": x} for s, x in lca_plan(list(p), list(q), [list(o) for o in os])] for p, q, os in zip(a, b, lcas)])

    return run(a, b, lcas)


def rendered(groups: list[tuple], a: str = "<<<<<<< \n", mid: str = "=======\n", b: str = ">>>>>>> \n") -> list[str]:
    out: list[str] = []
    for g in groups:
        out += g[0] if len(g) == 1 else [a, *g[0], mid, *g[1], b]
    return out


def merge_plan_column(base: Column, a: Column, b: Column) -> Column:
    @F.pandas_udf(PLAN)
    def run(base: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"state": s, "line": x} for s, x in merge_plan(list(p), list(q), list(r))] for p, q, r in zip(base, a, b)])

    return run(base, a, b)


def weave(versions: list[tuple[str, list[str], list[str]]]) -> list[tuple[int, tuple[int, ...], str]]:
    """(insert, deletes, line) rows that hold all versions (id, parent ids, lines), given parents first."""
    place = {v: k for k, (v, _, _) in enumerate(versions)}
    above: list[set[int]] = []
    rows: list[list] = []
    for k, (_, parents, lines) in enumerate(versions):
        inc = {k}.union(*(above[place[p]] for p in parents if p in place))
        above.append(inc)
        old = inc - {k}
        active = [i for i, (ins, dels, _) in enumerate(rows) if ins in old and not (set(dels) & old)]
        basis = [rows[i][2] for i in active]
        put: list[tuple[int, list]] = []
        pa, pb = 0, 0
        for i, j, n in [*matching_blocks(basis, lines), (len(basis), len(lines), 0)]:
            for d in range(pa, i):
                rows[active[d]][1].append(k)
            if j > pb:
                put.append((active[i] if i < len(active) else len(rows), [[k, [], x] for x in lines[pb:j]]))
            pa, pb = i + n, j + n
        for at, new in reversed(put):
            rows[at:at] = new
    return [(i, tuple(d), x) for i, d, x in rows]


def weave_text(rows: list[tuple[int, tuple[int, ...], str]], included: set[int]) -> list[tuple[int, str]]:
    """(origin, line) of the version whose ancestry (itself included) is ``included``."""
    return [(i, x) for i, d, x in rows if i in included and not (set(d) & included)]


#: fixed values: state of a weave line by where it was inserted (c both ancestries, a or b one of them) and where deleted
WEAVE_STATES = {
    "c": "unchanged", "ca": "killed-a", "cb": "killed-b", "cab": "killed-both", "cc": "killed-base",
    "a": "new-a", "aa": "ghost-a", "b": "new-b", "bb": "ghost-b",
}


def weave_state(ins: Column, dels: Column, a: Column, b: Column) -> Column:
    """State of a weave line (inserted by ``ins``, deleted by the versions ``dels``) in the merge of two ancestries a and b.

    A key of WEAVE_STATES is spelt from set membership: one letter for the insertion, then
    the sides that deleted it; a deletion that both ancestries share settles the line alone.
    """
    both = F.array_intersect(a, b)
    in_a, in_b = F.array_contains(a, ins), F.array_contains(b, ins)
    put = F.when(in_a & in_b, "c").when(in_a, "a").when(in_b, "b").otherwise("-")
    gone = lambda side, mark: F.when(F.arrays_overlap(dels, side), mark).otherwise("")
    cut = F.when(put == "c", F.concat(gone(a, "a"), gone(b, "b"))).when(put == "a", gone(a, "a")).when(put == "b", gone(b, "b")).otherwise("")
    spelt = F.when(F.arrays_overlap(dels, both), "cc").otherwise(F.concat(put, cut))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in WEAVE_STATES.items() for x in kv]), spelt), F.lit("irrelevant"))


def weave_plan(weaves: DataFrame, pairs: DataFrame, key: str = "weave") -> DataFrame:
    """(key, pos, state, line): merge plans from weave lines (key, pos, ins, dels, line) and one pair of ancestries (key, a, b) a weave."""
    return weaves.join(pairs.select(key, "a", "b"), key).select(key, "pos", weave_state(F.col("ins"), F.col("dels"), F.col("a"), F.col("b")).alias("state"), "line")


def weave_texts(weaves: DataFrame, versions: DataFrame, key: str = "weave") -> DataFrame:
    """(key, version, pos, origin, line): the annotated text of each version (key, version, ancestry with itself) of a weave."""
    here = F.array_contains("ancestry", F.col("ins")) & ~F.arrays_overlap("dels", "ancestry")
    return weaves.join(versions.select(key, "version", "ancestry"), key).where(here).select(key, "version", "pos", F.col("ins").alias("origin"), "line")


def weave_problems(weaves: DataFrame, versions: DataFrame, key: str = "weave") -> DataFrame:
    """(key, version, problem) of versions (key, version, ancestry, sha1): another text than was stored, or a line deleted before it came.

    A version without any line has the empty text.
    """
    texts = weave_texts(weaves, versions, key).groupBy(key, "version").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "").alias("text"))
    got = versions.select(key, "version", "sha1").join(texts, [key, "version"], "left")
    wrong = got.where(F.sha1(F.coalesce("text", F.lit(""))) != F.col("sha1")).select(key, "version", F.lit("another text").alias("problem"))
    early = weaves.select(key, F.explode("dels").alias("version"), "ins").join(versions.select(key, "version", "ancestry"), [key, "version"]).where(~F.array_contains("ancestry", F.col("ins")))
    return wrong.unionByName(early.select(key, "version", F.lit("deletes a line that it does not have").alias("problem")).distinct())


def gaps(blocks: Column, side: str, n: Column) -> Column:
    """Ranges (start, end) of one side's ``n`` lines that no matching block (a, b, n) covers; blocks come in order."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    add = lambda out, lo, hi: F.when(hi > lo, F.concat(out, F.array(F.struct(lo.cast("int").alias("start"), hi.cast("int").alias("end"))))).otherwise(out)
    acc = F.aggregate(blocks, start, lambda acc, x: F.struct((x[side] + x["n"]).cast("int").alias("at"), add(acc["out"], acc["at"], x[side]).alias("out")))
    return add(acc["out"], acc["at"], n)


def blocks_column(a: Column, b: Column) -> Column:
    """Matching blocks (a, b, n) of two arrays of lines."""
    @F.pandas_udf(BLOCKS)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"a": i, "b": j, "n": n} for i, j, n in matching_blocks(list(p), list(q))] for p, q in zip(a, b)])

    return run(a, b)


def sha1_lines(lines: list[str]) -> str:
    return hashlib.sha1("".join(lines).encode()).hexdigest()


HUNKS = "array<struct<parent:int,parent_pos:int,child_pos:int,n:int,lines:array<string>>>"


def multi_parent_column(parents: Column, lines: Column) -> Column:
    """Multi-parent diff of arrays of lines: hunks with a parent's number, or with new lines and a null parent."""
    @F.pandas_udf(HUNKS)
    def run(parents: pd.Series, lines: pd.Series) -> pd.Series:
        out = []
        for ps, ls in zip(parents, lines):
            hunks = multi_parent_diff([list(p) for p in ps], list(ls))
            out.append([{"parent": None, "n": len(h[1]), "lines": h[1]} if h[0] == "new" else {"parent": h[1], "parent_pos": h[2], "child_pos": h[3], "n": h[4], "lines": []} for h in hunks])
        return pd.Series(out)

    return run(parents, lines)


def multi_parent_text(parents: Column, hunks: Column) -> Column:
    """Lines that a multi-parent diff gives on its parents' lines, without leaving the JVM."""
    return F.flatten(F.transform(hunks, lambda h: F.when(h["parent"].isNull(), h["lines"]).otherwise(F.slice(F.element_at(parents, h["parent"] + 1), h["parent_pos"] + 1, h["n"]))))


def line_plans(rows: DataFrame, key: str = "key") -> DataFrame:
    """(key, pos, state, line): three-way merge plans of rows (key, base, a, b) of arrays of lines."""
    return rows.select(key, F.posexplode(merge_plan_column(F.col("base"), F.col("a"), F.col("b"))).alias("pos", "x")).select(key, "pos", "x.state", "x.line")
