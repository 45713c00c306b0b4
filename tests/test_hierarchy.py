import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.operators import hierarchy as H
from palimpsest.operators import tree as T

ENTRY = "snapshot string, file_id string, parent_id string, name string"
INV = "snapshot string, root_id string"


def brute(entries, root):
    """state, root, depth, path, number of descendants of each entry, by walking."""
    up = {f: (p, n) for f, p, n in entries}
    out = {}
    for f in up:
        seen, at, names = [], f, []
        while True:
            if at in seen:
                state = "on_cycle" if at == f else "below_cycle"
                break
            if at == root:
                state = "ok"
                break
            if at not in up:
                state = "detached"
                at = seen[-1]
                break
            seen.append(at)
            names.append(up[at][1] or "")
            if up[at][0] is None:
                state = "detached"
                break
            at = up[at][0]
        if state == "below_cycle" and f in _ring(up, f):
            state = "on_cycle"
        out[f] = (state, at, len(names) - (state == "detached"), ("/" if state == "ok" else "") + "/".join(reversed(names)))
    return out


def _ring(up, f):
    seen, at = [], f
    while at not in seen:
        seen.append(at)
        at = up[at][0]
    return seen[seen.index(at) :]


def tree(rng, n, damaged):
    entries = [("root", None, "")]
    for i in range(1, n):
        p = "root" if i == 1 or rng.random() < 0.2 else f"f{rng.randrange(max(1, i - 3), i)}" if rng.random() < 0.6 else f"f{rng.randrange(1, i)}"
        entries.append((f"f{i}", p, f"n{i}"))
    if damaged:
        for _ in range(max(1, n // 12)):
            k = rng.randrange(1, n)
            f, _, name = entries[k]
            entries[k] = (f, rng.choice([None, "gone", f"f{rng.randrange(1, n)}", f]), name)
    return entries


@pytest.mark.parametrize("limit", [10**6, 12])
def test_against_walking(spark, limit):
    rng = random.Random(4)
    cases = {f"s{k}": tree(rng, rng.randrange(2, 60), k % 2) for k in range(12 if limit > 100 else 5)}
    rows = [(s, f, p, n) for s, es in cases.items() for f, p, n in es]
    rows += rows[::5] + [(None, "x", None, "x"), ("s1", None, None, "y")]
    rng.shuffle(rows)
    entry = spark.createDataFrame(rows, ENTRY)
    inv = spark.createDataFrame([(s, "root") for s in cases] * 2 + [(None, "root"), ("s0", None)], INV)
    got = {(r.snapshot, r.file_id): r for r in H.hierarchy(entry, inv, limit=limit).collect()}
    found = {(r.snapshot, r.file_id): r.state for r in H.hierarchy(entry, inv, full=False, limit=limit).collect()}
    want = {(s, f): w for s, es in cases.items() for f, w in brute(es, "root").items()}
    assert set(got) == set(want)
    for k, (state, root, depth, path) in want.items():
        r = got[k]
        assert r.state == state, k
        assert found.get(k, "ok") == state
        if state in ("ok", "detached"):
            assert (r.root, r.depth, r.path) == (root, depth, path), k
    for s, es in cases.items():
        for f, _, _ in es:
            r = got[s, f]
            if r.state in ("ok", "detached"):
                below = sum(1 for g, _, _ in es if got[s, g].state == r.state and got[s, g].root == r.root and g != f and f in chain(es, g))
                assert r.n_descendants == below, (s, f)
                if r.first_place is not None:
                    inside = {g for g, _, _ in es if got[s, g].root == r.root and got[s, g].first_place is not None and r.first_place < got[s, g].first_place <= r.first_place + r.n_descendants}
                    assert inside == {g for g, _, _ in es if g != f and got[s, g].root == r.root and f in chain(es, g)}


def chain(es, g):
    up, out = {f: p for f, p, _ in es}, []
    while g is not None and g in up and g not in out:
        out.append(g)
        g = up[g]
    return out


def test_empty_and_headless(spark):
    none = spark.createDataFrame([], ENTRY)
    inv = spark.createDataFrame([], INV)
    assert H.hierarchy(none, inv).count() == 0 and H.hierarchy(none, inv, full=False).count() == 0
    one = spark.createDataFrame([("s", "a", None, "a"), ("s", "b", "a", "b")], ENTRY)
    assert {r.state for r in H.hierarchy(one, inv).collect()} == {"detached"}


def test_clashing_columns(spark):
    e = spark.createDataFrame([("s", "a", None, "a", 1, True, "x")], ENTRY + ", tree int, is_head boolean, node string")
    assert H.hierarchy(e, spark.createDataFrame([("s", "a", 7)], INV + ", up int")).collect()[0].state == "ok"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-1, 30), min_size=1, max_size=31))
def test_contraction(parents):
    p = np.array([x if x < len(parents) else -1 for x in parents], np.int64)
    done = H.Contraction(p, np.ones(len(p), np.int64), np.zeros(len(p), np.int64)).run()
    root, total, on = done.expand()
    depth = done.sums(np.ones(len(p), np.int64))
    for i in range(len(p)):
        seen, at = [], i
        while at not in seen and p[at] >= 0:
            seen.append(at)
            at = p[at]
        cyclic = at in seen
        assert on[i] == (cyclic and i in seen[seen.index(at) :])
        if not cyclic:
            assert root[i] == at and depth[i] == len(seen)


def test_long_chain_and_wide_star():
    n = 20000
    chain_ = np.arange(-1, n - 1)
    d = H.Contraction(chain_, np.ones(n, np.int64), np.zeros(n, np.int64)).run()
    root, total, _ = d.expand()
    assert (d.sums(np.ones(n, np.int64)) == np.arange(n)).all() and (total == n - np.arange(n)).all() and not root.any()
    star = np.r_[-1, np.zeros(n - 1, np.int64)]
    d = H.Contraction(star, np.ones(n, np.int64), np.zeros(n, np.int64)).run()
    assert d.expand()[1][0] == n


def test_descendants(spark):
    rng = random.Random(3)
    cases = {f"s{k}": tree(rng, 40, k) for k in range(2)}
    e = spark.createDataFrame([(s, f, p, "same") for s, es in cases.items() for f, p, _ in es], ENTRY)
    inv = spark.createDataFrame([(s, "root") for s in cases], INV)
    state = {(r.snapshot, r.file_id): r.state for r in H.hierarchy(e, inv).collect()}
    want = {(s, a, f) for s, es in cases.items() for f, _, _ in es if state[s, f] in ("ok", "detached") for a in chain(es, f)[1:]}
    got = [tuple(r) for r in H.descendants(e, inv).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_large_equals_small(spark):
    rng = random.Random(11)
    cases = {f"s{k}": tree(rng, rng.randrange(14, 60), k % 2) for k in range(4)}
    cases["s0"] = [(f, p, "same") for f, p, _ in cases["s0"]]
    entry = spark.createDataFrame([(s, f, p, n) for s, es in cases.items() for f, p, n in es], ENTRY)
    inv = spark.createDataFrame([(s, "root") for s in cases], INV)
    small, large = ({(r.snapshot, r.file_id): r.asDict() for r in H.hierarchy(entry, inv, limit=n).collect()} for n in (10**6, 12))
    assert small.keys() == large.keys() and any(r["first_place"] for r in large.values())
    for column in next(iter(small.values())):
        assert {k: r[column] for k, r in small.items()} == {k: r[column] for k, r in large.items()}, column
    wanted = entry.where("file_id IN ('f3', 'f9')").select("snapshot", "file_id")
    got = [{tuple(r) for r in T.subtree_filter(entry, inv, wanted, limit=n, block=k).collect()} for n, k in ((10**6, 1 << 16), (12, 4))]
    assert got[0] == got[1] and {r[0] for r in got[1]} == set(cases)
    above = lambda s, f: chain(cases[s], f)
    want = {(s, g) for s, es in cases.items() for g, _, _ in es if small[s, g]["first_place"] is not None and any((f in above(s, g) or g in above(s, f)) and small[s, f]["first_place"] is not None for f in ("f3", "f9"))}
    assert {r[:2] for r in got[0]} == want


def test_rows_that_disagree(spark):
    rows = [("s", "r", None, ""), *[("s", d, "r", d) for d in "ab"], *[("s", "x", p, n) for p, n in (("a", "y"), ("b", "x"), ("a", "x"), ("b", None))], ("s", "z", "x", "z")]
    seen = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        entry, inv = spark.createDataFrame(rows, ENTRY), spark.createDataFrame([("s", "r")], INV)
        seen |= {tuple(sorted(map(tuple, H.hierarchy(entry, inv, limit=n).collect()))) for n in (10**6, 1)}
    assert len(seen) == 1


def test_ends_and_cycles_above_the_limit(spark, monkeypatch):
    calls = []

    def counted(df, durable=H.durable):
        calls.append(1)
        assert len(calls) < 60, "the rounds do not end"
        return durable(df)

    monkeypatch.setattr(H, "durable", counted)
    cases = {
        "loose": [(f"f{i}", None if i % 2 else "gone", f"n{i}") for i in range(20)],
        "loops": [(f"f{i}", f"f{i}", f"n{i}") for i in range(12)] + [("g0", "g1", "a"), ("g1", "g0", "b"), ("h", "g0", "c")],
        "whole": tree(random.Random(5), 5, 0),
    }
    entry = spark.createDataFrame([(s, f, p, n) for s, es in cases.items() for f, p, n in es], ENTRY)
    inv = spark.createDataFrame([(s, "root") for s in cases], INV)
    small, large = (sorted(map(tuple, H.hierarchy(entry, inv, limit=n).collect()), key=repr) for n in (10**6, 10))
    assert small == large and {r[0] for r in large} == set(cases)
