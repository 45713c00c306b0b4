from datetime import datetime

import numpy as np

from palimpsest.operators import orphans, snapshots
from palimpsest.plans import skew

REV = "revision_id string, parent_ids array<string>, arrived_at timestamp_ntz"
HEAD = "header_id string, ghosts array<string>, arrived_at timestamp_ntz"
NODE = "index_name string, key array<string>, absent boolean, refs array<array<array<string>>>, arrived_at timestamp_ntz"
GONE = "tab string, rec_key string, removed_at timestamp_ntz"
T = [datetime(2024, m, 1) for m in range(1, 13)]


def found(spark, rev=(), head=(), node=(), gone=()):
    df = orphans.orphan_references(*(spark.createDataFrame(list(r), s) for r, s in ((rev, REV), (head, HEAD), (node, NODE), (gone, GONE))))
    return {tuple(r) for r in df.collect()}


def test_states(spark):
    rev = [("a", ["b", None, "null:", "c", "c"], T[1]), ("a", ["b", "c"], T[0]), ("c", [], T[2]), ("d", ["e"], T[3]), ("e", None, T[1]), (None, ["zz"], T[1]), ("f", ["gone"], None)]
    got = found(spark, rev, [("h", ["x", "a"], T[4]), ("h", None, T[5])], [], [("revision", "e", T[0]), ("revision", "e", T[1])])
    assert got == {
        ("revision", "parent_ids", "2024-01", "a", "b", "missing"), ("revision", "parent_ids", "2024-01", "a", "c", "late"), ("revision", "parent_ids", "2024-04", "d", "e", "deleted"),
        ("revision", "parent_ids", None, "f", "gone", "missing"), ("dirstate_header", "ghosts", "2024-05", "h", "x", "missing"),
    }


def test_index_nodes(spark):
    node = [
        ("t", ["f", "1"], False, [[["f", "0"], ["f", None], None]], T[1]), ("t", ["f", "1"], False, [[], [["f", "2"]]], T[0]), ("t", ["f", "2"], False, [], T[2]), ("t", ["f", "0"], True, [], T[1]),
        ("t", ["f", "2"], True, None, T[0]), ("r", ["k"], None, None, T[1]), (None, ["q"], False, [[["w"]]], T[1]),
    ]
    assert found(spark, node=node, gone=[("index_node", "r:k", T[0])]) == {
        ("index_node", "refs", "2024-01", "t:f/1", "t:f/0", "missing"), ("index_node", "refs", "2024-01", "t:f/1", "t:f/2", "late"),
        ("index_node", "absent", "2024-02", "t:f/0", "t:f/0", "missing"), ("index_node", "absent", "2024-01", "t:f/2", "t:f/2", "late"),
    }


def test_empty_and_hot(spark, monkeypatch):
    assert found(spark) == set()
    monkeypatch.setattr(skew, "hot_buckets", lambda df, keys: [r[0] for r in df.select(skew.bucket_of(keys)).distinct().collect()])
    rev = [(f"r{i}", ["hot", f"r{i + 1}"], T[i % 6]) for i in range(60)]
    got = found(spark, rev)
    assert len([x for x in got if x[4] == "hot"]) == 60 and ("revision", "parent_ids", "2024-06", "r59", "r60", "missing") in got


def test_hot_bucket_is_found(spark, monkeypatch):
    df = spark.range(40_000).selectExpr("if(id % 3 = 0, 'hot', cast(id as string)) AS k", "id AS v")
    assert len(skew.hot_buckets(df, ["k"])) == 1
    right = df.select("k").distinct().selectExpr("k", "length(k) AS n")
    assert skew.salted_join(df, right, ["k"], ["v"]).where("n = length(k)").count() == 40_000


ENT = "snapshot string, file_id string, parent_id string, name string, kind string, revision string, text_sha1 string, text_size bigint, executable boolean, symlink_target string, reference_revision string"
INV = "snapshot string, branch string, seq int"


def test_changes(spark):
    row = lambda s, f, name="n", size=1: (s, f, "p", name, "file", None, None, size, None, None, None)
    e = [row("s1", "a"), row("s1", "b"), row("s1", "b"), row("s1", "c", None), row("s3", "a", "m"), row("s3", "c", None), row("s3", "d"), row("s9", "d"), row("s9", "a", "m"), row("s9", "c", "x"), row("t1", "z"), row(None, "q"), row("s3", None), row("lost", "y")]
    inv = [("s1", "b", 1), ("s3", "b", 3), ("s3", "b", 3), ("s9", "b", 9), ("t1", "u", 1), (None, "u", 2), ("v", None, 1), ("w", "u", None)]
    df = snapshots.snapshot_changes(spark.createDataFrame(e, ENT), spark.createDataFrame(inv, INV))
    assert {tuple(r) for r in df.collect()} == {("s3", "b", "removed"), ("s3", "a", "changed"), ("s3", "d", "added"), ("s9", "c", "changed")}
    assert snapshots.snapshot_changes(spark.createDataFrame([], ENT), spark.createDataFrame(inv, INV)).count() == 0
    assert snapshots.changed_values(spark.createDataFrame(e, ENT), spark.createDataFrame(inv, INV)).count() == 4


def test_null_is_no_value(spark):
    row = lambda s, a, b: (s, "f", a, b, "file", None, None, None, None, None, None)
    df = snapshots.snapshot_changes(spark.createDataFrame([row("s1", None, "x"), row("s2", "x", None)], ENT), spark.createDataFrame([("s1", "b", 1), ("s2", "b", 2)], INV))
    assert df.collect()[0].change == "changed"


def test_bucket_against_sets():
    rng = np.random.default_rng(3)
    n, ranks = 400, 5
    rows = {(int(b), int(f), int(r)): int(h) for b, f, r, h in zip(rng.integers(0, 3, n), rng.integers(0, 30, n), rng.integers(0, ranks, n), rng.integers(0, 3, n))}
    k = np.array([*rows], np.int64)
    args = [k[:, 0], k[:, 1] * 10**17 - 5, k[:, 2], np.full(len(k), ranks - 1), np.array([*rows.values()], np.int64)]
    got = {(int(b), int((f + 5) // 10**17), int(r), int(c)) for b, r, f, c in zip(*snapshots.differing(*(np.concatenate([a, a[:20]]) for a in args)))}
    want = set()
    for b in range(3):
        for f in range(30):
            for r in range(1, ranks):
                old, new = rows.get((b, f, r - 1)), rows.get((b, f, r))
                if old != new:
                    want.add((b, f, r, 0 if old is None else 1 if new is None else 2))
    assert got == want
