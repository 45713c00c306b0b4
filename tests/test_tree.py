from palimpsest.operators import tree as T
from palimpsest.operators.hierarchy import hierarchy

KINDS = ", ".join(f"{c} {k}" for c, k in zip(T.ENTRY, T.KINDS_OF))
ROW = "snapshot string, file_id string, " + KINDS


def entry(f, p, name, kind="file", sha="1", s="s"):
    return (s, f, p, name, kind, "r", sha, 1, False, None, None)


def test_edits_and_invalid_deltas(spark):
    rows = [entry("root", None, "", "directory"), entry("d", "root", "d", "directory"), entry("e", "d", "e", "directory"), entry("f", "e", "f"), entry("g", "root", "g")]
    base = spark.createDataFrame(rows, ROW)
    inv = spark.createDataFrame([("s", "root")], "snapshot string, root_id string")
    paths = hierarchy(base, inv)
    pick = lambda *ids: spark.createDataFrame([("s", i) for i in ids], "snapshot string, file_id string")
    after = lambda delta: {r.file_id: (r.parent_id, r.name) for r in T.apply_delta(base, delta).collect()}
    problems = lambda delta: {(r.what, r.problem) for r in T.invalid_delta(base, paths, delta).collect()}

    gone = T.removal(paths, pick("d"), block=2)
    assert set(after(gone)) == {"root", "g"} and problems(gone) == set()
    assert set(after(T.removal(paths, pick("f", "e")))) == {"root", "d", "g"} and T.removal(paths, pick("x")).count() == 0
    half = gone.where("file_id <> 'f'")
    assert ("f", "parent is missing afterwards") in problems(half)

    moved = T.moves(base, paths, spark.createDataFrame([("s", "f", "root", "ff"), ("s", "g", "d", None)], "snapshot string, file_id string, to_parent string, to_name string"))
    assert after(moved)["f"] == ("root", "ff") and after(moved)["g"] == ("d", "g") and problems(moved) == set()
    assert {(r.old_path, r.new_path) for r in moved.collect()} == {("/d/e/f", "/ff"), ("/g", "/d/g")}
    under_file = T.moves(base, paths, spark.createDataFrame([("s", "f", "g", "x")], "snapshot string, file_id string, to_parent string, to_name string"))
    assert ("f", "parent is no directory afterwards") in problems(under_file)

    added = T.additions(paths, spark.createDataFrame([entry("n", "e", "n"), entry("m", "nowhere", "m")], ROW))
    assert after(added)["n"] == ("e", "n") and {r.new_path for r in added.where("file_id = 'n'").collect()} == {"/d/e/n"}
    assert ("m", "no path") in problems(added) or ("m", "parent is missing afterwards") in problems(added)
    bad = spark.createDataFrame([("s", "g", None, "/g", *entry("g", "root", "g")[2:]), ("s", "f", "/x", None, *[None] * 9), ("s", "q", "/q", None, *[None] * 9), ("s", "d", "/d", "/z", *entry("d", "root", "d", "directory")[2:])], "snapshot string, file_id string, old_path string, new_path string, " + KINDS)
    assert {("g", "added entry is there"), ("f", "old path is another"), ("q", "removed entry is not there"), ("d", "new path is not the name")} <= problems(bad)

    new = T.renumbered(base, spark.createDataFrame([("s", "root", "top"), ("s", "e", "ee")], "snapshot string, file_id string, new_id string"))
    assert {(r.file_id, r.parent_id) for r in new.collect()} == {("top", None), ("d", "top"), ("ee", "d"), ("f", "ee"), ("g", "top")}


def test_working_states(spark):
    rows = [entry("root", None, "", "directory", s=s) for s in "ab"] + [entry("x", "root", "x", sha="1", s="a"), entry("x", "root", "y", sha="2", s="b"), entry("old", "root", "o", s="b"), entry("new", "root", "n", s="a")]
    trees = spark.createDataFrame([("w", 0, "a"), ("w", 1, "b")], "state_id string, tree_index int, snapshot string")
    st = T.working_states(spark.createDataFrame(rows, ROW), trees).cache()
    slot = {(r.file_id, r.tree_index): (r.kind, r.fingerprint) for r in st.collect()}
    assert slot[("x", 0)] == ("f", "1") and slot[("x", 1)] == ("r", "root/y") and slot[("old", 0)] == ("a", "") and slot[("new", 1)] == ("a", "") and len(slot) == 8
    assert {tuple(r)[1:] for r in T.state_changes(st, 1, 0).collect()} == {("x", "changed"), ("old", "removed"), ("new", "added")}
    assert T.state_problems(st).count() == 0
    disk = spark.createDataFrame([("w", "root", "d", None, "", "", 0, False), ("w", "x", "f", "root", "x", "9", 1, True), ("w", "z", "f", "lost", "z", "5", 1, False)], "state_id string, file_id string, kind string, parent_id string, name string, fingerprint string, size int, executable boolean")
    now = T.with_working_tree(st, disk)
    assert {(r.file_id, r.kind) for r in now.where("tree_index = 0").collect()} == {("root", "d"), ("x", "f"), ("z", "f"), ("old", "a")}
    assert {tuple(r)[1:] for r in T.state_problems(now).collect()} == {("z", "parent is missing")}
    assert {r.file_id for r in T.without_trees(now, 1).collect()} == {"root", "x", "z"}
    twice = st.unionByName(st.where("file_id = 'x' AND tree_index = 0")).where("NOT (file_id = 'new' AND tree_index = 1)")
    assert {tuple(r)[1:] for r in T.state_problems(twice).collect()} == {("x", "slot occurs twice"), ("new", "slot is missing")}


def test_paths_into_nested_trees(spark):
    rows = [entry("root", None, "", "directory"), entry("d", "root", "d", "directory"), entry("sub", "d", "sub", "tree-reference"), entry("f", "d", "f")]
    base, inv = spark.createDataFrame(rows, ROW), spark.createDataFrame([("s", "root")], "snapshot string, root_id string")
    asked = spark.createDataFrame([("s", p) for p in ("/", "/d/f", "/d/sub", "/d/sub/x/y", "d/f", "/d/f/no", "/none", None)], "snapshot string, asked string")
    got = {(r.asked, r.file_id, r.rest) for r in T.at_paths(hierarchy(base, inv), base, asked).collect()}
    assert got == {("/", "root", ""), ("/d/f", "f", ""), ("d/f", "f", ""), ("/d/sub", "sub", ""), ("/d/sub/x/y", "sub", "x/y")}
