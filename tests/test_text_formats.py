import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import scalars as S
from palimpsest.operators import contentmap, graph, index, text
from palimpsest.sources import formats as X

LINES = st.lists(st.sampled_from(["a\n", "b\n", "c\n", "d\n", "e\n"]), max_size=14)


@settings(max_examples=200, deadline=None)
@given(LINES, LINES)
def test_blocks_and_delta(a, b):
    pa = pb = 0
    for i, j, n in text.matching_blocks(a, b):
        assert n > 0 and i >= pa and j >= pb and a[i : i + n] == b[j : j + n]
        pa, pb = i + n, j + n
    out, off = list(a), 0
    for s, e, lines in text.line_delta(a, b):
        out[s + off : e + off] = lines
        off += len(lines) - (e - s)
    assert out == b


@settings(max_examples=100, deadline=None)
@given(LINES, LINES, LINES)
def test_multi_parent_weave_and_merge(base, a, b):
    assert text.apply_multi_parent([base, a], text.multi_parent_diff([base, a], b)) == b
    rows = text.weave([("0", [], base), ("1", ["0"], a), ("2", ["0"], b), ("3", ["1", "2"], a)])
    for inc, lines in (({0}, base), ({0, 1}, a), ({0, 2}, b), ({0, 1, 2, 3}, a)):
        assert [x for _, x in text.weave_text(rows, inc)] == lines
    plan = text.merge_plan(base, a, b)
    assert text.plan_base(plan) == base
    assert [x for s, x in plan if s in ("unchanged", "killed-b", "new-a")] == a
    assert [x for s, x in plan if s in ("unchanged", "killed-a", "new-b")] == b


def test_weave_plan(spark):
    base, a, b = ["a\n", "b\n", "c\n", "d\n"], ["a\n", "x\n", "c\n"], ["b\n", "y\n", "c\n", "d\n"]
    rows = text.weave([("0", [], base), ("1", ["0"], a), ("2", ["0"], b), ("3", ["1", "2"], a)])
    weaves = spark.createDataFrame([("w", k, i, list(d), x) for k, (i, d, x) in enumerate(rows)], "weave string, pos int, ins int, dels array<int>, line string")
    pairs = spark.createDataFrame([("w", [0, 1], [0, 2])], "weave string, a array<int>, b array<int>")
    plan = [(r.state, r.line) for r in text.weave_plan(weaves, pairs).orderBy("pos").collect()]
    assert [x for s, x in plan if s in ("unchanged", "killed-b", "new-a")] == a and [x for s, x in plan if s in ("unchanged", "killed-a", "new-b")] == b
    got = text.weave_texts(weaves, spark.createDataFrame([("w", 3, [0, 1, 2, 3])], "weave string, version int, ancestry array<int>")).orderBy("pos").collect()
    assert [r.line for r in got] == a
    state = lambda i, d: spark.range(1).select(text.weave_state(F.lit(i), F.array(*map(F.lit, d)).cast("array<int>"), F.array(F.lit(0), F.lit(1)), F.array(F.lit(0), F.lit(2)))).first()[0]
    want = {(0, ()): "unchanged", (0, (1,)): "killed-a", (0, (2,)): "killed-b", (0, (1, 2)): "killed-both", (0, (0,)): "killed-base", (1, ()): "new-a", (1, (1,)): "ghost-a", (1, (2,)): "new-a", (2, ()): "new-b", (2, (2,)): "ghost-b", (9, ()): "irrelevant", (9, (0,)): "killed-base"}
    assert {k: state(*k) for k in want} == want


def test_merged_texts(spark):
    texts = [("1", "1 2 3", "1 x 3", "1 y 3"), ("2", "1 2", "1 x", "1 x"), ("3", "1 2 3", "1 3", "1 2 3 4"), ("4", "a b c", "a c e h g", "f a b g"), ("5", "", "", "")]
    plans, want = [], {}
    for k, o, p, q in texts:
        o, p, q = ([x + "\n" for x in t.split()] for t in (o, p, q))
        plan = text.merge_plan(o, p, q)
        plans += [(k, i, s, x) for i, (s, x) in enumerate(plan)]
        groups = text.plan_groups(plan)
        if groups:
            want[k] = ("".join(text.rendered(groups)), sum(len(g) == 2 for g in groups))
    got = {r.doc_id: (r.text, r.n_conflicts) for r in text.merged_texts(spark.createDataFrame(plans, "doc_id string, pos int, state string, line string")).collect()}
    assert got == want and got["1"] == ("1\n<<<<<<< \nx\n=======\ny\n>>>>>>> \n3\n", 1) and got["3"] == ("1\n3\n4\n", 0)


def test_golden_merge():
    a, b, c = (list(x) for x in ("abc", "acehg", "fabg"))
    plan = text.merge_plan(a, b, c)
    assert ("killed-a", "b") in plan and ("killed-b", "c") in plan and ("unchanged", "a") in plan and ("new-b", "f") in plan
    groups = text.plan_groups(text.merge_plan(["1\n", "2\n", "3\n"], ["1\n", "x\n", "3\n"], ["1\n", "y\n", "3\n"]))
    assert text.rendered(groups) == ["1\n", "<<<<<<< \n", "x\n", "=======\n", "y\n", ">>>>>>> \n", "3\n"]
    assert text.rendered(text.plan_groups(text.merge_plan(["1\n", "2\n"], ["1\n", "x\n"], ["1\n", "x\n"]))) == ["1\n", "x\n"]


def test_annotate():
    got = text.annotate([("A", [], ["a\n", "b\n"]), ("B", ["A"], ["a\n", "x\n", "b\n"]), ("C", ["A"], ["a\n", "b\n", "y\n"]), ("D", ["B", "C"], ["a\n", "x\n", "b\n", "y\n", "z\n"])])
    assert got["D"] == [("A",), ("B",), ("A",), ("C",), ("D",)]


def test_formats():
    nodes = [(["b", "1"], "v1", [[["a", "0"], ["b", "0"]], []]), (["a", "0"], "", [[], [["b", "1"]]])]
    rows = {tuple(r["key"]): r for r in X.parse_graph_index(X.graph_index_bytes(nodes, 2, 2))}
    assert rows["b", "1"]["refs"] == [[["a", "0"], ["b", "0"]], []] and rows["b", "0"]["absent"] and rows["a", "0"]["value"] == ""
    assert list(X.parse_graph_index(X.graph_index_bytes([], 1, 1))) == []
    page = list(X.parse_leaf_page(X.leaf_page(nodes, 2), 2, 2))
    assert [(r["key"], r["value"], r["refs"]) for r in page] == sorted(nodes)
    records = [(["n/1", "m"], b"abc\n"), ([], b""), (["x"], b"E")]
    assert [(r["names"], r["body"]) for r in X.parse_container(X.container_bytes(records))] == records
    with pytest.raises(ValueError):
        X.container_bytes([(["a"], b""), (["a"], b"")])
    with pytest.raises(ValueError):
        list(X.parse_container(X.container_bytes(records)[:-6]))
    stanzas = [[("number", "42"), ("name", "fr\ned"), ("name", "")], [("q", 'say "hi"')]]
    got = list(X.parse_stanzas(X.stanza_bytes(stanzas)))
    assert [[(r["tag"], r["value"]) for r in got if r["stanza"] == k] for k in (0, 1)] == stanzas
    state = [("", "", "root", [("d", "", 0, False, "x" * 32), ("d", "", 0, False, "rev")]), ("a", "f", "id", [("f", "sha", 10, True, "p"), ("a", "", 0, False, "")])]
    got = list(X.parse_state(X.state_bytes(["p1", "g1"], ["g1"], [(d, b, f, t) for d, b, f, t in state])))
    assert len(got) == 4 and got[2]["executable"] and got[2]["size"] == 10
    delta = [{"old_path": None, "new_path": "/a", "file_id": "i", "parent_id": "p", "revision": "r", "kind": "file", "text_size": 3, "executable": True, "text_sha1": "s", "symlink_target": None, "reference_revision": None}]
    assert list(X.parse_inventory_delta(X.inventory_delta_bytes(delta, "null:", "v"))) == delta
    e = {"kind": "file", "file_id": "i", "parent_id": "p", "name": "n", "revision": "r", "text_sha1": "s", "text_size": 4, "executable": True, "symlink_target": None, "reference_revision": None}
    assert X.parse_entry(X.entry_text(e)) == e
    assert X.bdecode(X.bencode({"a": [1, "x"], "b": -5})) == {b"a": [1, b"x"], b"b": -5}
    assert all(X.parse_varint(X.varint(n)) == (n, len(X.varint(n))) for n in (0, 127, 128, 300, 1 << 40))


def test_index_files(spark, tmp_path):
    rows = [("i", ["k%03d" % i], "v%d" % i, [[["k%03d" % (i // 2)], ["ghost"]]]) for i in range(40)]
    files = X.write_graph_indices(spark.createDataFrame(rows, "index_name string, key array<string>, value string, refs array<array<array<string>>>"), per_file=15)
    back = X.parsed_graph_indices(files).where("NOT absent")
    assert {(r.key[0], r.value, r.refs[0][0][0]) for r in back.collect()} == {(k[0], v, r[0][0][0]) for _, k, v, r in rows}
    for i, r in enumerate(files.collect()):
        (tmp_path / f"{i}.idx").write_bytes(bytes(r.content))
    assert X.read_files(spark, str(tmp_path), X.parse_graph_index, X.NODE).where("NOT absent").count() == 40


def test_scalars(spark):
    one = spark.createDataFrame([(["foo", "bar"], "a/b/c", -7200, 130)], "k array<string>, p string, z int, s int")
    r = one.select(
        S.search_key_16(F.col("k")).alias("k16"), S.ancestor_paths(F.col("p")).alias("up"), S.zone_text(F.col("z")).alias("z"), S.age_text(F.col("s")).alias("age"), S.key_is_valid(F.col("k"), 2).alias("ok"),
        S.packed_stat(F.lit(1), F.lit(2), F.lit(3), F.lit(4), F.lit(5), F.lit(6)).alias("stat"), S.lines(F.lit("a\n\nb")).alias("lines"), S.is_inside(F.lit("a"), F.col("p")).alias("in1"), S.is_inside(F.lit("a/bc"), F.col("p")).alias("in2"),
        S.common_prefix(F.lit("abcd"), F.lit("abxd")).alias("lcp"), S.hashed_partition(F.lit("abc d")).alias("part"), S.normalized_pattern(F.lit("a\\b//c/")).alias("pat"), S.summary_line(F.lit("\n one\ntwo")).alias("sum"),
    ).first()
    import zlib

    assert r.k16 == "\0".join("%08X" % zlib.crc32(x) for x in (b"foo", b"bar")) and r.up == ["a/b", "a"] and r.z == "-0200" and r.age == "2 minutes ago" and r.ok
    assert r.stat == X.packed_stat(1, 2, 3, 4, 5, 6) and r["lines"] == ["a\n", "\n", "b"] and r.in1 and not r.in2 and r.lcp == "ab"
    assert r.part == "%02x/abc%%20d" % (zlib.adler32(b"abc d") & 0xFF) and r.pat == "a/b/c" and r["sum"] == "one"


def test_prefixes_are_elements(spark):
    n = spark.createDataFrame([("i", ["foo", "a"], False, "v", [[]], 0, None), ("i", ["foobar", "b"], False, "w", [[]], 0, None)], "index_name string, key array<string>, absent boolean, value string, refs array<array<array<string>>>, src int, arrived_at timestamp_ntz")
    p = spark.createDataFrame([("i", ["foo"])], "index_name string, prefix array<string>")
    assert [r.value for r in index.prefix_lookup(n, p).collect()] == ["v"]
    assert [r.key for r in index.prefix_view(n, ["foo"]).collect()] == [["a"]]
    assert index.prefix_lookup(n.limit(0), p).count() == 0


def test_map_delta(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    swap = spark.createDataFrame([("a", "b", "1"), ("b", "a", "2")], "old string, new string, value string")
    assert {tuple(r) for r in contentmap.apply_map_delta(rows, swap).collect()} == {("a", "2"), ("b", "1")}
    with pytest.raises(Exception, match="exists"):
        contentmap.apply_map_delta(rows, spark.createDataFrame([(None, "a", "9")], "old string, new string, value string")).collect()


def test_graph_cycles_and_ghosts(spark):
    e = spark.createDataFrame([("b", "a", 0), ("c", "b", 0), ("x", "y", 0), ("y", "x", 0), ("z", "x", 0), ("c", "ghost", 1)], "child string, parent string, ord int")
    n = spark.createDataFrame([(v,) for v in "abcxyz"], "node string")
    assert {r.node: r.level for r in graph.levels(e, n).collect()} == {"a": 0, "b": 1, "c": 2, "x": None, "y": None, "z": None}
    assert {r.node for r in graph.pruned(e, n).collect()} == set("xyz")
    tips = spark.createDataFrame([("c",)], "tip string")
    assert {r.node for r in graph.missing_ancestors(e, n, tips).collect()} == {"ghost"}
    assert {r.node for r in graph.unique_ancestors(e, "c", "b").collect()} == {"c", "ghost"}
    links = spark.createDataFrame([("k1", None, 5), ("k2", "k1", 1), ("k3", "k2", 1), ("l1", "l2", 1), ("l2", "l1", 1), ("g", "gone", 2)], "key string, parent string, size int")
    got = {r.key: (r.root, r.depth, r.total) for r in graph.chain_depths(links).collect()}
    assert got == {"k1": ("k1", 0, 5.0), "k2": ("k1", 1, 6.0), "k3": ("k1", 2, 7.0), "l1": (None, None, None), "l2": (None, None, None), "g": ("g", 0, 2.0)}


def test_streams(spark, tmp_path):
    from palimpsest.streaming import records

    schema = "file_id string, rev string, basis string, payload string"
    for i, part in enumerate([[("f", "3", "2", "c"), ("f", "1", None, "a")], [("f", "2", "1", "b"), ("f", "1", None, "a"), ("g", "9", "8", "x")]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
    q = records.insert_records(stream).writeStream.format("memory").queryName("inserted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = [(r.rev, r.state) for r in spark.table("inserted").collect()]
    assert sorted(got) == [("1", "inserted"), ("2", "inserted"), ("3", "inserted")]
    assert got.index(("2", "inserted")) < got.index(("3", "inserted"))
