import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import scalars as S
from palimpsest.operators import contentmap, graph, packs, text, versions
from palimpsest.sources import pages, registry, wire, worktree

KEYS = st.lists(st.text("abcxyz019-", min_size=1, max_size=12), min_size=1, max_size=2).map(tuple)


def nodes(n, rng, wide=20):
    return [([f"f{k:05d}", "".join(rng.choices("abcdef0123456789", k=wide))], f"{k} {rng.randrange(99999)}", [[[f"f{k // 2:05d}", "x"]], []]) for k in range(n)]


@pytest.mark.parametrize("n", [0, 1, 50, 4000])
def test_paged_index(n):
    rows = nodes(n, random.Random(n))
    data = pages.paged_index_bytes(rows, 2, 2)
    o = pages.parse_options(data)
    assert o["len"] == n and sum(o["row_lengths"]) == -(-len(data) // pages.PAGE) * (n > 0) and (n < 4000 or len(o["row_lengths"]) > 1)
    assert [(r["key"], r["value"], r["refs"]) for r in pages.parse_paged_index(data)] == sorted(rows)
    reads = []
    read = lambda a, k: (reads.append(a), data[a : a + k])[1]
    asked = [r[0] for r in rows[:: max(1, n // 7)]] + [["nothing", "here"]]
    assert sorted(r["key"] for r in pages.find(read, asked)) == sorted(r[0] for r in rows[:: max(1, n // 7)])
    assert len(reads) <= 1 + len(asked) * max(1, len(o["row_lengths"]))
    with pytest.raises(ValueError):
        pages.paged_index_bytes([(["k"], "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=20000)), [])], 0, 1)


@settings(max_examples=100, deadline=None)
@given(KEYS, st.none() | st.lists(KEYS, max_size=3), st.booleans(), st.binary(max_size=60))
def test_wire_records(key, parents, bare, body):
    r = wire.parse_record(wire.record("knit-delta-gz", key, parents, bare, body))
    assert (r["kind"], r["key"], r["parents"], r["bare_end"], r["body"]) == ("knit-delta-gz", key, parents, bare, body)
    recs = [{"key": key, "parents": parents, "method": "fulltext", "bare_end": bare, "next": None, "body": body}, {"key": key, "parents": [], "method": "line-delta", "bare_end": False, "next": key, "body": b"\n\n"}]
    assert wire.parse_closure(wire.closure(bare, [key], recs)) == (bare, [key], recs)
    table = [(key, parents, 0, len(body)), (key, [], len(body), len(body))]
    assert wire.parse_block(wire.block(table, body)) == (table, body)
    got = list(wire.parse_stream([wire.record("fulltext", key, parents, bare, body), wire.closure(False, [], recs), wire.block(table, body)]))
    assert len(got) == 5 and got[3]["body"] == body


def test_wire_errors():
    whole = wire.block([(("a",), None, 0, 3)], b"abc")
    for bad in (b"", b"x", b"groupcompress-block\n1\n", whole[:-1], whole + b"x"):
        with pytest.raises(ValueError):
            wire.parse_block(bad)
    with pytest.raises(ValueError):
        wire.parse_record(b"fulltext\nk\n\n"[:-1])
    with pytest.raises(ValueError):
        wire.parse_closure(wire.closure(True, [("a",)], [{"key": ("a",), "parents": None, "method": "fulltext", "bare_end": False, "next": None, "body": b"abc"}])[:-1])


def tree_of(items, most, prefix="", depth=0):
    """Pages of a map, by recursion."""
    place = lambda x: hashlib.sha1(x[0].encode()).hexdigest()[: depth + 1]
    if sum(40 + len(k) + len(v) for k, v in items) <= most or len(items) == 1:
        return {prefix: sorted(items)}
    out = {prefix: None}
    for c in sorted({place(x) for x in items}):
        out |= tree_of([x for x in items if place(x) == c], most, c, depth + 1)
    return out


def test_built_map(spark):
    rng = random.Random(5)
    items = sorted({"".join(rng.choices("abc", k=rng.randrange(1, 9))): "\n".join("v" * rng.randrange(9) for _ in range(rng.randrange(1, 3))) for _ in range(120)}.items())
    df = spark.createDataFrame(items, "key string, value string")
    got = {r.prefix: r for r in contentmap.built_map(df, 300).collect()}
    want = tree_of(items, 300)
    assert set(got) == set(want)
    for prefix, leaf in want.items():
        if leaf is not None:
            p = contentmap.parse_leaf(got[prefix].text)
            assert [("\0".join(k), v) for k, v in p["items"]] == leaf and all(k.startswith(p["prefix"]) for k, _ in leaf)
        else:
            p = contentmap.parse_inner(got[prefix].text)
            assert dict(p["children"]) == {c: got[c].page for c in want if len(c) == len(prefix) + 1 and c.startswith(prefix)}
    again = contentmap.built_map(df.orderBy(F.rand(3)).repartition(5), 300).where("depth = 0").first().page
    assert again == got[""].page and contentmap.built_map(df.where("key <> 'a'").withColumn("value", F.concat("value", F.lit("!"))), 300).where("depth = 0").first().page != again
    assert contentmap.built_map(df.limit(0), 300).count() == 0
    for bad in ("", "chkleaf:\n1\n1\n1\n\n", "chknode:\n1\n1\n0\n\n", "x\n1\n1\n1\n\n"):
        with pytest.raises(ValueError):
            (contentmap.parse_inner if bad.startswith("chknode") else contentmap.parse_leaf)(bad)


def test_merges_without_base(spark):
    a, b = (["1\n", "2\n", "x\n", "4\n"], ["1\n", "y\n", "4\n", "5\n"])
    rows = spark.createDataFrame([("k", a, b)], "key string, a array<string>, b array<string>")
    plan = rows.select("key", F.posexplode(text.two_way_column(F.col("a"), F.col("b"))).alias("pos", "x")).select("key", "pos", "x.state", "x.line")
    got = text.merged_texts(plan, "key").first()
    assert got.n_conflicts == 2 and got.text == "1\n<<<<<<< \n2\nx\n=======\ny\n>>>>>>> \n4\n<<<<<<< \n=======\n5\n>>>>>>> \n"
    wide = text.line_plans(spark.createDataFrame([("k", ["b\n"], ["p\n", "same\n", "q\n"], ["r\n", "same\n", "s\n"])], "key string, base array<string>, a array<string>, b array<string>"))
    segments = text.merged_segments(wide, "key")
    assert segments.count() == 1 and segments.first().conflict
    cut = text.reduced(segments, "key").orderBy("segment", "part").collect()
    assert [(r.conflict, r.lines, r.a, r.b) for r in cut] == [(True, None, ["p\n"], ["r\n"]), (False, ["same\n"], ["same\n"], ["same\n"]), (True, None, ["q\n"], ["s\n"])]


def test_lca_plan():
    a, b = ["1", "new", "both", "old"], ["1", "both", "theirs"]
    assert text.lca_plan(a, b, [["1", "both", "old"]]) == [("unchanged", "1"), ("new-a", "new"), ("unchanged", "both"), ("killed-b", "old"), ("new-b", "theirs")]
    assert ("conflicted-a", "old") in text.lca_plan(a, b, [["1", "both", "old"], ["1", "both"]])


def test_plan_difference():
    plan = [("unchanged", "1"), ("new-b", "x"), ("killed-b", "2"), ("new-a", "y"), ("new-b", "z")]
    assert text.plan_difference(plan, plan[:4]) == [("unchanged", "1"), ("unchanged", "2"), ("new-a", "y"), ("new-b", "z")]
    assert text.plan_difference(plan, []) == plan and text.plan_difference([], plan) == []


def test_whole_versions(spark):
    chain = {f"v{i:02d}": [f"v{i - 1:02d}"] if i else [] for i in range(12)}
    whole = graph.by_ancestors(chain, 3)
    assert whole == ["v00", "v04", "v08"]
    merge = {"a": [], "b": ["a"], "c": ["a", "ghost"], "d": ["b", "c"]}
    assert graph.by_ancestors(merge, 2) == ["a", "d"] and graph.by_ancestors(merge, 3) == ["a"] and graph.by_ancestors({}, 1) == []
    nodes_ = spark.createDataFrame([(f, v) for f in "fg" for v in chain], "file string, node string")
    edges = spark.createDataFrame([(f, c, p) for f in "fg" for c, ps in chain.items() for p in ps], "file string, child string, parent string")
    assert {tuple(r) for r in graph.snapshot_selection(edges, nodes_, "file", 3).collect()} == {(f, v) for f in "fg" for v in whole}


def test_long_chain_of_versions(spark):
    rng = random.Random(2)
    lines, rows = [f"{i}\n" for i in range(30)], []
    for k in range(450):
        rows.append((f"v{k}", f"v{k - 1}" if k else None, list(lines)))
        i = rng.randrange(len(lines))
        lines[i : i + rng.randrange(3)] = [f"{k}.{j}\n" for j in range(rng.randrange(1, 3))]
    v = spark.createDataFrame(rows + [("lost", "gone", ["x\n"]), ("empty", None, None)], "key string, parent string, lines array<string>")
    stored = versions.stored(v).cache()
    assert 3 <= stored.where("lines IS NOT NULL").count() < 20
    got = {r.key: r for r in versions.fulltexts(stored).collect()}
    assert all(got[k].lines == ls and got[k].intact for k, _, ls in rows) and got["empty"].lines == []
    broken = stored.where("key <> 'v0'")
    lost = {r.key for r in versions.fulltexts(broken).where("NOT intact").collect()}
    assert "v1" in lost and "v449" not in lost and "v0" not in lost
    blocks = stored.where("hunks IS NOT NULL AND key = 'v5'").select(versions.delta_blocks(F.col("hunks"), F.col("n_lines")).alias("b")).first().b
    assert sum(x.n for x in blocks) <= len(rows[4][2]) and blocks[-1].n == 0 and all(rows[4][2][x.a : x.a + x.n] == rows[5][2][x.b : x.b + x.n] for x in blocks)
    grown = versions.inserted(stored.where("key IN ('v0', 'v1', 'v2')"), v.where("key IN ('v2', 'v3')"))
    assert {r.key: r.lines for r in versions.fulltexts(grown).collect()} == {k: ls for k, _, ls in rows[:4]}


def test_insert_problems(spark):
    rows = [("ok", ["old"], ["a\n", "b"], None), ("r:", [], ["a\n"], None), ("cut", [], ["a", "b\n"], None), ("two", [], ["a\nb\n"], None), ("sha", [], ["a\n"], "0"), ("old", [], ["z\n"], None), ("far", ["nowhere", "ok"], [], None)]
    t = spark.createDataFrame(rows, "key string, parents array<string>, lines array<string>, sha1 string")
    got = {(r.key, r.problem) for r in versions.insert_problems(t, spark.createDataFrame([("old", "1")], "key string, sha1 string")).collect()}
    assert got == {("r:", "reserved key"), ("cut", "not whole lines"), ("two", "not whole lines"), ("sha", "sha1 differs"), ("old", "key exists with another text"), ("far", "missing parent")}


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(S.precise_date(F.lit(1120153132.350850105), F.lit(-18000)))[:29] == "Thu 2005-06-30 12:38:52.35085" and get(S.precise_date(F.lit(0.5), F.lit(None).cast("int"))) == "Thu 1970-01-01 00:00:00.500000000 +0000"
    back = get(S.parse_precise_date(F.lit("Thu 2005-06-30 12:38:52.350850105 -0530")))
    assert abs(back.timestamp - 1120154932.350850105) < 1e-6 and back.offset == -19800 and get(S.parse_precise_date(F.lit("x 2005"))) is None
    assert get(S.split_path(F.lit("a/./b//c"))) == ["a", "b", "c"] and get(S.mode_kind(F.lit(0o100644))) == "file" and get(S.mode_kind(F.lit(0o120777))) == "symlink" and get(S.mode_kind(F.lit(0))) == "unknown"
    with pytest.raises(Exception):
        get(S.split_path(F.lit("a/../b")))
    assert [tuple(b) for b in get(S.bugs(F.create_map(F.lit("bugs"), F.lit("http://x/1 fixed\nhttp://x/2 related"))))] == [("http://x/1", "fixed"), ("http://x/2", "related")]
    assert get(S.new_file_id(F.lit("..Über File.TXT"), F.lit(0.0))).startswith("berfile.txt-19700101000000-") and get(S.new_revision_id(F.lit("Joe <Joe@x.example>"), F.lit(0.0))).startswith("joe@x.example-19700101000000-")
    assert get(S.xml_storable(F.lit("a\x0cb"))) == "a\\x0cb" and get(S.is_tag(F.lit("a-b_1"))) and not get(S.is_tag(F.lit("a b")))
    assert get(S.replaced(F.lit("a.b aa.b a"), {"a.b": "X", "a": "a.b"})) == "X a.bX a.b" and get(S.replaced(F.lit("q"), {})) == "q"
    assert tuple(get(S.name_is_normal(F.lit("e\u0301")))) == ("é", False) and tuple(get(S.name_is_normal(F.lit("a")))) == ("a", True)
    assert get(S.estimated_records(F.lit(10))) == 103 and get(S.escaped_partition(F.lit("Ab"))).endswith("/%2541b")
    assert get(contentmap.common_prefix(F.array(F.lit("abc"), F.lit("abd"), F.lit("abce")))) == "ab" and get(contentmap.common_prefix(F.array().cast("array<string>"))) is None


def test_registry_and_filters(spark):
    r = registry.codecs()
    assert "paged-index" in r.names() and len(r.get("wire-record")) == 2
    r.add_lazy("mine", lambda: "made")
    assert r.get("mine") == "made"
    for bad in (lambda: r.add("mine", 1), lambda: r.get("none")):
        with pytest.raises((ValueError, KeyError)):
            bad()
    r.remove("mine")
    upper = registry.Filter("upper", F.upper, F.lower)
    df = spark.createDataFrame([("a\nb\n",)], "t string")
    seen = df.select(registry.reading(F.col("t"), [registry.line_ends(), upper]).alias("t"))
    assert seen.first().t == "A\r\nB\r\n" and seen.select(registry.writing(F.col("t"), [registry.line_ends(), upper]).alias("t")).first().t == "a\nb\n"


def test_worktree(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    for name, body in {"a.txt": "one", "d/b c.txt": "two", "d/e/ü.txt": "three", "d/skip.pyc": "x"}.items():
        (tmp_path / name).write_text(body)
    files = worktree.scan(spark, str(tmp_path), r"\.pyc$")
    assert {(r.path, r.size) for r in files.collect()} == {("a.txt", 3), ("d/b c.txt", 3), ("d/e/ü.txt", 5)} and {r.path for r in worktree.folders(files).collect()} == {"d", "d/e"}
    recorded = files.select("path", "size", "sha1").where("path <> 'a.txt'").withColumn("sha1", F.when(F.col("size") == 5, "0").otherwise(F.col("sha1"))).unionByName(spark.createDataFrame([("gone", 1, "1")], "path string, size bigint, sha1 string"))
    assert {tuple(r) for r in worktree.differences(recorded, files).collect()} == {("a.txt", "unknown"), ("d/e/ü.txt", "modified"), ("gone", "missing")}
    cache = files.withColumn("read_at", F.col("modified") + F.expr("INTERVAL 10 SECONDS")).withColumn("sha1", F.lit("cached"))
    assert {r.sha1 for r in worktree.cached_hashes(files, cache).collect()} == {"cached"} and not any(r.reused for r in worktree.cached_hashes(files, cache.withColumn("read_at", F.col("modified"))).collect())


def test_packs(spark):
    rows = [(f"k{i}", None if i == 3 else bytes([i % 7]) * (i % 5) + b"\n\nB") for i in range(40)]
    made = packs.packed(spark.createDataFrame(rows, "key string, body binary"), 9).cache()
    assert made.count() > 2 and {r.pack for r in made.collect()} == {r.pack for r in packs.packed(spark.createDataFrame(rows[::-1], "key string, body binary"), 9).collect()}
    assert {r.key: bytes(r.body) for r in packs.read_packed(made, packs.pack_index(made)).collect()} == {k: b or b"" for k, b in rows}
    v = spark.createDataFrame([("N12 34",), ("5 6",), ("1 2 3 4",), (None,), ("",)], "v string")
    assert [tuple(r.p) if r.p else None for r in v.select(packs.position(F.col("v")).alias("p")).collect()][:2] == [(12, 34, True), (5, 6, False)]
    assert tuple(v.where("v = '1 2 3 4'").select(packs.block_position(F.col("v")).alias("p")).first().p) == (1, 2, 3, 4)
    seen = packs.first_seen_groups(spark.createDataFrame([("b/1", 0), ("a/1", 1), ("b/2", 2)], "key string, pos int")).orderBy("first", "pos").collect()
    assert [r.key for r in seen] == ["b/1", "b/2", "a/1"]


def test_weave_problems(spark):
    weaves = spark.createDataFrame([("w", 0, 0, [1], "a\n"), ("w", 1, 1, [], "b\n"), ("w", 2, 0, [2], "c\n")], "weave string, pos int, ins int, dels array<int>, line string")
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    v = spark.createDataFrame([("w", 0, [0], sha("a\nc\n")), ("w", 1, [0, 1], sha("b\nc\n")), ("w", 2, [2], sha("")), ("w", 3, [0, 3], sha("x"))], "weave string, version int, ancestry array<int>, sha1 string")
    assert {tuple(r)[1:] for r in text.weave_problems(weaves, v).collect()} == {(2, "deletes a line that it does not have"), (3, "another text")}


def test_gaps_and_places(spark):
    df = spark.createDataFrame([(list("abcxd"), list("bcyd"))], "a array<string>, b array<string>")
    r = df.withColumn("m", text.blocks_column(F.col("a"), F.col("b"))).select(text.gaps(F.col("m"), "a", F.size("a")).alias("a"), text.gaps(F.col("m"), "b", F.size("b")).alias("b")).first()
    assert [tuple(x) for x in r.a] == [(0, 1), (3, 4)] and [tuple(x) for x in r.b] == [(2, 3)]
    paths = F.array(*[F.lit(x) for x in ("a", "b", "a/a", "a/b", "a/b/c", "a-b/c")])
    got = spark.range(1).select(S.place_left(paths, F.lit("a/b")).alias("l"), S.place_right(paths, F.lit("a/b")).alias("r"), S.block_place(F.array(F.lit(""), F.lit("a"), F.lit("a/b"), F.lit("a-b")), F.lit("a/b")).alias("d")).first()
    assert (got.l, got.r, got.d) == (3, 4, 2)


def test_build_ranking():
    chain = {f"v{i}": [f"v{i - 1}"] if i else ["ghost"] for i in range(5)}
    assert graph.build_ranking(chain, {"v0"})[0] == "v2" and sorted(graph.build_ranking(chain, set())) == sorted(chain) and graph.build_ranking({}, set()) == []
