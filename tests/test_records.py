import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.operators import graph, text
from palimpsest.sources import formats as X
from palimpsest.sources import records as R


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=400), st.lists(st.tuples(st.integers(0, 390), st.integers(1, 120), st.binary(max_size=40)), max_size=6))
def test_binary_delta(source, parts):
    target = b"".join(source[i : i + n] + extra for i, n, extra in parts)
    assert R.apply_binary_delta(source, R.binary_delta(source, target)) == target


def test_binary_delta_long_and_damaged():
    rng = random.Random(2)
    big = bytes(rng.randrange(256) for _ in range(200_000))
    d = R.binary_delta(big, big[1000:] + b"tail")
    assert len(d) < 100 and R.apply_binary_delta(big, d) == big[1000:] + b"tail"
    for bad in (b"\x05\x00", b"\x05\x05ab", X.varint(3) + R._copy(0, 9)):
        with pytest.raises((ValueError, IndexError)):
            R.apply_binary_delta(b"abc", bad)


def test_text_records():
    lines = ["a\n", "b\n"]
    assert R.parse_text_record(R.text_record("v", lines))[:2] == ("v", lines)
    with pytest.raises(ValueError):
        R.text_record("v", ["a"])
    with pytest.raises(ValueError):
        R.parse_text_record(R.text_record("v", lines), "w")
    hunks = [(0, 1, ["x\n", "y z\n"]), (3, 3, [])]
    assert R.parse_line_delta(R.line_delta_text(hunks)) == hunks
    noted = [(0, 1, [("o", "x y\n")])]
    assert R.parse_line_delta(R.line_delta_text(noted, True), True) == noted
    assert R.parse_annotated(R.annotated_text([("o", "x y\n")])) == [("o", "x y\n")]
    assert R.without_eol(["a\n", "b"]) == (["a\n", "b\n"], True) and R.without_eol([]) == ([], False)
    rows = [("r1", ["fulltext"], 0, 10, []), ("r2", ["line-delta", "no-eol"], 10, 5, ["r1", "ghost"])]
    got = list(R.parse_record_index(R.record_index_rows(rows) + b"\nr3 fulltext 15"))
    assert [(x["rid"], x["options"], x["pos"], x["size"], x["parents"]) for x in got] == rows


def test_weave_and_multi_parent_files():
    versions = [("v0", [], ["a\n", "b\n"]), ("v1", ["v0"], ["a\n", "c\n", "b"]), ("v2", ["v0"], ["b\n"])]
    rows = text.weave(versions)
    head = [(v, [0] * bool(p), text.sha1_lines(x)) for v, p, x in versions]
    assert R.parse_weave_file(R.weave_file(head, rows)) == (head, rows)
    with pytest.raises(ValueError):
        R.parse_weave_file(R.weave_file(head, rows)[:-3])
    hunks = text.multi_parent_diff([["a\n", "b\n"]], ["x\n", "a\n", "b\n", "y\n"])
    assert R.parse_multi_parent(R.multi_parent_text(hunks)) == hunks


def test_blocks():
    w = R.BlockWriter()
    base = b"".join(b"line %d of the text\n" % i for i in range(200))
    texts = {"a": base, "b": base.replace(b"line 7 ", b"row 7 "), "c": b"", "d": b"other"}
    for k, t in texts.items():
        w.add(k, t)
    content = R.block_content(w.block())
    assert {k: R.block_text(content, *w.places[k]) for k in texts} == texts and len(content) < 1.2 * len(base)


def test_caches_and_xml():
    rows = [("a b", "s" * 40, 3, 1, 2, 5, 6, 33188)]
    got = list(R.parse_stat_cache(R.stat_cache(rows) + b"broken line\n"))
    assert [tuple(x.values()) for x in got] == rows
    r = {"revision_id": "r", "inventory_sha1": "s", "timestamp": 12.5, "committer": "A <é>", "timezone": -3600, "message": "m & n\nx", "parent_ids": ["p", "q"], "properties": {"k": "v\nw"}}
    assert R.parse_revision_xml(R.revision_xml(r)) == r
    e = [{"kind": "file", "file_id": "f&", "parent_id": "p", "name": "n<", "revision": "r", "text_sha1": "s", "symlink_target": None, "reference_revision": None, "text_size": 4, "executable": True}]
    x = R.inventory_xml("r", e)
    assert list(R.parse_inventory_xml(x)) == e and R.text_keys([x.decode()]) == {("f&", "r")}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab\\\t x"), min_size=1, max_size=120), min_size=1, max_size=4), st.integers(12, 40))
def test_patch_lines(lines, width):
    data = "".join(x + "\n" for x in lines).encode()
    out = R.patch_lines(data, width)
    assert R.parse_patch_lines(out) == data and all(len(x) <= width + 1 for x in out)


def test_graph_extras(spark):
    e = spark.createDataFrame([("b1", "a", 0), ("b2", "a", 0), ("c1", "b1", 0), ("c1", "b2", 1), ("c2", "b1", 0), ("c2", "b2", 1)], "child string, parent string, ord int")
    assert graph.recursive_common_ancestor(e, "c1", "c2") == [["b1", "b2"], ["a"]]
    n = spark.createDataFrame([(v, v[0]) for v in ("a", "b1", "b2", "c1", "c2")], "node string, p string")
    assert [r.node for r in graph.compression_order(e, n, "p").orderBy("p", "place").collect()] == ["a", "b1", "b2", "c1", "c2"]
    w = spark.createDataFrame([("v", ["a"], "s")], "version string, parents array<string>, sha1 string")
    assert graph.union_weaves(w, spark.createDataFrame([("v", ["b"], "s")], w.schema)).first().parents == ["a", "b"]
    with pytest.raises(Exception, match="differ"):
        graph.union_weaves(w, spark.createDataFrame([("v", ["b"], "t")], w.schema)).collect()


def test_text_record_keeps_other_line_ends():
    lines = ["a\rb\x0b\x1c\n", "\u2028\x85\n", "\n"]
    assert R.parse_text_record(R.text_record("v", lines), "v")[1] == lines
