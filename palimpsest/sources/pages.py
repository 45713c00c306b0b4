"""Paged index files: rows of deflated pages, the root's row first and leaves last.

The first page begins with the options. A lookup reads one page a row; a scan reads the
leaves in order. Pages are packed by asking how many sorted lines still deflate into one.
"""

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.sources.formats import NODE, parse_leaf_page

PAGE = 4096  # fixed value: bytes of a page
LEAF, INTERNAL = b"type=leaf\n", b"type=internal\n"  # fixed values: first lines of a page's text
DEFAULT_SIGNATURE = "Paged graph index 2"


def _leaf_line(key: list[str], value: str, refs: list[list[list[str]]], lists: int) -> bytes:
    middle = b"\t".join(b"\r".join("\0".join(r).encode() for r in ls) for ls in refs) if lists else b""
    return "\0".join(key).encode() + b"\0" + middle + b"\0" + value.encode() + b"\n"


def _most(lines: list[bytes], lo: int, room: int, head: bytes) -> int:
    """End of the longest stretch from ``lo`` whose page deflates into ``room`` bytes: doubling, then halving."""
    fits = lambda hi: len(zlib.compress(head + b"".join(lines[lo:hi]), 9)) <= room
    good, step = lo, 16
    while good < len(lines) and fits(min(len(lines), good + step)):
        good, step = min(len(lines), good + step), step * 2
    bad = min(len(lines), good + step) + 1
    while good + 1 < bad:
        mid = (good + bad) // 2
        good, bad = (mid, bad) if mid <= len(lines) and fits(mid) else (good, mid)
    if good == lo and lo < len(lines):
        raise ValueError("a row is larger than a page")
    return good


def paged_index_bytes(nodes: list[tuple[list[str], str, list[list[list[str]]]]], lists: int, arity: int, signature: str = DEFAULT_SIGNATURE) -> bytes:
    """A paged file of (key, value, refs) rows; keys are unique, references whole keys."""
    rows = sorted(nodes, key=lambda n: "\0".join(n[0]).encode())
    keys = ["\0".join(k).encode() for k, _, _ in rows]
    lines = [_leaf_line(k, v, r, lists) for k, v, r in rows]
    options = lambda lengths: f"{signature}\nnode_ref_lists={lists}\nkey_elements={arity}\nlen={len(rows)}\nrow_lengths={','.join(map(str, lengths))}\n".encode()
    room = PAGE - len(options([10**6] * 6))  # every page leaves room for options, so any of them may be the first
    level, pages = [], []
    at = 0
    while at < len(lines):
        end = _most(lines, at, room, LEAF)
        level.append((keys[at], LEAF + b"".join(lines[at:end])))
        at = end
    if not rows:
        return options([])
    tiers = [[text for _, text in level]]
    firsts = [k for k, _ in level]
    while len(tiers[0]) > 1:
        texts, nxt, at = [], [], 0
        while at < len(firsts):
            head = INTERNAL + f"offset={at}\n".encode()
            split = [k + b"\n" for k in firsts[at + 1 :]]
            end = at + 1 + (_most(split, 0, room, head) if split else 0)
            texts.append(head + b"".join(split[: end - at - 1]))
            nxt.append(firsts[at])
            at = end
        tiers.insert(0, texts)
        firsts = nxt
    head = options([len(t) for t in tiers])
    for text in (t for tier in tiers for t in tier):
        body = zlib.compress(text, 9)
        pages.append((head if not pages else b"") + body)
    return b"".join(p.ljust(PAGE, b"\0") for p in pages[:-1]) + pages[-1]


def parse_options(data: bytes) -> dict:
    """signature, node_ref_lists, key_elements, len, row_lengths (root first) and end of the options."""
    signature, *options = data.split(b"\n", 5)[:5]
    got = dict(x.split(b"=", 1) for x in options)
    if set(got) != {b"node_ref_lists", b"key_elements", b"len", b"row_lengths"}:
        raise ValueError("bad options")
    end = len(signature) + sum(map(len, options)) + 5
    return {"signature": signature.decode(), "lists": int(got[b"node_ref_lists"]), "arity": int(got[b"key_elements"]), "len": int(got[b"len"]), "row_lengths": [int(x) for x in got[b"row_lengths"].split(b",") if x], "end": end}


def page_text(read: Callable[[int, int], bytes], options: dict, number: int) -> bytes:
    """Inflated text of a page; ``read`` gives (offset, length) bytes, fewer at the end of the file."""
    raw = read(number * PAGE, PAGE)
    return zlib.decompressobj().decompress(raw[options["end"] :] if number == 0 else raw)


def parse_internal(text: bytes) -> tuple[int, list[bytes]]:
    """(place of the first child in its row, split keys) of an internal page."""
    kind, offset, *keys = text.split(b"\n")
    if kind + b"\n" != INTERNAL or not offset.startswith(b"offset="):
        raise ValueError("not an internal page")
    return int(offset[7:]), [k for k in keys if k]


def parse_paged_index(data: bytes) -> Iterator[dict]:
    """All rows in key order: the leaves' row, the last one, is read from its first page on."""
    o = parse_options(data)
    first = sum(o["row_lengths"][:-1])
    for k in range(first, first + (o["row_lengths"][-1] if o["row_lengths"] else 0)):
        text = page_text(lambda a, n: data[a : a + n], o, k)
        yield from parse_leaf_page(zlib.compress(text), o["arity"], o["lists"])


def find(read: Callable[[int, int], bytes], keys: list[list[str]]) -> list[dict]:
    """Rows of the requested keys; one page a row of the file and key, pages that keys share are read once."""
    o = parse_options(read(0, PAGE))
    starts = [sum(o["row_lengths"][:i]) for i in range(len(o["row_lengths"]))]
    wanted = {0: sorted({"\0".join(k).encode() for k in keys})} if o["row_lengths"] else {}
    for tier in range(len(starts) - 1):
        below: dict[int, list[bytes]] = {}
        for number, asked in wanted.items():
            first, split = parse_internal(page_text(read, o, starts[tier] + number))
            for k in asked:
                below.setdefault(first + bisect_right(split, k), []).append(k)
        wanted = below
    out = []
    for number, asked in wanted.items():
        rows = parse_leaf_page(zlib.compress(page_text(read, o, starts[-1] + number)), o["arity"], o["lists"])
        out += [r for r in rows if "\0".join(r["key"]).encode() in set(asked)]
    return out


def write_paged_indices(nodes: DataFrame, per_file: int = 50_000, signature: str = DEFAULT_SIGNATURE) -> DataFrame:
    """(index_name, bucket, n_nodes, content): paged files of about ``per_file`` rows of a combined index, by key hash."""
    counts = nodes.groupBy("index_name").count().select("index_name", F.ceil(F.col("count") / per_file).alias("n_buckets"))
    placed = nodes.join(F.broadcast(counts), "index_name").withColumn("bucket", F.pmod(F.xxhash64("key"), F.col("n_buckets")).cast("int"))  # a row an index

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [([*k], v or "", [[[*x] for x in ls] for ls in r]) for k, v, r in zip(pdf["key"], pdf["value"], pdf["refs"])]
        lists = max((len(r) for _, _, r in got), default=0)
        content = paged_index_bytes([(k, v, r + [[]] * (lists - len(r))) for k, v, r in got], lists, len(got[0][0]), signature)
        return pd.DataFrame({"index_name": [pdf["index_name"].iloc[0]], "bucket": [int(pdf["bucket"].iloc[0])], "n_nodes": [len(got)], "content": [content]})

    return placed.select("index_name", "bucket", "key", "value", "refs").groupBy("index_name", "bucket").applyInPandas(run, "index_name string, bucket int, n_nodes bigint, content binary")


def parsed_paged_indices(files: DataFrame) -> DataFrame:
    """(index_name, node) rows of paged files held in a content column."""
    def run(batches):
        for b in batches:
            for name, content in zip(b["index_name"], b["content"]):
                rows = [{"index_name": name, **r} for r in parse_paged_index(bytes(content))]
                if rows:
                    yield pd.DataFrame(rows)

    return files.select("index_name", "content").mapInPandas(run, f"index_name string, {NODE}")
