"""Readers and writers of the store's own file formats.

Parsers work on the bytes of one file and yield rows; ``read_files`` runs them distributed
over a folder, one file a row of the binary source. Writers give (name, content) rows of
bounded size. First lines that only name a format are parameters: readers take any.
"""

import base64
import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "key array<string>, absent boolean, value string, refs array<array<array<string>>>"
RECORD = "names array<string>, body binary"
STANZA = "stanza int, pos int, tag string, value string"
STATE_ROW = "dirname string, basename string, file_id string, tree_index int, kind string, fingerprint string, size bigint, executable boolean, tail string"
DELTA_ROW = "old_path string, new_path string, file_id string, parent_id string, revision string, kind string, text_size bigint, executable boolean, text_sha1 string, symlink_target string, reference_revision string"
ENTRY_ROW = "kind string, file_id string, parent_id string, name string, revision string, text_sha1 string, text_size bigint, executable boolean, symlink_target string, reference_revision string"
DEFAULT_SIGNATURE = "graph index 1"
DEFAULT_CONTAINER = "container format 1"


def read_files(spark: SparkSession, path: str, parse: Callable[[bytes], Iterator[dict]], schema: str) -> DataFrame:
    """Rows of every file below ``path``, parsed where the file is read; a file is parsed by one task."""

    def run(batches):
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                rows = [{"file": name, **r} for r in parse(bytes(content))]
                if rows:
                    yield pd.DataFrame(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, f"file string, {schema}")


# ---- graph index: options, then one line a key: KEY NUL absent NUL offsets of references NUL value ----


def parse_graph_index(data: bytes) -> Iterator[dict]:
    head = data.split(b"\n", 4)
    if len(head) < 5:
        raise ValueError("no index header")
    options = dict(x.split(b"=", 1) for x in head[1:4])
    arity, lists = int(options[b"key_elements"]), int(options[b"node_ref_lists"])
    at = sum(len(x) + 1 for x in head[:4])
    rows, keys = [], {}
    for line in head[4].split(b"\n"):
        if line:
            parts = line.split(b"\0")
            if len(parts) != arity + 3:
                raise ValueError("a line with a wrong number of fields")
            key = [p.decode() for p in parts[:arity]]
            keys[at] = key
            rows.append((key, parts[arity] == b"a", parts[arity + 1], parts[arity + 2].decode()))
        at += len(line) + 1
    for key, absent, refs, value in rows:
        named = [] if absent or not lists else [[keys[int(o)] for o in ls.split(b"\r") if o] for ls in refs.split(b"\t")]
        yield {"key": key, "absent": absent, "value": None if absent else value, "refs": named}


def graph_index_bytes(nodes: list[tuple[list[str], str, list[list[list[str]]]]], lists: int, arity: int, signature: str = DEFAULT_SIGNATURE) -> bytes:
    """An index file of (key, value, refs); keys that are only referred to become absent lines."""
    body = {tuple(k): (v, [[tuple(x) for x in ls] for ls in refs]) for k, v, refs in nodes}
    every = sorted({*body, *(x for _, refs in body.values() for ls in refs for x in ls)})
    head = f"{signature}\nnode_ref_lists={lists}\nkey_elements={arity}\nlen={len(body)}\n".encode()

    def line(key: tuple, offset: Callable[[tuple], bytes]) -> bytes:
        value, refs = body.get(key, ("", []))
        places = b"\t".join(b"\r".join(offset(x) for x in ls) for ls in refs)
        return "\0".join(key).encode() + b"\0" + (b"" if key in body else b"a") + b"\0" + places + b"\0" + value.encode() + b"\n"

    digits = 1
    while True:  # the width of offsets depends on the size, which depends on the width
        sizes = [len(line(k, lambda _: b"0" * digits)) for k in every]
        if len(str(len(head) + sum(sizes))) <= digits:
            break
        digits += 1
    at, places = len(head), {}
    for k, n in zip(every, sizes):
        places[k] = at
        at += n
    return head + b"".join(line(k, lambda x: str(places[x]).zfill(digits).encode()) for k in every) + b"\n"


def write_graph_indices(nodes: DataFrame, per_file: int = 50_000, signature: str = DEFAULT_SIGNATURE) -> DataFrame:
    """(index_name, bucket, n_nodes, content): index files of about ``per_file`` keys, by key hash.

    ``nodes`` is a combined index (index_name, key, value, refs). The number of buckets follows the count.
    """
    counts = nodes.groupBy("index_name").count().withColumn("n_buckets", F.ceil(F.col("count") / per_file))
    rows = nodes.join(F.broadcast(counts.select("index_name", "n_buckets")), "index_name")
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.col("n_buckets")).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [([*k], v or "", [[[*x] for x in ls] for ls in r]) for k, v, r in zip(pdf["key"], pdf["value"], pdf["refs"])]
        lists = max((len(r) for _, _, r in got), default=0)
        content = graph_index_bytes([(k, v, r + [[]] * (lists - len(r))) for k, v, r in got], lists, len(got[0][0]), signature)
        return pd.DataFrame({"index_name": [pdf["index_name"].iloc[0]], "bucket": [int(pdf["bucket"].iloc[0])], "n_nodes": [len(got)], "content": [content]})

    return placed.select("index_name", "bucket", "key", "value", "refs").groupBy("index_name", "bucket").applyInPandas(run, "index_name string, bucket int, n_nodes bigint, content binary")


def parsed_graph_indices(files: DataFrame) -> DataFrame:
    """(index_name, node) rows of index files held in a content column."""

    def run(batches):
        for b in batches:
            for name, content in zip(b["index_name"], b["content"]):
                rows = [{"index_name": name, **r} for r in parse_graph_index(bytes(content))]
                if rows:
                    yield pd.DataFrame(rows)

    return files.select("index_name", "content").mapInPandas(run, f"index_name string, {NODE}")


# ---- paged index: leaf pages of sorted lines, deflated ----


def parse_leaf_page(page: bytes, arity: int, lists: int) -> Iterator[dict]:
    """Lines of one deflated leaf page: KEY NUL reference lists NUL value, references as whole keys."""
    text = zlib.decompress(page)
    kind, _, body = text.partition(b"\n")
    if kind != b"type=leaf":
        raise ValueError("not a leaf page")
    for line in body.split(b"\n"):
        if line:
            parts = line.split(b"\0")
            key = [p.decode() for p in parts[:arity]]
            value = parts[-1].decode()
            raw = b"\0".join(parts[arity:-1])
            refs = [[[e.decode() for e in r.split(b"\0")] for r in ls.split(b"\r") if r] for ls in raw.split(b"\t")] if lists else []
            yield {"key": key, "absent": False, "value": value, "refs": refs}


def leaf_page(nodes: list[tuple[list[str], str, list[list[list[str]]]]], lists: int) -> bytes:
    out = [b"type=leaf\n"]
    for key, value, refs in sorted(nodes):
        middle = b"\t".join(b"\r".join("\0".join(r).encode() for r in ls) for ls in refs) if lists else b""
        out.append("\0".join(key).encode() + b"\0" + middle + (b"\0" if lists else b"\0") + value.encode() + b"\n")
    return zlib.compress(b"".join(out))


# ---- container: B records (length, names, blank line, body) up to the end marker E ----


def parse_container(data: bytes) -> Iterator[dict]:
    at = data.index(b"\n") + 1
    while True:
        kind = data[at : at + 1]
        at += 1
        if kind == b"E":
            if at != len(data):
                raise ValueError("bytes after the end marker")
            return
        if kind != b"B":
            raise ValueError("unknown record kind or cut container")
        end = data.index(b"\n", at)
        length, at, names = int(data[at:end]), end + 1, []
        while True:
            end = data.index(b"\n", at)
            line, at = data[at:end], end + 1
            if not line:
                break
            names.append("/".join(p.decode() for p in line.split(b"\0")))
        if at + length > len(data):
            raise ValueError("cut record")
        yield {"names": names, "body": data[at : at + length]}
        at += length


def container_bytes(records: list[tuple[list[str], bytes]], first: str = DEFAULT_CONTAINER) -> bytes:
    """Names are tuples joined by ``/`` and must be unique, without white space."""
    out, seen = [first.encode() + b"\n"], set()
    for names, body in records:
        for n in names:
            if n in seen or any(c.isspace() for c in n) or not n:
                raise ValueError(f"bad or repeated name {n!r}")
            seen.add(n)
        lines = b"".join("\0".join(n.split("/")).encode() + b"\n" for n in names)
        out.append(b"B%d\n" % len(body) + lines + b"\n" + body)
    return b"".join(out) + b"E"


# ---- stanzas: tag: value, continued lines start with a tab, a blank line ends a stanza ----


def parse_stanzas(data: bytes) -> Iterator[dict]:
    stanza, pos, tag, value = 0, 0, None, None
    for line in [*data.decode().split("\n"), ""]:
        if line.startswith("\t") and tag is not None:
            value += "\n" + line[1:]
            continue
        if tag is not None:
            yield {"stanza": stanza, "pos": pos, "tag": tag, "value": value}
            tag, pos = None, pos + 1
        if not line:
            stanza, pos = stanza + (pos > 0), 0
            continue
        tag, colon, value = line.partition(": ")
        if not colon or not tag.replace("-", "a").replace("_", "a").isalnum():
            raise ValueError(f"bad line {line!r}")


def stanza_bytes(stanzas: list[list[tuple[str, str]]]) -> bytes:
    return "\n".join("".join(f"{t}: " + v.replace("\n", "\n\t") + "\n" for t, v in s) for s in stanzas).encode()


# ---- working-tree state: checksum, count, parents, ghosts, then NUL-separated rows ----


def parse_state(data: bytes) -> Iterator[dict]:
    head = data.split(b"\n", 3)
    crc, count, rest = int(head[1].split(b": ")[1]), int(head[2].split(b": ")[1]), head[3]
    if zlib.crc32(rest) != crc:
        raise ValueError("checksum differs")
    parts = rest.split(b"\0")
    n = int(parts[0])
    n_ghosts = int(parts[n + 2])
    width = 1 + max(0, n - n_ghosts)
    at, seen = n + n_ghosts + 4, 0
    while at + 3 + 5 * width <= len(parts):
        d, b, f = (x.decode() for x in parts[at : at + 3])
        for t in range(width):
            k, finger, size, x, tail = parts[at + 3 + 5 * t : at + 8 + 5 * t]
            yield {"dirname": d, "basename": b, "file_id": f, "tree_index": t, "kind": k.decode(), "fingerprint": finger.decode(), "size": int(size or 0), "executable": x == b"y", "tail": tail.decode()}
        seen += 1
        at += 4 + 5 * width
    if seen != count:
        raise ValueError(f"{seen} rows instead of {count}")


def state_bytes(parents: list[str], ghosts: list[str], rows: list[tuple[str, str, str, list[tuple]]], first: str = "state format 3") -> bytes:
    """rows: dirname, basename, file id, and per tree (kind, fingerprint, size, executable, tail); sorted by directory components."""
    line = lambda xs: "\0".join([str(len(xs)), *xs, ""])
    body = [line(parents) + "\n", line(ghosts) + "\n"]
    for d, b, f, trees in sorted(rows, key=lambda r: (r[0].split("/"), r[1], r[2])):
        cells = [x for k, p, s, e, t in trees for x in (k, p, str(s), "y" if e else "n", t)]
        body.append("\0".join([d, b, f, *cells, ""]) + "\n")
    data = "\0".join(body).encode()
    return f"{first}\ncrc32: {zlib.crc32(data)}\nnum_entries: {len(rows)}\n".encode() + data


# ---- inventory delta: five header lines, then OLD NUL NEW NUL ID NUL PARENT NUL REVISION NUL CONTENT ----


def parse_inventory_delta(data: bytes) -> Iterator[dict]:
    lines = data.decode().split("\n")
    if len(lines) < 5 or any(not x.startswith(p) for x, p in zip(lines[1:5], ("parent: ", "version: ", "versioned_root: ", "tree_references: "))):
        raise ValueError("bad delta header")
    seen: set[str] = set()
    for x in lines[5:]:
        if not x:
            continue
        old, new, fid, parent, rev, kind, *rest = x.split("\0")
        if fid in seen:
            raise ValueError(f"file id {fid!r} twice")
        seen.add(fid)
        for p in (old, new):
            if p != "None" and not p.startswith("/"):
                raise ValueError(f"path {p!r} is not absolute")
        if kind == "tree" and lines[4].endswith("false"):
            raise ValueError("tree reference where none is allowed")
        row = {"old_path": None if old == "None" else old, "new_path": None if new == "None" else new, "file_id": fid, "parent_id": parent or None, "revision": rev or None, "kind": {"dir": "directory", "link": "symlink", "tree": "tree-reference"}.get(kind, kind)}
        row |= {"text_size": int(rest[0]) if kind == "file" else None, "executable": kind == "file" and rest[1] == "Y", "text_sha1": rest[2] if kind == "file" else None}
        yield row | {"symlink_target": rest[0] if kind == "link" else None, "reference_revision": rest[0] if kind == "tree" else None}


def inventory_delta_bytes(rows: list[dict], parent: str, version: str, versioned_root: bool = True, tree_references: bool = True, first: str = "format: inventory delta 1") -> bytes:
    out = []
    for r in rows:
        kind = {"directory": "dir", "symlink": "link", "tree-reference": "tree"}.get(r["kind"], r["kind"])
        if r["new_path"] is None:
            kind = "deleted"
        tail = ["", ""] if kind == "deleted" else [str(r["text_size"] or 0), "Y" if r["executable"] else "", r["text_sha1"] or ""] if kind == "file" else [r["symlink_target"] or ""] if kind == "link" else [r["reference_revision"] or ""] if kind == "tree" else []
        out.append("\0".join([r["old_path"] or "None", r["new_path"] or "None", r["file_id"], r["parent_id"] or "", r["revision"] or "", kind, *tail]))
    flag = lambda b: "true" if b else "false"
    head = [first, f"parent: {parent}", f"version: {version}", f"versioned_root: {flag(versioned_root)}", f"tree_references: {flag(tree_references)}"]
    return "\n".join([*head, *sorted(out), ""]).encode()


# ---- tree entry as lines: kind: id / parent / name / revision / what the kind needs ----


def entry_text(r: dict) -> str:
    kind = {"directory": "dir", "tree-reference": "tree"}.get(r["kind"], r["kind"])
    lines = [f"{kind}: {r['file_id']}", r["parent_id"] or "", r["name"] or "", r["revision"] or ""]
    if kind == "file":
        lines += [r["text_sha1"] or "", str(r["text_size"] if r["text_size"] is not None else ""), "Y" if r["executable"] else "N"]
    elif kind == "symlink":
        lines.append(r["symlink_target"] or "")
    elif kind == "tree":
        lines.append(r["reference_revision"] or "")
    return "\n".join(lines)


def parse_entry(text: str) -> dict:
    lines = text.split("\n")
    kind, _, fid = lines[0].partition(": ")
    out = {"kind": {"dir": "directory", "tree": "tree-reference"}.get(kind, kind), "file_id": fid, "parent_id": lines[1] or None, "name": lines[2], "revision": lines[3] or None, "text_sha1": None, "text_size": None, "executable": False, "symlink_target": None, "reference_revision": None}
    if kind == "file":
        out |= {"text_sha1": lines[4] or None, "text_size": int(lines[5]) if lines[5] else None, "executable": lines[6] == "Y"}
    elif kind == "symlink":
        out["symlink_target"] = lines[4]
    elif kind == "tree":
        out["reference_revision"] = lines[4] or None
    return out


# ---- bencoding, as used for revisions ----


def bencode(x) -> bytes:
    if isinstance(x, int):
        return b"i%de" % x
    if isinstance(x, str):
        x = x.encode()
    if isinstance(x, bytes):
        return b"%d:" % len(x) + x
    if isinstance(x, dict):
        return b"d" + b"".join(bencode(k) + bencode(x[k]) for k in sorted(x)) + b"e"
    return b"l" + b"".join(map(bencode, x)) + b"e"


def bdecode(data: bytes):
    def at(i: int):
        c = data[i : i + 1]
        if c == b"i":
            e = data.index(b"e", i)
            return int(data[i + 1 : e]), e + 1
        if c in (b"l", b"d"):
            items, i = [], i + 1
            while data[i : i + 1] != b"e":
                x, i = at(i)
                items.append(x)
            return (items if c == b"l" else dict(zip(items[::2], items[1::2]))), i + 1
        e = data.index(b":", i)
        n = int(data[i:e])
        return data[e + 1 : e + 1 + n], e + 1 + n

    x, end = at(0)
    if end != len(data):
        raise ValueError("bytes after the value")
    return x


# ---- small codecs ----


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def parse_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            return n, at


def packed_stat(size: int, mtime: int, ctime: int, dev: int, ino: int, mode: int) -> str:
    return base64.b64encode(struct.pack(">6L", *(x & 0xFFFFFFFF for x in (size, mtime, ctime, dev, ino, mode)))).decode()
