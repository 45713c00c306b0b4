"""Records as they travel: single records, closures of deltas, blocks with their record table.

A key is a tuple of strings joined by NUL, parents are keys joined by tabs; a record whose
parents are unknown says so, which is not the same as having none.
"""

import zlib
from collections.abc import Iterator

UNKNOWN = b"None:"  # fixed value: parents that are not known
BLOCK, CLOSURE = b"groupcompress-block", b"knit-delta-closure"  # fixed values: kinds on the wire

Key = tuple[str, ...]


def _key(key: Key) -> bytes:
    return "\0".join(key).encode()


def _parents(parents: list[Key] | None) -> bytes:
    return UNKNOWN if parents is None else b"\t".join(map(_key, parents))


def _as_key(line: bytes) -> Key:
    return tuple(p.decode() for p in line.split(b"\0"))


def _as_parents(line: bytes) -> list[Key] | None:
    return None if line == UNKNOWN else [_as_key(p) for p in line.split(b"\t") if p]


def _lines(data: bytes, at: int, n: int) -> tuple[list[bytes], int]:
    """``n`` lines from ``at`` on and the place behind them."""
    out = []
    for _ in range(n):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("a record is cut short")
        out.append(data[at:end])
        at = end + 1
    return out, at


def record(kind: str, key: Key, parents: list[Key] | None, bare_end: bool, body: bytes) -> bytes:
    """One record; ``bare_end`` says that the text's last line lacks its line feed."""
    return b"\n".join([kind.encode(), _key(key), _parents(parents), (b"N" if bare_end else b" ") + body])


def parse_record(data: bytes) -> dict:
    (kind, key, parents), at = _lines(data, 0, 3)
    if at >= len(data):
        raise ValueError("a record without its flag")
    return {"kind": kind.decode(), "key": _as_key(key), "parents": _as_parents(parents), "bare_end": data[at : at + 1] == b"N", "body": data[at + 1 :]}


def closure(annotated: bool, emit: list[Key], records: list[dict]) -> bytes:
    """Records (key, parents, method, bare_end, next, body) from which the texts of the keys ``emit`` can be built."""
    out = [CLOSURE, b"annotated" if annotated else b"", b"\t".join(map(_key, emit))]
    parts = ["\n".encode().join(out) + b"\n"]
    for r in records:
        head = [_key(r["key"]), _parents(r["parents"]), r["method"].encode(), b"T" if r["bare_end"] else b"F", _key(r["next"]) if r["next"] else b"", str(len(r["body"])).encode()]
        parts.append(b"\n".join(head) + b"\n" + r["body"])
    return b"".join(parts)


def parse_closure(data: bytes) -> tuple[bool, list[Key], list[dict]]:
    (kind, flag, emit), at = _lines(data, 0, 3)
    if kind != CLOSURE:
        raise ValueError("not a closure of deltas")
    records = []
    while at < len(data):
        (key, parents, method, bare, nxt, size), at = _lines(data, at, 6)
        body = data[at : at + int(size)]
        if len(body) != int(size):
            raise ValueError("a record is cut short")
        at += int(size)
        records.append({"key": _as_key(key), "parents": _as_parents(parents), "method": method.decode(), "bare_end": bare == b"T", "next": _as_key(nxt) if nxt else None, "body": body})
    return flag == b"annotated", [_as_key(k) for k in emit.split(b"\t") if k], records


def block(table: list[tuple[Key, list[Key] | None, int, int]], content: bytes) -> bytes:
    """A block behind its table of (key, parents, start, end)."""
    rows = b"".join(b"\n".join([_key(k), _parents(p), str(a).encode(), str(b).encode()]) + b"\n" for k, p, a, b in table)
    packed = zlib.compress(rows)
    return b"\n".join([BLOCK, *(str(len(x)).encode() for x in (packed, rows, content))]) + b"\n" + packed + content


def parse_block(data: bytes) -> tuple[list[tuple[Key, list[Key] | None, int, int]], bytes]:
    (kind, *sizes), at = _lines(data, 0, 4)
    if kind != BLOCK:
        raise ValueError("not a block")
    n_packed, n_rows, n_content = map(int, sizes)
    packed, content = data[at : at + n_packed], data[at + n_packed :]
    rows = zlib.decompress(packed)
    if len(packed) != n_packed or len(rows) != n_rows or len(content) != n_content:
        raise ValueError("a block of another size than said")
    lines = rows.split(b"\n")
    if lines.pop() or len(lines) % 4:
        raise ValueError("a block's table is cut short")
    return [(_as_key(k), _as_parents(p), int(a), int(b)) for k, p, a, b in zip(*(lines[i::4] for i in range(4)))], content


def parse_stream(messages: list[bytes]) -> Iterator[dict]:
    """Records of a stream of messages of any kind, as (kind, key, parents, body); blocks give a row a table entry."""
    for m in messages:
        kind = m.split(b"\n", 1)[0]
        if kind == BLOCK:
            table, content = parse_block(m)
            yield from ({"kind": BLOCK.decode(), "key": k, "parents": p, "body": content[a:b]} for k, p, a, b in table)
        elif kind == CLOSURE:
            _, _, records = parse_closure(m)
            yield from ({"kind": CLOSURE.decode(), "key": r["key"], "parents": r["parents"], "body": r["body"]} for r in records)
        else:
            r = parse_record(m)
            yield {k: r[k] for k in ("kind", "key", "parents", "body")}
