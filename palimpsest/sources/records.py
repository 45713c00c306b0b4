"""Record-level codecs: framed text records, line deltas, weave files, binary deltas, blocks, caches, XML.

All work on the bytes of one record or file; use them through ``formats.read_files`` or in
Arrow batches. First lines that only name a format are parameters.
"""

import gzip
import hashlib
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator

from palimpsest.sources.formats import parse_varint, varint

# ---- framed text record: version line, lines, end line; deflated as one gzip member ----


def text_record(version: str, lines: list[str]) -> bytes:
    if lines and not lines[-1].endswith("\n"):
        raise ValueError("the last line has no line feed")
    digest = hashlib.sha1("".join(lines).encode()).hexdigest()
    body = f"version {version} {len(lines)} {digest}\n{''.join(lines)}end {version}\n"
    return gzip.compress(body.encode(), mtime=0)


def parse_text_record(data: bytes, version: str | None = None) -> tuple[str, list[str], str]:
    lines = [x + "\n" for x in gzip.decompress(data).decode().split("\n")[:-1]]  # other line ends are text
    head = lines[0].split() if lines else []
    if len(head) != 4 or head[0] != "version":
        raise ValueError("bad record header")
    if version is not None and head[1] != version:
        raise ValueError(f"record of {head[1]!r} instead of {version!r}")
    if lines[-1] != f"end {head[1]}\n" or int(head[2]) != len(lines) - 2:
        raise ValueError("record is cut")
    return head[1], lines[1:-1], head[3]


# ---- line deltas: `start,end,count` and the new lines, plain or with their origins ----


def line_delta_text(hunks: list[tuple[int, int, list]], annotated: bool = False) -> list[str]:
    out = []
    for start, end, lines in hunks:
        out.append(f"{start},{end},{len(lines)}\n")
        out += [f"{o} {x}" for o, x in lines] if annotated else lines
    return out


def parse_line_delta(lines: list[str], annotated: bool = False) -> list[tuple[int, int, list]]:
    out, at = [], 0
    while at < len(lines):
        start, end, n = map(int, lines[at].split(","))
        part = lines[at + 1 : at + 1 + n]
        if len(part) < n:
            raise ValueError("delta is cut")
        out.append((start, end, [tuple(x.split(" ", 1)) for x in part] if annotated else part))
        at += 1 + n
    return out


def annotated_text(rows: list[tuple[str, str]]) -> list[str]:
    return [f"{o} {x}" for o, x in rows]


def parse_annotated(lines: list[str]) -> list[tuple[str, str]]:
    return [tuple(x.split(" ", 1)) for x in lines]


def without_eol(lines: list[str]) -> tuple[list[str], bool]:
    """Lines with a line feed added to the last where it lacks one, and that flag."""
    bare = bool(lines) and not lines[-1].endswith("\n")
    return ([*lines[:-1], lines[-1] + "\n"] if bare else lines), bare


# ---- index rows of framed records: id, options, position, size, parents by number or .name ----


def record_index_rows(rows: list[tuple[str, list[str], int, int, list[str]]], first: str = "# record index 8") -> bytes:
    number, out = {}, [first + "\n"]
    for k, (rid, options, pos, size, parents) in enumerate(rows):
        named = [str(number[p]) if p in number else f".{p}" for p in parents]
        out.append(" ".join(["\n" + rid, ",".join(options), str(pos), str(size), *named, ":"]))
        number.setdefault(rid, k)
    return "".join(out).encode()


def parse_record_index(data: bytes) -> Iterator[dict]:
    ids: list[str] = []
    for line in data.decode().split("\n")[1:]:
        parts = line.split(" ")
        if len(parts) < 5 or parts[-1] != ":":
            continue  # a row that was cut while being written does not count
        rid, options, pos, size, *refs = parts[:-1]
        ids.append(rid)
        yield {"rid": rid, "options": options.split(","), "pos": int(pos), "size": int(size), "parents": [r[1:] if r.startswith(".") else ids[int(r)] for r in refs]}


# ---- weave file: per version parents, digest and name, then bracketed instructions ----


def weave_file(versions: list[tuple[str, list[int], str]], rows: list[tuple[int, tuple[int, ...], str]], first: str = "# weave file 5") -> bytes:
    """versions: (name, parent numbers, sha1); rows: (insert, deletes, line) as ``operators.text.weave`` makes them."""
    out = [first + "\n"]
    for name, parents, sha1 in versions:
        out.append("i" + "".join(f" {p}" for p in parents) + f"\n1 {sha1}\nn {name}\n\n")
    out.append("w\n")
    for insert, deletes, line in rows:
        out.append(f"{{ {insert}\n" + "".join(f"[ {d}\n" for d in deletes))
        out.append(f". {line}" if line.endswith("\n") else f", {line}\n")
        out.append("".join(f"] {d}\n" for d in reversed(deletes)) + "}\n")
    return "".join([*out, "W\n"]).encode()


def parse_weave_file(data: bytes) -> tuple[list[tuple[str, list[int], str]], list[tuple[int, tuple[int, ...], str]]]:
    lines = iter(data.decode().splitlines(keepends=True)[1:])
    versions, rows, inserts, deletes = [], [], [], []
    for line in lines:
        if line == "w\n":
            break
        parents = [int(x) for x in line.split()[1:]]
        sha1, name = next(lines).split()[1], next(lines)[2:-1]
        next(lines)
        versions.append((name, parents, sha1))
    for line in lines:
        kind, rest = line[:1], line[2:]
        if line == "W\n":
            if inserts or deletes:
                raise ValueError("open brackets at the end")
            return versions, rows
        if kind == "{":
            inserts.append(int(rest))
        elif kind == "}":
            inserts.pop()
        elif kind == "[":
            deletes.append(int(rest))
        elif kind == "]":
            deletes.remove(int(rest))
        else:
            rows.append((inserts[-1], tuple(deletes), rest if kind == "." else rest[:-1]))
    raise ValueError("weave is cut")


# ---- multi-parent diff text: `i n` with lines, `c parent parent_pos child_pos n` ----


def multi_parent_text(hunks: list[tuple]) -> list[str]:
    out = []
    for h in hunks:
        if h[0] == "new":
            out += [f"i {len(h[1])}\n", *h[1], "\n"]
        else:
            out.append("c {} {} {} {}\n".format(*h[1:]))
    return out


def parse_multi_parent(lines: list[str]) -> list[tuple]:
    out, at = [], 0
    while at < len(lines):
        kind, *nums = lines[at].split()
        if kind == "i":
            n = int(nums[0])
            out.append(("new", lines[at + 1 : at + 1 + n]))
            at += n + 2
        else:
            out.append(("parent", *map(int, nums)))
            at += 1
    return out


# ---- binary delta: length of the result, then copy (offset, length) and insert instructions ----


def _copy(offset: int, length: int) -> bytes:
    op, tail = 0x80, bytearray()
    for i in range(4):
        if b := offset >> 8 * i & 0xFF:
            op |= 1 << i
            tail.append(b)
    if length != 0x10000:
        for i in range(2):
            if b := length >> 8 * i & 0xFF:
                op |= 0x10 << i
                tail.append(b)
    return bytes([op]) + bytes(tail)


def binary_delta(source: bytes, target: bytes, window: int = 16) -> bytes:
    """Copies of at least ``window`` bytes are found by the hash of aligned source windows."""
    places = {}
    for i in range(0, len(source) - window + 1, window):
        places.setdefault(source[i : i + window], i)
    out, pending, at = [varint(len(target))], bytearray(), 0

    def flush() -> None:
        for k in range(0, len(pending), 127):
            part = pending[k : k + 127]
            out.append(bytes([len(part)]) + bytes(part))
        pending.clear()

    while at < len(target):
        i = places.get(target[at : at + window])
        if i is None:
            pending.append(target[at])
            at += 1
            continue
        back = 0
        while back < len(pending) and i - back > 0 and source[i - back - 1] == pending[-1 - back]:
            back += 1
        if back:
            del pending[-back:]
        n = window
        while at + n < len(target) and i + n < len(source) and source[i + n] == target[at + n]:
            n += 1
        flush()
        i, length = i - back, n + back
        while length:
            step = min(length, 0x10000)
            out.append(_copy(i, step))
            i, length = i + step, length - step
        at += n
    flush()
    return b"".join(out)


def apply_binary_delta(source: bytes, delta: bytes) -> bytes:
    want, at = parse_varint(delta)
    out = bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op == 0:
            raise ValueError("reserved instruction")
        if op < 0x80:
            if at + op > len(delta):
                raise ValueError("insert is cut")
            out += delta[at : at + op]
            at += op
            continue
        offset = length = 0
        for i in range(4):
            if op & 1 << i:
                offset |= delta[at] << 8 * i
                at += 1
        for i in range(3):
            if op & 0x10 << i:
                length |= delta[at] << 8 * i
                at += 1
        length = length or 0x10000
        if offset + length > len(source):
            raise ValueError("copy beyond the source")
        out += source[offset : offset + length]
    if len(out) != want:
        raise ValueError("wrong length")
    return bytes(out)


# ---- block of texts: header, sizes, deflated content; a text is full (f) or a delta (d) against the block so far ----


class BlockWriter:
    """Groups similar texts: each is stored whole or as delta against what came before, whichever is at most half its size."""

    def __init__(self):
        self.content, self.places = bytearray(), {}

    def add(self, key: str, text: bytes) -> tuple[int, int]:
        if not text:
            self.places[key] = (0, 0)
            return 0, 0
        delta = binary_delta(bytes(self.content), text) if self.content else None
        kind, body = (b"d", delta) if delta is not None and len(delta) * 2 <= len(text) else (b"f", text)
        start = len(self.content)
        self.content += kind + varint(len(body)) + body
        self.places[key] = (start, len(self.content))
        return self.places[key]

    def block(self, first: str = "block z 1") -> bytes:
        z = zlib.compress(bytes(self.content))
        return f"{first}\n{len(z)}\n{len(self.content)}\n".encode() + z


def block_content(block: bytes) -> bytes:
    _, z, n, body = block.split(b"\n", 3)
    content = zlib.decompress(body[: int(z)])
    if len(content) != int(n):
        raise ValueError("wrong block length")
    return content


def block_text(content: bytes, start: int, end: int) -> bytes:
    if start == end == 0:
        return b""
    n, at = parse_varint(content, start + 1)
    body = content[at : at + n]
    if at + n != end:
        raise ValueError("text does not end where its record says")
    return body if content[start : start + 1] == b"f" else apply_binary_delta(content[:start], body)


# ---- stat cache: path// sha1 size mtime ctime ino dev mode ----


def stat_cache(rows: list[tuple], first: str = "### stat cache 5") -> bytes:
    return "".join([first + "\n", *(f"{p}// {' '.join(map(str, rest))}\n" for p, *rest in sorted(rows))]).encode()


def parse_stat_cache(data: bytes) -> Iterator[dict]:
    for line in data.decode().split("\n")[1:]:
        path, sep, rest = line.partition("// ")
        fields = rest.split(" ")
        if sep and len(fields) == 7:  # damaged rows only cost a recomputation
            yield {"path": path, "sha1": fields[0], **{k: int(v) for k, v in zip(("size", "mtime", "ctime", "ino", "dev", "mode"), fields[1:])}}


# ---- XML revisions and inventories ----


def revision_xml(r: dict) -> bytes:
    e = ET.Element("revision", {"format": "8", "revision_id": r["revision_id"], "inventory_sha1": r["inventory_sha1"] or "", "timestamp": f"{r['timestamp']:.3f}"})
    if r.get("committer") is not None:
        e.set("committer", r["committer"])
    if r.get("timezone") is not None:
        e.set("timezone", str(r["timezone"]))
    ET.SubElement(e, "message").text = r.get("message") or ""
    parents = ET.SubElement(e, "parents")
    for p in r.get("parent_ids") or []:
        ET.SubElement(parents, "revision_ref", {"revision_id": p})
    if r.get("properties"):
        props = ET.SubElement(e, "properties")
        for k in sorted(r["properties"]):
            ET.SubElement(props, "property", {"name": k}).text = r["properties"][k]
    return ET.tostring(e)


def parse_revision_xml(data: bytes) -> dict:
    e = ET.fromstring(data)
    a = e.attrib
    return {
        "revision_id": a["revision_id"], "inventory_sha1": a.get("inventory_sha1") or None, "timestamp": float(a["timestamp"]), "committer": a.get("committer"), "timezone": int(a["timezone"]) if "timezone" in a else None,
        "message": e.findtext("message") or "", "parent_ids": [p.attrib["revision_id"] for p in e.iterfind("parents/revision_ref")], "properties": {p.attrib["name"]: p.text or "" for p in e.iterfind("properties/property")},
    }


def inventory_xml(revision: str, entries: list[dict]) -> bytes:
    root = ET.Element("inventory", {"format": "8", "revision_id": revision})
    for r in entries:
        keep = {k: str(r[k]) for k in ("file_id", "parent_id", "name", "revision", "text_sha1", "text_size", "symlink_target", "reference_revision") if r.get(k) is not None}
        if r.get("executable"):
            keep["executable"] = "yes"
        ET.SubElement(root, r["kind"], keep)
    return ET.tostring(root)


def parse_inventory_xml(data: bytes) -> Iterator[dict]:
    for x in ET.fromstring(data):
        a = x.attrib
        names = ("file_id", "parent_id", "name", "revision", "text_sha1", "symlink_target", "reference_revision")
        yield {"kind": x.tag, **{k: a.get(k) for k in names}, "text_size": int(a["text_size"]) if "text_size" in a else None, "executable": a.get("executable") == "yes"}


def text_keys(xml_lines: list[str]) -> set[tuple[str, str]]:
    """(file_id, revision) named on lines of inventory XML, without parsing the document."""
    import re

    out = set()
    for line in xml_lines:
        f, r = re.search(r'file_id="([^"]*)"', line), re.search(r' revision="([^"]*)"', line)
        if f and r:
            unescape = lambda s: s.replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&apos;", "'").replace("&amp;", "&")
            out.add((unescape(f.group(1)), unescape(r.group(1))))
    return out


# ---- stanzas inside a patch: `# ` in front, long lines wrapped with a backslash ----


def patch_lines(stanza: bytes, width: int = 72) -> list[str]:
    out = []
    for line in stanza.decode().splitlines():
        line = line.replace("\\", "\\\\").replace("\t", "\\t").replace("\r", "\\r")
        while line:
            room = width - 2
            if len(line) <= room:
                out.append(f"# {line}\n")
                break
            cut = room - 1
            while line[cut - 1] == "\\":
                cut -= 1
            out.append(f"# {line[:cut]}\\\n")
            line = line[cut:]
        else:
            out.append("#\n")
    return out


def parse_patch_lines(lines: list[str]) -> bytes:
    text, open_ = [], ""
    for line in lines:
        part = line.rstrip("\n")
        part = part[2:] if part.startswith("# ") else part[1:]
        ends = len(part) - len(part.rstrip("\\"))
        if ends % 2:
            open_ += part[:-1]
            continue
        text.append(open_ + part)
        open_ = ""
    plain = {"t": "\t", "r": "\r", "\\": "\\"}
    out = []
    for line in text:
        chars, i = [], 0
        while i < len(line):
            if line[i] == "\\" and i + 1 < len(line):
                chars.append(plain.get(line[i + 1], line[i + 1]))
                i += 2
            else:
                chars.append(line[i])
                i += 1
        out.append("".join(chars))
    return "".join(x + "\n" for x in out).encode()
