"""Scalar functions over columns: keys, paths, dates, escapes, checks. All stay in the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# One-letter codes of entry kinds in a working-tree state.
MINIKINDS = {"a": "absent", "f": "file", "d": "directory", "r": "relocated", "l": "symlink", "t": "tree-reference"}
VERSIONABLE = ["file", "directory", "symlink", "tree-reference"]
NULL_REVISION = "null:"
_SPACE = r"[ \t\n\x0B\f\r]"


def key_is_valid(key: Column, arity: Column | int) -> Column:
    """Right arity and no element null, empty, or with white space or NUL."""
    bad = F.exists(key, lambda x: x.isNull() | (F.length(x) == 0) | x.rlike(r"[ \t\n\x0B\f\r\x00]"))
    return F.coalesce((F.size(key) == arity) & ~bad, F.lit(False))


def value_is_valid(value: Column) -> Column:
    return F.coalesce(~value.rlike(r"[\n\x00]"), F.lit(False))


def id_is_valid(i: Column) -> Column:
    return F.coalesce((F.length(i) > 0) & ~i.rlike(r"[ \t\n\r]"), F.lit(False))


def is_reserved(i: Column) -> Column:
    return F.coalesce(i.endswith(":"), F.lit(False))


def name_is_valid(name: Column) -> Column:
    return F.coalesce(~name.contains("/") & ~name.isin("", ".", ".."), F.lit(False))


def properties_are_valid(p: Column) -> Column:
    return ~F.exists(F.coalesce(F.map_keys(p), F.array().cast("array<string>")), lambda k: k.rlike(_SPACE))


def search_key_plain(key: Column) -> Column:
    return F.array_join(key, "\0")


def search_key_16(key: Column) -> Column:
    """CRC32 of each element as eight upper-case hex digits, joined by NUL."""
    return F.array_join(F.transform(key, lambda x: F.lpad(F.hex(F.crc32(x)), 8, "0")), "\0")


def search_key_255(key: Column) -> Column:
    """Big-endian CRC32 bytes of each element in hex, with the byte 0A as 5F, joined by 00."""
    byte_pairs = lambda h: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(F.substring(h, i * 2 + 1, F.lit(2)) == "0A", F.lit("5F")).otherwise(F.substring(h, i * 2 + 1, F.lit(2)))), "")
    return F.array_join(F.transform(key, lambda x: byte_pairs(F.lpad(F.hex(F.crc32(x)), 8, "0"))), "00")


def content_key(text: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.sha1(text))


def lines(text: Column) -> Column:
    """Lines with their line feeds; the last may lack one; empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(text, F.lit(r"[^\n]*\n|[^\n]+$"), F.lit(0)))


def summary_line(message: Column) -> Column:
    """First line of a message without surrounding blanks; blank lines before it are skipped."""
    return F.element_at(F.split(F.regexp_replace(message, r"^[ \t\n\x0B\f\r]+", ""), "[\r\n]"), 1)


def authors(properties: Column, committer: Column) -> Column:
    """Property `authors` by line, else `author`, else the committer; empty ones dropped."""
    many, one = F.try_element_at(properties, F.lit("authors")), F.try_element_at(properties, F.lit("author"))
    raw = F.when(many.isNotNull(), F.split(many, "\n")).when(one.isNotNull(), F.array(one)).otherwise(F.array(committer))
    return F.filter(raw, lambda x: x.isNotNull() & (x != ""))


def revision_time(timestamp: Column) -> Column:
    return F.timestamp_seconds(timestamp)


def compact_date(timestamp: Column) -> Column:
    """yyyymmddHHMMSS in UTC of epoch seconds (the session's zone must be UTC)."""
    return F.date_format(F.timestamp_seconds(F.floor(timestamp)), "yyyyMMddHHmmss")


def zone_text(offset: Column) -> Column:
    """Offset seconds as +hhmm; fractions of a minute are dropped towards zero."""
    minutes = F.floor(F.abs(offset) / 60).cast("int")
    return F.concat(F.when(offset < 0, "-").otherwise("+"), F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lpad((minutes % 60).cast("string"), 2, "0"))


def dated(timestamp: Column, offset: Column) -> Column:
    """Local time of a revision as `2024-05-01 13:00:00 +0200`; a null offset counts as 0."""
    off = F.coalesce(offset, F.lit(0))
    return F.concat(F.date_format(F.timestamp_seconds(F.floor(timestamp) + off), "yyyy-MM-dd HH:mm:ss"), F.lit(" "), zone_text(off))


def age_text(seconds: Column) -> Column:
    """Relative time in the largest unit of which two fit: `130 seconds ago`, `3 hours in the future`."""
    s = F.abs(seconds)
    units = [("second", 1, 90), ("minute", 60, 90 * 60), ("hour", 3600, 36 * 3600), ("day", 86400, 1 << 62)]
    out = None
    for name, size, below in units:
        n = F.floor(s / size)
        text = F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"))
        out = F.when(s < below, text) if out is None else out.when(s < below, text)
    return F.concat(out, F.when(seconds < 0, " in the future").otherwise(" ago"))


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def ancestor_paths(path: Column) -> Column:
    """Directories above a path, nearest first: a/b/c gives a/b and a."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(n - 1, F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))


def is_inside(parent: Column, path: Column) -> Column:
    """Equal, below, or anything where the parent is empty."""
    return (parent == "") | (parent == path) | path.startswith(F.concat(parent, F.lit("/")))


def is_inside_any(parents: list[str], path: Column) -> Column:
    out = F.lit(False)
    for p in parents:
        out = out | is_inside(F.lit(p), path)
    return out


def component_order(path: Column) -> Column:
    """Sort key of depth-first path order: arrays compare component by component."""
    return F.split(path, "/")


def mapped_partition(prefix: Column) -> Column:
    """Url-quoted first key element: bytes outside A-Z a-z 0-9 _ . - ~ / become %XX."""
    quoted = F.regexp_replace(F.url_encode(prefix), r"\+", "%20")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(quoted, "%2F", "/"), "%7E", "~"), r"\*", "%2A")


def hashed_partition(prefix: Column) -> Column:
    """Two hex digits of the low byte of Adler-32, a slash, and the quoted prefix."""
    data = F.encode(prefix, "UTF-8")
    codes = F.transform(F.sequence(F.lit(1), F.greatest(F.length(data), F.lit(1))), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("int"))
    low = F.aggregate(codes, F.lit(1), lambda a, x: (a + F.coalesce(x, F.lit(0))) % 65521)
    return F.concat(F.lower(F.lpad(F.hex(low % 256), 2, "0")), F.lit("/"), mapped_partition(prefix))


def xml_escaped(s: Column) -> Column:
    out = s
    for a, b in (("&", "&amp;"), ("'", "&apos;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def packed_stat(size: Column, mtime: Column, ctime: Column, dev: Column, ino: Column, mode: Column) -> Column:
    """Base64 of six big-endian unsigned 32-bit numbers."""
    word = lambda c: F.lpad(F.hex(F.coalesce(c, F.lit(0)).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    return F.base64(F.unhex(F.concat(*map(word, (size, mtime, ctime, dev, ino, mode)))))


def minikind(kind: Column) -> Column:
    inverse = {v: k for k, v in MINIKINDS.items()}
    return F.element_at(F.create_map(*[F.lit(x) for kv in inverse.items() for x in kv]), kind)


def kind_of(code: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in MINIKINDS.items() for x in kv]), code)


def normalized_pattern(pattern: Column) -> Column:
    """Backslashes and runs of slashes become one slash, the trailing one goes; `RE:` patterns stay."""
    plain = F.regexp_replace(pattern, r"[\\/]+", "/")
    return F.when(pattern.startswith("RE:"), pattern).otherwise(F.when(F.length(plain) > 1, F.regexp_replace(plain, "/$", "")).otherwise(plain))


def common_prefix(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda k, i: F.when((k == i - 1) & (i <= n) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(k))
    return F.substring(a, F.lit(1), same)


def split_path(path: Column) -> Column:
    """Components of a relative path without empty ones and dots; a path that climbs up is an error."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    return F.when(F.array_contains(parts, ".."), F.raise_error(F.lit("a path that climbs up"))).otherwise(parts)


def mode_kind(mode: Column) -> Column:
    """Kind of a file from its mode bits."""
    kinds = {0o100000: "file", 0o040000: "directory", 0o120000: "symlink", 0o020000: "chardev", 0o060000: "block", 0o010000: "fifo", 0o140000: "socket"}  # fixed values
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), mode.cast("int").bitwiseAND(0o170000)), F.lit("unknown"))


def is_versionable(kind: Column) -> Column:
    return kind.isin("file", "directory", "symlink", "tree-reference")


def precise_date(timestamp: Column, offset: Column) -> Column:
    """Weekday, date, time with nine decimals and offset of an instant in seconds: ``Thu 2005-06-30 12:38:52.350850105 -0500``."""
    off = F.coalesce(offset, F.lit(0)).cast("bigint")
    whole = F.floor(timestamp)
    at = F.timestamp_seconds(whole + off)
    part = F.format_string("%.9f", timestamp - whole)
    zone = F.concat(F.when(off < 0, "-").otherwise("+"), F.lpad(F.floor(F.abs(off) / 3600).cast("string"), 2, "0"), F.lpad((F.floor(F.abs(off) / 60) % 60).cast("string"), 2, "0"))
    return F.concat(F.date_format(at, "E yyyy-MM-dd HH:mm:ss"), F.substring(part, F.lit(2), F.lit(10)), F.lit(" "), zone)


def parse_precise_date(text: Column) -> Column:
    """(timestamp, offset) of ``precise_date``'s text; null where it is no such text."""
    form = r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) (\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)(\.\d+) ([+-])(\d\d)(\d\d)$"
    g = lambda i: F.regexp_extract(text, form, i)
    off = F.when(g(3) == "-", -1).otherwise(1) * (g(4).cast("int") * 3600 + g(5).cast("int") * 60)
    base = F.unix_timestamp(F.to_timestamp(g(1), "yyyy-MM-dd HH:mm:ss"))
    return F.when(text.rlike(form), F.struct((base - off + g(2).cast("double")).alias("timestamp"), off.alias("offset")))


def bugs(properties: Column) -> Column:
    """(url, status) of each line of the property ``bugs``; lines of another form are an error when read."""
    lines = F.filter(F.split(F.coalesce(F.try_element_at(properties, F.lit("bugs")), F.lit("")), "\n"), lambda x: x != "")
    pair = lambda x: F.split(x, " ")
    return F.transform(lines, lambda x: F.when((F.size(pair(x)) == 2) & pair(x)[1].isin("fixed", "related"), F.struct(pair(x)[0].alias("url"), pair(x)[1].alias("status"))).otherwise(F.raise_error(F.concat(F.lit("no bug line: "), x))))


def chars(n: int, alphabet: str = "0123456789abcdefghijklmnopqrstuvwxyz") -> Column:
    """``n`` random characters; another text in every row and run."""
    return F.array_join(F.array(*[F.substring(F.lit(alphabet), (F.floor(F.rand() * len(alphabet)) + 1).cast("int"), F.lit(1)) for _ in range(n)]), "")


def new_file_id(name: Column, timestamp: Column) -> Column:
    """Up to twenty lower-case word characters of a name, the compact date and random characters."""
    word = F.regexp_replace(F.lower(F.regexp_replace(name, r"[^\x00-\x7f]", "")), r"[^a-z0-9_.]", "")
    return F.concat(F.substring(F.regexp_replace(word, r"^\.+", ""), 1, 20), F.lit("-"), compact_date(timestamp), F.lit("-"), chars(16), F.lit("-"), F.monotonically_increasing_id().cast("string"))


def new_revision_id(committer: Column, timestamp: Column) -> Column:
    """The mailbox of a committer, or their name with underscores, the compact date and random characters."""
    mail = F.regexp_extract(committer, r"<([^<>\s]*@[^<>\s]*)>", 1)
    plain = F.regexp_replace(F.lower(F.trim(F.regexp_replace(committer, r"<[^>]*>", ""))), r"[^a-z0-9_.-]+", "_")
    return F.concat_ws("-", F.when(mail != "", F.lower(mail)).otherwise(plain), compact_date(timestamp), chars(16))


def escaped_partition(prefix: Column) -> Column:
    """``hashed_partition`` for file systems without case: upper case and unusual characters become %xx, and the hash is of that text."""
    hexed = lambda x: F.lower(F.hex(F.encode(x, "UTF-8")))
    every = F.split(prefix, "")
    safe = F.array_join(F.transform(F.filter(every, lambda c: c != ""), lambda c: F.when(c.rlike("^[a-z0-9 _.,()@;-]$"), c).otherwise(F.regexp_replace(hexed(c), "(..)", "%$1"))), "")
    return F.concat(F.element_at(F.split(hashed_partition(safe), "/"), 1), F.lit("/"), mapped_partition(safe))


def xml_storable(s: Column) -> Column:
    """Text with characters that XML cannot hold as backslash escapes: ``\\x0c``."""
    bad = r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]"
    return F.when(s.rlike(bad), F.array_join(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.when(c.rlike(bad), F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(F.ascii(c)), 2, "0")))).otherwise(c)), "")).otherwise(s)


def is_tag(tag: Column) -> Column:
    """Whether a stanza may use a tag: letters, digits, minus and underscore."""
    return tag.rlike("^[-a-zA-Z0-9_]+$")


def replaced(s: Column, pairs: dict[str, str]) -> Column:
    """All of several texts replaced in one pass, the longest first where they begin alike; what was put in is not searched again."""
    if not pairs:
        return s
    alternatives = "|".join("\\Q" + k + "\\E" for k in sorted(pairs, key=len, reverse=True))
    found = F.regexp_extract_all(s, F.lit(f"({alternatives})"), F.lit(1))
    between = F.split(s, alternatives, -1)
    swap = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.array_join(F.transform(between, lambda x, i: F.concat(x, F.coalesce(F.try_element_at(swap, F.try_element_at(found, i + 1)), F.lit("")))), "")


def name_is_normal(name: Column) -> Column:
    """(name in composed form, whether it was): names that differ in composition only are the same file to some systems."""
    import unicodedata

    import pandas as pd

    @F.pandas_udf("name string, normal boolean")
    def run(names: pd.Series) -> pd.DataFrame:
        nfc = names.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))
        return pd.DataFrame({"name": nfc, "normal": (nfc == names) | names.isna()})

    return run(name)


def estimated_records(n_revisions: Column) -> Column:
    """Records that a transfer of so many revisions should bring: 10.3 a revision."""
    return F.floor(F.coalesce(n_revisions, F.lit(0)) * 10.3)


def lines_changed(hunks: Column) -> Column:
    """Lines that the hunks of a line delta bring."""
    return F.aggregate(hunks, F.lit(0), lambda n, h: n + F.size(h["lines"]))


def _dirblock(path: Column) -> Column:
    """By what paths of a working state are ordered: the folder's components, then the name."""
    return F.struct(F.split(dirname(path), "/").alias("d"), basename(path).alias("b"))


def place_left(paths: Column, path: Column) -> Column:
    """How many of an array of paths in folder order come before a path."""
    return F.size(F.filter(paths, lambda p: _dirblock(p) < _dirblock(path)))


def place_right(paths: Column, path: Column) -> Column:
    """How many of an array of paths in folder order come before or are a path."""
    return F.size(F.filter(paths, lambda p: _dirblock(p) <= _dirblock(path)))


def block_place(folders: Column, folder: Column) -> Column:
    """How many of an array of folders in component order come before a folder."""
    return F.size(F.filter(folders, lambda d: F.split(d, "/") < F.split(folder, "/")))
