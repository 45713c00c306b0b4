"""Garbled text from wrong character encoding, repaired by best-first search.

A node is a text; an edge encodes it with the encoding it may wrongly have been read with
and decodes the bytes with another (or unescapes references). A character-plausibility
cost orders the frontier, visited texts are kept by hash, and the cheapest reachable text
wins if it beats the given one by a margin. The search runs on lines, on stretches of
non-ASCII words, on words and on runs of non-ASCII characters, so that partly garbled
texts are repaired too. One-byte misreadings that leave a plausible word are recognised by
the corpus: the word that they stand for is counted far more often.
"""

import codecs
import heapq
import html
import math
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.plans.durable import durable
from palimpsest.plans.skew import SMALL, small_join
from palimpsest.plans.spread import spread

MAX_NODES = 10_000  # expanded texts of one search; only steps into UTF-8 and unescaping are expanded, and those shorten a text
ESCAPE = 1.5  # cost of an escape inside a word
MULTI_MARGIN, SINGLE_MARGIN, SINGLE_SHARE = 0.3, 2.4, 0.62
ODD, ODD_MARGIN = 2.2, 1.2  # a single character this implausible lets a one-byte step win by less

#: fixed values: encodings a text may wrongly have been read with, and those it may have been in
READ_AS = ["cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "iso8859-2", "koi8-r", "cp866", "iso8859-15", "cp1254", "cp1253", "gb18030", "cp932", "euc_jp", "big5", "cp949"]
SINGLE_FROM = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8-r", "cp866", "cp1250", "iso8859-2", "cp1254", "cp1253"]
MULTI_TO = ["euc_jp", "cp932", "gb18030", "big5", "cp949"]
SINGLE_TO = ["cp1252", "cp1251", "koi8-r", "cp866", "cp1250", "iso8859-2", "mac_roman", "cp437", "cp850"]
#: preference among one-byte encodings a text may have been in, as added cost
UNUSUAL = {"koi8-r": 0.2, "cp866": 0.2, "cp1250": 0.3, "iso8859-2": 0.4, "mac_roman": 0.5, "cp437": 0.6, "cp850": 0.6}
CJK_READ = {"gb18030", "cp932", "euc_jp", "big5", "cp949"}

# Lower-case Russian letters from frequent to rare; the order gives the cost of a letter.
_RUSSIAN = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"
_RUSSIAN_COST = {c: 0.3 + 0.025 * i for i, c in enumerate(_RUSSIAN)}
_PLAIN_MARKS = set("«»„“”’‘–—…·§°©®½⅓→←™•€£²³±×º")
_LATIN_FREQUENT = set("éèêëàâäáãåçíìîïñóòôöõúùûüýßøæœąćęłńśźżčďěňřšťůžșțăğışőűīāēō")


@lru_cache(maxsize=65536)
def _kind(c: str) -> tuple[str, float]:
    """Class of a character and what it costs by itself."""
    o = ord(c)
    if o < 0x80:
        if c.isalpha():
            return "a", 0.0
        return ("s", 0.0) if c.isspace() else ("p", 0.0 if o >= 0x20 and o != 0x7F else 4.0)
    if o < 0xA0:
        return "x", 4.0
    if c == "�":
        return "x", 6.0
    if 0xE000 <= o <= 0xF8FF or o >= 0xF0000:
        return "x", 5.0
    if c.isalpha() and (o < 0x250 or 0x1E00 <= o < 0x1F00) and c not in "ªº":
        low = c.lower()
        if c != low:
            return "L", 1.1 if low in _LATIN_FREQUENT else 1.8
        return "l", 0.9 if c in _LATIN_FREQUENT else 1.6
    if 0x400 <= o < 0x530:
        low = c.lower()
        return ("c" if c == low else "C"), _RUSSIAN_COST.get(low, 2.2) + (0.25 if c != low else 0.0)
    if 0x2500 <= o < 0x25A0:
        return "b", 1.0
    if 0x3040 <= o < 0x3100:
        return "h", 0.6
    if 0x3000 <= o < 0x3040 or 0xFF00 <= o < 0xFF61:
        return "h", 0.6
    if 0x4E00 <= o < 0xA000 or 0x3400 <= o < 0x4DC0:
        for enc, lo, hi in (("gb2312", 0xB0, 0xD7), ("shift_jis", 0x88, 0x97)):
            try:
                if lo <= c.encode(enc)[0] <= hi:
                    return "h", 0.8
            except UnicodeEncodeError:
                pass
        return "h", 1.9
    if 0xAC00 <= o < 0xD7A4:
        return "h", 1.0
    if 0xFF61 <= o < 0xFFA0:
        return "h", 2.0
    if c in _PLAIN_MARKS:
        return "m", 0.9
    if o in (0x200D, 0xFE0F) or 0x1F000 <= o < 0x1FB00 or 0x2600 <= o < 0x27C0:
        return "e", 0.5
    if c.isspace():
        return "n", 1.0
    if 0x370 <= o < 0x400:
        return "g", 1.4
    return ("o", 1.8) if c.isalpha() else ("m", 1.9)


_ODD = re.compile(r"[^\x20-\x7e\t-\r]")  # characters that may cost something


def cost(s: str, most: float = math.inf) -> float:
    """How implausible the non-ASCII part of a text is; 0.0 for plain ASCII. Above ``most`` some larger number may stand for it."""
    return costs(s, most)[0]


def costs(s: str, most: float = math.inf) -> tuple[float, float]:
    """The cost of a text and that of its most implausible character; counting ends above ``most``."""
    if s.isascii():
        return (0.0, 0.0) if s.isprintable() else (sum(_kind(c)[1] for c in s), 0.0)
    total = worst = 0.0
    n, kind = len(s), _kind
    for m in _ODD.finditer(s):
        i = m.start()
        k, v = kind(s[i])
        if k in "asp" and not v:
            continue
        add = v
        left = kind(s[i - 1])[0] if i else "s"
        right = kind(s[i + 1])[0] if i + 1 < n else "s"
        if k in "lL":
            if left in "lL":
                add += 1.0
            if k == "L" and left in "al" and s[i - 1].islower():
                add += 2.0
            if k == "L" and left in "aL" and right in "al" and s[i - 1].isupper() and s[i + 1].islower():
                add += 1.2
            if left in "mxbcC" and s[i - 1] not in "«„“‘’—–…":
                add += 1.2
            if right in "mxb" and s[i + 1] not in "»”“’‘—–…,":
                add += 1.2
        elif k in "cC":
            if k == "C" and left == "c":
                add += 1.6
            if left in "alL" or right in "alL":
                add += 1.9
            if k == "c" and left == "C" and i > 1 and kind(s[i - 2])[0] == "C":
                add += 1.0
        elif k == "m":
            if left in "alLcC" and right in "alLcC" and s[i] not in "’·–—…":
                add += 1.4
            elif right in "mx" and s[i] not in "…”»’":
                add += 0.8
            if v > 1 and s[i] not in "¡¿" and (left in "alL" or right in "alL"):
                add += 0.8
        elif k == "b":
            if left not in "bs" or right not in "bs":
                add += 1.6
        elif k == "h":
            if left in "lL" or right in "lL":
                add += 1.5
            add += 1.3 * ((left == "a") + (right == "a"))
        elif k in "go":
            if left in "alLcChm" or right in "alLcChm":
                add += 1.0
        total += add
        if add > worst:
            worst = add
        if total > most:
            break
    return total, worst


def _sloppy(enc: str) -> tuple[dict[int, int], str]:
    """(code point to byte, character of each byte) with undefined bytes as C1 controls."""
    up = []
    for b in range(256):
        try:
            up.append(bytes([b]).decode(enc))
        except UnicodeDecodeError:
            up.append(chr(b))
    return {ord(c): b for b, c in enumerate(up)}, "".join(up)


_TABLES = {e: _sloppy(e) for e in {*READ_AS, *SINGLE_TO} - CJK_READ}
_PAIR = re.compile(r"[^\x00-\x7f]{2}")
_IDEOGRAPH = re.compile(r"[\u1100-\u11ff\u2e80-\ufaff\uff00-\uffef]")


def to_bytes(s: str, enc: str) -> bytes | None:
    try:
        return codecs.charmap_encode(s, "strict", _TABLES[enc][0])[0] if enc in _TABLES else s.encode(enc)
    except UnicodeEncodeError:
        return None


def from_bytes(b: bytes, enc: str) -> str | None:
    try:
        return codecs.charmap_decode(b, "strict", _TABLES[enc][1])[0] if enc in _TABLES else b.decode(enc)
    except UnicodeDecodeError:
        return None


def least(s: str) -> float:
    """A lower bound of the cost of any text that a one-byte step can make of ``s``.

    Such a step keeps the number of non-ASCII characters; beside an ASCII letter none costs
    less than 0.9, elsewhere none less than 0.3.
    """
    total, n = 0.0, len(s)
    for i, c in enumerate(s):
        if c >= "\x80":
            beside = (i and s[i - 1] < "\x80" and s[i - 1].isalpha()) or (i + 1 < n and s[i + 1] < "\x80" and s[i + 1].isalpha())
            total += 0.9 if beside else 0.3
    return total


#: escapes of characters outside ASCII: references, code points, and bytes in three notations
_REFERENCE = re.compile(r"&(?:#\d{2,7}|#[xX][0-9a-fA-F]{2,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_POINT = re.compile(r"\\u\{?([0-9a-fA-F]{4,6})\}?")
_BYTES = {"%": re.compile(r"(?:%[89A-Fa-f][0-9A-Fa-f])+"), "=": re.compile(r"(?:=[89A-F][0-9A-F])+"), "\\x": re.compile(r"(?:\\x[89A-Fa-f][0-9A-Fa-f])+")}
#: what may be such an escape, for a filter that runs before Python
ESCAPED = r"&#?[A-Za-z0-9]{2,};|\\u\{?[0-9a-fA-F]{4}|(?:%[89A-Fa-f][0-9A-Fa-f]){2}|(?:=[89A-F][0-9A-F]){2}|(?:\\x[89A-Fa-f][0-9A-Fa-f]){2}"
_ESCAPED = re.compile(ESCAPED)
#: escapes that stand in a word or follow each other: a lone reference may well be meant
_IN_WORD = re.compile(rf"(?<=[^\W\d_])(?:{ESCAPED})|(?:{ESCAPED})(?=[^\W\d_]|{ESCAPED})")


def has_escape(s: str) -> bool:
    return ("&" in s or "%" in s or "\\" in s or "=" in s) and bool(_ESCAPED.search(s))


def escapes(s: str) -> float:
    """What the escapes inside the words of a text cost."""
    return ESCAPE * len(_IN_WORD.findall(s)) if has_escape(s) else 0.0


def _start(s: str, i: int) -> int:
    """Where the word that place ``i`` lies in begins."""
    return max(s.rfind(c, 0, i) for c in " \t\n") + 1


def unescaped(s: str):
    """(text, grade, name) of each notation's escapes undone; those of ASCII characters stay as they are."""
    if "&" in s:
        t = _REFERENCE.sub(lambda m: m.group() if (u := html.unescape(m.group())).isascii() else u, s)
        if t != s:
            yield t, NEUTRAL, "unescape&"
    if "\\u" in s:
        def point(m: re.Match) -> str:
            n = int(m.group(1), 16)
            return chr(n) if 0x80 <= n <= 0x10FFFF else m.group()

        t = _POINT.sub(point, s)
        try:
            t = t.encode("utf-16-le", "surrogatepass").decode("utf-16-le")
        except UnicodeDecodeError:
            t = s
        if t != s:
            yield t, NEUTRAL, "unescape\\u"
    for mark, pattern in _BYTES.items():
        if mark in s:
            def text(m: re.Match, mark=mark) -> str:
                if mark != "\\x" and "/" in s[_start(s, m.start()) : m.start()]:
                    return m.group()  # addresses of pages are meant to hold them
                b = bytes.fromhex(m.group().replace(mark, ""))
                return from_bytes(b, "utf-8") or m.group()

            t = pattern.sub(text, s)
            if t != s:
                yield t, STRONG, f"unescape{mark}>utf-8"


WEAK, NEUTRAL, STRONG = range(3)


def edges(s: str, limit: float):
    """(next text, grade of evidence, its name); weak steps only if they can cost up to ``limit``."""
    if has_escape(s):
        yield from unescaped(s)
    pair, ideograph = bool(_PAIR.search(s)), bool(_IDEOGRAPH.search(s))
    single = least(s) <= limit
    for enc in READ_AS:
        if enc in CJK_READ:
            if not ideograph:
                continue
        elif not (pair or (single and enc in SINGLE_FROM)):
            continue
        b = to_bytes(s, enc)
        if b is None or b.isascii():
            continue
        t = from_bytes(b, "utf-8")
        if t is not None and t != s:
            yield t, STRONG, f"{enc}>utf-8"
        if enc in SINGLE_FROM:
            if single:
                for to in SINGLE_TO:
                    if to != enc and (t := from_bytes(b, to)) != s:
                        yield t, WEAK, f"{enc}>{to}"
            if enc in ("cp1252", "latin-1", "mac_roman") and pair and sum(x >= 0x80 for x in b) >= 4:
                for to in MULTI_TO:
                    t = from_bytes(b, to)
                    if t is not None and t != s:
                        yield t, WEAK, f"{enc}>{to}"


@lru_cache(maxsize=50_000)
def search(s: str) -> tuple[str, tuple[str, ...]]:
    """The cheapest text reachable from ``s`` and the steps to it; no steps if none is cheap enough.

    Strong and neutral steps are followed to the end, cheapest text first, each text once.
    A weak step ends its way: it is judged against the start, never expanded.
    """
    start, worst = costs(s)
    start += escapes(s)
    if start < 0.9:
        return s, ()
    margin = ODD_MARGIN if worst >= ODD else SINGLE_MARGIN
    limit = min(start * SINGLE_SHARE, start - margin)
    sure_best, weak_best = (start, s, ()), (start, s, ())
    seen, frontier, k = {hash(s)}, [(start, 0, s, ())], 0
    while frontier and k < MAX_NODES:
        c, _, t, steps = heapq.heappop(frontier)
        if c < 0.5 and steps:
            break
        for u, grade, name in edges(t, limit):
            if hash(u) in seen or "\x00" in u:
                continue
            path = (*steps, name)
            if grade == WEAK:
                cu = cost(u, min(limit, weak_best[0]) + 1e-6) + escapes(u) + UNUSUAL.get(name.partition(">")[2], 0.0)
                if cu < weak_best[0] and cu + margin <= start and cu <= start * SINGLE_SHARE:
                    weak_best = (cu, u, path)
                continue
            seen.add(hash(u))
            cu = cost(u) + escapes(u)
            if cu < sure_best[0] and cu + MULTI_MARGIN <= start:
                sure_best = (cu, u, path)
            k += 1
            heapq.heappush(frontier, (cu + 0.2 * len(steps), k, u, path))
    _, best, best_steps = sure_best if sure_best[2] else weak_best
    return best, best_steps


_WORD = re.compile(r"[^ \t\r\n]+")
_HIGH = re.compile(r"[^\x00-\x7f]+")
_STRETCH = re.compile(r"[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*(?:[ \t]+(?:[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*))*")
_CUT = re.compile(r"[\xc2-\xdf\xe2-\xf4][\x80-\x9f€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")


def _each(pattern: re.Pattern, s: str, steps: list[str], deeper) -> str:
    out, at = [], 0
    for m in pattern.finditer(s):
        out.append(s[at : m.start()])
        out.append(deeper(m.group(), steps))
        at = m.end()
    out.append(s[at:])
    return "".join(out)


def _clean(s: str) -> bool:
    return s.isascii() and not has_escape(s)


def _level(s: str, steps: list[str], level: int) -> str:
    if _clean(s):
        return s
    t, found = search(s)
    if level == 3 or (found and _strong(found)):
        steps.extend(found)
        return t
    parts: list[str] = []
    deeper = _each((_STRETCH, _WORD, _HIGH)[level], s, parts, lambda x, st: _level(x, st, level + 1))
    if found and not _strong(parts):  # weak evidence counts for the longest text that shows it
        parts, deeper = list(found), t
    steps.extend(parts)
    return deeper


def _strong(steps) -> bool:
    return any(x.endswith(">utf-8") or x.startswith("unescape") for x in steps)


def _lost(text: str) -> bool:
    return "\ufffd" in text or bool(_CUT.search(text))


def repair(text: str | None) -> tuple[str | None, tuple[str, ...], bool]:
    """The text with garbled parts restored, the steps taken, and whether characters were lost.

    What this search leaves may still be a misreading of a word that is far more frequent: see ``restored``.
    """
    if not text or _clean(text):
        return text, (), False
    steps: list[str] = []
    for _ in range(3):
        n = len(steps)
        text = "\n".join(line if _clean(line) else _level(line, steps, 0) for line in text.split("\n"))
        if len(steps) == n:
            break
    return text, tuple(steps), _lost(text)


FOREIGN = r"[^\s<>()\[\]\"/.,;:]*[^\x00-\x7f\s][^\s<>()\[\]\"/.,;:]*"  # a word with a character outside ASCII
_FOREIGN = re.compile(FOREIGN)
MAYBE = r"[^\x00-\x7f]|" + ESCAPED  # what a text must hold to be garbled
FAR_MORE = 10  # times that a word must be as frequent as what may be its misreading
_BATCH = 1_000_000  # characters of misreadings that leave a task at once


def _readings(w: str):
    """(word, step) of each weak step from a word to one of at least three letters, in order of preference."""
    for u, grade, name in edges(w, math.inf) if len(w) > 2 else ():
        if grade == WEAK and sum(c.isalpha() for c in u) > 2:
            yield u, name


@lru_cache(maxsize=50_000)
def _readable(w: str) -> bool:
    return any(True for _ in _readings(w))


def _all_readings(batches):
    out, size = [], 0
    for b in batches:
        for w in b["w"]:
            for k, (u, how) in enumerate(_readings(w)):
                out.append((w, u, how, k))
                size += len(w) + len(u)
                if size > _BATCH:
                    yield pd.DataFrame(out, columns=["w", "u", "how", "k"])
                    out, size = [], 0
    if out:
        yield pd.DataFrame(out, columns=["w", "u", "how", "k"])


def foreign_words(texts: DataFrame) -> DataFrame:
    """(w, n): counts of the words outside ASCII in a column ``text``, over all rows; those of one row or under three characters are left out."""
    word = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({FOREIGN})"), F.lit(1))))
    return texts.select(word.alias("w")).where("length(w) > 2").groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def familiar(words: DataFrame, counts: DataFrame) -> DataFrame:
    """(w, u, how): of the distinct words ``w``, those that may be a misreading of a word ``u`` that ``counts`` has FAR_MORE times as often.

    Of several the most frequent one is taken, of equally frequent ones the first in order of preference.
    """
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = words.repartition(parts).mapInPandas(_all_readings, "w string, u string, how string, k int")  # AQE would merge the partitions
    often = counts.where(F.col("n") >= FAR_MORE).select(F.col("w").alias("u"), "n")
    few = often.limit(SMALL + 1).count() <= SMALL
    best = read.join(F.broadcast(often) if few else often, "u").groupBy("w").agg(F.min_by(F.struct("u", "how", "n"), F.struct(-F.col("n"), "k")).alias("b"))
    own = best.select("w", "b.*").join(counts.select("w", F.col("n").alias("own")), "w", "left")
    return own.where(F.col("n") >= FAR_MORE * F.coalesce("own", F.lit(1))).select("w", "u", "how")


def restored(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows whose column ``text`` is garbled, with fixed (the repaired text), steps and lost; ``texts`` is where words are counted.

    The search runs once a row. Words that it leaves are then judged once each by the counts
    of all words; both are tables, and no number of words is left out.
    """
    @F.pandas_udf("fixed string, steps array<string>, lost boolean, words array<string>")
    def search_all(texts: pd.Series) -> pd.DataFrame:
        code, distinct = pd.factorize(texts)
        once = [(repair(t), t) for t in distinct]
        words = [sorted({w for w in _FOREIGN.findall(r[0]) if _readable(w)}) for r, _ in once]
        return pd.DataFrame({
            "fixed": [None if once[c][0][0] == once[c][1] else once[c][0][0] for c in code],
            "steps": [list(once[c][0][1]) for c in code],
            "lost": [once[c][0][2] for c in code],
            "words": [words[c] for c in code],
        })

    @F.pandas_udf("fixed string, steps array<string>, lost boolean")
    def reread(texts: pd.Series, words: pd.Series, meant: pd.Series, how: pd.Series) -> pd.DataFrame:
        out = []
        for t, *known in zip(texts, words, meant, how):
            if t is None:
                out.append((None, None, None))
                continue
            known, steps = {w: (u, h) for w, u, h in zip(*known)}, []

            def word(m: re.Match, known=known, steps=steps) -> str:
                u, h = known.get(m.group(), (m.group(), None))
                if h:
                    steps.append(h)
                return u

            t = _FOREIGN.sub(word, t)
            out.append((t, steps, _lost(t)))
        return pd.DataFrame(out, columns=["fixed", "steps", "lost"])

    counts = durable(foreign_words(texts))
    held = spread(rows).withColumn("r", search_all("text")).where("size(r.steps) > 0 OR r.lost OR size(r.words) > 0")
    held = durable(held.select(*rows.columns, "r.*").withColumn("_row", F.monotonically_increasing_id()))
    words = held.select("_row", F.explode("words").alias("w"))
    known = durable(familiar(words.select("w").distinct(), counts))
    hits = durable(small_join(words, known, ["w"], ["_row"]).groupBy("_row").agg(F.collect_list(F.struct("w", "u", "how")).alias("_hits")))
    out = small_join(held.drop("words"), hits, ["_row"], ["_row"], "left")
    out = out.withColumn("r", reread(F.when(F.col("_hits").isNotNull(), F.coalesce("fixed", "text")), F.col("_hits.w"), F.col("_hits.u"), F.col("_hits.how")))
    out = out.select(
        *rows.columns, F.coalesce("r.fixed", "fixed", "text").alias("fixed"),
        F.when(F.col("_hits").isNull(), F.col("steps")).otherwise(F.concat("steps", "r.steps")).alias("steps"), F.coalesce("r.lost", "lost").alias("lost"),
    )
    return out.where("size(steps) > 0 OR lost")


def garbled(df: DataFrame, id_col: str = "revision_id", fields: tuple[str, ...] = ("message", "committer")) -> DataFrame:
    """id_col, field, text, restored, steps of every garbled field value, once per distinct value.

    restored is null where characters were lost. Null, empty and ASCII values without escapes
    are never garbled and do not leave the JVM; ids may be null. Repeated rows count once.
    """
    long = None
    for f in fields:
        part = df.select(F.col(id_col).alias("id"), F.lit(f).alias("field"), F.col(f).alias("text")).where(F.col(f).rlike(MAYBE))
        long = part if long is None else long.unionAll(part)
    out = restored(long, long).select(F.col("id").alias(id_col), "field", "text", F.when(~F.col("lost"), F.col("fixed")).alias("restored"), "steps")
    return out.dropDuplicates([id_col, "field", "text"])


def garbled_fields(df: DataFrame, id_col: str = "revision_id") -> DataFrame:
    """(id_col, field) of every garbled value, once."""
    return garbled(df, id_col).select(id_col, "field").distinct()
