"""Personal information inside free text, by candidate gradient boosting.

Generators with high recall propose overlapping spans of five kinds; boosted trees score
each from its format and context; calibrated thresholds, one a kind, select the spans that
typed placeholders replace. The trees are fitted on the driver on items and look-alikes that
``examples`` builds from the rules of their formats and sets into a bounded sample of the
corpus (SAMPLE messages), so labels need no annotation; the lexicons behind the features
are counted over all rows (``names.learnt``).
"""

import base64
import math
import pickle
import re
import unicodedata
import uuid
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import numbers
from palimpsest.llm.boosting import Boosted
from palimpsest.llm.examples import Examples
from palimpsest.llm.garbled import repair
from palimpsest.llm.names import NICKNAMES, ORG_WORDS, PARTICLES, ROBOT_WORDS, TITLES, VERB_NAMES, WORD, NameModel, learnt, plain
from palimpsest.llm.tokens import vocabulary_path
from palimpsest.plans.durable import durable, release
from palimpsest.plans.spread import spread

KINDS = ["email", "phone", "id_number", "street_address", "person_name"]
SAMPLE = 6000  # messages whose lines surround the labelled items
INJECTED = 26000  # labelled texts made from them

_AT = r"(?: ?@ ?| ?\(at\) ?| ?\[at\] ?| at )"
_DOT = r"(?:\.| ?\(dot\) ?| ?\[dot\] ?| dot )"
EMAIL = re.compile(rf"(?<![^\W_])(?:mailto:)?[^\W_][\w.+%’'-]*(?: dot [\w+-]+)*{_AT}[\w-]+(?:{_DOT}[\w-]+)*", re.I)
_MAYBE_AT = re.compile(r"@|\bat\b|[(\[]at[)\]]", re.I)
_SPELT = re.compile(r"dot |\(dot|\[dot|\(at\)|\[at\]", re.I)
_PLAIN_AT = re.compile(r" at [\w-]+(?:\.[\w-]+)*\.[a-z]{2,7}$", re.I)
_DIGIT = re.compile(r"\d")
_MAYBE_NUMBER = re.compile(r"\d[^a-z]{2,}\d|\d\d")
# Words by which addresses name a way, in several languages.
_WAY = r"(?:street|st|road|rd|avenue|ave|lane|ln|boulevard|blvd|drive|dr|court|ct|crescent|terrace|place|pl|square|sq|close|way|row|highway|hwy|parkway|pkwy|grove|gardens|hill|mews|trail|circle|walk|wharf|quay|alley|plaza)"
_UP = r"[^\W\d_][\w’'-]*"
ADDRESS = re.compile(
    rf"(?:(?:flat|apt|suite|unit) \w+, (?:{_UP} ){{1,2}}house, )?\b\d{{1,5}}[a-z]? (?:[nsew]\.? )?(?:{_UP} ){{1,3}}{_WAY}\b\.?(?![\w/_(])"
    rf"|\b\d{{1,4}}[a-z]?,? (?:bis,? |ter,? )?(?:rue|avenue|av\.|boulevard|bd|chemin|impasse|quai|allée|cours|place|square) (?:d[eu]s? |de la |d[’'])?{_UP}(?: {_UP})?"
    rf"|\b(?:calle|c/|avenida|av\.|plaza|paseo|carrer|rua|travessa|largo|via|viale|piazza|corso|strada) (?:d[eao]s? |della |del |las? |los )?{_UP}(?: {_UP}){{0,2}},? (?:n[.º°]{{0,2}} ?)?\d+"
    rf"|(?<!\w)(?:ul\.|ulica|al\.|os\.|pl\.|ulice|nám\.|náměstí|ул\.|улица|пр\.|просп\.|проспект|пер\.|вул\.|бул\.|οδός) ?{_UP}(?: {_UP})?,? (?:[дd]\. ?)?\d+[\w/]*"
    r"|\b[^\W\d_]{3,}(?:straße|strasse|strase|str\.|weg|platz|allee|gasse|ring|damm|ufer|gatan|vägen|gränd|gata|vej|gade|veien|vei|laan|straat|plein|kade|katu|tie) \d+ ?[a-z]?\b"
    rf"|\b{_UP} (?:utca|út|sokak|sokağı|caddesi|cad\.|straße|straat|allee|platz|weg) (?:no:? ?)?\d+[a-z]?\b"
    r"|[\u4e00-\u9fff]{2,}(?:路|街|道|巷|弄)\d+号?|[\u4e00-\u9fff]{2,}[都道府県市区町村][\u3040-\u30ff\u4e00-\u9fff]*\d+(?:[丁目番地号]|[-－]\d+)+|[\uac00-\ud7a3]+(?:로|길) ?\d+(?:-\d+)?",
    re.I,
)
_TAIL = re.compile(r"(?:,? ?(?:apt|suite|unit|flat)\.? \w+)?(?:, ?(?:\d+º \w|[кk]в\. ?\d+|д\. ?\d+))*(?:(?:\n[^\W\d_]+, [A-Z]{2} \d{4,6})|,\s?(?:[A-Z]{2} )?(?:\d{4,6} )?[^\W\d_]+(?: (?:[A-Z]{2} )?\d{4,6})?)?", re.I)

# Words that announce a kind, and words that announce something else.
PHONE_WORDS = re.compile(r"(?:call|phone|tel|telephone|mobile|cell|fax|desk|on-call|fragen|anrufen|ring|ext|whatsapp|téléphone|teléfono|telefon\w*|тел|звоните|móvil|handy|電話|电话|전화|reach \w+ at)\b\.?", re.I)
ID_WORDS = re.compile(
    r"\bssn\b|\bsin\b|social (?:security|insurance)|tax id|tax file|taxpayer|\btfn\b|\bcpf\b|\bdni\b|\bnie\b|\bnif\b|\bcurp\b|\brfc\b|\bpan\b|aadhaar|pesel|steuer-?id|снилс|инн\b|\bni number|\bnhs\b|national insurance|nino\b|passport|reisepass|pasaporte|passeport|паспорт|ausweis|medicare|\bahv\b|\brrn\b|resident registration|주민등록"
    r"|driving licen|driver'?s licen|licence no|permis|führerschein|personal id|personnummer|fødselsnummer|\bcpr\b|hetu\b|henkilötunnus|rodné|マイナンバー|my number|身份证|\bbsn\b|insee|\bnir\b|sécurité sociale|codice fiscale|identity (?:card|number|no)|national id|\bid (?:no|number|card)\b|citizen", re.I)  # fmt: skip
DECOY_WORDS = re.compile(
    r"(?:lines?|rows?|pages?|offset|timing|build|bug|crc(?:32)?|checksum|epoch|version|sha\d*|size|address|port|pid|chapter|section|rev|revision|commit|issue|ticket|takes|costs|run|bytes|ms|kb|mb|s|times|items|entries|blocks?|skipped|per (?:step|page|run)|is not|seed|chunk|index|column|step|timeout|retry|limit|count|code|status|part|test|case|slot|order|total|width|height|time|length|were|€|\$|%|#)(?!\w)", re.I)
_DECOY_BEFORE = re.compile(r"(?<!\w)" + DECOY_WORDS.pattern + r"[ :=#\"“”„«»'(*]*$", re.I)
CARRIER = re.compile(
    r"(?:\b(?:by|from|to|cc|thanks|thanks to|via|per|ping|mit|und|et|y|e|i|and|merci à|gracias a|спасибо|dzięki|obrigado a|contact|kontakt|credit|mail|with|ask|as|für|for|r=|reviewer|owner|author|todo|was|had|used|contained|leaked|redact|strip|moved|goes|wohnt|shows|reported|\w+-by)\b\W*|[(\[\"“=;*#>|-]\s*|^\s*)$", re.I)
_TRAILER = re.compile(r"\b[a-z]+(?:-[a-z]+)*-by: *$|\bcc: *$", re.I)
_PLACE = re.compile(r"\b(?:in|em|em são|at|near|à|bei|aus|en|w|в) $", re.I)
CODE = {"py", "rs", "toml", "json", "txt", "md", "c", "h", "sh", "svg", "po", "cfg", "js", "html", "xml", "yml", "go", "java"}
_OTHER_SCRIPT = re.compile(r"^[\u0370-\u03ff\u0530-\u06ff\u0900-\u0dff\u0e00-\u0eff\u10a0-\u10ff\u1100-\u11ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3]+$")
_IDEOGRAPHIC = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3]")


def folded(text: str) -> str:
    """Full-width digits, signs and spaces as ASCII, character by character."""
    if text.isascii():
        return text
    return "".join(map(_folded, text))


@lru_cache(maxsize=65536)
def _folded(c: str) -> str:
    if c in "–−‑‐":
        return "-"
    if 0xFF00 <= ord(c) < 0xFF5F or c == "　":
        n = unicodedata.normalize("NFKC", c)
        return n if len(n) == 1 else c
    return c


@lru_cache(maxsize=2)
def public_words(path: str | None = None) -> tuple[dict[str, int], dict[str, int]]:
    """Whole words of a public tokenizer's vocabulary with their ranks: those in lower case, and those capitalised."""
    low, cap = {}, {}
    with open(path or vocabulary_path(), "rb") as f:
        for line in f:
            token, rank = line.split()
            t = base64.b64decode(token)
            if len(t) > 2 and t[:1] == b" " and t[1:].isalpha() and t.isascii():
                w = t[1:].decode()
                if w.islower():
                    low[w] = int(rank)
                elif w[1:].islower():
                    cap[w] = int(rank)
    return low, cap


class Word:
    """What is known of one word, wherever it stands."""

    __slots__ = ("plain", "given", "family", "common", "low", "proper", "cap", "core", "upper", "inner", "other", "initial", "title", "particle")

    def __init__(self, w: str, model: NameModel, low: dict[str, int], cap: dict[str, int]):
        p = plain(w)
        self.plain = p
        self.given = p in model.given or ("�" in w and p in model.lossy_given) or ("а" <= w[:1].lower() <= "я" and p.replace("v", "w") in model.given)
        self.family, self.common = model.family(p), p in model.common
        rank = low.get(w.lower())
        self.low = 0.0 if rank is None else 17.0 - math.log2(rank + 2)
        self.proper = w.capitalize() in cap and rank is None
        self.cap = w[:1].isupper()
        self.upper = len(w) > 1 and w.isupper()
        self.inner = not w.isupper() and any(c.isupper() for c in w[1:]) and "’" not in w and "'" not in w
        self.other = bool(_OTHER_SCRIPT.match(w))
        self.initial = len(w) == 1 and self.cap
        self.title = w.lower() in TITLES
        self.particle = p in PARTICLES
        likely = len(p) > 3 and self.family > (0.6 if "�" in w else -0.1) and not ((self.common or self.low) and w.islower())
        unknown = self.cap and len(p) > 1 and not self.low and not self.common and "�" not in w
        written = self.other and (2 <= len(w) <= 5 if _IDEOGRAPHIC.search(w) else 3 <= len(w) <= 14)
        self.core = self.given or likely or unknown or written


class Tokens:
    """Words of a text with what the models know of them."""

    def __init__(self, text: str, lookup):
        self.spans, self.words, self.info = [], [], []
        for m in WORD.finditer(text):
            self.spans.append(m.span())
            self.words.append(m.group())
        self.info = [lookup(w) for w in self.words]
        self.breaks = [-1, *(m.start() for m in re.finditer("\n", text)), len(text)]

    def line(self, s: int) -> int:
        """Length of the line that place ``s`` lies in."""
        i = bisect_right(self.breaks, s - 1) - 1
        return self.breaks[i + 1] - self.breaks[i] - 1


def _glued(text: str, a: int, b: int) -> bool:
    """Whether a word is part of an identifier, a path, a call or a number."""
    if a and (text[a - 1] in "_@./" or text[a - 1].isdigit() or (text[a - 1] == "-" and text[a - 2 : a - 1].isdigit())):
        return True
    nxt = text[b : b + 1]
    return bool(nxt) and (nxt in "_@/" or nxt.isdigit() or text[b : b + 2] == "()" or (nxt == "." and text[b + 1 : b + 2].isalpha()))


_GAP = {" ", ". ", "  ", ", "}


def _name_spans(text: str, t: Tokens, masked: list[tuple[int, int]]):
    """Runs of name-like words with at least one that may be a name; (first, last) word positions."""
    n, info = len(t.words), t.info
    likely = [i for i in range(n) if info[i].core]
    for i in range(1, n):
        if not info[i].core and info[i].cap and len(info[i].plain) > 2 and (info[i - 1].title or (info[i - 1].initial and text[t.spans[i - 1][1] : t.spans[i][0]] == ". ")):
            likely.append(i)
    if not likely:
        return

    masked, ends = sorted(masked), []
    for _, e in masked:  # furthest end so far: the masked spans may overlap
        ends.append(max(e, ends[-1]) if ends else e)

    def free(i: int) -> bool:
        a, b = t.spans[i]
        k = bisect_left(masked, (b, 0)) - 1
        return (k < 0 or ends[k] <= a) and not _glued(text, a, b)

    core = {i for i in likely if free(i)}
    done = -1
    for i in sorted(core):
        if i <= done:
            continue
        a = b = i
        while a - 1 > done and text[t.spans[a - 1][1] : t.spans[a][0]] in _GAP and (a - 1 in core or ((info[a - 1].initial or info[a - 1].particle) and free(a - 1))):
            a -= 1
        while b + 1 < n and (text[t.spans[b][1] : t.spans[b + 1][0]] in _GAP or text[t.spans[b][1] : t.spans[b + 1][0]] == "-") and (b + 1 in core or (info[b + 1].initial and free(b + 1)) or (info[b + 1].particle and b + 2 in core)):
            b += 1
        while a < b and a not in core and t.words[a].islower() and info[a].plain in ("da", "la", "le", "de") and not any(k in core for k in range(a + 1, b + 1)):
            a += 1
        done = b
        yield a, b
        # where a plain word of the language begins or ends the run, the rest is proposed too
        lo, hi = a, b
        while lo < hi and (info[lo].low or info[lo].common) and not info[lo].given:
            lo += 1
        while hi > lo and (info[hi].low or info[hi].common) and not info[hi].given:
            hi -= 1
        if (lo, hi) != (a, b) and any(k in core for k in range(lo, hi + 1)):
            yield lo, hi
        # a comma may part two persons or a person and a place
        for k in range(a, b):
            if text[t.spans[k][1] : t.spans[k + 1][0]] == ", ":
                yield from ((x, y) for x, y in ((a, k), (k + 1, b)) if any(z in core for z in range(x, y + 1)))


def candidates(text: str, lookup):
    """(kind index, start, end, x, y) of every span a generator proposes; x, y are word positions, or number pieces left out on either side."""
    flat = folded(text)
    out, masked = [], []
    if _MAYBE_AT.search(flat):
        for m in EMAIL.finditer(flat):
            s = m.group()
            if "@" not in s and not _SPELT.search(s) and not _PLAIN_AT.search(s):
                continue
            out.append((0, m.start(), m.end(), 0, 0))
            masked.append(m.span())
    if _MAYBE_NUMBER.search(flat):
        for a, b, x, y in numbers.windows(flat):
            if len(_DIGIT.findall(flat[a:b])) >= 7:
                out.append((1, a, b, x, y))
            out.append((2, a, b, x, y))
    if _DIGIT.search(flat):
        for m in ADDRESS.finditer(flat):
            tail = _TAIL.match(flat, m.end())
            out.append((3, m.start(), tail.end() if tail else m.end(), 0, 0))
            masked.append(out[-1][1:3])
    t = Tokens(text, lookup)
    out.extend((4, t.spans[a][0], t.spans[b][1], a, b) for a, b in _name_spans(text, t, masked))
    return out, t, flat


def features(text: str, flat: str, t: Tokens, c: tuple, field: int) -> list[float]:
    kind, s, e, x, y = c
    span = flat[s:e]
    before, after = flat[max(0, s - 40) : s].rpartition("\n")[2], flat[e : e + 24].partition("\n")[0]
    line = t.line(s)
    f = [field, e - s, (e - s) / max(1, line), bool(CARRIER.search(before)), before[-1:] in "([\"<*=“" if before else True, after[:1] in "),;]\">*”" if after else True]
    if kind == 0:
        parts = re.split(_AT, span, maxsplit=1, flags=re.I)
        domain, local = parts[-1], parts[0].replace("mailto:", "")
        labels = [z for z in re.split(r"[^\w-]+|\bdot\b", domain) if z]
        last = labels[-1].lower() if labels else ""
        i = bisect_left(t.spans, (s, 0))
        around = [w for z, w in zip(t.words[max(0, i - 8) : i + 12], t.info[max(0, i - 8) : i + 12]) if z in local]
        spelt, known = max((w.family for w in around), default=-2.0), any(w.given for w in around)
        f += [span.islower(), span.isupper(), domain[:1].isdigit(), len(labels), last.isalpha(), last in CODE, bool(re.fullmatch(r"[0-9a-f]{6,40}", domain)), "@" in span, " at " in span.lower(), "dot" in span.lower(), len(last), any(z.isdigit() for z in domain), bool(re.search(r"[._+]", local)), spelt, known, span.startswith("mailto:"), len(local)]
    elif kind in (1, 2):
        f += numbers.form(span)
        f += [x, y, bool(PHONE_WORDS.search(before)), bool(PHONE_WORDS.search(after)), bool(ID_WORDS.search(before)) or bool(ID_WORDS.search(span)), bool(_DECOY_BEFORE.search(before)), bool(DECOY_WORDS.match(after.lstrip())), bool(re.search(r"[\w.]+[@=:-]$", before)), bool(re.search(r"\d\W*$", before)), bool(re.match(r"\W*\d", after)), bool(re.search(r"^\w+[ =:]*$", before)), flat is not text and flat[s:e] != text[s:e]]
    elif kind == 3:
        f += [len(re.findall(r"[A-ZÀ-Ý]", span)), bool(re.search(rf"\b{_WAY}\b", span, re.I)), bool(re.search(r"\b(?:lane|road|avenue|street|blvd|boulevard|st|rd|ave|drive|court)\b", span, re.I)), bool(re.search(r"rue|calle|rua|via|ul\.|ул\.", span, re.I)), bool(re.search(r"(?:weg|str|gatan|platz|allee|gasse)", span, re.I)), span.count(","), bool(re.search(r"apt|suite|flat|кв|º", span, re.I)), bool(re.search(r"\b\d{5}\b", span)), len(span.split()), span.islower(), span[:1].isdigit(),
              bool(DECOY_WORDS.match(after.lstrip())), bool(_DECOY_BEFORE.search(before)), bool(re.match(r" [a-z]", after)), span[-1:].isdigit()]
        words = [z for z in re.findall(r"[^\W\d_]+", span)]
        low, cap = public_words()
        f += [sum(z.lower() in low for z in words) / max(1, len(words)), sum(z[:1].isupper() for z in words) / max(1, len(words))]
    else:
        a, b = x, y
        info, words = t.info[a : b + 1], t.words[a : b + 1]
        fam = [w.family for w in info]
        near = {t.info[i].plain for i in range(max(0, a - 2), min(len(t.words), b + 4))}
        prev = t.info[a - 1] if a else None
        nxt = t.info[b + 1] if b + 1 < len(t.words) else None
        joined = nxt is not None and text[e : e + 1] == " "
        n = len(info)
        f += [
            n, sum(w.given for w in info), max(fam), sum(fam) / n, min(fam), sum(z > 0.6 for z in fam), sum(w.common for w in info), sum(w.cap for w in info), sum(w.upper for w in info), sum(w.initial for w in info), sum(w.inner for w in info),
            sum(w.low > 0 for w in info), max(w.low for w in info), sum(w.proper for w in info), sum(w.cap and not w.low and not w.common for w in info), sum(w.other for w in info),
            bool(near & ORG_WORDS), bool(near & ROBOT_WORDS), (prev is not None and prev.title) or info[0].title, a == 0 or "\n" in text[t.spans[a - 1][1] : s] or text[s - 2 : s - 1] in (".", "!", "?"),
            joined and t.words[b + 1].islower() and (nxt.common or nxt.low > 0), joined and nxt.cap, prev is not None and prev.cap and text[s - 1 : s] == " ", 0.0 if prev is None else prev.low, sum(w.plain in VERB_NAMES for w in info), sum(w.plain in NICKNAMES for w in info),
            bool(re.match(r"\s*[<(]?\S*@|\s*<", after)), after.startswith(("'s", "’s")), bool(_PLACE.search(before)), bool(_TRAILER.search(before)), "," in text[s:e], "-" in text[s:e], max(len(w.plain) for w in info), min(len(w.plain) for w in info),
            any("Ѐ" <= ch < "԰" for ch in span), max((w.family for w in info if not w.given), default=-2.0), line == e - s, bool(re.match(r"[.(]", after) and re.match(r"[.(]\w", after)), "�" in span, text.isascii(),
        ]
    return [float(z) for z in f]


def labelled(names: NameModel, lines: list[str], seed: int, count: int):
    """(kind, label, features) of the candidates in ``count`` made texts whose label is known."""
    d = Detector(names)
    made = Examples(names, lines, sorted(w for w in d.cap if w.lower() not in d.low and len(w) > 3), seed)
    # frequent words, in a fixed order: of the corpus and of the public vocabulary
    made.common = sorted(w for w in names.common if len(w) > 3)[:3000] + sorted(w for w, k in d.low.items() if k < 8000 and len(w) > 3)
    for text, field, k, start, end in made.texts(count):
        found, t, flat = candidates(text, d.word)
        for c in found:
            y = d._label(c, t, text, field, k, start, end)
            if y is not None:
                yield c[0], y, features(text, flat, t, c, field)


def fit_kind(x: np.ndarray, y: np.ndarray) -> tuple[Boosted, float, int, float]:
    """Trees of one kind, calibrated on every fourth row, with the threshold of the best F1 there."""
    hold = np.arange(len(y)) % 4 == 0
    tree = Boosted(rounds=110, depth=4).fit(x[~hold], y[~hold]).calibrate(x[hold], y[hold])
    p = tree.predict(x[hold])
    grid = np.linspace(0.2, 0.8, 25)
    f1 = [2 * ((p >= g) & (y[hold] == 1)).sum() / max(1, (p >= g).sum() + y[hold].sum()) for g in grid]
    top = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
    return tree, float(grid[top[len(top) // 2]]), int(hold.sum()), float(max(f1))


class Detector:
    """Models of one corpus: words, one boosted classifier a kind, its threshold."""

    def __init__(self, names: NameModel):
        self.names, self._words = names, {}
        self.low, self.cap = public_words()
        self.trees, self.limits, self.held_out = [], [], {}

    @staticmethod
    def _label(c: tuple, t: Tokens, text: str, field: int, k: int, start: int, end: int) -> int | None:
        """1 for a span that covers the item well, 0 for one that surely covers none, None where that is unknown."""
        inside = min(c[2], end) - max(c[1], start)
        if inside > 0:
            if k == c[0]:
                if k in (1, 2):
                    return int(inside >= 0.95 * (end - start) and inside >= 0.95 * (c[2] - c[1]))
                return int(inside >= 0.6 * (c[2] - c[1]))
            if k >= 0 and (c[0] == 0 or k == 0 or (k == 2 and c[0] == 4) or field):
                return None
            return 0
        if field:
            return 1 if c[0] == 0 and "@" in text[c[1] : c[2]] else None
        if c[0] == 4:
            info = t.info[c[3] : c[4] + 1]
            if any(w.given for w in info) and (any(not w.given and w.family > 0.6 for w in info) or not all(w.plain in VERB_NAMES for w in info if w.given)):
                return None
            return 0 if all(w.common or w.low or w.family < 0.3 for w in info) else None
        return None

    def word(self, w: str) -> Word:
        if w not in self._words:
            if len(self._words) > 100_000:
                self._words.clear()
            self._words[w] = Word(w, self.names, self.low, self.cap)
        return self._words[w]

    def __getstate__(self):
        return self.__dict__ | {"_words": {}}

    def spans(self, text: str | None, field: int) -> list[tuple[int, int, int]]:
        """Selected (start, end, kind), without overlaps: the more probable span wins."""
        return self.batch([text or ""], field)[0]

    def batch(self, texts: list[str], field: int) -> list[list[tuple[int, int, int]]]:
        """``spans`` of many texts with one scoring call a kind."""
        found = [candidates(z, self.word) if z else ([], None, "") for z in texts]
        keep: list[list[tuple[float, tuple]]] = [[] for _ in texts]
        for k in range(len(KINDS)):
            at = [(i, c) for i, (cs, _, _) in enumerate(found) for c in cs if c[0] == k]
            if at:
                p = self.trees[k].predict(np.array([features(texts[i], found[i][2], found[i][1], c, field) for i, c in at]))
                for (i, c), q in zip(at, p):
                    if q >= self.limits[k]:
                        keep[i].append((float(q) - self.limits[k], c))
        out = []
        for scored in keep:
            taken: list[tuple[int, int, int]] = []  # sorted, without overlaps
            for _, c in sorted(scored, key=lambda z: (-round(z[0], 2), z[1][1] - z[1][2], z[1])):
                i = bisect_left(taken, (c[2], 0, 0))
                if i == 0 or taken[i - 1][1] <= c[1]:
                    taken.insert(i, (c[1], c[2], c[0]))
            out.append(taken)
        return out


def sample(df: DataFrame, column: str, rows: int = SAMPLE) -> list[str]:
    """Up to ``rows`` distinct values, those of least hash: the same on every run.

    A limit on the hash, from an estimate of the number of distinct values, leaves about twice
    as many before anything is sorted or sent, so what reaches the driver does not grow.
    """
    values = df.where(F.col(column).isNotNull()).select(column)
    n = values.agg(F.approx_count_distinct(column)).first()[0] or 0
    part = values.withColumn("h", F.pmod(F.xxhash64(column), F.lit(1 << 40)))
    if n > 2 * rows:
        part = part.where(F.col("h") < int((1 << 40) * 2 * rows / n))
    return [r[0] for r in part.distinct().orderBy("h", column).limit(rows).collect()]


PARTS = 16  # tasks that make the labelled texts; the same at every size of cluster and corpus


def fitted(df: DataFrame, seed: int = 5) -> Detector:
    """The detector of a revision table: lexicons of all rows, trees from INJECTED texts around lines of at most SAMPLE messages.

    Labelled texts are made and trees grown in Spark tasks, a part and a kind each; what they
    hold is bounded by the parameters. The same table gives the same detector.
    """
    spark = df.sparkSession
    names, messages = learnt(df), sample(df, "message")
    held = spark.sparkContext.broadcast((names, messages))

    def make(batches):
        names, messages = held.value
        lines = [z for m in messages for z in repair(m)[0].split("\n") if z.strip()]
        for b in batches:
            for part in b["id"]:
                rows = list(labelled(names, lines, seed * 1000 + int(part), INJECTED // PARTS))
                yield pd.DataFrame({"part": int(part), "n": range(len(rows)), "kind": [r[0] for r in rows], "y": [float(r[1]) for r in rows], "x": [r[2] for r in rows]})

    def grow(key, pdf):
        pdf = pdf.sort_values(["part", "n"])
        return pd.DataFrame({"kind": [int(key[0])], "model": [pickle.dumps(fit_kind(np.stack(pdf["x"].to_list()), pdf["y"].to_numpy()))]})

    made = durable(spark.range(0, PARTS, 1, PARTS).mapInPandas(make, "part int, n int, kind int, y double, x array<double>"))
    grown = {r["kind"]: pickle.loads(bytes(r["model"])) for r in made.groupBy("kind").applyInPandas(grow, "kind int, model binary").collect()}
    release(made)
    d = Detector(names)
    for k, kind in enumerate(KINDS):
        tree, limit, n, f1 = grown[k]
        d.trees.append(tree)
        d.limits.append(limit)
        d.held_out[kind] = (n, f1)
    return d


_worker: dict[str, Detector] = {}


def _load(key: str, blob) -> Detector:
    if key not in _worker:
        _worker.clear()
        _worker[key] = pickle.loads(blob.value)
    return _worker[key]


def _both(detector: Detector, texts: list[str | None], field: int):
    """Spans of the texts that need no repair, and the repaired texts with theirs."""
    fixed = [repair(x)[0] if x else x for x in texts]
    changed = [i for i, (a, b) in enumerate(zip(texts, fixed)) if a != b]
    plain_spans = detector.batch(["" if not a or a != b else a for a, b in zip(texts, fixed)], field)
    again = dict(zip(changed, detector.batch([fixed[i] for i in changed], field)))
    return plain_spans, fixed, again


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for s, e, k in spans:
        out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def _redact_garbled(text: str, fixed: str, spans) -> str:
    """Replaces in the garbled text the words that hold the repaired text's spans."""
    a, b = [m.span() for m in re.finditer(r"[^ \t\r\n]+", text)], [m.span() for m in re.finditer(r"[^ \t\r\n]+", fixed)]
    if len(a) != len(b):
        return redacted(fixed, spans)
    moved = []
    for s, e, k in spans:
        hit = [i for i, (x, y) in enumerate(b) if x < e and s < y]
        x, y = a[hit[0]], a[hit[-1]]
        same = text[x[0] : y[1]] == fixed[b[hit[0]][0] : b[hit[-1]][1]]
        moved.append((x[0] + (s - b[hit[0]][0] if same else 0), (x[0] + e - b[hit[0]][0]) if same else y[1], k))
    merged: list[tuple[int, int, int]] = []
    for m in sorted(moved):
        if not merged or m[0] >= merged[-1][1]:
            merged.append(m)
    return redacted(text, merged)


def personal(df: DataFrame, detector: Detector | None = None) -> DataFrame:
    """revision_id, message, committer with typed placeholders, message_kinds, committer_kinds.

    Garbled fields are searched as repaired; the placeholders go into the text as it stands.
    Null and empty fields stay as they are and have no kinds; other columns are not read;
    repeated rows give repeated results.
    """
    detector = detector or fitted(df)
    blob = df.sparkSession.sparkContext.broadcast(pickle.dumps(detector))  # some MB: bounded by names.MOST and the vocabulary
    key = str(uuid.uuid4())
    kind = "out string, kinds array<string>"

    def scan(field: int):
        @F.pandas_udf(kind)
        def run(texts: pd.Series) -> pd.DataFrame:
            d = _load(key, blob)
            code, distinct = pd.factorize(texts)  # repeated values are searched once a batch; nulls have code -1
            values = list(distinct)
            spans, fixed, again = _both(d, values, field)
            out, kinds = [], []
            for i, v in enumerate(values):
                more = again.get(i)
                out.append(v if not v else _redact_garbled(v, fixed[i], more) if more is not None else redacted(v, spans[i]))
                kinds.append(sorted({KINDS[k] for _, _, k in (spans[i] if more is None else more)}))
            out, kinds = [None if c < 0 else out[c] for c in code], [[] if c < 0 else kinds[c] for c in code]
            return pd.DataFrame({"out": out, "kinds": kinds})

        return run

    rows = spread(df.select("revision_id", "message", "committer"))
    got = rows.select("revision_id", scan(0)("message").alias("m"), scan(1)("committer").alias("c"))
    return got.select("revision_id", F.col("m.out").alias("message"), F.col("c.out").alias("committer"), F.col("m.kinds").alias("message_kinds"), F.col("c.kinds").alias("committer_kinds"))


def personal_fields(df: DataFrame, detector: Detector | None = None) -> DataFrame:
    """(revision_id, field, kind) of every field that holds an item of the kind, once."""
    got = personal(df, detector)
    rows = got.select("revision_id", F.explode(F.array(F.struct(F.lit("message").alias("field"), F.col("message_kinds").alias("kinds")), F.struct(F.lit("committer").alias("field"), F.col("committer_kinds").alias("kinds")))).alias("x"))
    return rows.select("revision_id", "x.field", F.explode("x.kinds").alias("kind")).distinct()
