"""Variant spellings of names typed by people, linked by noisy-channel attribution.

Spellings are parsed into units (a person's given and family name, an organisation's base
and trade, or what a short form leaves of them). Units are ranked by frequency; each takes
the more frequent unit of greatest posterior as its canonical form: log frequency as prior,
typo, abbreviation, nickname and mailbox likelihoods as channel, against being a rare name
of its own. Candidates meet through blocking keys only (deletion variants of family names,
mailboxes, mailbox spellings, cut-off prefixes), never within whole groups.
"""

import math
import pickle
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.garbled import MAYBE, restored
from palimpsest.llm.names import NICKNAMES, ORG_WORDS, PARTICLES, ROBOT_WORDS, TITLES, WORD, NameModel, learnt, plain
from palimpsest.plans.durable import durable
from palimpsest.plans.skew import salted_join

OWN = -8.0  # log chance that so similar a name is another person's
TYPO = -3.0
# Mailbox names of functions rather than people, as mail standards and habit have them; others the corpus shows.
ROLES = {"info", "contact", "root", "admin", "noreply", "no-reply", "support", "office", "mail", "help", "sales", "staff", "all", "list", "announce", "webmaster", "postmaster", "hostmaster", "abuse", "security", "team", "dev", "build", "builds", "release", "releases", "ci", "bot", "commits", "maintainers"}
ONE_OWNER = 0.7  # share of a mailbox's rows whose family names begin alike, below which it is a group's
# Trades in the names of organisations, and the short form that stands for all their spellings.
TRADES = {"laboratories": "lab", "laboratory": "lab", "engineering": "eng", "software": "soft", "consulting": "cons", "consultants": "cons", "industries": "ind", "industry": "ind", "systems": "sys", "technologies": "tech", "technology": "tech", "group": "group", "foundation": "found", "institute": "inst", "university": "univ", "solutions": "sol"}
INITIALISMS = {"sw": "soft", "labs": "lab"}
LEGAL = {"ltd", "limited", "inc", "incorporated", "gmbh", "sa", "ag", "llc", "plc", "corp", "corporation", "co", "company", "oy", "ab", "bv", "srl", "spa", "kg", "pty", "sarl", "s", "a", "g", "m", "b", "h", "the", "team"}
_MAIL = re.compile(r"<?\s*([\w.+%’'-]+(?: dot [\w+-]+)*)\s*(?:@|\(at\)|\[at\]| at )\s*([\w-]+(?:\s*(?:\.|\(dot\)|\[dot\]| dot )\s*[\w-]+)*)\s*>?", re.I)
_HOST = re.compile(r"^([a-z]+)\.([a-z]+)@([a-z0-9-]+)$", re.I)
UNIT = "s string, n bigint, cls string, given string, family string, mail string, loc string, cut boolean"


def canonical_given(g: str) -> str:
    return NICKNAMES.get(g, g)


@lru_cache(maxsize=100_000)
def trade_of(word: str) -> str:
    """The trade that a plain word names: spelt out, cut short after two letters or more, or with up to two typos."""
    if word in INITIALISMS:
        return INITIALISMS[word]
    short = {t for full, t in TRADES.items() if len(word) > 2 and full.startswith(word)}
    if short:
        return min(short)
    near = min(((distance(word, full, 2), full) for full in TRADES if len(word) >= 5 and abs(len(full) - len(word)) <= 2), default=(3, ""))
    if near[0] <= 2:
        return TRADES[near[1]]
    # an abbreviation with a typo: one edit from a cut of at least three letters that is in use
    return next((t for full, t in TRADES.items() if 3 <= len(word) <= 5 and any(distance(word, cut, 1) <= 1 for cut in (full[:3], full[:4], full[:5], full[:4] + "s", full[:3] + "s"))), "")


def parse(text: str, model: NameModel) -> dict:
    """cls p (full person), i (initial and family), t (cut off), m (mailbox only), o (organisation), r (robot), n (nothing usable) of a repaired text."""
    s = text.strip()
    out = {"cls": "n", "given": "", "family": "", "mail": "", "loc": "", "cut": False}
    flat = re.sub(r"\s*(?:\(dot\)|\[dot\]| dot )\s*", ".", s)
    m = _MAIL.search(flat)
    rest = flat
    if m:
        local, domain = m.group(1).lower(), m.group(2).lower()
        out["mail"] = "" if local in ROLES else f"{local}@{domain}"
        out["loc"] = "" if local in ROLES else plain(local.split("+")[0])
        if "<" not in flat and flat[: m.start()].strip() == "":
            h = _HOST.match(f"{local}@{domain}")
            rest = f"{h.group(1)} {h.group(2)}" if h and (canonical_given(h.group(1)) in model.given or h.group(1) in model.given or model.family(h.group(2)) > 0.5) else ""
            if rest == "" and local in ROLES:
                return out
        else:
            rest = flat[: m.start()]
    elif "<" in flat:
        rest = flat[: flat.index("<")]
    rest = re.sub(r"\([^)]*\)?", " ", rest).strip(" <\"'")
    words = [w for w in WORD.findall(rest)]
    low = [plain(w) for w in words]
    trades = [p for p in low if p not in LEGAL and (p in ORG_WORDS or p in INITIALISMS or (len(p) > 6 and trade_of(p) and p not in model.given))]
    if trades or any(p in LEGAL and p not in ("s", "a", "g", "m", "b", "h", "co", "sa", "ab") for p in low):
        base = [p for p in low if p not in ORG_WORDS and p not in LEGAL and len(p) > 2 and p not in trades]
        t = [trade_of(p) for p in low if p in trades]
        if len(base) >= 2:  # a misspelt trade word is left among the bases
            odd = [p for p in base if trade_of(p) and model.family(p) < 0.8]
            base = [p for p in base if p not in odd] or base
            t += [trade_of(p) for p in odd]
        return out | {"cls": "o", "given": next((x for x in t if x), ""), "family": "".join(base)} if base else out
    if set(low) & ROBOT_WORDS and not any(canonical_given(p) in model.given for p in low):
        return out | {"cls": "r"}
    out["cut"] = rest.endswith(("...", "…"))
    parts = re.split(r"\s*,\s*", rest)
    if len(parts) == 2:
        first, second = ([plain(w) for w in WORD.findall(p)] for p in parts)
        if first and second and (len(second) == 1 or second[0] in model.given) and not (len(first) >= 2 and canonical_given(first[0]) in model.given):
            words = [*WORD.findall(parts[1]), *WORD.findall(parts[0])]
        else:
            words = WORD.findall(parts[0])
    if len(words) == 1 and (g := re.match(r"^([A-ZÀ-Ž][a-zß-ž]+)((?:[A-ZÀ-Ž][’'])?[A-ZÀ-Ž].+)$", words[0])):
        first = g.group(1)
        for particle in ("vander", "vande", "van", "von", "dela", "del", "de", "der", "ter"):
            bare = plain(first)[: -len(particle)]
            if plain(first).endswith(particle) and (bare in model.given or canonical_given(bare) in model.given):
                first = bare
                break
        words = [first, g.group(2)]
    words = [w for w in words if w.lower() not in TITLES and plain(w) not in PARTICLES]
    words = [re.sub(r"^[Oo][’'](?=\w)", "", w) for w in words]
    low = [plain(w) for w in words]
    full = [p for p, w in zip(low, words) if len(w) > 1 and p]
    initials = [p for p, w in zip(low, words) if len(w) == 1 and p]
    if len(full) >= 2:
        a, b = full[0], full[-1]
        known = lambda p: p in model.given or canonical_given(p) in model.given
        if not known(a) and (known(b) or model.family(a) > model.family(b) + 0.4) and not (len(parts) == 2):
            a, b = b, a
        if out["cut"]:
            return out | {"cls": "t", "given": canonical_given(a), "family": b}
        return out | {"cls": "p", "given": canonical_given(a), "family": b}
    if out["cut"] and out["loc"]:
        return out | {"cls": "m"}
    if len(full) == 1 and initials and len(full[0]) > 2:
        return out | {"cls": "i", "given": initials[0], "family": full[0]}
    if len(full) == 1 and out["loc"]:
        return out | {"cls": "i", "given": "", "family": full[0]} if full[0] not in model.given and len(full[0]) > 3 else out | {"cls": "m"}
    return out | {"cls": "m"} if out["loc"] else out


def distance(a: str, b: str, most: int = 2) -> int:
    """Edits and swaps of neighbours between two short words; most + 1 stands for more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if two and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def shortened(f: str) -> list[str]:
    """A family name and what each lost letter would leave of it."""
    return list({f, *(f[:i] + f[i + 1 :] for i in range(len(f)))}) if len(f) >= 4 else [f]


def twice_shortened(f: str) -> list[str]:
    """A long name and what one or two lost letters would leave of it."""
    once = shortened(f)
    return list({*once, *(x for y in once for x in shortened(y))}) if len(f) >= 8 else once


def spelt(g: str, f: str) -> set[str]:
    return {g + f, f + g, g[:1] + f, f + g[:1], f} if f else set()


def keys_of(cls: str, given: str, family: str, mail: str, loc: str, canonical: bool) -> list[str]:
    """Blocking keys of a spelling; ``canonical`` for the side that may be attached to."""
    if cls == "o":
        return [f"O:{given}:{x}" for x in twice_shortened(family)]
    out = [f"M:{mail}"] if mail else []
    if cls == "p" or (cls == "i" and given):
        out += [f"F:{given[:1]}:{x}" for x in shortened(family)]
    if cls == "p":
        out += [f"D:{x}|{family}" for x in shortened(given)]
    if canonical and cls == "p":
        out += [f"L:{x}" for x in spelt(given, family)] + [f"T:{given[:1]}:{family[:k]}" for k in range(2, len(family) + 1)] + [f"N:{x}" for x in shortened(family)]
    elif not canonical:
        if cls == "t":
            out += [f"T:{given[:1]}:{x}" for x in shortened(family)]
        if cls in ("m", "p") and loc:
            out.append(f"L:{loc}")
        if cls == "i" and not given:
            out += [f"N:{x}" for x in shortened(family)]
    return out


def channel(v: dict, g: str, f: str, same_mail: bool, known: set[str]) -> float | None:
    """Log likelihood of spelling ``v`` given the person (g, f); None where it can't be theirs."""
    if v["cls"] == "o":
        d = distance(v["family"], f, 2)
        return None if v["given"] != g or d > (1 if len(f) < 8 else 2) else TYPO * d
    ll = 4.0 if same_mail else 0.0
    if v["cls"] == "m":
        if v["loc"] in spelt(g, f):
            return ll + (0.0 if v["loc"] != f else -2.0)
        return ll - 2.0 if same_mail and f and (f in v["loc"] or distance(f, v["loc"], 2) <= 2 or any(distance(x, v["loc"], 2) <= 2 for x in spelt(g, f))) else None
    a, b = v["given"], v["family"]
    if len(a) <= 1:
        if a and a != g[:1]:
            return None
        ll += -1.5 if a else -2.5
    elif a != g:
        d = distance(a, g)
        if d > 2 and same_mail and a not in known and b == f:
            return ll - 4.0  # a nickname that no table has
        if a in known and g in known and not (same_mail and d <= 1):
            return None
        if d > 2 or (d > 1 and not same_mail and len(g) < 7) or (len(g) <= 3 and not same_mail):
            return None
        ll += TYPO * d
    if v["cls"] == "t":
        return ll - 2.0 if f.startswith(b[: max(3, len(b))]) or distance(b, f[: len(b)]) <= 1 else None
    if b != f:
        d = distance(b, f)
        if d > 2 or (d == 2 and not (same_mail or (len(f) >= 7 and f in v["loc"]))) or (len(f) < 5 and not same_mail):
            return None
        ll += TYPO * d
        if v["loc"] and b in v["loc"] and f not in v["loc"]:
            ll -= 6.0
    return ll


def parsed(revision: DataFrame, model: NameModel, column: str = "committer") -> DataFrame:
    """Each distinct non-empty spelling once: its count and what it was parsed into."""
    blob = revision.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # bounded by names.MOST

    def run(batches):
        m = pickle.loads(blob.value)
        for b in batches:
            got = [parse(s, m) for s in b["fixed"]]
            yield pd.DataFrame({"s": b["s"], "n": b["n"], **{c: [x[c] for x in got] for c in ("cls", "given", "family", "mail", "loc", "cut")}})

    counts = revision.where(F.length(F.col(column)) > 0).groupBy(F.col(column).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    fixed = restored(counts.select(F.col("s").alias("text")).where(F.col("s").rlike(MAYBE)), revision.select(F.col(column).alias("text")))
    whole = counts.join(fixed.select(F.col("text").alias("s"), "fixed"), "s", "left").select("s", "n", F.coalesce("fixed", "s").alias("fixed"))
    # parsing costs more than its bytes suggest: keep all partitions, which AQE would merge
    parts = int(revision.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return whole.repartition(parts).mapInPandas(run, UNIT)


def _without_groups(units: DataFrame) -> DataFrame:
    """Units whose mailbox is a group's lose it: its rows name families that begin differently. One aggregation a mailbox and letter."""
    named = units.where("mail <> '' AND cls = 'p'")
    per = named.groupBy("mail", F.substring("family", 1, 1).alias("letter")).agg(F.sum("n").alias("n"))
    groups = per.groupBy("mail").agg((F.max("n") / F.sum("n")).alias("share"), F.count(F.lit(1)).alias("letters")).where(f"letters > 1 AND share < {ONE_OWNER}").select("mail", F.lit(True).alias("shared"))
    j = units.join(groups, "mail", "left")
    bare = lambda c: F.when(F.col("shared"), "").otherwise(F.col(c)).alias(c)
    return j.where("NOT (coalesce(shared, false) AND cls = 'm')").select("s", "n", "cls", "given", "family", bare("mail"), bare("loc"), "cut")


def attributed(revision: DataFrame, column: str = "committer") -> DataFrame:
    """(spelling, entity): the canonical unit of every spelling that has one.

    Null and empty spellings, robots and spellings without a usable name have none.
    """
    model = learnt(revision, column)
    spark = revision.sparkSession
    known = spark.sparkContext.broadcast(model.given)
    units = durable(parsed(revision, model, column).where("cls NOT IN ('n', 'r')"))
    units = durable(_without_groups(units))
    whole = F.col("cls").isin("p", "o")
    units = units.withColumn("u", F.when(whole, F.concat_ws("|", "cls", "given", "family")).otherwise(F.concat(F.lit("s|"), "s")))
    ranked = units.where(whole).groupBy("u").agg(F.sum("n").alias("nu"))
    keyed = units.join(ranked, "u", "left").withColumn("nu", F.coalesce("nu", "n"))

    def spread(canonical: bool):
        @F.pandas_udf("array<string>")
        def run(cls: pd.Series, given: pd.Series, family: pd.Series, mail: pd.Series, loc: pd.Series) -> pd.Series:
            return pd.Series([keys_of(*x, canonical) for x in zip(cls, given, family, mail, loc)])

        return F.explode(run("cls", "given", "family", "mail", "loc"))

    left = keyed.select("s", "u", "nu", "cls", "given", "family", "mail", "loc", spread(False).alias("key"))
    right = keyed.where(whole).select(F.col("u").alias("cu"), F.col("nu").alias("cn"), F.col("given").alias("cg"), F.col("family").alias("cf"), spread(True).alias("key")).distinct()
    ahead = (F.col("cn") > F.col("nu")) | ((F.col("cn") == F.col("nu")) & (F.col("cu") < F.col("u"))) | ~F.col("cls").isin("p", "o")
    pairs = salted_join(left, right, ["key"], ["s"], "inner").where((F.col("u") != F.col("cu")) & ahead)
    pairs = pairs.groupBy("s", "u", "cu").agg(*[F.first(c).alias(c) for c in ("nu", "cn", "cls", "given", "family", "mail", "loc", "cg", "cf")], F.max(F.col("key").startswith("M:")).alias("same"))

    @F.pandas_udf("double")
    def posterior(cls: pd.Series, given: pd.Series, family: pd.Series, loc: pd.Series, g: pd.Series, f: pd.Series, same: pd.Series, cn: pd.Series, nu: pd.Series) -> pd.Series:
        out = []
        for c, a, b, lo, x, y, sm, n, own in zip(cls, given, family, loc, g, f, same, cn, nu):
            ll = channel({"cls": c, "given": a, "family": b, "loc": lo}, x, y, bool(sm), known.value)
            rival = OWN + math.log(own) if c in ("p", "o") else -math.inf
            out.append(None if ll is None or math.log(n) + ll <= rival else math.log(n) + ll)
        return pd.Series(out, dtype="float64")

    scored = pairs.withColumn("post", posterior("cls", "given", "family", "loc", "cg", "cf", "same", "cn", "nu")).where("post IS NOT NULL AND NOT isnan(post)")
    best = scored.groupBy("u").agg(F.max(F.struct("post", "cn", "cu")).alias("b")).select("u", F.col("b.cu").alias("up"))
    best = durable(best)
    while True:  # each step halves the way to the canonical unit; ranks rise, so there is no cycle
        nxt = best.join(best.select(F.col("u").alias("up"), F.col("up").alias("up2")), "up", "left").select("u", F.coalesce("up2", "up").alias("up"), F.col("up2").isNotNull().alias("moved"))
        nxt = durable(nxt)
        best = nxt.select("u", "up")
        if nxt.where("moved").isEmpty():
            break
    lone = units.join(best, "u", "left").select("s", "mail", "cls", F.coalesce("up", "u").alias("entity"))
    # spellings with a mailbox only, whose owner is never named, share an entity by mailbox
    nameless = lone.where("cls = 'm' AND entity LIKE 's|%' AND mail <> ''").select("s", F.concat(F.lit("m|"), "mail").alias("entity"))
    return lone.where("NOT (cls = 'm' AND entity LIKE 's|%' AND mail <> '')").select("s", "entity").unionByName(nameless).withColumnRenamed("s", "spelling")


def variants(revision: DataFrame, column: str = "committer") -> DataFrame:
    """(committer_a, committer_b): pairs of different spellings of one entity, the smaller first, from the membership that ``attributed`` gives.

    The form asks for all pairs, so its size is quadratic in an entity's spellings; ``entities``
    says the same with a row a spelling.

    Strings compare by code points, exactly as they stand (blanks at the ends included).
    """
    a = durable(attributed(revision, column))
    b = a.select(F.col("spelling").alias("committer_b"), "entity")
    return a.select(F.col("spelling").alias("committer_a"), "entity").join(b, "entity").where("committer_a < committer_b").select("committer_a", "committer_b")


def entities(revision: DataFrame, column: str = "committer") -> DataFrame:
    """Each spelling with its entity and the entity's number of spellings and most frequent one."""
    a = attributed(revision, column)
    n = revision.groupBy(F.col(column).alias("spelling")).agg(F.count(F.lit(1)).alias("n"))
    w = a.join(n, "spelling")
    top = w.groupBy("entity").agg(F.count(F.lit(1)).alias("n_spellings"), F.max(F.struct("n", "spelling")).alias("t"))
    return w.join(top, "entity").select("spelling", "n", "entity", "n_spellings", F.col("t.spelling").alias("canonical"))
