"""What names look like: given names, nicknames, titles, organisation words, and a letter model of family names."""

import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.garbled import repair
from palimpsest.plans.durable import durable, release
from palimpsest.plans.spread import spread

# A nickname and the given name it stands for.
NICKNAMES = {
    "alex": "alexander", "sasha": "alexander", "sandy": "alexander", "ola": "aleksandra", "abby": "abigail", "gail": "abigail", "tony": "anthony", "ben": "benjamin",
    "benny": "benjamin", "charlie": "charles", "chuck": "charles", "deb": "deborah", "debbie": "deborah", "dima": "dmitri", "mitya": "dmitri", "ted": "edward", "ned": "edward",
    "ed": "edward", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "pancho": "francisco", "paco": "francisco", "fritz": "friedrich", "fred": "friedrich", "grzesiek": "grzegorz",
    "lupe": "guadalupe", "hetty": "henrietta", "etta": "henrietta", "nacho": "ignacio", "inga": "ingrid", "vanya": "ivan", "jim": "james", "jimmy": "james", "jamie": "james",
    "jirka": "jiri", "hans": "johannes", "jo": "josephine", "josie": "josephine", "pepe": "jose", "kate": "katharine", "kathy": "katharine", "katie": "katharine", "gosia": "malgorzata",
    "malgosia": "malgorzata", "maggie": "margaret", "peggy": "margaret", "meg": "margaret", "mike": "michael", "mick": "michael", "misha": "mikhail", "kolya": "nikolai", "seun": "oluwaseun",
    "pat": "patricia", "patty": "patricia", "trish": "patricia", "pippa": "philippa", "pip": "philippa", "rick": "richard", "dick": "richard", "rich": "richard", "bob": "robert", "rob": "robert",
    "bobby": "robert", "sam": "samuel", "sammy": "samuel", "sue": "susan", "susie": "susan", "theo": "theodore", "tomek": "tomasz", "vova": "vladimir", "volodya": "vladimir",
    "willa": "wilhelmina", "mina": "wilhelmina", "bill": "william", "will": "william", "billy": "william", "katya": "yekaterina", "andy": "andrew", "dan": "daniel", "danny": "daniel",
    "dave": "david", "greg": "gregory", "joe": "joseph", "jenny": "jennifer", "matt": "matthew", "nick": "nicholas", "steve": "stephen", "tom": "thomas", "tim": "timothy", "chris": "christopher",
    "jurek": "jerzy", "kuba": "jakub", "zosia": "zofia", "lukas": "lukasz", "jorg": "jorgen", "lola": "dolores", "manolo": "manuel", "sepp": "josef", "fanfan": "francois", "eddie": "edward", "hannes": "johannes", "teddy": "theodore", "curro": "francisco", "sanya": "alexander", "kolja": "nikolai", "lupita": "guadalupe", "trisha": "patricia", "becky": "rebecca", "uli": "ulrich", "gabi": "gabriele",
}
# Frequent given names.
GIVEN = """abigail aleksandra alexander amara andre anthony benjamin cagla charles dana deborah dmitri edward elizabeth francisco francois friedrich grzegorz guadalupe halim henrietta
ignacio ingrid ivan james jiri johannes jose josephine jurgen katharine lin lukasz malgorzata margaret michael mikhail nikolai noor nuria oluwaseun patricia philippa piet richard robert samuel
soren susan theodore tomasz viggo vladimir wilhelmina william yekaterina yuki zoe maria anna john mary peter paul daniel david thomas george laura julia martin hannah emma lucas olivia
ahmed fatima mohammed wei hiroshi sofia pablo carlos luis elena olga sergei natalia pierre jean marie claire giulia marco luca lars anders karin erik""".split()
TITLES = {"mr", "ms", "mrs", "miss", "dr", "prof", "frau", "herr", "senora", "senor", "sra", "sr", "mme", "mlle", "monsieur", "madame", "pan", "pani", "г-н", "г-жа"}
PARTICLES = {"van", "von", "de", "der", "den", "la", "le", "del", "della", "di", "da", "dos", "ter", "ten", "al", "bin"}
ORG_WORDS = {
    "ltd", "limited", "inc", "incorporated", "gmbh", "sa", "ag", "llc", "plc", "corp", "corporation", "co", "company", "laboratories", "laboratory", "labs", "lab", "systems", "system", "syst", "sys", "software", "softw",
    "consulting", "consult", "engineering", "eng", "industries", "industry", "ind", "group", "foundation", "solutions", "technologies", "technology", "tech", "institute", "university", "team", "project", "oy", "ab", "bv", "srl", "spa", "kg", "pty", "sarl",
}
ROBOT_WORDS = {"robot", "bot", "daemon", "nightly", "import", "importer", "mirror", "builder", "buildbot", "landing", "autopack", "sync", "cron", "service", "system", "jenkins", "noreply", "script", "root", "admin", "ci"}
VERB_NAMES = {"will", "mark", "bill", "grant", "max", "skip", "drew", "rose", "chase", "art", "dean", "jack", "may", "hope", "sue", "rob", "pat", "ray", "frank", "iris", "dawn", "penny", "rich", "guard", "lin", "dick", "pip", "dan", "jo", "ed", "ola", "al", "deb"}

_CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюя", "a b v g d e zh z i j k l m n o p r s t u f h c ch sh shch - y - e yu ya".split()))
_CYRILLIC |= {"ё": "e", "ъ": "", "ь": "", "і": "i", "ї": "i", "є": "e"}
_SPECIAL = {"ø": "o", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "þ": "th", "ı": "i"}


@lru_cache(maxsize=200_000)
def plain(token: str) -> str:
    """Lower-case Latin letters of a token: accents dropped, Cyrillic transliterated."""
    out = []
    for whole in token.lower():
        for c in (whole,) if whole in _CYRILLIC else unicodedata.normalize("NFKD", whole):
            if "a" <= c <= "z":
                out.append(c)
            elif c in _SPECIAL:
                out.append(_SPECIAL[c])
            elif c in _CYRILLIC:
                out.append(_CYRILLIC[c])
    return "".join(out).replace("-", "")


def lossy(name: str) -> set[str]:
    """What is left of a name when one letter was lost."""
    return {name[:i] + name[i + 1 :] for i in range(len(name))}


def alike(a: str, b: str) -> bool:
    """Whether two names are at most two edits apart (one for short names)."""
    from palimpsest.llm.aliases import distance

    return distance(a, b, 2) <= (2 if min(len(a), len(b)) >= 5 else 1)


PERSON = re.compile(r"^\s*([^\W\d_]+)(?: [^\W\d_]\.)? ([^<@()\d,]+?)\s*(?:\([^)]*\)\s*)?<([^@<> ]+)(?:@| at )")
WORD = re.compile(r"(?:[^\W\d_]|�)+(?:[’'](?:[^\W\d_]|�)+)*", re.UNICODE)
#: letters by which Latin names are written in Cyrillic, one for one
TO_CYRILLIC = dict(zip("abcdefghijklmnopqrstuvwyz", "абцдефгхийклмнопкрстуввыз")) | {"x": "кс"}

MOST = 200_000  # words of a lexicon that reach the driver, those in most rows; rarer ones are judged by their letters
FAMILIES = 4000  # family names that labelled examples are made of
LEAST_FAMILIES, LEAST_MESSAGES = 3, 4  # rows below which a count says nothing
SHARE_FAMILIES, SHARE_MESSAGES = 2e-4, 2e-5  # and the shares of all rows that a word needs in large corpora


def cyrillic(name: str) -> str:
    return "".join(TO_CYRILLIC.get(c, c) if c.islower() else TO_CYRILLIC.get(c.lower(), c).capitalize() for c in name)


def trigrams(word: Column) -> Column:
    w = F.concat(F.lit("^"), word, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(w, i, 3))


def bearers(committers: DataFrame) -> DataFrame:
    """(given, family) of each distinct committer whose mailbox spells the family name; Python sees each string once."""
    def run(batches):
        for b in batches:
            out = []
            for c in b["s"]:
                c = repair(c)[0]
                m = PERSON.match(c)
                if not m or (len(m.group(1)) > 1 and m.group(1).isupper() and not m.group(2).isupper()):
                    continue  # nobody, or FAMILY Given
                last = plain(m.group(2).split()[-1])
                if len(last) >= 3 and last in plain(m.group(3)) and not {plain(w) for w in WORD.findall(c)} & (ORG_WORDS | ROBOT_WORDS):
                    out.append((plain(m.group(1)), last))
            yield pd.DataFrame(out, columns=["given", "family"])

    return committers.mapInPandas(run, "given string, family string")


def word_counts(messages: DataFrame, given: set[str]) -> DataFrame:
    """(word, near, n_low, n_rows, n_near) partial counts of plain words, summed per batch; ``near`` is a given name beside it or null."""
    def run(batches):
        known: dict[str, tuple[str, bool]] = {}
        for b in batches:
            low, rows, beside, near = Counter(), Counter(), Counter(), Counter()
            for text in b["s"]:
                words = []
                for w in WORD.findall(repair(text)[0]):
                    got = known.get(w)
                    if got is None:
                        if len(known) > 200_000:
                            known.clear()
                        p = plain(w)
                        got = known[w] = (p, w[:1].islower(), p in given)
                    words.append(got)
                low.update([w[0] for w in words if w[1]])
                rows.update({w[0] for w in words})
                close: dict[int, set[str]] = {}
                for i, w in enumerate(words):
                    if w[2]:  # a given name stands beside the word before and the two words after
                        for j in (i - 1, i + 1, i + 2):
                            if 0 <= j < len(words):
                                close.setdefault(j, set()).add(w[0])
                for j, names in close.items():
                    beside[words[j][0]] += 1
                    near.update([(words[j][0], g) for g in names])
            yield pd.DataFrame([(w, None, low[w], n, beside[w]) for w, n in rows.items()] + [(w, g, 0, 0, 0) for w, g in near], columns=["word", "near", "n_low", "n_rows", "n_near"])

    return messages.mapInPandas(run, "word string, near string, n_low bigint, n_rows bigint, n_near bigint").where("length(word) > 0")


def learnt(df: DataFrame, committer: str | None = "committer", message: str | None = "message") -> "NameModel":
    """The name model of all rows of a table: counts are Spark aggregations, the driver takes at most MOST words and all trigrams."""
    spark = df.sparkSession
    texts = lambda c: df.where(F.length(F.col(c)) > 0).select(F.col(c).alias("s"))
    none = spark.createDataFrame([], "given string, family string")
    pairs = durable(bearers(spread(texts(committer).distinct())) if committer in df.columns else none)
    n_pairs = pairs.count()
    least = max(LEAST_FAMILIES, int(n_pairs * SHARE_FAMILIES))
    counts = pairs.groupBy("given").agg(F.count_distinct("family").alias("n")).where((F.col("n") >= least) & (F.length("given") > 2)).orderBy(F.col("n").desc(), "given").limit(MOST).collect()
    givens = {r["given"]: r["n"] for r in counts}
    # a given name is one that people of several families bear and that is no rare spelling of another
    first = list(givens)[:400]
    givens = {g: n for g, n in givens.items() if g in GIVEN or not any(givens[o] >= 3 * n and alike(g, o) for o in first if o != g)}
    families = pairs.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    lexicon = set(givens) | set(GIVEN) | set(NICKNAMES)
    if message in df.columns:
        parts = durable(word_counts(spread(texts(message)), lexicon))
    else:
        parts = spark.createDataFrame([], "word string, near string, n_low bigint, n_rows bigint, n_near bigint")
    n_messages = df.where(F.col(message).isNotNull()).count() if message in df.columns else 0
    often = max(LEAST_MESSAGES, int(n_messages * SHARE_MESSAGES))
    words = parts.groupBy("word").agg(F.sum("n_low").alias("n_low"), F.sum("n_rows").alias("n_rows"), F.sum("n_near").alias("n_near"), F.count_distinct("near").alias("company"))
    known = families.select(F.col("family").alias("word")).unionAll(spark.createDataFrame([(g,) for g in sorted(lexicon)], "word string"))
    # a frequent word is no name unless it mostly stands beside given names, and then beside few of them
    frequent = (F.col("n_rows") >= often) & ((F.col("n_near") * 4 < F.col("n_rows")) | (F.col("company") >= 4))
    words = durable(words.join(known, "word", "left_anti").select("word", "n_rows", frequent.alias("frequent"), "n_low").where("frequent OR n_low >= 2"))
    common = words.where(F.col("frequent") | (F.col("n_low") >= 3)).orderBy(F.col("n_rows").desc(), "word").limit(MOST).select("word").toPandas()["word"]
    grams = lambda t: {r["g"]: r["n"] for r in t.select(F.explode(trigrams(F.col("w"))).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "g").limit(MOST).collect()}
    sample = [r["family"] for r in families.orderBy(F.xxhash64("family"), "family").limit(FAMILIES).collect()]
    model = NameModel(givens, sorted(sample), {*common}, grams(families.select(F.col("family").alias("w"))), grams(words.select(F.col("word").alias("w"))))
    release(pairs, words, *([parts] if message in df.columns else []))
    return model


class NameModel:
    """A lexicon of given names, frequent words of the corpus, and letter trigrams of family names against those of ordinary words."""

    def __init__(self, givens: dict[str, int], families: list[str], common: set[str], name_grams: dict[str, int], word_grams: dict[str, int]):
        self.given = set(givens) | set(GIVEN) | set(NICKNAMES)
        self.common, self.families = common, families
        a, b = name_grams, word_grams
        ta, tb, k = sum(a.values()) + 1, sum(b.values()) + 1, 4000
        self.odds = {t: math.log((a.get(t, 0) + 0.4) / (ta + 0.4 * k)) - math.log((b.get(t, 0) + 0.4) / (tb + 0.4 * k)) for t in sorted({*a, *b})}
        self.givens = sorted(givens) or list(GIVEN)
        self.lossy_given = {x for g in self.givens for x in lossy(g) if len(g) > 3}
        self._memo: dict[str, float] = {}

    def family(self, word: str) -> float:
        """Mean log odds of a plain word's trigrams to be those of a family name."""
        if word not in self._memo:
            if len(self._memo) > 200_000:
                self._memo.clear()
            w = f"^{word}$"
            self._memo[word] = sum(self.odds.get(w[i : i + 3], 0.3) for i in range(len(word))) / max(1, len(word)) if len(word) > 2 else -1.0
        return self._memo[word]
