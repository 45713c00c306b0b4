"""Stored versions of texts: delta chains, full texts, line origins, record streams, insertion checks.

A record holds one version (key, parent, n_lines) either whole (``lines``) or as a line delta
from its parent (``hunks``). A delta is unfolded into a recipe, one item a line: the line
itself with its origin, or the place of the line in the text it builds on. Recipes compose,
so pointer doubling turns chains of any length into texts with their annotation in a number
of joins that grows with the logarithm of the longest chain; nothing leaves the JVM.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import scalars
from palimpsest.operators import graph
from palimpsest.operators.text import line_delta_column
from palimpsest.plans.durable import durable, release

MAX_CHAIN = 200  # fixed value: deltas between a version and the whole text below it
ITEM = "struct<src:int,line:string,origin:string>"


def stored(versions: DataFrame, max_chain: int | None = MAX_CHAIN) -> DataFrame:
    """Records (key, parent, depth, n_lines, hunks, lines, sha1) of versions (key, parent, lines).

    A version is stored whole if it has no parent here, if it is ``max_chain`` deltas away
    from the last whole one, or if its delta holds as many bytes as its text. Keys are
    unique; versions with null lines count as empty. Keys on parent cycles have no depth and
    are stored whole. Without ``max_chain`` every version that has a parent is a delta.
    """
    v = versions.where("key IS NOT NULL").select("key", "parent", F.coalesce("lines", F.array().cast("array<string>")).alias("lines"))
    chain = graph.chain_depths(v.select("key", "parent", F.lit(0).alias("size"))).select("key", "depth")
    base = v.select(F.col("key").alias("parent"), F.col("lines").alias("base"))
    both = v.join(chain, "key").join(base, "parent", "left")
    fits = F.col("base").isNotNull() & (F.col("depth").isNotNull() if max_chain is None else F.col("depth") % (max_chain + 1) != 0)
    both = both.withColumn("hunks", F.when(fits, line_delta_column(F.when(fits, F.col("base")), F.col("lines"))))
    n_bytes = lambda ls: F.aggregate(ls, F.lit(0).cast("bigint"), lambda n, x: n + F.octet_length(x))
    small = F.col("hunks").isNotNull() & F.lit(max_chain is None) | F.col("hunks").isNotNull() & (n_bytes(F.flatten(F.transform("hunks", lambda h: h["lines"]))) < n_bytes("lines"))
    text = F.array_join("lines", "")
    return both.select("key", "parent", "depth", F.size("lines").alias("n_lines"), F.when(small, F.col("hunks")).alias("hunks"), F.when(~small, F.col("lines")).alias("lines"), F.sha1(text).alias("sha1"))


def recipe(hunks: Column, n_lines: Column, origin: Column) -> Column:
    """Line delta of a text of ``n_lines`` lines as one item a line: (src, null, null) or (null, line, origin)."""
    taken = lambda lo, hi: F.transform(F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(i.cast("int").alias("src"), F.lit(None).cast("string").alias("line"), F.lit(None).cast("string").alias("origin")))
    put = lambda lines: F.transform(lines, lambda x: F.struct(F.lit(None).cast("int").alias("src"), x.alias("line"), origin.alias("origin")))
    gained = F.aggregate(hunks, F.lit(0), lambda n, h: n + F.size(h["lines"]) - (h["end"] - h["start"]))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{ITEM}>").alias("out"))
    folded = F.aggregate(hunks, start, lambda acc, h: F.struct(h["end"].alias("at"), F.concat(acc["out"], taken(acc["at"], h["start"]), put(h["lines"])).alias("out")))
    return F.concat(folded["out"], taken(folded["at"], n_lines - gained))


def annotated(records: DataFrame) -> DataFrame:
    """(key, items, sha1): the text of every record, each line with the key of the version that brought it.

    A version that is stored whole starts afresh: its lines are its own. Records whose chain
    misses its basis or runs in a cycle have null items.
    """
    whole = F.transform("lines", lambda x: F.struct(F.lit(None).cast("int").alias("src"), x.alias("line"), F.col("key").alias("origin")))
    items = F.when(F.col("lines").isNotNull(), whole).otherwise(recipe(F.col("hunks"), F.col("n_lines"), F.col("key")))
    t = durable(records.select("key", F.when(F.col("lines").isNull(), F.col("parent")).alias("up"), items.alias("items"), "sha1"))
    while True:
        waiting = t.where("up IS NOT NULL")
        ready = t.select(F.col("key").alias("up"), F.col("up").alias("up2"), F.col("items").alias("base"))
        met = waiting.join(ready, "up", "left")
        composed = F.transform("items", lambda x: F.when(x["src"].isNull(), x).otherwise(F.element_at("base", x["src"] + 1)))
        # a basis that is missing leaves null items for good
        lost = F.col("base").isNull()
        step = met.select("key", F.when(~lost, F.col("up2")).alias("up"), F.when(~lost, composed).alias("items"), "sha1")
        old, n = t, waiting.count()
        t = durable(t.where("up IS NULL").unionByName(step))
        release(old)
        left = t.where("up IS NOT NULL").count()
        if not left:
            return t.select("key", "items", "sha1")
        if left == n and t.where("up IS NOT NULL").select(F.col("up").alias("key")).join(t.where("up IS NULL"), "key", "left_semi").isEmpty():
            return t.select("key", F.when(F.col("up").isNull(), F.col("items")).alias("items"), "sha1")


def fulltexts(records: DataFrame) -> DataFrame:
    """(key, lines, intact): the text of every record from its delta chain, and whether its sha1 is the stored one.

    Where the chain has no basis, lines is null and intact false.
    """
    lines = F.transform("items", lambda x: x["line"])
    return annotated(records).select("key", lines.alias("lines"), F.coalesce(F.sha1(F.array_join(lines, "")) == F.col("sha1"), F.lit(False)).alias("intact"))


def line_origins(versions: DataFrame) -> DataFrame:
    """(key, pos, origin, line) of every line of versions (key, parent, lines): the version of the chain that brought it, however it is stored."""
    return annotated(stored(versions, None)).select("key", F.posexplode("items").alias("pos", "item")).select("key", "pos", F.col("item.origin").alias("origin"), F.col("item.line").alias("line"))


def lines_added(records: DataFrame) -> DataFrame:
    """(key, line): lines that each record itself stores, without any reconstruction; whole texts store all of theirs."""
    own = F.coalesce("lines", F.flatten(F.transform("hunks", lambda h: h["lines"])))
    return records.select("key", F.explode(own).alias("line"))


def delta_blocks(hunks: Column, n_lines: Column) -> Column:
    """Matching blocks (a, b, n) of a stored delta of a text of ``n_lines`` lines, with the closing block of no lines."""
    gained = F.aggregate(hunks, F.lit(0), lambda n, h: n + F.size(h["lines"]) - (h["end"] - h["start"]))
    block = lambda a, b, n: F.array(F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), n.cast("int").alias("n")))
    start = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.array().cast("array<struct<a:int,b:int,n:int>>").alias("out"))

    def step(acc, h):
        run = h["start"] - acc["a"]
        return F.struct(h["end"].alias("a"), (acc["b"] + run + F.size(h["lines"])).alias("b"), F.concat(acc["out"], block(acc["a"], acc["b"], run)).alias("out"))

    acc = F.aggregate(hunks, start, step)
    rest = n_lines - acc["b"]
    runs = F.filter(F.concat(acc["out"], block(acc["a"], acc["b"], rest)), lambda x: x["n"] > 0)
    return F.concat(runs, block(n_lines - gained, n_lines, F.lit(0)))


def record_stream(records: DataFrame, requested: DataFrame, order: str = "unordered") -> DataFrame:
    """(key, parent, storage_kind, lines, sha1, place columns) of each requested (key, ord), absent ones included.

    ``order``: ``unordered``; ``as-requested`` (place is ord); ``topological`` (place is the
    length of the way from the first version: parents come before children); ``grouped``
    (place1 is the key's prefix up to the last slash, place2 counts from the newest version
    down: children before parents). Sort by the place columns and key to read in that order;
    no sort is forced. Repeated requests collapse to the first.
    """
    asked = requested.where("key IS NOT NULL").groupBy("key").agg(F.min("ord").alias("ord"))
    texts = fulltexts(records).join(records.select("key", "parent", "depth", "sha1"), "key")
    kind = F.when(F.col("sha1").isNull(), "absent").otherwise("fulltext")
    got = asked.join(texts, "key", "left").withColumn("storage_kind", kind)
    places = {"unordered": [], "as-requested": [F.col("ord").alias("place")], "topological": [F.col("depth").alias("place")], "grouped": [F.regexp_extract("key", "^(.*)/[^/]*$", 1).alias("place1"), (-F.col("depth")).alias("place2")]}
    return got.select("key", "parent", "storage_kind", "lines", "sha1", *places[order])


def insert_problems(texts: DataFrame, present: DataFrame) -> DataFrame:
    """(key, problem) of texts (key, parents, lines, sha1) that an insertion into ``present`` keys rejects.

    Reserved or badly formed keys, lines that are none or hold a line feed inside, a sha1 that is not the
    text's, parents neither present nor inserted, and keys that are present with another text.
    """
    here = present.select("key", F.col("sha1").alias("stored")).dropDuplicates(["key"])
    coming = here.select("key").unionByName(texts.select("key")).where("key IS NOT NULL").distinct()
    lacking = texts.select("key", F.explode("parents").alias("parent")).where("parent IS NOT NULL").join(coming.withColumnRenamed("key", "parent"), "parent", "left_anti").select("key", F.lit("missing parent").alias("problem")).distinct()
    text_sha1 = F.sha1(F.array_join("lines", ""))
    cut = lambda x: x.isNull() | (F.length(x) == 0) | ~F.instr(x, "\n").isin(0, F.length(x))
    inner = F.slice("lines", 1, F.greatest(F.size("lines") - 1, F.lit(0)))
    checks = [
        (F.col("key").isNull() | (F.col("key") == "") | scalars.is_reserved(F.col("key")), "reserved key"),
        (F.exists("lines", cut) | F.exists(inner, lambda x: ~x.endswith("\n")), "not whole lines"),
        (F.col("sha1").isNotNull() & (F.col("sha1") != text_sha1), "sha1 differs"),
        (F.col("stored").isNotNull() & (F.col("stored") != text_sha1), "key exists with another text"),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(t)) for c, t in checks]), lambda x: x.isNotNull())
    own = texts.join(here, "key", "left").select("key", F.explode(found).alias("problem"))
    return own.unionByName(lacking)


def inserted(records: DataFrame, versions: DataFrame) -> DataFrame:
    """The store with versions (key, parent, lines) added: new records build on stored texts; present keys are kept as they are."""
    fresh = versions.join(records.select("key"), "key", "left_anti")
    needed = fresh.select(F.col("parent").alias("key")).where("key IS NOT NULL").distinct().join(fresh.select("key"), "key", "left_anti")
    basis = fulltexts(records).join(needed, "key", "left_semi").select("key", F.lit(None).cast("string").alias("parent"), "lines")
    made = stored(fresh.select("key", "parent", "lines").unionByName(basis)).join(fresh.select("key"), "key", "left_semi")
    return records.unionByName(made.select(*records.columns))
