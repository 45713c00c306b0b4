"""Keyed graph indices as tables: key, absent, value, refs (lists of keys), src.

A combined index is the union of its sources by ``src``; the first source that has a key
wins. Absent rows are placeholders for keys that are only referred to.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.scalars import NULL_REVISION, key_is_valid, value_is_valid
from palimpsest.plans.skew import salted_join


def present(nodes: DataFrame) -> DataFrame:
    return nodes.where(~F.coalesce("absent", F.lit(False)))


def combined(nodes: DataFrame) -> DataFrame:
    """First source wins: one present row a key (ties within a source: earliest arrival, then value).

    One aggregation with map-side combining; a key in many rows costs one row a task.
    """
    rows = present(nodes)
    first = F.struct(F.col("src"), F.col("arrived_at"), F.col("value"), F.col("refs"))
    top = rows.where("key IS NOT NULL").groupBy("index_name", "key").agg(F.min(first).alias("f"))
    return top.select("index_name", "key", F.col("f.src").alias("src"), F.col("f.value").alias("value"), F.col("f.refs").alias("refs"))


def point_lookup(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """Present rows of the requested keys; missing ones drop out, repeated requests collapse."""
    return combined(nodes).join(keys.select("index_name", "key").distinct(), ["index_name", "key"], "left_semi")


def missing_keys(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.select("index_name", "key").distinct().join(present(nodes).select("index_name", "key"), ["index_name", "key"], "left_anti")


def lengths(keys: DataFrame, key: str) -> list[int]:
    """Distinct tuple lengths; there are no more of them than elements in the longest tuple."""
    return sorted(r[0] for r in keys.where(F.col(key).isNotNull()).select(F.size(key)).distinct().collect())


def starting_with(rows: DataFrame, prefixes: DataFrame, by: list[str], key: str = "key", prefix: str = "prefix") -> DataFrame:
    """Rows whose ``key`` starts with the elements of some ``prefix`` and that agree on ``by``; each row at most once for each of its prefixes.

    Every row is repeated for the requested lengths that it has, and met in one semi join.
    """
    sizes = lengths(prefixes, prefix)
    mine = F.filter(F.array(*[F.lit(n) for n in sizes]) if sizes else F.array().cast("array<int>"), lambda n: n <= F.size(key))
    wanted = prefixes.where(F.col(prefix).isNotNull()).select(*by, F.col(prefix).alias("_prefix")).distinct()
    return rows.withColumn("_n", F.explode(mine)).withColumn("_prefix", F.slice(key, F.lit(1), F.col("_n"))).join(wanted, [*by, "_prefix"], "left_semi").drop("_n", "_prefix")


def prefix_lookup(nodes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Rows of the combined index whose first key elements equal a prefix of (index_name, prefix); elements, never bytes.

    Any number of prefix lengths; the empty prefix asks for the whole index, a null one for
    nothing. A row that several prefixes name comes once.
    """
    return starting_with(combined(nodes), prefixes, ["index_name"]).dropDuplicates(["index_name", "key"])


def prefix_view(nodes: DataFrame, prefix: list[str]) -> DataFrame:
    """The keyspace below a prefix, with the prefix stripped from keys and references."""
    n = len(prefix)
    starts = F.slice("key", 1, n) == F.array(*map(F.lit, prefix))
    strip = lambda k: F.slice(k, F.lit(n + 1), F.greatest(F.size(k) - n, F.lit(0)))
    return combined(nodes).where((F.size("key") > n) & starts).select("index_name", strip(F.col("key")).alias("key"), "value", F.transform("refs", lambda ls: F.transform(ls, strip)).alias("refs"))


def key_count(nodes: DataFrame) -> DataFrame:
    """Rows per index and source, and their sum: sources are not compared with each other."""
    return present(nodes).groupBy("index_name", "src").agg(F.count_distinct("key").alias("n_keys"))


def row_problems(nodes: DataFrame) -> DataFrame:
    """Rows that an insert would reject, with the first reason."""
    arity = F.when(F.col("index_name") == "texts", 2).otherwise(1)
    lists = F.when(F.col("index_name") == "texts", 2).otherwise(F.when(F.col("index_name") == "revisions", 1).otherwise(0))
    bad_ref = F.exists("refs", lambda ls: F.exists(ls, lambda k: ~key_is_valid(k, arity)))
    reason = (
        F.when(~key_is_valid(F.col("key"), arity), "bad key")
        .when(F.col("absent"), None)
        .when(~value_is_valid(F.col("value")), "bad value")
        .when(F.size("refs") != lists, "wrong number of reference lists")
        .when(bad_ref, "bad reference")
    )
    return nodes.select("index_name", "src", F.array_join("key", "/").alias("key"), reason.alias("reason")).where("reason IS NOT NULL")


def edges(nodes: DataFrame, ref_list: int = 0) -> DataFrame:
    """index_name, key, parent, ord of one reference list of the combined index."""
    lists = combined(nodes).where(F.size("refs") > ref_list)
    return lists.select("index_name", "key", F.posexplode(F.col("refs")[ref_list]).alias("ord", "parent"))


def parent_map(nodes: DataFrame) -> DataFrame:
    """Key and its parents (reference list 0); a key without parents has the null revision."""
    null = F.array(F.array(F.lit(NULL_REVISION)))
    parents = F.when(F.size("refs") > 0, F.col("refs")[0])
    return combined(nodes).select("index_name", "key", F.when(F.size(parents) > 0, parents).otherwise(null).alias("parents"))


def external_references(nodes: DataFrame, ref_list: int = 0) -> DataFrame:
    """Keys that a reference list names and no source holds: an anti join on all present keys."""
    named = edges(nodes, ref_list).select("index_name", F.col("parent").alias("key")).distinct()
    return named.join(present(nodes).select("index_name", "key"), ["index_name", "key"], "left_anti")


def missing_bases(nodes: DataFrame) -> DataFrame:
    """(src, index_name, key) that rows of a source build on (reference list 1) and that the source lacks: it cannot stand alone."""
    rows = present(nodes)
    named = rows.where(F.size("refs") > 1).select("src", "index_name", F.explode(F.col("refs")[1]).alias("key")).distinct()
    return named.join(rows.select("src", "index_name", "key"), ["src", "index_name", "key"], "left_anti")


def referrers(nodes: DataFrame, ref_list: int = 0) -> DataFrame:
    """Number of distinct keys that refer to each key, and whether the key itself is present."""
    counts = edges(nodes, ref_list).groupBy("index_name", F.col("parent").alias("key")).agg(F.count_distinct("key").alias("n_referrers"))
    here = present(nodes).select("index_name", "key").distinct().withColumn("here", F.lit(True))
    return counts.join(here, ["index_name", "key"], "left").withColumn("here", F.coalesce("here", F.lit(False)))


def with_placeholders(nodes: DataFrame) -> DataFrame:
    """The combined index plus an absent row for each reference that it lacks."""
    rows = combined(nodes).select("index_name", "key", F.lit(False).alias("absent"), "value")
    gaps = edges(nodes, 0).select("index_name", F.col("parent").alias("key")).unionByName(edges(nodes, 1).select("index_name", F.col("parent").alias("key"))).distinct()
    gaps = gaps.join(rows, ["index_name", "key"], "left_anti")
    return rows.unionByName(gaps.select("index_name", "key", F.lit(True).alias("absent"), F.lit(None).cast("string").alias("value")))


def source_conflicts(nodes: DataFrame) -> DataFrame:
    """Keys whose sources disagree on value or references."""
    v = present(nodes).groupBy("index_name", "key").agg(F.count_distinct("src").alias("n_sources"), F.count_distinct(F.coalesce("value", F.lit("\0"))).alias("n_values"), F.count_distinct("refs").alias("n_refs"))
    return v.where("n_values > 1 OR n_refs > 1")


def lookup_from(child: DataFrame, parent: DataFrame, on: list[str], spread: list[str]) -> DataFrame:
    """Skew-safe left join for lookups with hot keys."""
    return salted_join(child, parent, on, spread)


def joined_key(key: Column) -> Column:
    return F.array_join(key, "/")
