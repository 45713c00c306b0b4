"""References to records that do not exist, by table and month.

References and parent keys are shuffled on the same key, sorted and merged linearly
(two sort-merge joins with hot keys split); each parent key carries its validity: first
arrival, first arrival as a placeholder, and whether it was removed.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.plans.skew import bucket_of, pieces, salted_join

NULL_REVISION = "null:"  # fixed value: the id that stands for "no revision"


def index_key(name: Column, key: Column) -> Column:
    return F.concat(name, F.lit(":"), F.array_join(key, "/"))


def _clean(refs: Column) -> Column:
    return F.array_distinct(F.filter(refs, lambda x: x.isNotNull() & (x != NULL_REVISION)))


def _index_refs(name: Column, refs: Column) -> Column:
    """Reference keys of a node as strings; keys with null elements and ``null:`` name nothing."""
    lists = F.flatten(F.filter(refs, lambda x: x.isNotNull()))
    real = F.filter(
        lists,
        lambda k: k.isNotNull()
        & (F.size(k) > 0)
        & ~F.exists(k, lambda x: x.isNull())
        & ~((F.size(k) == 1) & (F.element_at(k, 1) == NULL_REVISION)),
    )
    return F.array_distinct(F.transform(real, lambda k: index_key(name, k)))


def validity(revision: DataFrame, header: DataFrame, index_node: DataFrame, removed_key: DataFrame) -> DataFrame:
    """One row per key: tag+key, first arrival of present rows, of placeholders, and the removal flag.

    One hash aggregation with map-side combining, so a key with many rows costs one row a task.
    """
    never = F.lit(None).cast(index_node.schema["arrived_at"].dataType)
    revs = revision.select(F.concat(F.lit("r"), "revision_id").alias("k"), F.col("arrived_at").alias("here"), never.alias("gap"), F.lit(0).alias("rm"))
    heads = header.select(F.concat(F.lit("h"), "header_id").alias("k"), F.col("arrived_at").alias("here"), never.alias("gap"), F.lit(0).alias("rm"))
    absent = F.coalesce("absent", F.lit(False))
    nodes = index_node.select(
        F.concat(F.lit("n"), index_key(F.col("index_name"), F.col("key"))).alias("k"),
        F.when(~absent, F.col("arrived_at")).alias("here"),
        F.when(absent, F.col("arrived_at")).alias("gap"),
        F.lit(0).alias("rm"),
    )
    tag = F.when(F.col("tab") == "revision", "r").when(F.col("tab") == "index_node", "n")
    gone = removed_key.select(F.concat(tag, "rec_key").alias("k"), never.alias("here"), never.alias("gap"), F.lit(1).alias("rm"))
    rows = revs.unionAll(heads).unionAll(nodes).unionAll(gone).where("k IS NOT NULL")
    return rows.groupBy("k").agg(F.min("here").alias("here"), F.min("gap").alias("gap"), F.max("rm").alias("rm"))


def references(revision: DataFrame, header: DataFrame, index_node: DataFrame) -> DataFrame:
    """Rows (f, k, refs): field tag, tagged key of the referring record, tagged target keys of one delivered row."""
    tagged = lambda t, refs: F.transform(refs, lambda x: F.concat(F.lit(t), x))
    revs = revision.select(F.lit("p").alias("f"), F.concat(F.lit("r"), "revision_id").alias("k"), tagged("r", _clean(F.col("parent_ids"))).alias("refs"))
    heads = header.select(F.lit("g").alias("f"), F.concat(F.lit("h"), "header_id").alias("k"), tagged("r", _clean(F.col("ghosts"))).alias("refs"))
    absent = F.coalesce("absent", F.lit(False))
    key = F.concat(F.lit("n"), index_key(F.col("index_name"), F.col("key")))
    nodes = index_node.select(
        F.when(absent, "a").otherwise("x").alias("f"),
        key.alias("k"),
        F.when(absent, F.array(key)).otherwise(tagged("n", _index_refs(F.col("index_name"), F.col("refs")))).alias("refs"),
    )
    return revs.unionAll(heads).unionAll(nodes).where("k IS NOT NULL AND size(refs) > 0")


def _hot(refs: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """Hot buckets of the referring and of the target keys, from one counting pass before any join."""
    own = refs.select(F.lit(0).alias("side"), bucket_of(["k"]).alias("b"))
    targets = refs.select(F.explode("refs").alias("k")).select(F.lit(1).alias("side"), bucket_of(["k"]).alias("b"))
    rows = own.unionAll(targets).groupBy("side", "b").count().collect()  # at most two histograms of BUCKETS counters
    parts = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = (pieces({r["b"]: r["count"] for r in rows if r["side"] == side}, parts) for side in (0, 1))
    return a, b


def orphan_references(revision: DataFrame, header: DataFrame, index_node: DataFrame, removed_key: DataFrame) -> DataFrame:
    """tab, field, period, rec_key, ref_key, state of every reference to a deleted, missing or late target.

    Null or empty reference lists, null elements and ``null:`` give no row; rows with a null key
    are ignored; a record without any arrival time has a null period and no late references;
    repeated deliveries count once. Empty tables give an empty result.
    """
    valid = validity(revision, header, index_node, removed_key)
    recs = valid.select("k", F.col("here").alias("rec_here"), F.col("gap").alias("rec_gap"))
    refs = references(revision, header, index_node)
    hot_recs, hot_targets = _hot(refs)
    rows = salted_join(refs, recs, ["k"], ["refs"], hot=hot_recs)
    pairs = rows.select(
        "f",
        F.col("k").alias("rec"),
        F.when(F.col("f") == "a", F.col("rec_gap")).otherwise(F.col("rec_here")).alias("first"),
        F.explode("refs").alias("k"),
    )
    targets = valid.select("k", "here", "rm")
    state = (
        F.when(F.col("rm") == 1, "deleted")
        .when(F.col("here").isNull(), "missing")
        .when(F.col("here") > F.col("first"), "late")
    )
    found = salted_join(pairs, targets, ["k"], ["rec"], hot=hot_targets).withColumn("state", state).where("state IS NOT NULL")
    named = lambda **by: F.when(F.col("f") == "p", by["p"]).when(F.col("f") == "g", by["g"]).when(F.col("f") == "x", by["x"]).otherwise(by["a"])
    return found.select(
        named(p="revision", g="dirstate_header", x="index_node", a="index_node").alias("tab"),
        named(p="parent_ids", g="ghosts", x="refs", a="absent").alias("field"),
        F.date_format("first", "yyyy-MM").alias("period"),
        F.expr("substr(rec, 2)").alias("rec_key"),
        F.expr("substr(k, 2)").alias("ref_key"),
        "state",
    ).distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """Counts of orphan references by table, field, month and state."""
    return found.groupBy("tab", "field", "period", "state").agg(F.count(F.lit(1)).alias("n_refs"), F.count_distinct("ref_key").alias("n_targets"))
