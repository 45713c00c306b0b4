"""Packs: records laid into container files, indices of their places, reads by place, checks of what packs need.

An index value says where a record lies: start and length, for records in blocks also its
bounds inside the block. All is joins and expressions; contents are cut inside the JVM.
"""

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators.index import combined, present
from palimpsest.sources import formats


def position(value: Column) -> Column:
    """(start, length, bare_end) of a value ``[N| ]start length``; a leading N says that the text's last line has no line feed."""
    numbers = F.split(F.regexp_replace(value, "^[N ]", ""), " ")
    return F.struct(F.try_element_at(numbers, F.lit(1)).try_cast("bigint").alias("start"), F.try_element_at(numbers, F.lit(2)).try_cast("bigint").alias("length"), value.startswith("N").alias("bare_end"))


def block_position(value: Column) -> Column:
    """(start, length, from, to) of a value ``start length from to``: the block's place in its pack, and the record's inside the block."""
    numbers = F.split(value, " ")
    return F.struct(*[F.try_element_at(numbers, F.lit(i + 1)).try_cast("bigint").alias(n) for i, n in enumerate(("start", "length", "from", "to"))])


def build_details(nodes: DataFrame) -> DataFrame:
    """index_name, key, src, method, basis, parents, start, length of each combined row that names a place.

    A row with a basis (reference list 1) is stored as a line delta, any other whole.
    """
    rows = combined(nodes).withColumn("at", position(F.col("value")))
    basis = F.expr("try_element_at(try_element_at(refs, 2), 1)")
    return rows.select("index_name", "key", "src", F.when(basis.isNull(), "fulltext").otherwise("line-delta").alias("method"), basis.alias("basis"), F.expr("try_element_at(refs, 1)").alias("parents"), "at.start", "at.length")


def read_order(details: DataFrame) -> DataFrame:
    """Places by which reading goes through each source once from start to end: sort by src, start."""
    return details.select("src", "start", "index_name", "key").where("start IS NOT NULL")


def read_ranges(details: DataFrame, gap: int = 4096) -> DataFrame:
    """(src, start, end, n): stretches that hold all places of a source, neighbours joined across gaps of at most ``gap`` bytes.

    A task looks at one source and its places, not at contents; overlapping places are one stretch.
    """
    order = W.partitionBy("src").orderBy("start", "end")
    at = details.where("start IS NOT NULL AND length IS NOT NULL").select("src", "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    reached = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    cut = at.withColumn("new", F.coalesce(F.col("start") > reached + gap, F.lit(True)).cast("int")).withColumn("stretch", F.sum("new").over(order))
    return cut.groupBy("src", "stretch").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).drop("stretch")


def pack_problems(nodes: DataFrame) -> DataFrame:
    """(src, index_name, key, problem) of packs that cannot stand alone: texts and signatures of revisions, and bases, that the pack lacks."""
    rows = present(nodes).select("src", "index_name", "key", F.expr("try_element_at(try_element_at(refs, 2), 1)").alias("basis")).dropDuplicates(["src", "index_name", "key"])
    revisions = rows.where("index_name = 'revisions'").select("src", F.element_at("key", 1).alias("revision"))
    owned = rows.where("index_name <> 'revisions'").withColumn("revision", F.element_at("key", -1))
    lost = owned.join(revisions, ["src", "revision"], "left_anti").select("src", "index_name", "key", F.concat("index_name", F.lit(" of a revision that is not here")).alias("problem"))
    here = rows.select("src", "index_name", F.col("key").alias("basis"))
    bare = rows.where("basis IS NOT NULL").join(here, ["src", "index_name", "basis"], "left_anti").select("src", "index_name", "key", F.lit("basis is not here").alias("problem"))
    return lost.unionByName(bare)


def packed(records: DataFrame, per_pack: int = 5000) -> DataFrame:
    """(pack, n, content): containers of about ``per_pack`` records (key, body), by key hash; a pack is named by its content.

    The number of packs follows the count, so a task holds one pack. Null bodies are empty;
    keys are unique.
    """
    n_packs = max(1, -(-records.count() // per_pack))
    rows = records.select("key", F.coalesce("body", F.lit(b"")).alias("body")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(n_packs)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        content = formats.container_bytes([([k], bytes(b)) for k, b in zip(pdf["key"], pdf["body"])])
        return pd.DataFrame({"pack": [hashlib.md5(content).hexdigest()], "n": [len(pdf)], "content": [content]})

    return rows.groupBy("bucket").applyInPandas(run, "pack string, n bigint, content binary")


def pack_index(packs: DataFrame) -> DataFrame:
    """(key, pack, start, length) of each record's body, by one walk over each container."""
    def run(batches):
        for b in batches:
            out = []
            for pack, content in zip(b["pack"], b["content"]):
                content, at = bytes(content), 0
                for r in formats.parse_container(content):
                    # a body follows its names and an empty line; bodies come in order
                    at = content.index(b"\n\n" + r["body"], at) + 2
                    out.append(("/".join(r["names"]), pack, at, len(r["body"])))
                    at += len(r["body"])
            yield pd.DataFrame(out, columns=["key", "pack", "start", "length"])

    return packs.select("pack", "content").mapInPandas(run, "key string, pack string, start bigint, length bigint")


def read_packed(packs: DataFrame, places: DataFrame) -> DataFrame:
    """(key, body) of places (key, pack, start, length): every pack meets its places once, bodies are cut in the JVM."""
    grouped = places.join(packs.select("pack", "content"), "pack")
    return grouped.select("key", F.substring("content", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("body"))


def first_seen_groups(keys: DataFrame) -> DataFrame:
    """(prefix, first, key, pos): keys (key, pos) with the place at which their prefix was first seen; sort by first, pos to read group by group."""
    p = keys.withColumn("prefix", F.regexp_extract("key", "^(.*)/[^/]*$", 1))
    return p.join(p.groupBy("prefix").agg(F.min("pos").alias("first")), "prefix").select("prefix", "first", "key", "pos")
