"""Storage policies: block use, batches, ranking by size."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.plans.running import running_total

# Fixed values of the policies; sizes in bytes.
MIN_WELL_USED = 0.75
FULL_BLOCK = 3_145_728
FULL_MIXED_BLOCK = 1_572_864


def block_actions(ranges: DataFrame) -> DataFrame:
    """keep, trim or rebuild per block; ranges has block, start, end, length (of the whole block)."""
    a = ranges.groupBy("block").agg(F.sum(F.col("end") - F.col("start")).alias("used"), F.max("end").alias("last"), F.max("length").alias("length"))
    action = F.when(F.col("used") * 2 >= F.col("length"), "keep").when(F.col("used") * 2 > F.col("last"), "trim").otherwise("rebuild")
    return a.select("block", "used", "last", action.alias("action"))


def well_used(ranges: DataFrame) -> DataFrame:
    """Whether a block is worth keeping as it stands; ranges also has prefix, the first key element."""
    a = ranges.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("used"), F.max("length").alias("length"), F.count_distinct("prefix").alias("n_prefixes"))
    ok = F.when(F.col("n") == 1, False).when(F.col("used") < F.col("length") * MIN_WELL_USED, False).when(F.col("length") >= FULL_BLOCK, True).when((F.col("n_prefixes") > 1) & (F.col("length") >= FULL_MIXED_BLOCK), True).otherwise(False)
    return a.select("block", "n", "used", "n_prefixes", ok.alias("well_used"))


def laid_out(docs: DataFrame, block: str, order: list[str], size: str) -> DataFrame:
    """start and end of each row in its block, rows laid one after the other, and the block's length; blocks of any size."""
    placed = running_total(docs, [block], order, size, "end").withColumn("start", F.col("end") - F.col(size))
    whole = docs.groupBy(block).agg(F.sum(size).alias("length"))
    return placed.join(whole.withColumnRenamed(block, "_block"), F.col(block).eqNullSafe(F.col("_block"))).drop("_block")


def size_batches(docs: DataFrame, group: str, order: list[str], size: str, most: int) -> DataFrame:
    """Batch number of each row: a batch ends once its bytes pass ``most`` (running total over whole batches); groups of any size."""
    return running_total(docs, [group], order, size, "_end").withColumn("batch", F.floor((F.col("_end") - F.col(size)) / most)).drop("_end")


def largest(docs: DataFrame, size: str, key: str, k: int) -> DataFrame:
    """The k largest rows, ties by key: a top-k, never a full sort."""
    return docs.orderBy(F.col(size).desc(), F.col(key)).limit(k)
