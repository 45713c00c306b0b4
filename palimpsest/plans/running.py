"""Running totals in groups that may be too large for one task."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.plans.durable import durable


def running_total(df: DataFrame, by: list[str], order: list[str], value: str, total: str) -> DataFrame:
    """The rows with ``total``, the sum of ``value`` over their group up to and including the row.

    Rows are cut into ranges of (by, order); each range of a group is summed by itself and
    starts from what the group's earlier ranges hold, of which there are no more than
    partitions. ``order`` should tell the rows of a group apart.
    """
    placed = durable(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    cut = [*by, "_range"]
    sums = placed.groupBy(*cut).agg(F.sum(value).alias("_sum"))
    earlier = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(*cut, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    within = W.partitionBy(*cut).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    keyed = placed.withColumn("_own", F.sum(value).over(within))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in cut]
    return keyed.alias("a").join(base.alias("b"), same).select(*[F.col(f"a.{c}") for c in df.columns], (F.col("a._own") + F.col("b._base")).alias(total))
