"""Spreading rows over the cluster before functions that cost more than their bytes suggest."""

from pyspark.sql import DataFrame


def spread(df: DataFrame, per_core: int = 3) -> DataFrame:
    """Rows in at least ``per_core`` partitions a core; large inputs already have them and stay as they are.

    Select the needed columns first: what is passed on here is shuffled.
    """
    want = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
