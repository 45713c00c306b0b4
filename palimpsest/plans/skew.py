"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096  # buckets of the key histogram: the most rows it can send to the driver
HOT = 64  # a bucket is hot above 1/HOT of all rows, so fewer than HOT are hot
FEW = 10_000  # rows below which no bucket is worth splitting
SMALL = 200_000  # rows up to which a side is broadcast


def bucket_of(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def pieces(counts: dict[int, int], partitions: int) -> dict[int, int]:
    """Hot buckets and the number of pieces that brings each down to an even share of the rows."""
    total = sum(counts.values())
    even = max(1, total // max(HOT, partitions))
    return {b: -(-n // even) for b, n in counts.items() if n > max(total / HOT, FEW)}


def hot_buckets(df: DataFrame, keys: list[str]) -> dict[int, int]:
    """Pieces of each key bucket with more than 1/HOT of all rows, found by one counting pass.

    Counts are combined map-side; at most BUCKETS rows of two integers reach the driver.
    """
    counts = df.select(bucket_of(keys).alias("b")).groupBy("b").count().collect()
    return pieces({r["b"]: r["count"] for r in counts}, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], how: str = "left", hot: dict[int, int] | None = None) -> DataFrame:
    """Sort-merge join of ``left`` with ``right`` on ``keys``.

    Rows of hot key buckets on the left are split into pieces by the hash of the ``spread``
    columns, as many as their measured share asks for; the matching right rows, and only
    those, are repeated per piece. Both sides are shuffled on the same columns, sorted and
    merged linearly. ``right`` should hold few rows a key; null keys match nothing. ``hot``
    is the result of ``hot_buckets`` where the left side would be costly to count here.
    """
    if hot is None:
        hot = hot_buckets(left, keys)
    if not hot:
        return left.join(right.hint("merge"), keys, how)
    n = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in hot.items() for x in kv]), bucket_of(keys)), F.lit(1))
    lhs = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), n).cast("int"))
    rhs = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1)))
    return lhs.join(rhs.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def small_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], how: str = "inner", most: int = SMALL) -> DataFrame:
    """Join with a side that is usually small: broadcast only if it holds at most ``most`` rows, else salted sort-merge."""
    if right.limit(most + 1).count() <= most:
        return left.join(F.broadcast(right), keys, how)
    return salted_join(left, right, keys, spread, how)
