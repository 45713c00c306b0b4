"""Working trees on a file system: scans and what differs from a recorded tree."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, root: str, ignored: str | None = None) -> DataFrame:
    """path, name, size, modified, sha1 of every file below a folder of any Hadoop file system; contents never leave their task.

    ``ignored`` is a pattern of paths to leave out. Folders are those of the files' paths.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:(?://[^/]*)?(?=/)", ""), "^" + base.replace(".", r"\.") + "/", "")
    out = files.select(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha1("content").alias("sha1"))
    out = out.withColumn("name", F.regexp_extract("path", "([^/]*)$", 1))
    return out.where(~F.col("path").rlike(ignored)) if ignored else out


def folders(files: DataFrame) -> DataFrame:
    """Every folder that a scanned file lies in, once."""
    parts = F.split("path", "/")
    ways = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return files.where(F.col("path").contains("/")).select(F.explode(ways).alias("path")).distinct()


def differences(recorded: DataFrame, files: DataFrame) -> DataFrame:
    """(path, change): missing, modified or unknown files against recorded (path, size, sha1); sizes settle most without a hash."""
    a = recorded.select("path", F.col("size").alias("size0"), F.col("sha1").alias("sha0"), F.lit(True).alias("was"))
    j = a.join(files.select("path", "size", "sha1", F.lit(True).alias("there")), "path", "full")
    change = F.when(F.col("there").isNull(), "missing").when(F.col("was").isNull(), "unknown").when((F.col("size0") != F.col("size")) | (F.col("sha0") != F.col("sha1")), "modified")
    return j.select("path", change.alias("change")).where("change IS NOT NULL")


def cached_hashes(files: DataFrame, cache: DataFrame, cutoff_seconds: int = 3) -> DataFrame:
    """path, sha1, reused: hashes of a cache (path, size, modified, sha1, read_at) where size and time agree and the file was old enough when read."""
    c = cache.where(F.col("modified") < F.col("read_at") - F.expr(f"INTERVAL {cutoff_seconds} SECONDS")).select("path", F.col("size").alias("size0"), F.col("modified").alias("modified0"), F.col("sha1").alias("sha0")).dropDuplicates(["path"])
    same = (F.col("size0") == F.col("size")) & (F.col("modified0") == F.col("modified"))
    return files.join(c, "path", "left").select("path", F.when(same, F.col("sha0")).otherwise(F.col("sha1")).alias("sha1"), F.coalesce(same, F.lit(False)).alias("reused"))
