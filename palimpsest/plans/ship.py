"""Makes this package importable in Python workers, wherever the session runs."""

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once an application: adds the package as a zip file that Spark hands to every executor."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        work = Path(tempfile.mkdtemp(prefix="package-"))
        shutil.copytree(root, work / "tree" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(str(work / root.name), "zip", work / "tree"))
        shutil.rmtree(work / "tree")
        _shipped.add(sc.applicationId)
