"""Tables written between steps, so that iterative work does not depend on one executor's memory or disk."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where it is unset and one machine runs all, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="plinth-shared-"))
    return context.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for a table under the shared folder, among those of this application."""
    return f"{shared_dir(spark)}/plinth/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> bool:
    """Remove the tables that this application's operators wrote between steps; results read from them must be saved before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/plinth/{spark.sparkContext.applicationId}")
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table; later steps read it and do not recompute it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to Python workers that cannot import it from where the driver did; once an application."""
    import shutil
    from pathlib import Path

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    package = Path(__file__).resolve().parents[1]
    if not package.is_dir():  # already imported from a shipped archive
        return
    target = Path(tempfile.mkdtemp(prefix="plinth-package-"))
    shutil.copytree(package, target / "tree" / package.name, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(target / package.name), "zip", target / "tree"))
