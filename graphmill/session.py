"""Session helpers: lineage cuts in the shared folder, and this package for Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent
#: Whether the shuffle files of a query go as soon as it ends; otherwise they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shipped(spark: SparkSession) -> None:
    """Give Python workers this package, unless they find it by their path already."""
    context = spark.sparkContext
    found = {Path(x).resolve() for x in os.environ.get("PYTHONPATH", "").split(os.pathsep) if x}
    if PACKAGE.parent in found or getattr(context, "_package_shipped", False):
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-package-')}/{PACKAGE.name}", "zip", PACKAGE.parent, PACKAGE.name)
    context.addPyFile(archive)
    context._package_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; without that setting a temporary one, on one machine only."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not hasattr(context, "_own_folder"):
        context._own_folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    return context._own_folder


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark's file systems hold it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of each frame made go when its query ends: for queries that save their rows, so that none is read again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder of ``spark.checkpoint.dir``."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint()  # the setting holds for frames made under it


def saved_rows(df: DataFrame, which: str = "true") -> tuple[DataFrame, int]:
    """``saved``, and how many rows meet the condition ``which``: counted by the job that saves them.

    A task that runs again may count twice; whether the number is 0 is exact.
    """
    seen = Observation()
    out = saved(df.observe(seen, F.count_if(F.expr(which)).alias("n")))
    return out, seen.get.get("n") or 0
