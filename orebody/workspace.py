"""Shared scratch space and materialised tables.

Intermediate results that are read more than once are written as Parquet below the folder the
session names in ``spark.checkpoint.dir``, which every executor shares; the lineage is cut there
and a lost executor costs only its running tasks.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="orebody-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the interpreter ends."""
    path = f"{shared_dir(spark)}/orebody-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@contextmanager
def released():
    """Tables and paths made inside are removed at the end; for jobs that return nothing lazy, in sessions that live long."""
    before = len(_made)
    try:
        yield
    finally:
        for spark, path in _made[before:]:
            remove(spark, path)
        del _made[before:]


def materialise(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write ``df`` once and read it back; types and order of columns stay. ``free``: its shuffle files are removed right after."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(CLEANUP, None)
    if free:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package where it isn't installed: by path in local mode, else as a zip file."""
    context, root = spark.sparkContext, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.path.basename(root) == "site-packages":
        return
    if context.master.startswith("local["):
        known = context.environment.get("PYTHONPATH", "")
        if root not in known.split(os.pathsep):
            context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    elif not getattr(context, "_orebody_shipped", False):
        name = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="orebody-"), "orebody"), "zip", root, os.path.basename(os.path.dirname(os.path.abspath(__file__))))
        context.addPyFile(name)
        context._orebody_shipped = True


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone already
            pass


atexit.register(_clean)
