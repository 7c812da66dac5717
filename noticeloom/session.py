"""SparkSession factory and the settings the library reads from a session."""

from __future__ import annotations

import contextlib
import gc
import tempfile
from collections.abc import Iterator

from pyspark.sql import SparkSession


def session(app: str = "noticeloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution. conf: further settings, dots written as '__'."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's, or, where none is set and the master is local, a temporary one.

    A cluster's executors can't read each other's temporary folders, so there a folder must be set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    held = context.getCheckpointDir()
    if held:
        return held
    if not named and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="noticeloom-checkpoint-"))
    return context.getCheckpointDir()


def release(spark: SparkSession) -> None:
    """Have shuffle files of finished jobs deleted: they stay until the driver collects its garbage, which may be long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reads, if it is there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries built inside delete their shuffle files when they end: for steps whose results are checkpoints."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
