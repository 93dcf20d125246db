"""Session settings, and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str | None = None, app: str = "sparkwire", **settings) -> SparkSession:
    """A session with SETTINGS; other settings by name with __ for a dot."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once, so that Python workers there can import it."""
    context = spark.sparkContext
    if getattr(context, "_sparkwire_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="sparkwire-"), "sparkwire.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(here):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("sparkwire", os.path.relpath(path, here)))
    context.addPyFile(target)
    context._sparkwire_shipped = True


def shared_folder(spark) -> str:
    """The folder of spark.checkpoint.dir; a folder of its own only where none is set and the master is local."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def checkpoint(df):
    """Cuts the lineage into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_dropped(spark):
    """What runs within leaves no shuffle files behind; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: A table of at least so many bytes is dealt out if its files give fewer partitions than there are cores.
SPREAD_BYTES = 2 << 20


def spread(df):
    """df over all cores. A large table's files already give enough partitions, and it is returned as it is."""
    context = df.sparkSession.sparkContext
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < SPREAD_BYTES or df.rdd.getNumPartitions() >= context.defaultParallelism:
        return df
    return df.repartition(context.defaultParallelism)
