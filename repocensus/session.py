"""Session defaults and the shared scratch location."""

from __future__ import annotations

import pathlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Runtime settings only; anything the cluster already decided stays as it is.
RUNTIME_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: str = "8", app: str = "repocensus", **conf: str) -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**RUNTIME_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_utc(spark: SparkSession) -> SparkSession:
    """Pin the session time zone; every date in a finding is written in an explicit zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_base(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    A local session without that setting, as in tests, gets a temporary folder as its checkpoint
    folder; on a cluster the setting has to be there, since machines do not share temporary folders.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    chosen = context.getLocalProperty("repocensus.scratch")
    if chosen:
        return chosen
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError(f"{CHECKPOINT_KEY} is not set: name a folder that driver and executors share")
    base = tempfile.mkdtemp(prefix="repocensus-")
    context.setCheckpointDir(base)
    context.setLocalProperty("repocensus.scratch", base)
    return base


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_base(spark)}/{purpose}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, once per application (needed by the Arrow functions).

    Clusters that already distribute it, with ``--py-files`` say, need not call this.
    """
    context = spark.sparkContext
    if context.getLocalProperty("repocensus.shipped"):
        return
    package = pathlib.Path(__file__).parent
    archive = shutil.make_archive(
        f"{tempfile.mkdtemp(prefix='repocensus-')}/repocensus", "zip", package.parent, package.name
    )
    context.addPyFile(archive)
    context.setLocalProperty("repocensus.shipped", "yes")
