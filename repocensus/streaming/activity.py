"""Running commit activity per repository and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Hashes seen are kept without expiry, so they belong on disk.
STATE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def distinct_activity(commits: DataFrame) -> DataFrame:
    """(repo_name, day_start) of every commit of a stream, each hash of a repository once.

    However late a commit comes it counts, so there is no watermark: the state holds all hashes seen.
    """
    once = commits.dropDuplicates(["repo_name", "hash"])
    return once.select("repo_name", F.date_trunc("day", "committer_when").alias("day_start"))


def write_activity(activity: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append what is new to the table of active days; a restarted stream adds nothing twice."""
    spark = activity.sparkSession
    before = spark.conf.get(STATE, None)
    spark.conf.set(STATE, ROCKSDB)
    try:  # a query takes its settings when it starts
        return (
            activity.writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.unset(STATE) if before is None else spark.conf.set(STATE, before)


def daily_activity(spark: SparkSession, out: str) -> DataFrame:
    """Commits per repository and UTC day so far, the newest days included."""
    return spark.read.parquet(out).groupBy("repo_name", "day_start").agg(F.count("*").alias("commits"))
