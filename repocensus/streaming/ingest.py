"""Incremental scans: new file-table data in, findings appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from repocensus.functions.props import flatten
from repocensus.operators.extractor import Extractor
from repocensus.plans.scan import scan_records
from repocensus.schemas import FILES


def file_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """New parquet parts of a FILES table as they appear."""
    reader = spark.readStream.schema(FILES)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def ingest(
    files: DataFrame,
    out: str,
    checkpoint: str,
    extractors: list[Extractor] | None = None,
) -> StreamingQuery:
    """Scan what is new and append it to ``out``, exactly once.

    Extractors work row by row, so the batch plan runs unchanged and keeps no state.
    ``out`` holds findings and extractor errors under ``kind=finding`` and ``kind=error``.
    """
    records = scan_records(files, extractors)
    kind = F.when(F.col("extractor").isNull(), F.lit("finding")).otherwise(F.lit("error"))
    stored = records.withColumn("kind", kind).withColumn(
        "properties", F.when(F.col("kind") == "finding", flatten(F.col("properties")))
    )
    return (
        stored.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .partitionBy("kind")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
