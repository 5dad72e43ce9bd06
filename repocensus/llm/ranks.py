"""Global ranks without one task over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repocensus.llm.tables import stored


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the 1-based position in the given total order.

    Rows are dealt by ranges; a row's rank is its place in its range after the sizes of the ranges before.
    Only those sizes, one row per range, meet in one task.
    """
    dealt = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_place", place).join(before, "_range").withColumn(name, F.col("_place") + F.col("_before")).drop("_range", "_place", "_before")
