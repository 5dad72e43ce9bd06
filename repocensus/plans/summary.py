"""Findings about findings: grouped aggregates written back as finding rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repocensus.functions.props import number, props
from repocensus.schemas import FINDING_COLUMNS


def summarise(
    findings: DataFrame, name: str, value: Column, by: str = "repo_name", type: str = "summary"
) -> DataFrame:
    """One finding per group whose ``value`` property is the given aggregate."""
    grouped = findings.groupBy(F.col(by).alias("repo_name")).agg(value.alias("value"))
    return grouped.select(
        F.lit(name).alias("name"),
        F.lit(type).alias("type"),
        F.lit("").alias("category"),
        F.lit("").alias("path"),
        "repo_name",
        props(value=number(F.col("value"))).alias("properties"),
    ).select(*FINDING_COLUMNS)
