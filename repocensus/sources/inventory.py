"""Repository inventories and history tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repocensus.functions.paths import repo_name_from_url


def latest_repositories(listings: DataFrame) -> DataFrame:
    """One row per ``full_name``: the one of the highest batch, ties by payload.

    A grouped maximum combines on the map side, so endless re-listings of one repository
    never meet in one task.
    """
    newest = F.max(F.struct("batch", "payload", "clone_url")).alias("newest")
    return listings.groupBy("full_name").agg(newest).select("full_name", "newest.*")


def with_repo_names(repos: DataFrame, url: str = "clone_url") -> DataFrame:
    """Add ``repo_name`` and ``error`` derived from the clone URL."""
    return repos.withColumn("__parsed", repo_name_from_url(F.col(url))).select(
        *repos.columns, "__parsed.repo_name", "__parsed.error"
    )


def _utc(c: Column) -> Column:
    """A zoned timestamp as UTC wall clock; an NTZ column is taken to be UTC already."""
    return F.convert_timezone(None, F.lit("UTC"), c.cast("timestamp_ntz"))


def history(
    table: DataFrame, times: list[str], offset: str | None = "tz_offset_minutes"
) -> DataFrame:
    """History rows with their time columns as UTC TIMESTAMP_NTZ."""
    types = dict(table.dtypes)
    fixed = {
        t: F.col(t) if types[t] == "timestamp_ntz" else _utc(F.col(t)) for t in times
    }
    if offset and offset not in table.columns:
        fixed[offset] = F.lit(0)
    return table.withColumns(fixed)


def refs(table: DataFrame) -> DataFrame:
    return history(table, ["author_when"], None)


def tags(table: DataFrame) -> DataFrame:
    return history(table, ["tagger_when", "committer_when"], None)


def commits(table: DataFrame) -> DataFrame:
    return history(table, ["author_when", "committer_when"])
