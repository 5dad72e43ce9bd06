"""Connected components by alternating large and small stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repocensus.llm.tables import Scope, stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _lows(directed: DataFrame) -> DataFrame:
    """Smallest neighbour of each ``u``, itself included."""
    return directed.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"))


def components(edges: DataFrame) -> DataFrame:
    """(``u``, ``low``): the smallest node of its component for every node of ``edges`` (``u``, ``v``) but that one.

    Every round hangs nodes on smaller neighbours, so paths shorten by a factor and the
    number of rounds is logarithmic in the number of nodes. Neighbourhoods are never gathered: a
    minimum is an aggregate that combines in each task, and is joined back to the edges.
    """
    spark, before, scope = edges.sparkSession, None, Scope()
    with scope:
        edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        last, scope = scope, Scope()
        with scope:
            edges = _round(edges)
        # It is over when a round leaves the same stars.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        last.delete(spark)
        if now == before:
            return stored(edges.select("u", F.col("v").alias("low")), "components")
        before = now


def _round(edges: DataFrame) -> DataFrame:
    # Large star: bigger neighbours go to the smallest neighbour.
    both = _both(edges)
    large = both.join(_lows(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
    large = stored(large, "large-star")
    # Small star: smaller neighbours and the node itself go to the smallest of them.
    lows = _lows(large)
    small = (
        large.join(lows, "u")
        .where("v <> low")
        .select(F.col("v").alias("u"), F.col("low").alias("v"))
        .union(lows.select("u", F.col("low").alias("v")))
        .where("u <> v")
        .distinct()
    )
    return stored(small, "small-star")
