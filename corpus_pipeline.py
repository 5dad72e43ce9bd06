"""The corpus pipeline: quality rules, exact dedup, near-duplicate dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the
shared folder and reads it back as the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from repocensus.llm.exact import exact_stage
from repocensus.llm.mixing import mix_stage
from repocensus.llm.packing import packed
from repocensus.llm.quality import quality_stage
from repocensus.llm.simhash import simhash_stage
from repocensus.llm.tables import Scope, stored
from repocensus.session import ship_package

# Scratch tables of the stage that ran last. A stage's result is written before the next one starts, so
# they can go then.
_scratch = Scope()


def _stage(work: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        _scratch.delete(spark)
        with _scratch:
            return work(docs)

    return run_stage


STAGES = [
    ("quality rules", _stage(quality_stage)),
    ("exact dedup", _stage(exact_stage)),
    ("near duplicates", _stage(simhash_stage)),
    ("mixing", _stage(mix_stage)),
    ("packing", _stage(packed)),
]

# Tokenising and similarity have no SQL form: tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
