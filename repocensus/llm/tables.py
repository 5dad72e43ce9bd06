"""Scratch tables in the shared folder, and other helpers of the operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repocensus.session import shared_dir

# White space of the contracts: blank and \t \n \v \f \r.
SPACES = r"[\x20\x09-\x0D]+"


# Folders of the running scope, if there is one.
_scope: list[str] | None = None


class Scope:
    """Scratch folders made while it is open, to be deleted once nothing reads them any more."""

    def __init__(self):
        self.folders: list[str] = []

    def __enter__(self) -> Scope:
        global _scope
        self._before, _scope = _scope, self.folders
        return self

    def __exit__(self, *_) -> None:
        global _scope
        _scope = self._before

    def delete(self, spark: SparkSession) -> None:
        while self.folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(self.folders.pop())
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder in the shared one."""
    path = shared_dir(spark, f"llm-{purpose}")
    if _scope is not None:
        _scope.append(path)
    return path


# Lets a query's shuffle files go when it ends, not when the driver next collects garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, purpose: str, shuffles_go: bool = False) -> DataFrame:
    """The same rows as a Parquet table below ``spark.checkpoint.dir``.

    Cuts lineage like a checkpoint (a lost executor costs no recomputation), keeps columns apart so
    that later reads are pruned, and gives later joins a measured size. With ``shuffles_go`` the shuffle
    files of the write, which nothing reads after it, are deleted at its end.
    """
    path = scratch_folder(df.sparkSession, purpose)
    before = df.sparkSession.conf.get(SHUFFLES_GO)
    if shuffles_go:
        df.sparkSession.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        df.sparkSession.conf.set(SHUFFLES_GO, before)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._llm_path = path
    return table


def place_of(table: DataFrame) -> str:
    """The folder of a table that ``stored`` returned."""
    return table._llm_path


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(text: str | Column = "text") -> Column:
    """Text as bytes, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def arrow_batches(spark, rows: int = 512) -> None:
    """Batches for the Arrow functions: few enough rows that very long texts fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of at most so many rows for the Arrow functions of what is written inside; the setting before comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
