"""Order-dependent steps without a window over a whole group.

Rows are sorted over range partitions, so a group of any size is spread over as many tasks as it fills. What
crosses from one task to the next is one row per task, or one number per group and task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repocensus.session import shared_dir

PLACE_BITS = 33  # of a row's place within its task, as monotonically_increasing_id has it


def sorted_ranges(rows: DataFrame, *keys: str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)


def written(rows: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table in the shared folder, read once however often it is used."""
    path = shared_dir(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def ranked(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """The rows with ``rank``: 0, 1 and so on within ``by``, in the given order."""
    table = written(sorted_ranges(rows, by, *order).withColumn("__place", F.monotonically_increasing_id()), "ranked")
    table = table.withColumn("__part", F.shiftright("__place", PLACE_BITS))
    runs = table.groupBy(by, "__part").agg(F.min("__place").alias("__low"), F.count("*").alias("n"))
    # As many rows for a group as tasks that have some of it.
    before = F.sum("n").over(Window.partitionBy(by).orderBy("__part")) - F.col("n")
    starts = runs.select(by, "__part", "__low", before.alias("__before"))
    rank = (F.col("__before") + F.col("__place") - F.col("__low")).alias("rank")
    return table.join(starts, [by, "__part"]).select(*rows.columns, rank)


def with_previous(rows: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """The rows with ``previous_<column>`` for carried columns: those of the row before in the order of ``keys``.

    Every task hands its last row to the next one that has rows.
    """
    spark = rows.sparkSession
    fields = [T.StructField(f"previous_{c}", rows.schema[c].dataType) for c in carried]
    edges = [T.StructField("__part", T.IntegerType()), T.StructField("__first", T.BooleanType()), T.StructField("__last", T.BooleanType())]
    names = [*rows.columns, *(f.name for f in fields + edges)]

    def run(batches):
        part, held, before = TaskContext.get().partitionId(), None, None

        def closed(columns, first, last):
            n = len(columns[0])
            flags = [pa.array([part] * n, pa.int32()), pa.array([first] + [False] * (n - 1)), pa.array([False] * (n - 1) + [last])]
            return pa.RecordBatch.from_arrays([*columns, *flags], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(batch.schema.get_field_index(c)) for c in carried]
            earlier = before or [pa.nulls(1, c.type) for c in own]
            if held:
                yield closed(*held, False)
            held = ([*batch.columns, *(pa.concat_arrays([b, c.slice(0, len(c) - 1)]) for b, c in zip(earlier, own, strict=True))], before is None)
            before = [c.slice(len(c) - 1) for c in own]
        if held:
            yield closed(*held, True)

    table = written(sorted_ranges(rows, *keys).mapInArrow(run, T.StructType([*rows.schema.fields, *fields, *edges])), "previous")
    ends = table.where("__first OR __last").select("__part", "__last", *carried).collect()  # at most two rows a task
    last = {r["__part"]: r for r in ends if r["__last"]}
    parts = sorted(last)
    handed = [(p, *(last[q][c] for c in carried)) for q, p in zip(parts, parts[1:], strict=False)]
    schema = T.StructType([T.StructField("__part", T.IntegerType()), *(T.StructField(f"__handed_{c}", f.dataType) for c, f in zip(carried, fields, strict=True))])
    found = table.join(spark.createDataFrame(handed, schema), "__part", "left")
    return found.select(
        *rows.columns, *[F.when(F.col("__first"), F.col(f"__handed_{c}")).otherwise(F.col(f"previous_{c}")).alias(f"previous_{c}") for c in carried]
    )
