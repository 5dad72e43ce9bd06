import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
from repocensus.operators import manifests
from repocensus.plans.registry import ENTRIES
from repocensus.streaming import activity, ingest

# Registered queries cheap enough for every test run; check.py compares all of them.
SAMPLE = [
    "assembly_names", "branch_names", "commits_per_week", "compose_services", "flattened_properties",
    "git_metrics", "libraries_maven", "pattern_matches_documents", "pattern_rules", "tag_gaps", "terraform_blocks",
]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    cur = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert check.rows(df.columns, df.collect()) == check.rows(columns, cur.fetchall())


def test_every_query_of_the_registry_has_sql():
    assert set(ENTRIES) <= set(entry.queries()) and set(ENTRIES) <= set(entry.oracle_sql())


def test_ingest_is_incremental(spark, files, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    scan = lambda: ingest.ingest(ingest.file_stream(spark, folder), out, state, [manifests.npm()]).awaitTermination()
    files({"package.json": '{"dependencies": {"a": "1"}}'}).write.parquet(folder)
    scan()
    files({"x/package.json": '{"dependencies": {"b": "1"}}', "y/package.json": "{"}).write.mode("append").parquet(folder)
    scan()
    scan()
    rows = spark.read.parquet(out).collect()
    assert sorted((r.kind, r.name or r.path) for r in rows) == [("error", "y/package.json"), ("finding", "a"), ("finding", "b")]


def test_activity_has_late_and_newest_days(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "repo_name STRING, hash STRING, committer_when TIMESTAMP"
    at = lambda d, h=0: dt.datetime(2024, 1, d, h, tzinfo=dt.timezone.utc)
    run = lambda: activity.write_activity(
        activity.distinct_activity(spark.readStream.schema(schema).parquet(folder)), out, state
    ).awaitTermination()
    got = lambda: {
        (r.day, r.commits)
        for r in activity.daily_activity(spark, out).select(F.date_format("day_start", "dd").alias("day"), "commits").collect()
    }
    spark.createDataFrame([("r", "1", at(20)), ("r", "1", at(20)), ("r", "2", at(20, 5)), ("r", "3", at(21))], schema).write.parquet(folder)
    run()
    assert got() == {("20", 2), ("21", 1)}
    late = [("r", "4", at(1)), ("r", "5", at(20)), ("r", "1", at(20))]
    spark.createDataFrame(late, schema).write.mode("append").parquet(folder)
    run()
    run()
    assert got() == {("01", 1), ("20", 3), ("21", 1)}
