"""What a row costs: texts parsed once, rules settled once, methods that the JVM compiles, all cores at work."""

import pytest
from pyspark.sql import functions as F

from repocensus.functions.props import flatten, json_object
from repocensus.operators.matching import known_names, match_patterns
from repocensus.operators.store import numbered
from repocensus.plans import registry
from repocensus.sources.catalogue import Catalogue, Pattern
from repocensus.streaming import ingest


def test_a_property_bag_is_parsed_once(spark):
    """However many members it has; the last of a repeated key counts, NULL and unreadable bags are empty."""
    bags = ['{"b":{"x":1},"a":[1,{"y":2}],"Name":"n","c":null}', '{"k":{"z":1},"k":2}', '{"a', None, "{}"]
    flat = spark.createDataFrame([(b,) for b in bags], "p STRING").select(flatten(F.col("p")).alias("f"))
    assert [r.f for r in flat.collect()] == ['{"a":[1,{"y":2}],"b":"{\\"x\\":1}","c":null}', '{"k":2}', "{}", "{}", "{}"]
    assert flat._jdf.queryExecution().analyzed().toString().count("from_json(") == 1
    made = spark.createDataFrame([({"b": "1", "a": '"x"'},)], "m MAP<STRING, STRING>").select(json_object(F.col("m")).alias("o"))
    assert made.first().o == '{"a":"x","b":1}'


def test_ids_need_no_shuffle_of_the_findings(spark):
    rows = spark.range(0, 1000, 1, 7).where("id < 140 OR id > 800")  # tasks without rows
    given = numbered(rows.withColumnRenamed("id", "x"), 5)
    assert sorted(r.id for r in given.collect()) == list(range(6, 6 + rows.count()))
    plan = given._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Exchange" not in given._jdf.queryExecution().executedPlan().toString()
    assert numbered(rows.where("false")).count() == 0


def test_listed_names_have_their_rules_settled_before_the_scan(spark, files):
    names = ["go.mod", "Dockerfile", r"httpd\.conf", "mod", "^x.*y$", "a.c"]
    known = known_names({n: [i] for i, n in enumerate(names)})
    assert set(known["go.mod"]) == {0} and known["httpd.conf"] == [2] and known["mod"] == [3]
    table = files([("r", f"d/{n}", "") for n in ["go.mod", "xgoZmody", "go\nmod", "Dockerfile", "httpd.conf", "my-httpd.conf.bak", "httpdxconf", "mod", "xay", "xa", "a.c", "abcd", ".c"]])
    found = match_patterns(table, Catalogue(tuple(Pattern(n, file_names=(n,)) for n in names)))
    assert {(r.path[2:], r.name) for r in found.collect()} == {
        ("go.mod", "go.mod"), ("xgoZmody", "go.mod"), ("Dockerfile", "Dockerfile"), ("httpd.conf", r"httpd\.conf"), ("my-httpd.conf.bak", r"httpd\.conf"),
        ("mod", "mod"), ("xay", "^x.*y$"), ("xgoZmody", "^x.*y$"), ("a.c", "a.c"), ("abcd", "a.c"),
    }


def test_a_trigger_has_work_for_every_core(spark, sf, monkeypatch):
    asked = []

    def stop(spark, folder, files_per_trigger=None):
        asked.append(files_per_trigger)
        raise InterruptedError

    monkeypatch.setattr(ingest, "file_stream", stop)
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 12)
    with pytest.raises(InterruptedError):
        registry.incremental_scan(spark, sf)
    assert asked == [12]
