import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from repocensus.functions import times
from repocensus.operators import gitmetrics as g
from repocensus.schemas import COMMITS, REFS, TAGS
from repocensus.sources import inventory


def at(text):
    return dt.datetime.fromisoformat(text)


@pytest.fixture(scope="module")
def history(spark):
    repos = spark.createDataFrame([("a",), ("empty",)], "repo_name string")
    refs = spark.createDataFrame(
        [("a", "refs/heads/main", "branch", at("2024-03-01")), ("a", "refs/remotes/o/x", "remote", at("2023-01-01")),
         ("a", "refs/tags/v1", "tag", at("2024-03-01"))], REFS)
    tags = spark.createDataFrame(
        [("a", "v1", at("2024-01-01"), at("2020-01-01")), ("a", "v2", None, at("2024-01-04")),
         ("a", "v3", at("2024-01-11 12:00:00"), None)], TAGS)
    commits = spark.createDataFrame(
        [
            ("a", "h1", "x@e", None, at("2024-12-30 22:30:00"), 120),
            ("a", "h1", "x@e", None, at("2024-12-30 22:30:00"), 120),
            ("a", "h2", "X@e", None, at("2024-12-30 10:00:00"), 0),
            ("a", "h3", "x@e", None, at("2025-01-01 00:00:00"), -90),
            ("a", "h4", "y@e", None, at("2025-02-01 00:00:00"), 0),
        ],
        COMMITS,
    )
    return repos, refs, tags, commits


def values(df, repo):
    return {r.name: json.loads(r.properties) for r in df.where(F.col("repo_name") == repo).collect()}


def test_thirteen_rows_per_repository(history):
    found = g.git_metrics(*history)
    a, empty = values(found, "a"), values(found, "empty")
    assert len(a) == len(empty) == 13 and found.count() == 26
    assert a["Branch Count"] == {"branches": ["refs/heads/main", "refs/remotes/o/x"], "cutoff": -1, "value": 2}
    assert a["Tag Count"] == {"value": 3}
    assert a["Average Time Between Tags"] == {"value": "5.25 days"}
    assert a["Total Commits"] == {"value": 4}
    assert a["First Commit Date"] == {"value": "2024-12-30T10:00:00Z"}
    assert a["Last Commit Date"] == {"value": "2025-02-01T00:00:00Z"}
    # own clocks: 2024-12-31 00:30 +02:00, 2024-12-30, 2024-12-31 22:30 -01:30, 2025-02-01
    assert a["Max Commits Per Day"] == {"value": 2}
    assert a["Average Commits Per Day"] == {"value": 4 / 3}
    assert a["Max Commits Per Week"] == {"value": 3} and a["Average Commits Per Week"] == {"value": 2.0}
    assert a["Max Commits Per Month"] == {"value": 3} and a["Average Commits Per Month"] == {"value": 2.0}
    assert a["Unique Contributors"] == {"value": 3}
    assert empty["Branch Count"] == {"branches": None, "cutoff": -1, "value": 0}
    assert empty["Average Time Between Tags"] == {"value": g.NOT_ENOUGH_TAGS}
    assert empty["First Commit Date"] == empty["Last Commit Date"] == {"value": times.ZERO_TIME}
    assert empty["Average Commits Per Week"] == {"value": 0.0} and empty["Total Commits"] == {"value": 0}


def test_cutoff(history):
    a = values(g.git_metrics(*history, cutoff="2024-01-04"), "a")
    assert a["Branch Count"]["value"] == 1 and a["Branch Count"]["cutoff"] == 1704326400
    assert a["Tag Count"]["value"] == 2
    assert a["Total Commits"]["value"] == 4


def test_epoch_cutoff_means_none_for_tags_only(spark):
    tags = spark.createDataFrame([("a", "v", None, None)], TAGS)
    assert g.tag_times(tags, "1970-01-01").count() == 1
    assert g.tag_times(tags, "1970-01-02").count() == 0
    refs = spark.createDataFrame([("a", "r", "branch", at("1960-01-01"))], REFS)
    assert g.branches(refs, "1970-01-01").count() == 0


def test_long_branch_lists_stay_whole(history, spark):
    repos, _, tags, commits = history
    names = [f"refs/heads/b{i:03}" for i in range(50)]
    refs = spark.createDataFrame([("a", n, "branch", at("2024-01-01")) for n in names], REFS)
    found = g.git_metrics(repos, refs, tags, commits).where("repo_name = 'a'")
    count = values(found.where("name = 'Branch Count'"), "a")["Branch Count"]
    assert (count["value"], count["branches"]) == (50, names)
    assert found.count() == 13


def test_long_branch_lists_go_on_in_pieces(history, spark, monkeypatch):
    monkeypatch.setattr(g, "PIECE", 7)
    repos, _, tags, commits = history
    names = [f"refs/heads/b{i:03}" for i in range(50)]
    refs = spark.createDataFrame([("a", n, "branch", at("2024-01-01")) for n in names] + [("empty", "refs/x", "branch", at("2024-01-01"))], REFS)
    found = g.git_metrics(repos, refs.repartition(5), tags, commits)
    bags = [json.loads(r.properties) for r in found.where("repo_name = 'a' AND name = 'Branch Count'").collect()]
    assert [x for b in sorted(bags, key=lambda b: b.get("piece", 0)) for x in b["branches"]] == names
    assert sorted(b.get("piece", 0) for b in bags) == list(range(8)) and [b["value"] for b in bags if "value" in b] == [50]
    assert found.count() == 26 + 7


def test_tag_gaps_of_one_large_repository(spark):
    """Equal times, undated tags and tasks with few rows; the plan reads its input once."""
    rows = [("big", f"v{i:04}", None if i % 3 == 0 else at("2024-01-01") + dt.timedelta(seconds=(i * i) % 50)) for i in range(400)]
    rows += [("one", "v", at("2024-01-01")), ("two", "a", None), ("two", "b", None)]
    tags = spark.createDataFrame([(r, n, t, None) for r, n, t in rows], TAGS).repartition(9)
    got = sorted((r.repo_name, r.tag_name, r.gap_seconds) for r in g.tag_gaps(g.tag_times(tags)).collect())
    zero = dt.datetime(1, 1, 1)
    want = []
    for repo in ("big", "two"):
        ordered = sorted((t or zero, n) for r, n, t in rows if r == repo)
        want += [(repo, b[1], int((b[0] - a[0]).total_seconds())) for a, b in zip(ordered, ordered[1:])]
    assert got == sorted(want)
    plan = g.tag_gaps(g.tag_times(tags))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Window" not in plan


def test_tag_gaps_match_a_plain_sort(spark):
    rows = [("r" + str(i % 2), f"v{i:02}", at("2024-01-01") + dt.timedelta(hours=(i * i * 7) % 90)) for i in range(40)]
    tags = spark.createDataFrame([(r, n, t, None) for r, n, t in rows], TAGS)
    got = sorted((r.repo_name, r.tag_name, r.gap_seconds) for r in g.tag_gaps(g.tag_times(tags)).collect())
    want = []
    for repo in ("r0", "r1"):
        ordered = sorted((t, n) for r, n, t in rows if r == repo)
        want += [(repo, b[1], int((b[0] - a[0]).total_seconds())) for a, b in zip(ordered, ordered[1:])]
    assert got == sorted(want)


def test_cutoff_texts(spark):
    one = spark.range(1)
    value = lambda text: one.select(times.cutoff_seconds(text)).first()[0]
    assert value("") == value(None) == -1
    assert value("2024-01-15") == 1705276800 == value("2024-01-15T02:00:00+02:00")
    now = one.select(F.unix_seconds(F.current_timestamp())).first()[0]
    assert abs(now - 14 * 86400 - value("2 weeks ago")) < 100
    with pytest.raises(ValueError):
        times.cutoff_seconds("when pigs fly")


def test_zoned_input_becomes_utc(spark):
    raw = spark.sql("SELECT 'a' repo_name, timestamp'2024-01-01 00:30:00+02:00' author_when, timestamp'2024-01-01 00:30:00+02:00' committer_when")
    row = inventory.commits(raw).first()
    assert row.committer_when == at("2023-12-31 22:30:00") and row.tz_offset_minutes == 0
