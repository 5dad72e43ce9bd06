"""Repository history metrics: thirteen finding rows per repository.

Inputs are the REFS, TAGS and COMMITS tables.  Numbers are grouped aggregation with
map-side combining, reduced to (repository, day) before any per-repository step; ordered steps
(branch lists, tag gaps) run over range partitions.  So one repository may own most of the history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repocensus.functions.props import Json, number, props
from repocensus.functions.times import (
    NO_CUTOFF,
    cutoff_seconds,
    day_key,
    days_text,
    epoch_seconds,
    month_key,
    own_clock,
    rfc3339,
    week_key,
)
from repocensus.operators.extractor import finding
from repocensus.operators.ordering import ranked, with_previous, written
from repocensus.schemas import FINDING_COLUMNS

NOT_ENOUGH_TAGS = "Not enough tags to calculate"
# Fixed value: the time of a tag that has neither a tagger nor a commit.
UNKNOWN_TIME = "TIMESTAMP_NTZ '0001-01-01 00:00:00'"
BRANCH_KINDS = ["branch", "remote"]
# Names in one finding of a branch list.
PIECE = 10_000


def _after(when: Column, cutoff: Column) -> Column:
    return (cutoff == NO_CUTOFF) | (epoch_seconds(when) >= cutoff)


def branches(refs: DataFrame, cutoff: str | None = None) -> DataFrame:
    """Branch and remote refs whose latest commit was authored at or after the cutoff."""
    return refs.where(
        F.col("ref_kind").isin(BRANCH_KINDS) & _after(F.col("author_when"), cutoff_seconds(cutoff))
    )


def tag_times(tags: DataFrame, cutoff: str | None = None) -> DataFrame:
    """(repo_name, tag_name, tagged_at): tagger time, else commit time, else the zero time."""
    limit = cutoff_seconds(cutoff)
    # a cutoff of the epoch itself means none, for tags only
    limit = F.when(limit == 0, F.lit(NO_CUTOFF)).otherwise(limit)
    when = F.coalesce("tagger_when", "committer_when", F.expr(UNKNOWN_TIME))
    return tags.select("repo_name", "tag_name", when.alias("tagged_at")).where(
        _after(F.col("tagged_at"), limit)
    )


def commits_after(commits: DataFrame, cutoff: str | None = None) -> DataFrame:
    return commits.where(_after(F.col("committer_when"), cutoff_seconds(cutoff)))


def distinct_commits(commits: DataFrame) -> DataFrame:
    """Each hash of a repository once."""
    return commits.dropDuplicates(["repo_name", "hash"])


def branch_counts(kept: DataFrame) -> DataFrame:
    return kept.groupBy("repo_name").agg(F.count("*").alias("branch_count"))


def branch_names(kept: DataFrame) -> DataFrame:
    """(repo_name, piece, names): a repository's sorted ref names as JSON text arrays of at most PIECE names each."""
    pieces = ranked(kept.select("repo_name", "ref_name"), "repo_name", "ref_name").groupBy("repo_name", F.floor(F.col("rank") / PIECE).alias("piece"))
    return pieces.agg(F.to_json(F.array_sort(F.collect_list("ref_name"))).alias("names"))


def tag_stats(times: DataFrame) -> DataFrame:
    seconds = epoch_seconds(F.col("tagged_at"))
    return times.groupBy("repo_name").agg(
        F.count("*").alias("tag_count"),
        F.min(seconds).alias("first_tag"),
        F.max(seconds).alias("last_tag"),
    )


def tag_gaps(times: DataFrame) -> DataFrame:
    """Gap in seconds between each tag of a repository and the one before it.

    Their mean is (last - first) / (n - 1), which is what the metric uses; this table is for
    looking at the gaps themselves.  Tags of the same second are ordered by name.
    """
    seconds = times.withColumn("second", epoch_seconds(F.col("tagged_at")))
    chained = with_previous(seconds, ["repo_name", "second", "tag_name"], ["repo_name", "second"])
    gap = F.col("second") - F.col("previous_second")
    return chained.where(F.col("previous_repo_name") == F.col("repo_name")).select("repo_name", "tag_name", "tagged_at", gap.alias("gap_seconds"))


def daily_commits(commits: DataFrame, *also: str) -> DataFrame:
    """Commits per repository and day of the committer's own clock (and per other columns)."""
    clock = own_clock(F.col("committer_when"), F.col("tz_offset_minutes"))
    seconds = epoch_seconds(F.col("committer_when"))
    offset = F.col("tz_offset_minutes")
    return (
        distinct_commits(commits)
        .groupBy("repo_name", day_key(clock).alias("day"), *also)
        .agg(
            F.count("*").alias("n"),
            F.min(seconds).alias("first_commit"),
            F.max(seconds).alias("last_commit"),
            F.min_by(offset, seconds).alias("first_offset"),
            F.max_by(offset, seconds).alias("last_offset"),
        )
    )


def period_activity(daily: DataFrame, period: str) -> DataFrame:
    """Max and mean commits per active day, week or month; idle periods do not count."""
    date = F.to_date("day", "yyyy-MM-dd")
    key = {"day": F.col("day"), "week": week_key(date), "month": month_key(date)}[period]
    per_key = daily.groupBy("repo_name", key.alias("period")).agg(F.sum("n").alias("n"))
    return per_key.groupBy("repo_name").agg(
        F.max("n").alias(f"max_per_{period}"),
        (F.sum("n").cast("double") / F.count("*").cast("double")).alias(f"avg_per_{period}"),
    )


def contributors(commits: DataFrame) -> DataFrame:
    """Distinct author addresses, compared exactly."""
    authors = commits.select("repo_name", "author_email").distinct()
    return authors.groupBy("repo_name").agg(F.count("*").alias("contributors"))


def commit_stats(commits: DataFrame) -> DataFrame:
    """Totals, first/last commit, activity and contributors per repository, in one pass over the commits.

    The table of (repository, day, author) is put under its day, week, month and author at once;
    a repository's values then come from the groups of each kind.
    """
    date = F.to_date("day", "yyyy-MM-dd")
    keys = {"day": F.col("day"), "week": week_key(date), "month": month_key(date), "author": F.col("author_email")}
    kinds = [F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key")) for kind, key in keys.items()]
    per_key = (
        daily_commits(commits, "author_email")
        .select("*", F.explode(F.array(*kinds)).alias("at"))
        .groupBy("repo_name", "at.kind", "at.key")
        .agg(F.sum("n").alias("n"), *_first_and_last())
    )
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    activity = []
    for period in ("day", "week", "month"):
        total, groups = F.sum(of(period, F.col("n"))), F.count(of(period, F.lit(1)))
        activity.append(F.max(of(period, F.col("n"))).alias(f"max_per_{period}"))
        activity.append((total.cast("double") / groups.cast("double")).alias(f"avg_per_{period}"))
    return per_key.groupBy("repo_name").agg(
        F.sum(of("day", F.col("n"))).alias("total_commits"),
        *_first_and_last(),
        *activity,
        F.count(of("author", F.lit(1))).alias("contributors"),
    )


def _first_and_last() -> list[Column]:
    return [
        F.min("first_commit").alias("first_commit"),
        F.max("last_commit").alias("last_commit"),
        F.min_by("first_offset", "first_commit").alias("first_offset"),
        F.max_by("last_offset", "last_commit").alias("last_offset"),
    ]


def repository_stats(
    repos: DataFrame, refs: DataFrame, tags: DataFrame, commits: DataFrame, cutoff: str | None = None
) -> DataFrame:
    """One wide row of metric values per repository, present even without any history."""
    return (
        repos.select("repo_name").distinct()
        .join(branch_counts(branches(refs, cutoff)), "repo_name", "left")
        .join(tag_stats(tag_times(tags, cutoff)), "repo_name", "left")
        .join(commit_stats(commits_after(commits, cutoff)), "repo_name", "left")
    )


def _metric(name: str, value: Column | Json) -> Column:
    return finding(name, "git_metric", "repository_analysis", props(value=value))


def metric_rows() -> Column:
    """The thirteen findings of a wide row as an array."""
    count = lambda c: number(F.coalesce(F.col(c), F.lit(0)).cast("bigint"))
    mean_gap = (F.col("last_tag") - F.col("first_tag")).cast("double") / (
        F.col("tag_count") - 1
    ).cast("double")
    branch_count = F.coalesce(F.col("branch_count"), F.lit(0)).cast("string")
    rows = [
        _branch_list(("branches", F.coalesce("names", F.lit("null"))), ("cutoff", F.col("cutoff").cast("string")), ("value", branch_count)),
        _metric("Tag Count", count("tag_count")),
        _metric(
            "Average Time Between Tags",
            F.when(F.col("tag_count") > 1, days_text(mean_gap)).otherwise(F.lit(NOT_ENOUGH_TAGS)),
        ),
        _metric("Total Commits", count("total_commits")),
        _metric("First Commit Date", rfc3339(F.col("first_commit"), F.col("first_offset"))),
        _metric("Last Commit Date", rfc3339(F.col("last_commit"), F.col("last_offset"))),
    ]
    for period in ("Day", "Week", "Month"):
        rows.append(_metric(f"Max Commits Per {period}", count(f"max_per_{period.lower()}")))
        rows.append(
            _metric(
                f"Average Commits Per {period}",
                number(F.coalesce(F.col(f"avg_per_{period.lower()}"), F.lit(0.0))),
            )
        )
    rows.append(_metric("Unique Contributors", count("contributors")))
    return F.array(*rows)


def _branch_list(*members: tuple[str, Column]) -> Column:
    text = [x for key, value in members for x in (F.lit(f'"{key}":'), value, F.lit(","))][:-1]
    return finding("Branch Count", "git_metric", "repository_analysis", F.concat(F.lit("{"), *text, F.lit("}")))


def git_metrics(
    repos: DataFrame,
    refs: DataFrame,
    tags: DataFrame,
    commits: DataFrame,
    cutoff: str | None = None,
) -> DataFrame:
    """Thirteen ``git_metric`` findings per repository; the branch list is in the Branch Count row.

    A list of more than PIECE names goes on in further Branch Count rows, numbered by ``piece``.
    """
    pieces = written(branch_names(branches(refs, cutoff)), "branches")
    limit = cutoff_seconds(cutoff)
    stats = repository_stats(repos, refs, tags, commits, cutoff).join(pieces.where("piece = 0").select("repo_name", "names"), "repo_name", "left")
    rows = stats.withColumn("cutoff", limit).select("repo_name", F.inline(metric_rows()))
    more = _branch_list(("branches", F.col("names")), ("cutoff", limit.cast("string")), ("piece", F.col("piece").cast("string")))
    further = pieces.where("piece > 0").select("repo_name", F.inline(F.array(more)))
    return rows.unionByName(further).withColumn("path", F.lit("")).select(*FINDING_COLUMNS)
