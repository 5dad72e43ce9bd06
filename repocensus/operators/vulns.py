"""Vulnerability scanner reports as findings; every severity is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repocensus.functions.props import props
from repocensus.operators.extractor import finding

# Where Spark's readers put a record that they cannot read.
CORRUPT = "_corrupt_record"


def vulnerability_findings(reports: DataFrame) -> DataFrame:
    """One finding per vulnerability of (repo_name, Results) report rows."""
    text = lambda c: F.coalesce(c, F.lit(""))
    # rows first, so that bags are plain columns, which Spark compiles
    results = reports.select("repo_name", F.explode("Results").alias("r"))
    rows = results.select("repo_name", F.col("r.Target").alias("target"), F.col("r.Type").alias("result_type"), F.explode("r.Vulnerabilities").alias("v"))
    found = finding(
        text(F.col("v.VulnerabilityID")),
        "VULNERABILITY_SCAN",
        "Trivy Filesystem",
        props(
            title=text(F.col("v.Title")),
            severity=text(F.col("v.Severity")),
            installed_version=text(F.col("v.InstalledVersion")),
            pkg_name=text(F.col("v.PkgName")),
            target=text(F.col("target")),
            result_type=text(F.col("result_type")),
        ),
    )
    return rows.select("repo_name", found.alias("f")).select(
        "f.name", "f.type", "f.category", F.lit("").alias("path"), "repo_name", "f.properties"
    )


def vulnerability_scan(reports: DataFrame) -> DataFrame:
    """The findings, and a row with a ``message`` for each report that could not be read (``_corrupt_record``)."""
    found = vulnerability_findings(reports).withColumn("message", F.lit(None).cast("string"))
    if CORRUPT not in reports.columns:
        return found
    bad = reports.where(F.col(CORRUPT).isNotNull()).select("repo_name", F.lit("unreadable vulnerability report").alias("message"))
    return found.unionByName(bad, allowMissingColumns=True)
