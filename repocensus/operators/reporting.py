"""SQL over findings, and the reports made from it."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repocensus.functions import sqlite
from repocensus.functions.props import json_text
from repocensus.operators.ordering import written
from repocensus.sources.batches import NamedQuery

VIEW = "Findings"
ANSI = "spark.sql.ansi.enabled"
# Report file names.
JSON_SUMMARY = "cloud_services_summary.json"
SHEET_SUMMARY = "summary_report"


def register_findings(findings: DataFrame, view: str = VIEW) -> DataFrame:
    """Expose findings to SQL as ``Findings(id, Name, Type, Category, Path, RepoName, Properties)``.

    Stored findings bring their ids; others get unique ones, which are not dense.
    """
    known = F.col("id") if "id" in findings.columns else F.monotonically_increasing_id() + 1
    table = findings.select(
        known.alias("id"),
        F.col("name").alias("Name"),
        F.col("type").alias("Type"),
        F.col("category").alias("Category"),
        F.col("path").alias("Path"),
        F.col("repo_name").alias("RepoName"),
        F.col("properties").alias("Properties"),
    )
    table.createOrReplaceTempView(view)
    return table


def property_types(findings: DataFrame, paths: Iterable[str]) -> dict[str, str]:
    """SQL types of the JSON values at some paths of ``Properties``, in one pass over it.

    Integers are ``BIGINT``, numbers ``DOUBLE``, booleans ``BOOLEAN``; paths with anything else, or with values
    of different kinds, are ``STRING``.
    """
    paths = sorted(paths)
    if not paths:
        return {}
    document = F.try_parse_json("Properties")
    kind = lambda p: F.regexp_extract(F.schema_of_variant(F.try_variant_get(document, p, "variant")), "^[A-Z]+", 0)
    whole = lambda p: F.get_json_object("Properties", p).rlike(r"\A-?\d{1,18}\z")
    found = findings.agg(
        *[F.collect_set(F.when(whole(p), "BIGINT").otherwise(kind(p))).alias(f"k{i}") for i, p in enumerate(paths)]
    ).first()
    types = {}
    for i, p in enumerate(paths):
        kinds = set(found[f"k{i}"]) - {"VOID"}
        numbers = kinds & {"BIGINT", "DECIMAL", "DOUBLE", "FLOAT"}
        types[p] = "STRING" if not kinds or kinds - sqlite.JSON_TYPES else "BIGINT" if kinds == {"BIGINT"} else "DOUBLE" if kinds == numbers else "BOOLEAN" if kinds == {"BOOLEAN"} else "STRING"
    return types


def _reading(spark: SparkSession, queries: Iterable[str], json_types: dict[str, str] | None) -> sqlite.Reading:
    paths = set().union(*(sqlite.json_paths(sqlite.parse(q)) for q in queries))
    if json_types is None:
        json_types = property_types(spark.table(VIEW), paths) if paths and spark.catalog.tableExists(VIEW) else {}
    return sqlite.Reading(json_types=json_types)


def run_query(spark: SparkSession, query: str, json_types: dict[str, str] | None = None) -> DataFrame:
    """A SQLite-flavoured query over registered tables.

    ``json_extract`` gives typed values: ``json_types`` names the types of paths, those in the findings
    are looked up otherwise. Integers divide to integers, other numbers do not; a double-quoted text
    is a column if there is one of that name, else a string; dividing by zero gives NULL.
    """
    return _analysed(spark, query, _reading(spark, [query], json_types))


def _analysed(spark: SparkSession, query: str, how: sqlite.Reading) -> DataFrame:
    items = sqlite.parse(query)
    how = sqlite.Reading(how.json_types)
    before = spark.conf.get(ANSI)
    spark.conf.set(ANSI, "false")  # expressions keep the mode they are analysed in
    try:
        while True:
            text = sqlite.render(items, how)
            try:
                return spark.sql(text)
            except AnalysisException as failure:
                if not _reread(items, how, text, failure):
                    raise
    finally:
        spark.conf.set(ANSI, before)


def _reread(items: list, how: sqlite.Reading, text: str, failure: AnalysisException) -> bool:
    """Reads one open token the other way, if the failure is about it."""
    condition = failure.getCondition() or ""
    if condition.startswith("UNRESOLVED_COLUMN"):
        name = (failure.getMessageParameters() or {}).get("objectName", "").strip("`")
        if name in sqlite.quoted_texts(items) - how.strings:
            how.strings.add(name)
            return True
    if condition.startswith("DATATYPE_MISMATCH") and failure.getQueryContext():
        place = failure.getQueryContext()[0]
        at = sqlite.failing_division(text, place.startIndex(), place.stopIndex())
        if at is not None and at not in how.real:
            how.real.add(at)
            return True
    return False


def run_queries(spark: SparkSession, queries: Iterable[NamedQuery]) -> dict[str, DataFrame]:
    """One DataFrame per named query; the first query that does not analyse aborts all."""
    results, queries = {}, list(queries)
    how = _reading(spark, [q.query for q in queries], None)
    for q in queries:
        try:
            results[q.name] = _analysed(spark, q.query, how)
        except AnalysisException as failure:
            raise ValueError(f"failed to execute query '{q.name}': {failure}") from failure
    return results


def run_sheet_queries(spark: SparkSession, queries: Iterable[NamedQuery]) -> dict[str, DataFrame]:
    """As :func:`run_queries`, but a query over a missing table is skipped."""
    results, queries = {}, list(queries)
    how = _reading(spark, [q.query for q in queries], None)
    for q in queries:
        try:
            results[q.name] = _analysed(spark, q.query, how)
        except AnalysisException as failure:
            if failure.getCondition() != "TABLE_OR_VIEW_NOT_FOUND":
                raise ValueError(f"failed to execute query '{q.name}': {failure}") from failure
    return results


def finding_count(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").alias("findings"))


def findings_per_repository(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo_name").agg(F.count("*").alias("findings"))


def error_count(errors: DataFrame) -> DataFrame:
    return errors.agg(F.count("*").alias("errors"))


def property_keys(findings: DataFrame) -> DataFrame:
    """Distinct top-level property keys; unreadable bags contribute none."""
    keys = F.explode(F.json_object_keys("properties")).alias("key")
    return findings.select(keys).distinct()


def sorted_row_json(df: DataFrame) -> DataFrame:
    """Each row as a JSON object with sorted keys, NULLs written out."""
    columns = sorted(df.columns)
    row = F.to_json(
        F.struct(*[F.col(f"`{c}`").alias(c) for c in columns]), {"ignoreNullFields": "false"}
    )
    return df.select(row.alias("row"))


def write_json_summary(results: dict[str, DataFrame], out: str, prefix: str) -> str | None:
    """Write ``<out>/<prefix>_cloud_services_summary.json``: query name to result rows.

    Queries without rows are left out and no queries mean no document.  The document is a folder of part files, which
    executors write, and ``manifest.json`` with their names: one after the other they are one JSON object.
    """
    if not results:
        return None
    spark = next(iter(results.values())).sparkSession
    target = f"{(out or '.').rstrip('/')}/{prefix}_{JSON_SUMMARY}"
    parts, queries = ["begin.json"], {}
    write_text(spark, f"{target}/begin.json", "{\n")
    for i, name in enumerate(sorted(results)):
        folder = f"rows-{i:05}"
        count = _write_rows(results[name], f"{target}/{folder}")
        if not count:
            continue
        write_text(spark, f"{target}/head-{i:05}.json", f"{',' if queries else ' '} {json.dumps(name)}: [\n")
        write_text(spark, f"{target}/tail-{i:05}.json", "  ]\n")
        queries[name] = {"folder": folder, "rows": count}
        parts += [f"head-{i:05}.json", *(f"{folder}/{x}" for x in _part_names(spark, f"{target}/{folder}")), f"tail-{i:05}.json"]
    write_text(spark, f"{target}/end.json", "}\n")
    write_text(spark, f"{target}/manifest.json", json.dumps({"parts": [*parts, "end.json"], "queries": queries}, indent=1))
    return target


def _write_rows(df: DataFrame, folder: str) -> int:
    """The rows as JSON lines in their order, all but the first with a comma before; their number."""
    rows = written(sorted_row_json(df).withColumn("place", F.monotonically_increasing_id()), "report")
    found = rows.agg(F.min("place").alias("first"), F.count("*").alias("n")).first()
    if found["n"]:
        lead = F.when(F.col("place") == found["first"], F.lit("    ")).otherwise(F.lit("   ,"))
        # Places grow from one task to the next, so ranges of them keep the order.
        ordered = rows.repartitionByRange("place").sortWithinPartitions("place")
        ordered.select(F.concat(lead, "row").alias("value")).write.mode("overwrite").text(folder)
    return found["n"]


def _part_names(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(f.getPath().getName() for f in files if f.getPath().getName().startswith("part-"))


def read_json_summary(spark: SparkSession, target: str, query: str, schema: str) -> DataFrame:
    """A query's rows of a written summary, read in parallel; none if it had none."""
    manifest = json.loads("\n".join(r.value for r in spark.read.text(f"{target}/manifest.json").collect()))
    at = manifest["queries"].get(query)
    if at is None:
        return spark.createDataFrame([], schema)
    row = F.regexp_replace("value", r"^[ ,]+", "")
    return spark.read.text(f"{target}/{at['folder']}").select(F.from_json(row, schema).alias("row")).select("row.*")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file (see :func:`write_pieces`)."""
    write_pieces(spark, path, [text])


def write_pieces(spark: SparkSession, path: str, pieces: Iterable[str]) -> None:
    """A file through the Hadoop file system, so that any shared storage works."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(target, True)
    try:
        for piece in pieces:
            stream.write(bytearray(piece.encode("utf-8")))
    finally:
        stream.close()


def write_sheets(results: dict[str, DataFrame], out: str, prefix: str) -> str:
    """One headered CSV folder per query, empty results included."""
    target = f"{out.rstrip('/')}/{prefix}_{SHEET_SUMMARY}"
    for name, df in results.items():
        df.write.mode("overwrite").option("header", True).csv(f"{target}/{name}")
    return target


def delivery_payloads(findings: DataFrame, report_id: str) -> DataFrame:
    """(report_id, payload): one finding set per row, empty fields left out."""
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    bag = F.when(
        F.col("properties").isNotNull() & (F.col("properties") != "{}"), F.col("properties")
    )
    members = F.array_compact(
        F.array(
            *[
                F.concat(F.lit(f'"{wire}":'), json_text(given(column)))
                for wire, column in [
                    ("name", "name"), ("type", "type"), ("category", "category"),
                ]
            ],
            F.concat(F.lit('"properties":'), bag),
            *[
                F.concat(F.lit(f'"{wire}":'), json_text(given(column)))
                for wire, column in [("path", "path"), ("repo_name", "repo_name")]
            ],
        )
    )
    payload = F.concat(F.lit('{"matchSet":[{'), F.array_join(members, ","), F.lit("}]}"))
    return findings.select(F.lit(report_id).alias("report_id"), payload.alias("payload"))


def deliver(findings: DataFrame, out: str, report_id: str) -> str:
    """Payload files under ``report_id=<id>``, then a completion marker.

    A failed batch fails the write job, and then no marker appears: one of an earlier delivery
    goes before anything is written.
    """
    folder = f"{out.rstrip('/')}/report_id={report_id}"
    marker = findings.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{folder}/_COMPLETED")
    conf = findings.sparkSession._jsc.hadoopConfiguration()
    marker.getFileSystem(conf).delete(marker, False)
    delivery_payloads(findings, report_id).select("payload").write.mode("overwrite").text(
        f"{folder}/results"
    )
    write_text(findings.sparkSession, f"{folder}/_COMPLETED", '{"status": "completed"}\n')
    return folder


# A reporter takes findings, named queries, a folder and a name, and says where its report is; None if there is none.
Reporter = Callable[[DataFrame, list[NamedQuery], str, str], "str | None"]


def json_reporter(findings: DataFrame, queries: list[NamedQuery], out: str, name: str) -> str | None:
    register_findings(findings)
    return write_json_summary(run_queries(findings.sparkSession, queries), out, name)


def sheet_reporter(findings: DataFrame, queries: list[NamedQuery], out: str, name: str) -> str | None:
    register_findings(findings)
    return write_sheets(run_sheet_queries(findings.sparkSession, queries), out, name)


def delivery_reporter(findings: DataFrame, queries: list[NamedQuery], out: str, name: str) -> str | None:
    """All findings as payloads; queries have no part in it."""
    return deliver(findings, out, name)


def report(findings: DataFrame, queries: list[NamedQuery], out: str, name: str, reporters: Iterable[Reporter]) -> list[str]:
    """What some reporters, built-in or a user's own, write about the same findings; the first failure ends it."""
    places = (reporter(findings, queries, out, name) for reporter in reporters)
    return [p for p in places if p is not None]
