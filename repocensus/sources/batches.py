"""Stored finding batches, vulnerability reports, named queries and service lists."""

from __future__ import annotations

import codecs
import itertools
import json
import re
import tempfile
from dataclasses import dataclass

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repocensus.schemas import FINDING_COLUMNS, VULN_REPORT


def read_batches(spark: SparkSession, folder: str, multi_line: bool = False) -> DataFrame:
    """Findings of every batch file; unreadable files or records are left out.

    ``multi_line`` reads files holding one (pretty-printed) array each, of any length.
    """
    fields = ", ".join(f"{c}: STRING" for c in FINDING_COLUMNS)
    if multi_line:
        listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path")
        texts = listed.mapInArrow(_records, "value STRING")
        record = F.from_json("value", f"ARRAY<STRUCT<{fields}>>")
        return texts.select(F.inline(record))
    texts = spark.read.text(folder, pathGlobFilter="*.json")
    parsed = texts.select(
        F.from_json("value", f"STRUCT<{fields}, _corrupt: STRING>", {"columnNameOfCorruptRecord": "_corrupt"}).alias("batch")
    )
    return parsed.where(F.col("batch._corrupt").isNull()).select("batch.*").select(*FINDING_COLUMNS)


CHARS, RECORDS = 1 << 20, 1000  # of a file read at once, of an array in one row


def _records(batches):
    """Arrays of at most RECORDS elements of each listed file's array; a file that does not end well gives none.

    Elements wait in a temporary file until the file is known to be well formed, so memory holds a few of them.
    """
    for batch in batches:
        for place in batch.column(0).to_pylist():
            with tempfile.TemporaryFile() as kept:
                try:
                    with _opened(place) as source, pa.ipc.new_stream(kept, _RECORDS) as out:
                        for some in _groups(elements(source)):
                            out.write_batch(pa.RecordBatch.from_arrays([pa.array([some], pa.string())], schema=_RECORDS))
                except (ValueError, RecursionError):  # not JSON: data, not a job failure
                    continue
                kept.seek(0)
                yield from pa.ipc.open_stream(kept)


_RECORDS = pa.schema([("value", pa.string())])


def _opened(place: str):
    from pyarrow import fs

    if place.startswith("file:"):
        system, path = fs.LocalFileSystem(), "/" + place.removeprefix("file:").lstrip("/")
    else:
        system, path = fs.FileSystem.from_uri(place)
    return codecs.getreader("utf-8")(system.open_input_stream(path), errors="replace")


def _groups(texts):
    while some := list(itertools.islice(texts, RECORDS)):
        yield f"[{','.join(some)}]"


def elements(source, chars: int = CHARS):
    """The texts of a JSON array's elements, read in pieces; one object alone counts as an array of it.

    What follows the array is not looked at. An array that does not end is an error.
    """
    decode, text, at = json.JSONDecoder().raw_decode, source.read(chars), 0
    blank = re.compile(r"[ \t\n\r]*")

    def more() -> bool:
        nonlocal text, at
        # as much again as is left, so that a long element is not tried over and over
        piece = source.read(max(chars, len(text) - at))
        text, at = text[at:] + piece, 0
        return bool(piece)

    def next_char() -> str:
        nonlocal at
        while True:
            at = blank.match(text, at).end()
            if at < len(text):
                return text[at]
            if not more():
                raise ValueError("array cut short")

    def element() -> str:
        nonlocal at
        while True:
            try:
                end = decode(text, at)[1]
                if end + 3 <= len(text):  # a number may go on where the piece ends: 1|.5, 1.|5, 1e+|5
                    break
            except ValueError:
                end = None
            if not more():
                if end is None:
                    raise ValueError("not JSON")
                end = decode(text, at)[1]
                break
        found, at = text[at:end], end
        return found

    if next_char() == "{":
        yield element()
        return
    if next_char() != "[":
        raise ValueError("not an array")
    at += 1
    if next_char() == "]":
        return
    while True:
        next_char()
        yield element()
        sign = next_char()
        at += 1
        if sign == "]":
            return
        if sign != ",":
            raise ValueError("no array")


def read_vulnerability_reports(spark: SparkSession, folder: str, keep_unreadable: bool = False) -> DataFrame:
    """Scanner reports laid out as ``<folder>/repo_name=<name>/<file>.json``, or ``.json.gz``.

    Unreadable ones are left out, or kept with their text in ``_corrupt_record``.
    """
    schema = f"{VULN_REPORT}, _corrupt_record STRING" if keep_unreadable else VULN_REPORT
    mode = "PERMISSIVE" if keep_unreadable else "DROPMALFORMED"
    return spark.read.schema(schema).option("multiLine", True).option("mode", mode).json(folder)


@dataclass(frozen=True)
class NamedQuery:
    name: str
    query: str


def read_queries(text: str) -> list[NamedQuery]:
    """``queries: [{name, query}]`` YAML text; a handful of rows of configuration."""
    loaded = yaml.safe_load(text) or {}
    return [NamedQuery(q["name"], q["query"]) for q in loaded.get("queries") or []]


def read_service_list(spark: SparkSession, path: str) -> DataFrame:
    """``Name : Category`` lines as (service, category); blank lines are skipped."""
    return services(spark.read.text(path))


def services(text_lines: DataFrame) -> DataFrame:
    at = F.split("value", " : ", 2)
    return text_lines.where(F.trim("value") != "").select(
        F.trim(F.get(at, F.lit(0))).alias("service"), F.trim(F.get(at, F.lit(1))).alias("category")
    )
