"""Pattern catalogues: reading them, validating them, and their exploded rule table."""

from __future__ import annotations

import io
import itertools
import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repocensus.functions.paths import bare_extension
from repocensus.functions.regexes import REGEX_SPECIALS
from repocensus.operators.ordering import written
from repocensus.sources import fixed_catalogue

# As read: ``properties`` is kept as raw JSON so that its values keep their types.
READ_SCHEMA = (
    "name STRING, type STRING, category STRING, file_names ARRAY<STRING>, "
    "path_patterns ARRAY<STRING>, file_extensions ARRAY<STRING>, "
    "content_patterns ARRAY<STRING>, properties STRING"
)


@dataclass(frozen=True)
class Pattern:
    name: str
    type: str = ""
    category: str = ""
    file_names: tuple[str, ...] = ()
    path_patterns: tuple[str, ...] = ()
    file_extensions: tuple[str, ...] = ()
    content_patterns: tuple[str, ...] = ()
    properties: str | None = None  # canonical JSON object

    @property
    def invalid_reason(self) -> str | None:
        if self.file_names and self.file_extensions:
            return BOTH_NAMES_AND_EXTENSIONS
        if self.content_patterns and not (self.file_names or self.file_extensions):
            return CONTENT_WITHOUT_FILES
        return None


BOTH_NAMES_AND_EXTENSIONS = "specifies both file_names and file_extensions"
CONTENT_WITHOUT_FILES = "has content_patterns but no file_names or file_extensions"


@dataclass(frozen=True)
class Catalogue:
    """Ordered patterns, ready to become column expressions."""

    patterns: tuple[Pattern, ...] = field(default_factory=tuple)

    @property
    def valid(self) -> list[Pattern]:
        return [p for p in self.patterns if p.invalid_reason is None]

    @property
    def invalid(self) -> list[tuple[Pattern, str]]:
        return [(p, p.invalid_reason) for p in self.patterns if p.invalid_reason]

    def __add__(self, other: "Catalogue") -> "Catalogue":
        return Catalogue(self.patterns + other.patterns)


def shipped_catalogue() -> Catalogue:
    """The built-in patterns: applications, frameworks, office files, SaaS, shell scripts."""
    return Catalogue(tuple(Pattern(**p) for p in fixed_catalogue.patterns()))


def read_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*.json`` pattern files of a folder; ``source_file`` and ``place`` give their order, malformed files are skipped.

    A file of any length is read in pieces and becomes a row for each pattern; ``properties`` is text as it stands in the file. Files
    outside local or mounted storage are read whole by Spark first.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).withColumn("source_file", F.input_file_name())
    elsewhere = files.where(~F.col("path").startswith("file:")).select("path").first() is not None
    content = F.col("content") if elsewhere else F.lit(None).cast("binary")
    texts = files.select("path", "source_file", content.alias("content")).mapInArrow(_patterns, _PATTERN_TEXTS)
    read = F.from_json("value", f"{READ_SCHEMA}, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"})
    rows = texts.select("source_file", "place", "bag", read.alias("read"))
    table = written(
        rows.select(
            *[F.col("read")[c].alias(c) for c in _READ_COLUMNS if c != "properties"], F.coalesce("bag", F.col("read.properties")).alias("properties"),
            "source_file", "place", (F.col("read").isNull() | F.col("read._corrupt").isNotNull()).alias("malformed"),
        ),
        "patterns",
    )
    malformed = written(table.where("malformed").select("source_file").distinct(), "malformed")
    folders = [c for c in files.columns if c not in ("path", "modificationTime", "length", "content", "source_file")]
    whole = table.join(malformed, "source_file", "left_anti")
    if folders:
        whole = whole.join(files.select("source_file", *folders), "source_file")
    return whole.select(*_READ_COLUMNS, *folders, "source_file", "place")


_READ_COLUMNS = [c.split()[0] for c in READ_SCHEMA.split(", ")]
_PATTERN_TEXTS = "source_file STRING, place BIGINT, value STRING, bag STRING"
CHARS, PATTERNS = 1 << 20, 1000  # of a file read at once, of its patterns in one batch


def _patterns(batches):
    """The patterns' texts of each file, and a row without text if it is malformed."""

    def batch(file, place, texts):
        columns = [[file] * len(texts), range(place, place + len(texts)), texts, [t and _bag(t) for t in texts]]
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in _PATTERN_TEXTS.split(", ")])

    for given in batches:
        for path, file, content in zip(*(c.to_pylist() for c in given.columns), strict=True):
            place = 0
            with open("/" + path.removeprefix("file:").lstrip("/"), "rb") if content is None else io.BytesIO(content) as raw:
                encoding = json.detect_encoding(raw.read(4))
                raw.seek(0)
                texts = objects(io.TextIOWrapper(raw, encoding, newline=""))
                try:
                    while some := list(itertools.islice(texts, PATTERNS)):
                        yield batch(file, place, some)
                        place += len(some)
                except ValueError:  # not JSON, or not text: data, not a job failure
                    yield batch(file, place, [None])


_BLANK = re.compile(r"[ \t\n\r]*")
_PLAIN = re.compile(r"""(?:[^"'{}\[\]]++|"[^"\\\x00-\x1f]*+")*+""")  # up to a bracket, or a string that is not over or has escapes
_ENDS = {quote: re.compile(rf"[{quote}\\\x00-\x1f]") for quote in "\"'"}


def objects(source, chars: int = CHARS):
    """The texts of the objects of a JSON array, or of one object alone, read in pieces; what follows is not looked at.

    Only brackets, quotes and the array's commas are looked at; a file without an end, or with anything else in the array, is an error.
    """
    want, held, depth, quote, escaped, alone = "[{", [], 0, "", False, False
    while piece := source.read(chars):
        at = begin = 0
        while at < len(piece):
            if escaped:
                at, escaped = at + 1, False
            elif quote:
                end = _ENDS[quote].search(piece, at)
                at = end.end() if end else len(piece)
                if end and end.group() not in (quote, "\\"):
                    raise ValueError("a string is not closed")
                escaped = bool(end) and end.group() == "\\"
                quote = "" if end and not escaped else quote
            elif depth:
                at = _PLAIN.match(piece, at).end()
                sign = piece[at : at + 1]
                at += 1
                if sign and sign in "\"'":
                    quote = sign
                elif sign:
                    depth += 1 if sign in "{[" else -1
                    if not depth:
                        yield "".join([*held, piece[begin:at]])
                        held.clear()
                        if alone:
                            return
                        want = ",]"
            else:
                at = _BLANK.match(piece, at).end()
                if at == len(piece):
                    break
                sign = piece[at]
                if sign not in want:
                    raise ValueError(f"{sign} where one of {want} is due")
                if sign == "]":
                    return
                if sign == "{":
                    begin, depth, alone = at, 1, want == "[{"
                want = {"[": "{]", ",": "{"}.get(sign, want)
                at += 1
        if depth:
            held.append(piece[begin:])
    if want != "[{" or depth:
        raise ValueError("cut short")


def _bag(text: str) -> str | None:
    """The text of a pattern's properties as it stands there, unless it is a string or null."""
    bag, at = None, _BLANK.match(text, 1).end()
    try:
        while text[at] != "}":
            key, at = _decoded(text, at)
            at = _BLANK.match(text, at).end() + 1  # the colon
            begin = _BLANK.match(text, at).end()
            value, at = _decoded(text, begin)
            if key == "properties":
                bag = None if value is None or isinstance(value, str) else text[begin:at]
            at = _BLANK.match(text, at).end()
            if text[at] == ",":
                at = _BLANK.match(text, at + 1).end()
    except (ValueError, IndexError, RecursionError):  # as Spark reads it, if it does
        return None
    return bag


_decoded = json.JSONDecoder().raw_decode


def to_catalogue(patterns: DataFrame) -> Catalogue:
    """Bring a pattern table, which is configuration, to the driver."""
    if "source_file" in patterns.columns:
        patterns = patterns.orderBy(*[c for c in ("source_file", "place") if c in patterns.columns])
    rows = patterns.collect()
    return Catalogue(tuple(_pattern(r.asDict(recursive=True)) for r in rows))


def _pattern(row: dict) -> Pattern:
    bag = row.get("properties")
    if isinstance(bag, str):
        bag = json.loads(bag)
    lists = ("file_names", "path_patterns", "file_extensions", "content_patterns")
    return Pattern(
        name=row.get("name") or "",
        type=row.get("type") or "",
        category=row.get("category") or "",
        properties=None if bag is None else json.dumps(bag, sort_keys=True, separators=(",", ":"), ensure_ascii=False),
        **{k: tuple(row.get(k) or ()) for k in lists},
    )


def catalogue_frame(spark: SparkSession, catalogue: Catalogue) -> DataFrame:
    rows = [
        (p.name, p.type, p.category, list(p.file_names), list(p.path_patterns),
         list(p.file_extensions), list(p.content_patterns), p.properties)
        for p in catalogue.patterns
    ]
    return spark.createDataFrame(rows, READ_SCHEMA)


def _has(col: str) -> Column:
    return F.coalesce(F.size(col), F.lit(0)) > 0


def invalid_reason() -> Column:
    """NULL for a usable pattern row, otherwise why it is ignored."""
    return F.when(_has("file_names") & _has("file_extensions"), F.lit(BOTH_NAMES_AND_EXTENSIONS)).when(
        _has("content_patterns") & ~_has("file_names") & ~_has("file_extensions"),
        F.lit(CONTENT_WITHOUT_FILES),
    )


def invalid_patterns(patterns: DataFrame) -> DataFrame:
    return patterns.withColumn("reason", invalid_reason()).where(F.col("reason").isNotNull())


def is_regex_column(value: Column) -> Column:
    escaped = "".join("\\" + ch for ch in REGEX_SPECIALS)
    return F.rlike(value, F.lit(f"[{escaped}]"))


def _rule_of(column: str, kind):
    shown = bare_extension if column == "file_extensions" else (lambda v: v)
    return lambda v: F.struct(kind(v).alias("rule_kind"), shown(v).alias("value"))


def pattern_rules(patterns: DataFrame, id_column: str = "pattern_id") -> DataFrame:
    """One row per rule of each usable pattern: (pattern id, rule_kind, value)."""
    kinds = [
        ("file_names", lambda v: F.when(is_regex_column(v), F.lit("name_rx")).otherwise(F.lit("name_eq"))),
        ("file_extensions", lambda v: F.lit("ext")),
        ("path_patterns", lambda v: F.lit("glob")),
        ("content_patterns", lambda v: F.lit("content_rx")),
    ]
    rules = F.flatten(
        F.array(
            *[
                F.transform(
                    F.coalesce(F.col(c), F.array().cast("array<string>")),
                    _rule_of(c, kind),
                )
                for c, kind in kinds
            ]
        )
    )
    return patterns.where(invalid_reason().isNull()).select(id_column, F.inline(rules))
