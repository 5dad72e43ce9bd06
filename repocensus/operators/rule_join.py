"""Files against a pattern table of any size, as joins.

:mod:`repocensus.operators.matching` puts a catalogue into the plan, which suits the built-in one. Here patterns stay
a DataFrame and are never collected. Patterns with the same criteria are one *class*, which is matched once however
many patterns it has. The distinct rules of all classes are joined to the *distinct* base names, and to the extensions and
paths of the files, equal texts by equi joins, regexes and globs by equi joins too, on three characters that
every match contains. What a name, extension or path leads to is stored, so that Spark knows its size, and joined back to
the files, where the criteria of a class are intersected and content is searched, in the file's own row.
A base name of a third of all files is one row until it is joined back, and then the side that Spark can split.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repocensus.functions.paths import with_path_columns
from repocensus.functions.regexes import contains_any, glob_regex, is_regex, java_regex, needle
from repocensus.operators.ordering import written
from repocensus.schemas import FINDING_COLUMNS
from repocensus.sources.catalogue import invalid_reason, is_regex_column

GRAM = 3
# So many needles at most are searched as one literal regex first. Texts with so many classes that all search the content get one
# search for all their needles first, the largest of them.
FIRST_NEEDLES, LARGE_TEXT, SEARCHED_TEXTS = 1000, 8, 16
NAMES, EXTENSIONS, PATHS = 1, 2, 4
_CRITERIA = {"file_names": NAMES, "file_extensions": EXTENSIONS, "path_patterns": PATHS}
_LISTS = [*_CRITERIA, "content_patterns"]
_RULE = [T.StructField(c, T.StringType()) for c in ("needle", "rx", "rule")]
_TEXT_RULES = T.ArrayType(T.StructType(_RULE))


@F.pandas_udf(_TEXT_RULES)
def _text_rules(texts: pd.Series) -> pd.Series:
    """Catalogue regexes as a text that every match contains and a regex, NULL for plain texts; catalogue rows only."""
    one = lambda t: {"needle": needle(t), "rx": java_regex(t), "rule": t} if is_regex(t) else {"needle": t, "rx": None, "rule": t}
    return texts.map(lambda given: [one(t) for t in given])


@F.pandas_udf(_TEXT_RULES)
def _glob_rules(globs: pd.Series) -> pd.Series:
    return globs.map(lambda given: [{"needle": glob_needle(g), "rx": glob_regex(g), "rule": g} for g in given])


def glob_needle(glob: str) -> str:
    """The longest text of a glob without alternatives or classes; '' when there is none."""
    if any(ch in glob for ch in "[]{}\\"):
        return ""
    return max(glob.replace("?", "*").split("*"), key=len)


@dataclass(frozen=True)
class Classes:
    """Usable patterns by their criteria: ``rules`` has a row for each class, ``members`` one for each pattern."""

    rules: DataFrame
    members: DataFrame


def classes(patterns: DataFrame, *kept: str) -> Classes:
    """The classes with ``class_id`` and translated rules, stored, so that every later read sees the same ids.

    Members carry ``row``, the columns of a finding, and the ``kept`` columns of the patterns.
    """
    given = patterns.where(invalid_reason().isNull()).select(
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("name", "type", "category")],
        F.nullif(F.to_json(F.try_parse_json("properties")), F.lit("null")).alias("properties"),
        *[F.coalesce(F.col(c).cast("array<string>"), F.array().cast("array<string>")).alias(c) for c in _LISTS],
        *[F.col(c).alias(f"__{c}") for c in kept],
    )
    needs = sum((F.when(F.size(c) > 0, F.lit(bit)).otherwise(0) for c, bit in _CRITERIA.items()), F.lit(0))
    made = given.select(*_LISTS).distinct().select(
        F.monotonically_increasing_id().alias("class_id"),
        needs.alias("needs"),
        *_LISTS,
        _text_rules("content_patterns").alias("contents"),
        _text_rules(F.filter("file_names", is_regex_column)).alias("name_rules"),
        _glob_rules("path_patterns").alias("path_rules"),
    )
    rules = written(made, "classes")
    row = F.struct("name", "type", "category", "properties").alias("row")
    named = given.join(rules.select("class_id", *_LISTS), _LISTS).select("class_id", row, *[F.col(f"__{c}").alias(c) for c in kept])
    return Classes(rules, written(named, "members"))


def _bare(rules: DataFrame) -> Column:
    return F.struct("class_id", "path_patterns", "contents").alias("c")


def equal_hits(rules: DataFrame, values: Column) -> DataFrame:
    """(``text``, ``c``) of classes that list exactly this text."""
    return rules.select(_bare(rules), F.explode(F.array_distinct(values)).alias("text"))


def searched_hits(texts: DataFrame, rules: DataFrame, column: str) -> DataFrame:
    """(``text``, ``rule``) of ``texts`` in which a rule of some class is found.

    Rules with a needle meet the texts that contain its first GRAM characters; only those without one are
    tried on every text. If the needles are few, only texts with one of them are taken apart at all.
    """
    ruled = rules.select(F.inline(column)).distinct()
    keyed = ruled.where(F.length("needle") >= GRAM).withColumn("gram", F.substring("needle", 1, GRAM))
    starts = F.sequence(F.lit(1), F.greatest(F.length("text") - GRAM + 1, F.lit(1)))
    few = [r["needle"] for r in keyed.select("needle").distinct().limit(FIRST_NEEDLES + 1).collect()]
    likely = texts.where(F.col("text").rlike(contains_any(sorted(few)))) if 0 < len(few) <= FIRST_NEEDLES else texts
    grams = likely.select("text", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substr("text", i, F.lit(GRAM))))).alias("gram"))
    found = F.col("text").contains(F.col("needle")) & (F.col("rx").isNull() | F.rlike("text", F.col("rx")))
    near = grams.join(keyed, "gram").where(found).select("text", "rule")
    rest = texts.join(ruled.where(F.length("needle") < GRAM), found).select("text", "rule")
    return near.unionByName(rest)


def hopeless(hits: DataFrame, name: str, text: Column, content: Column) -> Column:
    """Files of the texts with the most classes whose content has none of the needles that each of these classes needs.

    Regexes are constants, compiled once a task, so they are for some texts only; all others are searched class by class.
    """
    rules = F.flatten(F.transform(name, lambda c: c["contents"]))
    all_search = F.forall(name, lambda c: (F.size(c["contents"]) > 0) & F.forall(c["contents"], lambda r: r["needle"] != ""))
    large = hits.where((F.size(name) >= LARGE_TEXT) & all_search).orderBy(F.desc(F.size(name)), "text").limit(SEARCHED_TEXTS)
    needles = F.array_distinct(F.transform(rules, lambda r: r["needle"]))
    vain = F.lit(False)
    for r in large.select("text", F.slice(needles, 1, FIRST_NEEDLES + 1).alias("needles")).collect():
        if len(r["needles"]) <= FIRST_NEEDLES:
            vain = vain | ((text == r["text"]) & ~content.rlike(contains_any(sorted(r["needles"]))))
    return F.coalesce(vain, F.lit(False))


def matched_classes(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(``repo_name``, ``path``, ``class_id``) of every file and class whose every stated criterion holds."""
    placed = with_path_columns(files)
    texts = lambda c: placed.select(F.col(c).alias("text"))
    bare = F.transform("file_extensions", lambda e: F.regexp_replace(e, r"^\.", ""))
    leading = lambda name: rules.select(_bare(rules), F.explode(F.array_distinct(F.col(name)["rule"])).alias("rule"))
    by = lambda hits, name: hits.groupBy("text").agg(F.collect_set("c").alias(name))

    found_names = searched_hits(texts("base_name").distinct(), rules, "name_rules").join(leading("name_rules"), "rule").select("c", "text")
    by_name = written(by(equal_hits(rules, F.col("file_names")).unionByName(found_names), "names"), "by-name")
    by_ext = written(by(equal_hits(rules, bare), "extensions"), "by-extension")
    # Hardly two files have one path, so paths are searched as they come; a path keeps its globs, not all classes that state them.
    only = rules.where(F.col("needs") == PATHS).select(F.explode(F.array_distinct("path_patterns")).alias("rule"), "class_id")
    alone = only.groupBy("rule").agg(F.collect_set("class_id").alias("ids"))
    globs = searched_hits(texts("rooted_path"), rules, "path_rules").join(alone, "rule", "left")
    by_path = written(
        globs.groupBy("text").agg(F.collect_set("rule").alias("globs"), F.array_distinct(F.flatten(F.collect_set("ids"))).alias("paths")), "by-path"
    )

    content = F.coalesce("content", F.lit(""))
    holds = lambda r: content.contains(r["needle"]) & (r["rx"].isNull() | F.rlike(content, r["rx"]))
    on_path = lambda c: (F.size(c["path_patterns"]) == 0) | F.coalesce(F.arrays_overlap(c["path_patterns"], F.col("globs")), F.lit(False))
    passing = lambda c: on_path(c) & ((F.size(c["contents"]) == 0) | F.exists(c["contents"], holds))
    none = F.array().cast("array<bigint>")
    ids = lambda name: F.coalesce(F.transform(F.filter(name, passing), lambda c: c["class_id"]), none).alias(name)
    found = placed.select("repo_name", "path", "content", "base_name", "ext", "rooted_path")
    found = found.join(by_path.withColumnRenamed("text", "rooted_path"), "rooted_path", "left").withColumns(
        {"paths": F.coalesce("paths", none), "anywhere": F.col("globs").isNotNull()}
    )
    # Classes are cut down to those that hold before the next join, so that no row carries all classes of its name.
    for hits, on, name in ((by_name, "base_name", "names"), (by_ext, "ext", "extensions")):
        joined = found.join(hits.withColumnRenamed("text", on), on, "left").withColumn("anywhere", F.col("anywhere") | F.col(name).isNotNull())
        found = joined.withColumn(name, F.when(hopeless(hits, name, F.col(on), content), none).otherwise(ids(name)))
    # Patterns that state nothing are one class; they hold for every file that some rule leads anywhere.
    open_ones = rules.where("needs = 0").agg(F.collect_list("class_id")).scalar()
    everywhere = F.when(F.col("anywhere"), F.coalesce(open_ones, none)).otherwise(none)
    return found.select("repo_name", "path", F.explode(F.concat("names", "extensions", "paths", everywhere)).alias("class_id"))


def match_by_rules(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """One finding per (file, usable pattern) whose every stated criterion holds.

    ``patterns`` has the columns that :func:`repocensus.sources.catalogue.read_patterns` gives.
    """
    grouped = classes(patterns)
    found = matched_classes(files, grouped.rules).join(grouped.members, "class_id")
    return found.select("row.*", "repo_name", "path").select(*FINDING_COLUMNS)
