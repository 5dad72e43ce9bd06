"""Pattern tables joined to files give what the catalogue in the plan gives."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from repocensus.functions.regexes import contains_any
from repocensus.operators.matching import match_patterns
from repocensus.operators.rule_join import glob_needle, match_by_rules, searched_hits
from repocensus.sources.catalogue import Catalogue, Pattern, catalogue_frame, invalid_patterns, read_patterns

NAMES = ["a", "pom.xml", "xpom-xml", "README", "read.me", "x.py", "y.PY", "Dockerfile", "Dockerfile.dev", ".travis.yml", "né.js", "", "a b"]
FOLDERS = ["", "/", "src/", "src/x/", ".github/workflows/", "a.b/c/"]


def _same(spark, files, patterns):
    table = files([(f"r{i % 3}", path, content) for i, (path, content) in enumerate(_rows())])
    want = Counter(map(tuple, match_patterns(table, Catalogue(tuple(patterns))).collect()))
    got = Counter(map(tuple, match_by_rules(table, catalogue_frame(spark, Catalogue(tuple(patterns)))).collect()))
    assert got == want
    return got


def _rows():
    texts = ["", None, "license MIT", "flask==1", "x" * 300, "a.b\nc"]
    return [(folder + name, texts[(i * 7 + j) % len(texts)]) for i, folder in enumerate(FOLDERS) for j, name in enumerate(NAMES)] * 2


def test_every_kind_of_rule(spark, files):
    found = _same(
        spark,
        files,
        [
            Pattern("eq", "T", "C", file_names=("README", "a")),
            Pattern("rx", "T", "C", file_names=(r"pom.xml", r"^x\.")),
            Pattern("short", "T", "C", file_names=(r"a?", r"^$")),
            Pattern("opaque", "T", "C", file_names=(r"\d|e{1}",)),
            Pattern("ext", "T", "C", file_extensions=(".py", "dev", "travis.yml"), properties='{"k":"v"}'),
            Pattern("glob", "T", "C", path_patterns=("**/x/*", "/src/?")),
            Pattern("class", "T", "C", path_patterns=("/[as]*/{x,c}/*",)),
            Pattern("both", "T", "C", file_names=("a",), path_patterns=("/src/*",)),
            Pattern("ext and path", "T", "C", file_extensions=("py",), path_patterns=("*/x/*",), content_patterns=("fl.sk", "MIT")),
            Pattern("content", "T", "C", file_names=("README", "a", "x.py"), content_patterns=(r"a\.b", "license")),
            Pattern("open", "T", "C"),
            Pattern("open", "T", "C"),
            Pattern("invalid", file_names=("a",), file_extensions=("py",)),
            Pattern("invalid too", content_patterns=("a",)),
        ],
    )
    assert {r[0] for r in found} == {"eq", "rx", "short", "opaque", "ext", "glob", "class", "both", "ext and path", "content", "open"}


def test_no_patterns_and_no_files(spark, files):
    assert _same(spark, files, []) == Counter()
    assert match_by_rules(files([]), catalogue_frame(spark, Catalogue((Pattern("open"), Pattern("a", file_names=("a",)))))).collect() == []


def test_more_than_twenty_thousand_patterns(spark, files):
    """A large table is joined, not collected, and agrees with each file's own patterns."""
    draw = random.Random(1)
    words = ["".join(draw.choices("abcdef", k=6)) for _ in range(7000)]
    kinds = [lambda w: {"file_names": (f"{w}.txt",)}, lambda w: {"file_extensions": (w,)}, lambda w: {"path_patterns": (f"*/{w}/*",)}]
    patterns = [Pattern(f"{w}-{k}", "T", "C", **kind(w)) for w in words for k, kind in enumerate(kinds)]
    table = files([("r", f"/{words[i + 1]}/{words[i]}.{e}", "") for i in range(200) for e in ("txt", words[i + 2])])
    found = Counter((r.path, r.name) for r in match_by_rules(table, catalogue_frame(spark, Catalogue(tuple(patterns)))).collect())
    count = Counter(words)
    want = Counter()
    for i in range(200):
        for e in ("txt", words[i + 2]):
            path = f"/{words[i + 1]}/{words[i]}.{e}"
            want[path, f"{words[i + 1]}-2"] = count[words[i + 1]]
            want[path, f"{words[i]}-0" if e == "txt" else f"{e}-1"] = count[words[i] if e == "txt" else e]
    assert len(patterns) > 20_000 and found == want


def test_patterns_read_from_files(spark, files, tmp_path):
    """Catalogue files go into the join without passing the driver; properties keep their types."""
    (tmp_path / "a.json").write_text('[{"name": "A", "type": "T", "file_names": ["a"], "properties": {"n": 1, "l": ["x"]}}, {"name": "open"}]')
    (tmp_path / "b.json").write_text('[{"name": "broken", ')
    patterns = read_patterns(spark, str(tmp_path))
    found = match_by_rules(files({"x/a": "", "b": ""}), patterns).collect()
    assert sorted((r.path, r.name, r.category, r.properties) for r in found) == [("x/a", "A", "", '{"l":["x"],"n":1}'), ("x/a", "open", "", None)]
    assert invalid_patterns(patterns).count() == 0


@pytest.mark.parametrize("glob, text", [("/en/*", "/en/"), ("**/src?x/*", "/src"), ("{a,b}cd", ""), ("[x]yz", ""), ("*", "")])
def test_needles_of_globs(glob, text):
    assert glob_needle(glob) == text


def test_only_texts_with_a_needle_are_taken_apart(spark):
    """A few needles are one literal regex below the three-character pieces; the texts found stay the same."""
    rules = [("abc", None, "abc"), ("x.y&", r"x\.y&$", "x.y&$"), ("", r"^q\d$", r"^q\d$")]
    table = spark.createDataFrame([([dict(zip(("needle", "rx", "rule"), r, strict=True)) for r in rules],)], "r array<struct<needle:string,rx:string,rule:string>>")
    texts = spark.createDataFrame([(t,) for t in ["1abc2", "x.y&", "x.y& ", "q1", "other", "ab", ""]], "text string")
    found = searched_hits(texts, table, "r")
    assert sorted(map(tuple, found.collect())) == [("1abc2", "abc"), ("q1", r"^q\d$"), ("x.y&", "x.y&$")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.splitlines() if "Filter" in line and "RLIKE(text" in line.replace(" RLIKE ", "RLIKE(text") and "abc" in line]


def test_many_content_rules_of_one_name(spark, files):
    """Nine patterns that all search the content are given up at once where none of their needles occurs."""
    patterns = [Pattern(f"n{i}", "T", "C", file_names=("many.txt",), content_patterns=(rf"key{i}\d+z$",) if i == 3 else (f"key{i}&-",)) for i in range(9)]
    patterns += [Pattern("open", "T", "C", file_names=("mixed.txt",)), Pattern("anywhere", "T", "C")]
    given = files({"a/many.txt": "..key4&-..", "b/many.txt": "a", "c/many.txt": None, "f/many.txt": "key312z", "mixed.txt": "", "d/many.txt": "key4&- key5&- key3z", "e/none.txt": "key1&-"})
    got = sorted((r.path, r.name) for r in match_by_rules(given, catalogue_frame(spark, Catalogue(tuple(patterns)))).collect())
    want = [("a/many.txt", "n4"), ("d/many.txt", "n4"), ("d/many.txt", "n5"), ("f/many.txt", "n3"), ("mixed.txt", "open")]
    assert got == sorted(want + [(p, "anywhere") for p in ("a/many.txt", "b/many.txt", "c/many.txt", "d/many.txt", "f/many.txt", "mixed.txt")])


def test_literal_regexes_of_any_characters(spark):
    needles = ["a", "^b", "]c", "[d", "-e", "&&f", "\\g", '"h', " i", "~j", "\nk", "é", "bc"]
    texts = spark.createDataFrame([(t,) for t in [*needles, *(f"x{t}y" for t in needles), "b", "^", "]", "&f", "zzz", "\\", "", "k", "cb"]], "t string")
    got = {r.t for r in texts.where(F.col("t").rlike(contains_any(needles))).collect()}
    assert got == {r.t for r in texts.collect() if any(n in r.t for n in needles)}
    assert contains_any(needles).startswith("(?=[")
