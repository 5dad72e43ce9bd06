"""Extractors and summaries in Python, and labels by content."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from repocensus.operators import classify, languages
from repocensus.operators.user_code import PythonExtractor, SummaryProcessor, summarise_with
from repocensus.plans import scan as plan
from repocensus.plans.registry import ENTRIES
from repocensus.schemas import FINDINGS


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    """User code goes to the executors as any module of theirs does."""
    spark.sparkContext.addPyFile(__file__)


def _words(path, repo_name, content):
    if "bad" in content:
        raise KeyError("bad")
    for word in content.split():
        yield {"name": word, "type": "Word", "properties": {"n": len(word), "é": None}}


def test_own_python_extractor(spark, files):
    table = files([("r", "a.txt", "one two"), ("r", "b.txt", "bad one"), ("r", "c.py", "no"), ("s", "d.txt", None), ("s", "e.txt", "")])
    own = PythonExtractor("words", F.col("ext") == "txt", _words)
    records = plan.scan_records(table, [own, languages.file_rows()])
    found = {(r.path, r.type, r.name, r.properties) for r in plan.findings_of(records).collect()}
    assert {f for f in found if f[1] == "Word"} == {("a.txt", "Word", "one", '{"n":3,"é":null}'), ("a.txt", "Word", "two", '{"n":3,"é":null}')}
    assert len([f for f in found if f[1] == "File"]) == 5
    assert [(r.path, r.extractor, r.message) for r in plan.errors_of(records).collect()] == [("b.txt", "words", "KeyError: 'bad'")]
    assert plan.scan(table, [own]).count() == 2
    assert plan.scan(files([]), [own]).collect() == []


def test_only_routed_rows_reach_python(spark, files, tmp_path):
    files([("r", "a.txt", "x")]).write.parquet(str(tmp_path / "f"))
    table = spark.read.parquet(str(tmp_path / "f"))
    text = plan.scan(table, [PythonExtractor("w", F.col("ext") == "txt", _words)])._jdf.queryExecution().executedPlan().toString()
    node = next(i for i, line in enumerate(text.splitlines()) if "MapInArrow" in line)
    below = [line for line in text.splitlines()[node + 1 :]]
    assert any("Filter" in line for line in below[:4])


class Median(SummaryProcessor):
    """An exact median of name lengths: counts by length."""

    def new(self):
        return Counter()

    def process(self, state, finding):
        state[len(finding["name"])] += 1
        return state

    def merge(self, a, b):
        return a + b

    def findings(self, key, state):
        values = sorted(state.elements())
        yield {"name": "Median", "properties": {"value": values[len(values) // 2], "of": len(values)}}
        if key is None:
            yield {"name": "Nobody", "repo_name": "none"}


def test_own_summary(spark):
    rows = [("x" * (i % 17), "t", "", f"p{i}", "hot" if i % 3 else f"r{i % 5}", "{}") for i in range(5000)] + [("yy", "t", "", "p", None, None)]
    found = summarise_with(spark.createDataFrame(rows, FINDINGS).repartition(9), Median()).collect()
    of = defaultdict(list)
    for r in rows:
        of[r[4]].append(len(r[0]))
    want = {(k, "Median", f'{{"of":{len(v)},"value":{sorted(v)[len(v) // 2]}}}') for k, v in of.items()} | {("none", "Nobody", None)}
    assert {(r.repo_name, r.name, r.properties) for r in found} == want
    assert summarise_with(spark.createDataFrame([], FINDINGS), Median()).collect() == []


def _bayes(labelled, texts):
    """The same model in plain Python."""
    split = lambda t: re.findall(r"[^\W\d_]+|[^\w\s]+", (t or "").lower())
    counts, sizes = defaultdict(Counter), Counter()
    for text, label in labelled:
        sizes[label] += 1
        counts[label].update(split(text))
    known = set().union(*counts.values())
    out = []
    for text in texts:
        scores = []
        for label, n in sizes.items():
            total = counts[label].total() + len(known) + 1
            scores.append((math.log(n / sizes.total()) + sum(math.log((counts[label][w] + 1) / total) for w in split(text)), label))
        out.append(max(scores)[1])
    return out


def test_labels_by_words(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()]
    labelled = [(t, lang) for i, t, lang in docs if i % 2]
    model = classify.fit(spark.createDataFrame(labelled, "text string, label string"))
    hard = [(900, ""), (901, None), (902, "unheard"), (903, "1234 \n")]
    texts = [(i, t) for i, t, _ in docs] + hard
    got = {r.k: r.label for r in classify.predicted(spark.createDataFrame(texts, "k long, text string"), model, "k").collect()}
    assert got == dict(zip([k for k, _ in texts], _bayes(labelled, [t for _, t in texts]), strict=True))
    held_out = [got[i] == lang for i, t, lang in docs if i % 2 == 0 and (t or "").strip()]
    assert sum(held_out) >= 0.95 * len(held_out)


def test_languages_by_content_leave_known_files_alone(spark, files):
    labelled = [("def f(x): return x", "Python"), ("import os", "Python"), ("func main() { x := 1 }", "Go"), ("package main", "Go")]
    model = classify.fit(spark.createDataFrame(labelled, "text string, label string"))
    table = files([("r", "a.py", "package main"), ("r", "b", "func g() { y := 2 }"), ("r", "c.unknown", "def g(y): import os"), ("r", "d", "#!/bin/sh\nfunc"), ("r", "x.git/e", "func"), ("r", "f", " \n"), ("r", "g", None)])
    assert {(r.path, r.name) for r in languages.languages_by_content(table, model).collect()} == {("b", "Go"), ("c.unknown", "Python")}


def test_every_labelled_row_and_word_counts(spark):
    """More texts of a label and more words than the bounds that once were the defaults."""
    rows = spark.range(60_000).selectExpr("concat('common ', translate(id, '0123456789', 'abcdefghij')) AS text", "if(id % 3 = 0, 'x', 'y') AS label")
    model = classify.fit(rows)
    assert model.weights.select("word").distinct().count() == 60_001
    assert {r.label: r.prior for r in model.labels.collect()} == pytest.approx({"x": math.log(1 / 3), "y": math.log(2 / 3)})


def test_the_content_query_fits_its_model_to_all_documents(spark, sf, monkeypatch):
    given, fit = [], classify.fit
    monkeypatch.setattr(classify, "fit", lambda labelled, *bounds: given.append((labelled.count(), bounds)) or fit(labelled, *bounds))
    ENTRIES["languages_by_content"].run(spark, sf)
    assert given == [(spark.read.parquet(f"{sf}/documents.parquet").count(), ())]


def test_a_bounded_number_of_labelled_rows(spark):
    rows = [(f"w{i % 7} common", "abc"[i % 3]) for i in range(300)]
    model = classify.fit(spark.createDataFrame(rows, "text string, label string"), rows=10, most_words=4)
    assert model.weights.select("word").distinct().count() <= 4
    assert {r.label: r.prior for r in model.labels.collect()} == {x: math.log(1 / 3) for x in "abc"}
