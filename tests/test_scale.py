"""What large tables must not do: shuffle contents, hold a group whole, repeat work for every row."""

import io
import json

import pytest
from pyspark.sql import functions as F

from repocensus import testbed as tb
from repocensus.operators.classify import fit, predicted
from repocensus.operators.docker import dockerfile
from repocensus.operators.extractor import extract
from repocensus.operators.rule_join import classes, match_by_rules, matched_classes
from repocensus.operators.user_code import SummaryProcessor, summarise_with
from repocensus.operators.vulns import vulnerability_findings
from repocensus.plans import registry, scan
from repocensus.sources import batches, catalogue
from repocensus.sources.catalogue import Catalogue, Pattern, catalogue_frame


def test_routing_counts_paths_without_a_files_table(spark, sf, monkeypatch):
    def never(*_):
        raise AssertionError("contents are written to count paths")

    monkeypatch.setattr(tb, "files_table", never)
    counts = {r.extractor: r.files for r in registry.file_routing(spark, sf).collect()}
    assert counts["pip"] == tb.table(spark, sf, "lineitem").where("l_linenumber <> 7").count()


def test_large_tables_become_files_without_a_shuffle(spark, sf, tmp_path, monkeypatch):
    for name in ("lineitem", "orders", "customer", "part", "supplier", "documents"):
        rows = tb.table(spark, sf, name).limit(40)
        rows.repartition(16).write.parquet(f"{tmp_path}/{name}.parquet")
    cores, asked = spark.sparkContext.defaultParallelism, []
    kind = type(spark.range(1))
    mixed = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda df, n, *c: asked.append(n) or mixed(df, n, *c))
    assert tb.table(spark, str(tmp_path), "lineitem").rdd.getNumPartitions() >= cores
    files = tb.files_table(spark, str(tmp_path))
    assert 4 * cores not in asked and files.count() == tb.all_files(spark, str(tmp_path)).count()


def test_patterns_with_the_same_criteria_are_one_class(spark, files):
    """Files meet a class once, however many patterns it has; only findings have a row for each."""
    catalogue = Catalogue(tuple(Pattern(f"p{i}", "T", "C", file_extensions=("py",), path_patterns=("/src/*",)) for i in range(500)))
    grouped = classes(catalogue_frame(spark, catalogue), "name")
    table = files([("r", f"src/{i}.py", "") for i in range(20)] + [("r", "lib/x.py", "")])
    assert grouped.rules.count() == 1 and grouped.members.select("name").distinct().count() == 500
    assert matched_classes(table, grouped.rules).count() == 20
    assert match_by_rules(table, catalogue_frame(spark, catalogue)).count() == 500 * 20


def test_files_stay_where_they_are_for_a_small_catalogue(spark, files):
    """What rules lead to is small here, so that no content is shuffled."""
    table = files([("r", f"src/{i}.py", "x" * 100) for i in range(50)])
    catalogue = Catalogue((Pattern("n", file_names=("1.py",)), Pattern("e", file_extensions=("py",)), Pattern("g", path_patterns=("/src/2*",))))
    found = match_by_rules(table, catalogue_frame(spark, catalogue))
    found.count()
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 5 + 50 + 11


def test_one_extractor_has_items_as_rows_before_its_steps(spark, files):
    """Columns that nobody reads are not made, and errors are worked out once, where the contents are."""
    table = files({"Dockerfile": "FROM a/b:1 AS c\n", "x/Dockerfile": "FROM a\n\\\n", "requirements.txt": "a==1\n"})
    found = extract(table, dockerfile())
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(found).count("empty instruction") <= 1 and "transform" not in plan(found)
    assert "concat_ws" in plan(found) and "concat_ws" not in plan(found.select("repo_name", "type"))
    assert [(r.path, r.name, r.properties) for r in found.collect()] == [
        ("Dockerfile", "FROM", '{"alias":"c","image":"b","owner":"a","version":"1"}')
    ]


def test_errors_alone_leave_out_what_only_findings_need(spark, files):
    table = files({"Dockerfile": "FROM a\n\\\n", "go.mod": "require a v1\n", "package.json": "{", "build.gradle": "", "requirements.txt": "a"})
    errors = scan.scan_errors(table)
    assert "__go_text" not in errors._jdf.queryExecution().optimizedPlan().toString()
    want = scan.errors_of(scan.scan_records(table))
    assert sorted(errors.collect()) == sorted(want.collect()) and errors.count() == 3
    assert errors.columns == want.columns


@pytest.mark.parametrize("text", ["[]", " [ ] x", '[1]', '[1, 22,"a,]\\"",{"a":[1]} ,null]', '{"a": 1} z', "[1.5, 2e+7,-1.25e-3 ]"])
@pytest.mark.parametrize("chars", [1, 2, 7, 1000])
def test_elements_of_an_array_read_in_pieces(text, chars):
    got = [json.loads(e) for e in batches.elements(io.StringIO(text), chars)]
    want = json.JSONDecoder().raw_decode(text.strip())[0]
    assert got == (want if isinstance(want, list) else [want])


@pytest.mark.parametrize("text", ["", "[", "[1", "[1,", "[1 2]", '[{"a": 1}', '["a', "[1,]", "x"])
def test_an_array_cut_short_is_an_error(text):
    with pytest.raises(ValueError):
        list(batches.elements(io.StringIO(text), 2))


def test_batches_of_any_length_are_read_in_pieces(spark, tmp_path, monkeypatch):
    """No row holds a whole file; one that ends too early gives nothing."""
    row = '{\n "name": "é%d", "type": "T", "properties": {"n": 1}\n}'
    long = "[ " + ", ".join(row % i for i in range(2500)) + " ]"
    (tmp_path / "a.json").write_text(long, encoding="utf-8")
    (tmp_path / "b.json").write_text(long[:-3], encoding="utf-8")
    (tmp_path / "c.json").write_bytes(b'[{"name": "\xff"}]')
    found = batches.read_batches(spark, str(tmp_path), multi_line=True)
    rows = found.collect()
    assert len(rows) == 2501 and len({r.name for r in rows}) == 2501 and "\ufffd" in {r.name for r in rows}
    assert {(r.properties, r.path) for r in rows if r.type} == {('{"n":1}', None)}
    listed = spark.read.format("binaryFile").load(str(tmp_path)).select("path")
    lengths = [r[0] for r in listed.mapInArrow(batches._records, "value STRING").select(F.length("value")).collect()]
    assert len(lengths) == 4 and max(lengths) < 0.5 * len(long)


def test_summary_states_are_merged_without_a_call_for_each_group(spark):
    class Count(SummaryProcessor):
        def new(self):
            return 0

        def process(self, state, finding):
            return state + 1

        def merge(self, a, b):
            return a + b

        def findings(self, key, state):
            yield {"name": "n", "properties": {"n": state}}

    columns = [F.lit("x").alias(c) for c in ("name", "type", "category", "path")]
    repo = F.when(F.col("id") % 3000 > 0, F.concat(F.lit("r"), (F.col("id") % 3000).cast("string")))
    found = spark.range(30000, numPartitions=6).select(*columns, repo.alias("repo_name"), F.lit("{}").alias("properties"))
    counted = summarise_with(found, Count())
    assert "InArrow" in (plan := counted._jdf.queryExecution().optimizedPlan().toString()) and "FlatMapGroups" not in plan
    rows = counted.collect()
    assert len(rows) == 3000 and {r.properties for r in rows} == {'{"n":10}'}


def test_vulnerabilities_are_rows_before_their_bags(spark, sf):
    found = vulnerability_findings(tb.vulnerability_reports(spark, sf))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "concat_ws" in plan(found) and "concat_ws" not in plan(found.select("repo_name", "name"))
    reports = tb.vulnerability_reports(spark, sf).limit(1)
    empty = reports.select("repo_name", F.lit(None).cast(reports.schema["Results"].dataType).alias("Results"))
    assert vulnerability_findings(empty).count() == 0


def test_words_are_not_shuffled_to_label_texts(spark):
    texts = [(i, "der hund und die katze und" if i % 2 else "the dog and the cat and", "de" if i % 2 else "en") for i in range(40)]
    frame = spark.createDataFrame([*texts, (40, "", None), (41, "zzz", None)], "id LONG, text STRING, label STRING")
    told = predicted(frame.select("id", "text"), fit(frame.select("text", "label")), "id")
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" in plan and not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "word#" in line]
    got = {r.id: r.label for r in told.collect()}
    assert got == {i: label for i, _, label in texts} | {40: got[40], 41: got[41]} and len(got) == 42


@pytest.mark.parametrize("chars", [1, 2, 7, 1 << 20])
def test_objects_of_an_array_in_pieces(chars):
    found = lambda text: list(catalogue.objects(io.StringIO(text), chars))
    texts = ['{"a": "]},\\"{"}', "{'b' : 'x\\'\"['}", "{}", '{"c": [1, {"d": "\'"}]}']
    assert found(" [ " + " ,\n".join(texts) + " ] rest {") == texts
    assert found('{"a": [1]} {"b": 2}') == ['{"a": [1]}'] and found(" [ ] ") == found(" ") == []
    for text in ('[{"a": 1}', '[{"a": 1},', '[{"a": 1},]', '[{"a": 1} {"b": 2}]', "[1]", "[[{}]]", "[{}, null]", "5", '{"a": "b', '[{"a": "\n"}]'):
        with pytest.raises(ValueError):
            found(text)


def test_catalogues_of_any_length_are_read_in_pieces(spark, tmp_path):
    """No row holds a file; one malformed pattern, or a missing end, leaves out the whole file; properties stay as written."""
    pattern = '{\n "name": "p%d", "file_names": [ "é" ], "properties": { "n": 1.50,\n  "k": [ "x" ] }\n}'
    long = "[ " + ", ".join(pattern % i for i in range(2500)) + " ]"
    (tmp_path / "a.json").write_text(long, encoding="utf-8")
    (tmp_path / "b.json").write_text(long[:-3], encoding="utf-8")
    (tmp_path / "c.json").write_text(long[:-2] + ', {"name": "x", "file_names": 3} ]', encoding="utf-8")
    (tmp_path / "d.json").write_text('{"name": "one", "properties": 12.30}', encoding="utf-16")
    (tmp_path / "e.json").write_bytes(b'[{"name": "\xff"}]')
    rows = catalogue.read_patterns(spark, str(tmp_path)).orderBy("source_file", "place").collect()
    assert [r.name for r in rows] == [*(f"p{i}" for i in range(2500)), "one"]
    assert {r.properties for r in rows} == {'{ "n": 1.50,\n  "k": [ "x" ] }', "12.30"}
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", F.col("path").alias("source_file"), F.lit(None).cast("binary").alias("content"))
    texts = files.mapInArrow(catalogue._patterns, catalogue._PATTERN_TEXTS)
    assert texts.agg(F.max(F.length("value"))).first()[0] < 200 and texts.where("value IS NULL").count() == 2


def test_catalogue_files_are_written_row_by_row(spark, sf, tmp_path):
    """The text is that of the whole array at once, but for the order of its patterns."""
    tb.write_catalogues(spark, sf, str(tmp_path / "out"))
    brands = {r.p_brand: r.n for r in tb.table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n")).collect()}
    assert {f.name for f in (tmp_path / "out").iterdir()} == {b.replace("#", "-") + (".backup" if b.endswith("#1") else ".json") for b in brands}
    for brand, n in brands.items():
        number = int(brand.split("#")[1])
        text = (tmp_path / "out" / (brand.replace("#", "-") + (".backup" if number == 1 else ".json"))).read_text()
        if number % 5:
            assert len(json.loads(text)) == n and text.startswith("[ {\n") and "\n}, {\n" in text or n == 1
        else:
            assert text.count('"name"') == n and not text.rstrip().endswith("]")
