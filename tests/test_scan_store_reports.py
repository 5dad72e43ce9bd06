import json
import os

import pytest
from pyspark.sql import functions as F

from repocensus import testbed as tb
from repocensus.functions.props import flatten
from repocensus.functions import paths, sqlite
from repocensus.operators import reporting, store
from repocensus.operators.extractor import Extractor, finding, no_findings
from repocensus.operators.vulns import vulnerability_findings
from repocensus.plans import scan as plan
from repocensus.plans.summary import summarise
from repocensus.schemas import FILES, FINDINGS
from repocensus.sources import batches, filetree, inventory

ROWS = {
    "go.mod": "require a v1", "package.json": "{bad", "src/a.py": "", "Dockerfile": "FROM x",
    "run": "#!/usr/bin/env bash\n", ".git/config": "x", "main.tf": 'module "m" {\n source = "s"\n}',
    "compose.yml": "services: {w: {image: i}}",
}


def test_single_pass_scan(files):
    records = plan.scan_records(files(ROWS))
    found = {(r.type, r.name) for r in plan.findings_of(records).collect()}
    assert found == {
        ("Library", "a"), ("Docker Directive", "FROM"), ("TF Module Use", "TF Module"), ("Docker Compose Service", "w"),
        ("Application", "Docker"), ("Programming Language", "Python"), ("Programming Language", "Shell"),
        ("Programming Language", "HCL"), ("Programming Language", "YAML"), ("Programming Language", "Dockerfile"),
        ("Programming Language", "Go Module"), ("Programming Language", "JSON"),
        *{("File", p) for p in ROWS if ".git" not in p},
    }
    assert [(r.path, r.extractor) for r in plan.errors_of(records).collect()] == [("package.json", "npm")]


def test_scan_reads_the_files_once_and_does_not_shuffle(spark, files, tmp_path):
    files(ROWS).write.parquet(str(tmp_path / "f"))
    stored = spark.read.schema(FILES).parquet(str(tmp_path / "f"))
    text = plan.scan(stored)._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "Exchange" not in text and "Join" not in text
    one = plan.scan(stored.where(F.col("repo_name") == "repo"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(repo_name,repo)" in one
    narrow = paths.with_path_columns(stored).select("base_name")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in narrow


def test_failed_repositories_lose_everything(spark, files):
    good, bad = files([("a", "go.mod", "require a v1")]), files([("b", "go.mod", "require b v1")])
    broken = spark.createDataFrame([("b", "x", None, "denied"), ("c", "y", "ok", None)], FILES)
    extra = lambda: spark.createDataFrame([("m", "git_metric", "", "", r, "{}") for r in "abc"], FINDINGS)
    found = plan.scan_repositories(good.union(bad).union(broken), [extra])
    assert {r.repo_name for r in found.collect()} == {"a", "c"}
    lost = spark.createDataFrame([("c",)], "repo_name string")
    again = plan.scan_repositories(good.union(bad).union(broken), [extra], failed=lost)
    assert {r.repo_name for r in again.collect()} == {"a"}


def test_failures_come_from_the_one_scan(spark, files, tmp_path):
    files([("a", "go.mod", "require a v1")]).write.parquet(str(tmp_path / "f"))
    stored = spark.read.schema(FILES).parquet(str(tmp_path / "f"))
    found = plan.scan_repositories(stored)
    assert str(tmp_path / "f") not in found._jdf.queryExecution().executedPlan().toString() and {r.repo_name for r in found.collect()} == {"a"}


def test_post_scan_errors_drop_or_warn(spark, files):
    """Among many repositories an error of a step drops its repository; a scan of one keeps it as a warning."""
    table = files([("a", "go.mod", "require a v1"), ("a", "package.json", "{bad"), ("b", "go.mod", "require b v1")])
    schema = FINDINGS + ", message STRING"
    step = lambda: spark.createDataFrame([("m", "x", "", "", "a", "{}", None), (None, None, None, None, "a", None, "no report"), ("m", "x", "", "", "b", "{}", None)], schema)
    assert {r.repo_name for r in plan.scan_repositories(table, [step]).collect()} == {"b"}
    one = plan.scan_repository(table, "a", [step], extractors=None)
    assert {r.type for r in one.findings.collect()} == {"Library", "x", "File", "Programming Language"}
    assert {(r.extractor, r.message is not None) for r in one.warnings.collect()} == {("npm", True), (plan.POST_SCAN, True)}
    broken = table.union(spark.createDataFrame([("a", "y", None, "denied")], FILES))
    with pytest.raises(OSError, match="'y': denied"):
        plan.scan_repository(broken, "a")
    assert plan.scan_repository(broken, "b").warnings.count() == 0


def test_own_extractor(files):
    todo = Extractor(
        name="todo",
        route=F.col("ext") == "py",
        stages=[{"__todos": F.regexp_count("content", F.lit("TODO"))}],
        findings=F.when(F.col("__todos") > 0, F.array(finding("Todo", "Note", "", None))).otherwise(no_findings()),
    )
    found = plan.scan(files({"a.py": "# TODO", "b.py": "", "c.go": "TODO"}), [todo])
    assert [(r.path, r.name) for r in found.collect()] == [("a.py", "Todo")]


@pytest.mark.parametrize(
    "bag, stored",
    [
        (None, "{}"), ("not json", "{}"), ("{}", "{}"), ('{"b":1,"a":"x"}', None),
        ('{"a":"x","n":-1.5,"t":true,"z":null}', '{"a":"x","n":-1.5,"t":true,"z":null}'),
        ('{"Name":1,"TYPE":2,"category":3,"path":4,"RepoName":5,"names":6}', '{"names":6}'),
        ('{"m":{"b":1,"a":[1]},"l":[{"x":1}]}', '{"l":[{"x":1}],"m":"{\\"a\\":[1],\\"b\\":1}"}'),
        ('{"s":"{\\"type\\":1"}', '{"s":"{\\"type\\":1"}'),
    ],
)
def test_flatten(spark, bag, stored):
    got = spark.createDataFrame([(bag,)], "p string").select(flatten(F.col("p"))).first()[0]
    if stored is None:
        assert json.loads(got) == json.loads(bag)
    else:
        assert got == stored


def sample(spark, n, kind="T", repo="r"):
    return spark.createDataFrame([(f"n{i}", kind, "c", f"p{i}", repo, json.dumps({"k": i, "path": "x"})) for i in range(n)], FINDINGS)


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    store.create_store(sample(spark, 5), path, "old")
    store.create_store(sample(spark, 2), path, "one")
    store.append_findings(sample(spark, 2, "U"), path, "two")
    back = store.read_store(spark, path)
    assert back.count() == 4 and {r.properties for r in back.collect()} == {'{"k":0}', '{"k":1}'}
    store.clear_run(spark, path, "one")
    assert {r.type for r in store.read_store(spark, path).collect()} == {"U"}
    store.clear_store(spark, path)
    assert store.read_store(spark, path).count() == 0


def test_batches(spark, tmp_path):
    folder = str(tmp_path / "b")
    store.store_batch(sample(spark, 2), folder)
    store.store_batch(sample(spark, 2), folder)
    (tmp_path / "b" / "part-bad.json").write_text('{"name": \n')
    assert batches.read_batches(spark, folder).count() == 4
    assert len(batches.read_batches(spark, folder).collect()) == 4
    pretty = tmp_path / "p"
    pretty.mkdir()
    (pretty / "x.json").write_text(json.dumps([{"name": "a", "properties": {"k": [1]}}, {"name": "b"}], indent=2))
    (pretty / "y.json").write_text('[{"name": "c"')
    got = {(r.name, r.properties) for r in batches.read_batches(spark, str(pretty), multi_line=True).collect()}
    assert got == {("a", '{"k":[1]}'), ("b", None)}
    assert next(store.iterate(sample(spark, 3)))["matchSet"][0]["name"] == "n0"


def test_queries(spark):
    reporting.register_findings(sample(spark, 3).union(sample(spark, 1, "Other", "s")))
    run = lambda q: [tuple(r) for r in reporting.run_query(spark, q).collect()]
    assert run("SELECT COUNT(*) FROM findings WHERE name LIKE 'N%' AND Type LIKE 't';") == [(3,)]
    assert run("SELECT group_concat(DISTINCT Type) AS t FROM Findings WHERE Type = 'T'") == [("T",)]
    assert run("SELECT RepoName AS \"the repo\", json_extract(Properties, '$.k') k FROM Findings WHERE Type = 'Other'") == [("s", 0)]
    assert sqlite.render(sqlite.parse("SELECT 'a LIKE b' WHERE x like 'y'"), sqlite.Reading()) == "SELECT 'a LIKE b' WHERE x ILIKE 'y'"
    bad = [batches.NamedQuery("q", "SELECT * FROM missing"), batches.NamedQuery("ok", "SELECT 1 AS one")]
    with pytest.raises(ValueError, match="q"):
        reporting.run_queries(spark, bad)
    assert list(reporting.run_sheet_queries(spark, bad)) == ["ok"]
    with pytest.raises(ValueError):
        reporting.run_sheet_queries(spark, [batches.NamedQuery("x", "SELECT nope FROM Findings")])


def _document(target):
    parts = json.load(open(f"{target}/manifest.json"))["parts"]
    return json.loads("".join(open(f"{target}/{p}").read() for p in parts))


def test_a_long_report_keeps_its_order(spark, tmp_path):
    """Thousands of rows in several parts, the first parts without rows."""
    found = spark.range(0, 5000, 1, 7).select(F.col("id").cast("string").alias("name"), *[F.lit(c).alias(c) for c in ("type", "category", "path", "repo_name", "properties")])
    reporting.register_findings(found)
    queries = [
        batches.NamedQuery("sorted \"up\"", "SELECT Name, CAST(Name AS INTEGER) AS n FROM Findings ORDER BY n DESC"),
        batches.NamedQuery("late", "SELECT Name FROM Findings WHERE CAST(Name AS INTEGER) > 4990"),
        batches.NamedQuery("none", "SELECT Name FROM Findings WHERE Name = ''"),
    ]
    target = reporting.write_json_summary(reporting.run_queries(spark, queries), str(tmp_path), "x")
    whole = _document(target)
    assert [r["n"] for r in whole['sorted "up"']] == list(range(4999, -1, -1)) and len(whole["late"]) == 9 and set(whole) == {'sorted "up"', "late"}
    assert reporting.read_json_summary(spark, target, "late", "Name STRING").count() == 9
    empty = reporting.run_queries(spark, queries[2:])
    assert _document(reporting.write_json_summary(empty, str(tmp_path), "y")) == {}


def test_json_summary(spark, tmp_path):
    reporting.register_findings(sample(spark, 25))
    queries = batches.read_queries(
        "queries:\n- {name: all, query: 'SELECT Name, Category FROM Findings'}\n"
        "- {name: one, query: \"SELECT Name, NULL AS x FROM Findings WHERE Name = 'n1'\"}\n"
        "- {name: none, query: \"SELECT * FROM Findings WHERE Name = 'zz'\"}\n"
    )
    results = reporting.run_queries(spark, queries)
    target = reporting.write_json_summary(results, str(tmp_path), "pre")
    assert target == str(tmp_path / "pre_cloud_services_summary.json")
    whole = _document(target)
    assert set(whole) == {"all", "one"} and len(whole["all"]) == 25 and whole["one"] == [{"Name": "n1", "x": None}]
    assert reporting.read_json_summary(spark, target, "all", "Name STRING").count() == 25
    assert reporting.read_json_summary(spark, target, "none", "Name STRING").count() == 0
    assert reporting.write_json_summary({}, str(tmp_path), "x") is None
    assert batches.read_queries("") == []


def test_sheets_and_delivery(spark, tmp_path):
    reporting.register_findings(sample(spark, 2))
    results = reporting.run_sheet_queries(spark, [batches.NamedQuery("s", "SELECT Name FROM Findings"), batches.NamedQuery("e", "SELECT Name FROM Findings WHERE false")])
    target = reporting.write_sheets(results, str(tmp_path), "pre")
    read = lambda name: spark.read.option("header", True).csv(f"{target}/{name}")
    assert read("s").count() == 2 and os.path.isdir(f"{target}/e")
    folder = reporting.deliver(sample(spark, 2).withColumn("category", F.lit("")), str(tmp_path), "id1")
    sent = sorted(r.value for r in spark.read.text(f"{folder}/results").collect())
    assert json.loads(sent[0]) == {"matchSet": [{"name": "n0", "type": "T", "properties": {"k": 0, "path": "x"}, "path": "p0", "repo_name": "r"}]}
    assert len(sent) == 2 and json.load(open(f"{folder}/_COMPLETED")) == {"status": "completed"}


def test_reporters_have_one_signature(spark, tmp_path):
    def counting(findings, queries, out, name):
        reporting.write_text(spark, f"{out}/{name}.txt", f"{findings.count()} {len(queries)}")
        return f"{out}/{name}.txt"

    silent = lambda findings, queries, out, name: None
    queries = [batches.NamedQuery("all", "SELECT Name FROM Findings")]
    built_in = [reporting.json_reporter, reporting.sheet_reporter, reporting.delivery_reporter]
    places = reporting.report(sample(spark, 3), queries, str(tmp_path), "r", [*built_in, counting, silent])
    assert len(places) == 4 and all(os.path.exists(p) for p in places)
    assert open(places[-1]).read() == "3 1" and len(_document(places[0])["all"]) == 3
    with pytest.raises(ValueError, match="bad"):
        reporting.report(sample(spark, 1), [batches.NamedQuery("bad", "SELECT * FROM missing")], str(tmp_path), "x", [reporting.json_reporter])
    assert reporting.report(sample(spark, 1), [], str(tmp_path), "y", [reporting.json_reporter]) == []


def test_small_reports(spark):
    found = sample(spark, 3).union(sample(spark, 1, "T", "s"))
    assert reporting.finding_count(found).first()[0] == 4
    assert {tuple(r) for r in reporting.findings_per_repository(found).collect()} == {("r", 3), ("s", 1)}
    assert {r.key for r in reporting.property_keys(found).collect()} == {"k", "path"}
    total = summarise(found, "Total", F.count("*")).collect()
    assert {(r.repo_name, r.properties) for r in total} == {("r", '{"value":3}'), ("s", '{"value":1}')}


def test_vulnerabilities(spark, tmp_path):
    folder = tmp_path / "repo_name=r1"
    folder.mkdir()
    report = {"Results": [{"Target": "go.mod", "Type": "gomod", "Vulnerabilities": [{"VulnerabilityID": "CVE-1", "PkgName": "p", "Severity": "LOW", "Title": 'a "b"', "InstalledVersion": "1"}, {"VulnerabilityID": "CVE-2"}]}, {"Target": "clean"}]}
    (folder / "r.json").write_text(json.dumps(report, indent=1))
    (folder / "bad.json").write_text("{")
    got = vulnerability_findings(batches.read_vulnerability_reports(spark, str(tmp_path))).orderBy("name").collect()
    assert [r.name for r in got] == ["CVE-1", "CVE-2"] and got[0].repo_name == "r1"
    assert json.loads(got[0].properties) == {"title": 'a "b"', "severity": "LOW", "installed_version": "1", "pkg_name": "p", "target": "go.mod", "result_type": "gomod"}


def test_file_tree(spark, tmp_path):
    for repo, path in [("r1", "a.py"), ("r1", ".github/workflows/ci.yml"), ("r1", "_x/.env"), ("r2", "go.mod")]:
        target = tmp_path / repo / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(b"caf\xc3\xa9 \xff")
    os.symlink(tmp_path / "r1" / "a.py", tmp_path / "r1" / "link.py")
    os.symlink(tmp_path / "gone", tmp_path / "r2" / "dangling")
    tree = filetree.read_repositories(spark, str(tmp_path))
    rows = {(r.repo_name, os.path.relpath(r.path, tmp_path)): r for r in tree.collect()}
    assert set(rows) == {
        ("r1", "r1/a.py"), ("r1", "r1/.github/workflows/ci.yml"), ("r1", "r1/_x/.env"), ("r1", "r1/link.py"),
        ("r2", "r2/go.mod"), ("r2", "r2/dangling"),
    }
    assert rows["r1", "r1/link.py"].content == "café �"
    assert rows["r2", "r2/dangling"].read_error and not rows["r2", "r2/go.mod"].read_error
    only = filetree.read_directory(spark, str(tmp_path / "r1")).where(F.col("path").endswith(".yml"))
    assert [r.repo_name for r in only.collect()] == ["r1"]
    assert {r.repo_name for r in plan.failed_repositories(tree).collect()} == {"r2"}
    with pytest.raises(ValueError, match="no such folder"):
        filetree.read_directory(spark, str(tmp_path / "nope")).count()


def test_repository_urls(spark):
    cases = {
        "git@github.com:o/x.git": ("o/x", None), "https://h/o/x.git": ("x", None), "http://h/x": ("x", None),
        "git@h:1:x": (None, "unexpected repository URL format"), "ssh://h/x": (None, "unsupported repository URL format"),
        "https://h/o/x.git/": ("", None),
    }
    df = spark.createDataFrame([(u,) for u in cases], "clone_url string")
    got = {r.clone_url: (r.repo_name, r.error) for r in inventory.with_repo_names(df).collect()}
    assert got == cases


def test_latest_repositories(spark):
    rows = [("a", "u1", 1, "p1"), ("a", "u2", 3, "p3"), ("a", "u3", 2, "p2"), ("b", "u", 1, "q")]
    df = spark.createDataFrame(rows, "full_name string, clone_url string, batch bigint, payload string")
    assert {(r.full_name, r.payload) for r in inventory.latest_repositories(df).collect()} == {("a", "p3"), ("b", "q")}


def test_path_columns(spark):
    cases = {"": (".", "", "/"), "/": ("/", "", "/"), "a/b.c.d": ("b.c.d", "d", "/a/b.c.d"), "//x/.env": (".env", "env", "//x/.env"), "a.b/": ("a.b", "", "/a.b/")}
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    got = {r.path: (r.base_name, r.ext, r.rooted_path) for r in paths.with_path_columns(df).collect()}
    assert got == cases


def test_sqlite_spellings(spark):
    reporting.register_findings(sample(spark, 25))
    run = lambda q: [tuple(r) for r in reporting.run_query(spark, q).collect()]
    assert run("SELECT group_concat(upper(Name)) AS n FROM Findings WHERE Name = 'n1' -- don't stop\n AND Name LIKE 'N1'") == [("N1",)]
    assert run("SELECT total(length(Name)) AS t FROM Findings WHERE Name = 'no such'") == [(0.0,)]
    assert len(run("SELECT datetime('now') AS d")[0][0]) == 19


def _valued(spark, *values):
    rows = [(f"n{i}", "T" if i % 2 else "U", "c", f"p{i}", "r", v) for i, v in enumerate(values)]
    reporting.register_findings(spark.createDataFrame(rows, "name string, type string, category string, path string, repo_name string, properties string"))
    return lambda q, **k: [tuple(r) for r in reporting.run_query(spark, q, **k).collect()]


def test_json_values_have_types(spark):
    run = _valued(spark, '{"n":10,"f":1.5,"b":true,"m":1,"s":"x","o":{"a":[1,2]},"d":7}', '{"n":9,"f":2,"b":false,"m":"y","s":"10","d":null}', '{"n":9}', "not json", None)
    assert run("SELECT MAX(json_extract(Properties, '$.n')) AS n, MIN(json_extract(Properties, '$.f')) FROM Findings") == [(10, 1.5)]
    assert run("SELECT SUM(json_extract(Properties, '$.b')), MAX(json_extract(Properties, '$.m')), MAX(json_extract(Properties, '$.s')) FROM Findings") == [(1, "y", "x")]
    assert run("SELECT json_extract(f.Properties, '$.o.a[1]') + 1 AS x, json_extract(f.Properties, '$.o') FROM Findings f WHERE json_extract(f.Properties, '$.n') > 9") == [(3, '{"a":[1,2]}')]
    assert run("SELECT COUNT(*) FROM Findings WHERE json_extract(Properties, '$.d') IS NULL AND json_extract(Properties, '$.none') IS NULL") == [(4,)]
    assert run("SELECT Name FROM Findings WHERE json_extract(Properties, '$.n') = 9 ORDER BY json_extract(Properties, '$.n'), id DESC") == [("n2",), ("n1",)]
    assert run("SELECT MAX(json_extract(Properties, '$.n')) FROM Findings", json_types={"$.n": "STRING"}) == [("9",)]
    assert run("SELECT json_extract(Properties, '$.n') / 4 AS a, json_extract(Properties, '$.f') / 4 AS b FROM Findings WHERE Name = 'n0'") == [(2, 0.375)]


def test_integers_divide_to_integers(spark):
    run = _valued(spark, "{}", "{}", "{}")
    assert run("SELECT COUNT(*)/2 AS a, COUNT(*) / 2.0 AS b, -7/2 AS c, 7 / 2 / 2 AS d, 1/0 AS e FROM Findings") == [(1, 1.5, -3, 1, None)]
    assert run("SELECT (COUNT(*) + 0.5) / (3 / 2) AS a, 10 / (7 / 2.0) AS b, 100 * COUNT(*) / 7 AS c, AVG(id) / 2 > 0 FROM Findings") == [(3.5, 10 / 3.5, 42, True)]
    assert run("SELECT CAST(7 AS REAL) / 2 AS a, CAST('7' AS INTEGER) / 2 AS b, '1/2' AS c /* 1/2 */, 5 % 3 -- 4/2\n") == [(3.5, 3, "1/2", 2)]
    assert run("SELECT length(Name) / 2 AS half, COUNT(*) FROM Findings GROUP BY length(Name) / 2") == [(1, 3)]


def test_double_quotes_are_columns_or_strings(spark):
    run = _valued(spark, "{}", "{}")
    assert run('SELECT "Name" FROM Findings WHERE Type = "T"') == [("n1",)]
    assert run('SELECT COUNT(*) AS "how many" FROM Findings WHERE Type IN ("T", "U", "it\'s") ORDER BY "how many"') == [(2,)]
    assert run(r'''SELECT "a\b" AS x, 'it''s \n' AS y, "say ""x""" AS z FROM Findings LIMIT 1''') == [("a\\b", "it's \\n", 'say "x"')]
    with pytest.raises(Exception, match="nope"):
        run("SELECT nope FROM Findings")


def test_dates_are_texts(spark):
    run = _valued(spark, "{}")
    assert run("SELECT datetime('2024-01-01') AS a, date('2024-02-28 10:11:12', '+2 days') AS b, time('2024-01-01 10:11:12') AS c") == [("2024-01-01 00:00:00", "2024-03-01", "10:11:12")]
    assert run("SELECT strftime('%Y/%m week %d%%', '2024-01-05') AS a, datetime('nothing') AS b, datetime('2024-03-31', '-1 month') AS c") == [("2024/01 week 05%", None, "2024-02-29 00:00:00")]
    assert run("SELECT date('now') = date(), date('now', '-1 day') < date('now'), iif(1 < 2, 'a', 'b')") == [(True, True, "a")]


def test_ids_are_dense_and_go_on(spark, tmp_path):
    path = str(tmp_path / "s")
    store.create_store(sample(spark, 40).repartition(7), path, "one")
    store.append_findings(sample(spark, 31, "U").repartition(5), path, "two")
    store.append_findings(sample(spark, 0, "V"), path, "none")
    store.append_findings(sample(spark, 9, "W").repartition(3), path, "three")
    back = store.read_store(spark, path)
    assert sorted(r.id for r in back.collect()) == list(range(1, 81))
    assert {(r.run_id, r.lo, r.hi) for r in back.groupBy("run_id").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).collect()} == {("one", 1, 40), ("two", 41, 71), ("three", 72, 80)}
    reporting.register_findings(back)
    assert [tuple(r) for r in reporting.run_query(spark, "SELECT MAX(id), COUNT(*), COUNT(DISTINCT id) FROM Findings").collect()] == [(80, 80, 80)]
    store.clear_run(spark, path, "three")
    store.append_findings(sample(spark, 2), path, "four")
    assert store.last_id(spark, path) == 73
    store.create_store(sample(spark, 3), path, "anew")
    assert sorted(r.id for r in store.read_store(spark, path).collect()) == [1, 2, 3]


def test_a_failing_redelivery_leaves_no_marker(spark, tmp_path):
    found = sample(spark, 3)
    folder = reporting.deliver(found, str(tmp_path), "r")
    assert os.path.exists(f"{folder}/_COMPLETED")
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="broken"):
        reporting.deliver(found.withColumn("name", F.raise_error(F.lit("broken")).cast("string")), str(tmp_path), "r")
    assert not os.path.exists(f"{folder}/_COMPLETED")


def test_empty_types_survive_the_store(spark, tmp_path):
    from pyspark.sql import functions as F

    store.create_store(sample(spark, 4).withColumn("type", F.lit("")), str(tmp_path / "s"), "run")
    assert {r.type for r in store.read_store(spark, str(tmp_path / "s")).collect()} == {""}


def test_repeated_keys_take_the_last_value(spark):
    from repocensus.functions.props import flatten
    from pyspark.sql import functions as F

    df = spark.createDataFrame([('{"x":{"y":1},"x":2,"z":"a"}',)], "p string")
    assert df.select(flatten(F.col("p")).alias("p")).first().p == '{"x":2,"z":"a"}'


def test_report_files_take_little_disk(spark, sf, tmp_path):
    """Reports are compressed and not shuffled; what is read back are the rows of every repository but the unreadable ones."""
    rows = tb.write_reports(spark, sf, str(tmp_path / "reports"))
    files = list((tmp_path / "reports").glob("repo_name=*/report.json.gz"))
    assert rows == spark.read.parquet(f"{sf}/lineitem.parquet").count() and sum(f.stat().st_size for f in files) < 100 * rows
    got = vulnerability_findings(batches.read_vulnerability_reports(spark, str(tmp_path / "reports")))
    want = vulnerability_findings(tb.vulnerability_reports(spark, sf)).where("NOT endswith(repo_name, '0')")
    assert got.count() and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    every = batches.read_vulnerability_reports(spark, str(tmp_path / "reports"), keep_unreadable=True)
    bad = [r.repo_name for r in every.collect() if r["_corrupt_record"] is not None]
    assert sorted(bad) == sorted(f.parent.name.removeprefix("repo_name=") for f in files if f.parent.name.endswith("0")) != []
