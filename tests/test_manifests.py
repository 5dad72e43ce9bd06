import json

import pytest
from pyspark.sql import functions as F

from repocensus.operators import manifests as m
from repocensus.operators.extractor import extract, extract_errors


def versions(df):
    return sorted((r.name, json.loads(r.properties)["Version"]) for r in df.collect())


def run(files, extractor, path, content):
    frame = files({path: content})
    return versions(extract(frame, extractor)), extract_errors(frame, extractor).count()


POM = """<?xml version="1.0"?>
<project xmlns="http://maven.apache.org/POM/4.0.0">
  <dependencies>
    <dependency><groupId>org.a</groupId><artifactId>core</artifactId><version>5.3</version></dependency>
    <dependency><groupId>org.b</groupId><artifactId>x</artifactId><version>${v}</version></dependency>
    <dependency><groupId>org.c</groupId><artifactId>y</artifactId></dependency>
  </dependencies>
  <build><plugins><plugin><groupId>p</groupId><dependencies><dependency><groupId>no</groupId></dependency></dependencies></plugin></plugins></build>
</project>"""


@pytest.mark.parametrize(
    "content, expected, errors",
    [
        (POM, [("org.a:core", "5.3"), ("org.b:x", "${v}"), ("org.c:y", "")], 0),
        ("<project></project>", [], 0),
        ("<!-- lead --><project/>", [], 0),
        ("<project><dependencies></project>", [], 1),
        ("<other><dependencies/></other>", [], 1),
        ("", [], 1),
        (
            "<project><dependencies><dependency><groupId> a </groupId></dependency></dependencies>"
            "<dependencies><dependency><artifactId>b</artifactId></dependency></dependencies></project>",
            [(" a :", ""), (":b", "")],
            0,
        ),
    ],
)
def test_maven(files, content, expected, errors):
    assert run(files, m.maven(), "a/pom.xml", content) == (expected, errors)


@pytest.mark.parametrize(
    "content, expected",
    [
        ("module m\n\nrequire (\n\tg.com/a v1.0\n\tg.com/b v2.0 // indirect\n)\n", [("g.com/a", "v1.0"), ("g.com/b", "v2.0")]),
        ("require g.com/a v1\r\n  require   g.com/b \t v2 // x\n", [("g.com/a", "v1"), ("g.com/b", "v2")]),
        ("require (\n// a comment\nsingle\n)\nexclude g.com/x v1\n", [("//", "a")]),
        ("require (\ng.com/a v1\n", [("g.com/a", "v1")]),
        ("require (\nrequire (x y\ng.com/a v1\n) trailing\ng.com/c v3\nrequire (\n g.com/b v2\n)", [("g.com/a", "v1"), ("g.com/b", "v2")]),
        ("require (\n g.com/a\u00a0v1 \n)", [("g.com/a", "v1")]),
        ("require g.com/lonely", []),
        ("requires x y\nmodule z", []),
        ("", []),
    ],
)
def test_go_modules(files, content, expected):
    assert run(files, m.go_modules(), "go.mod", content) == (expected, 0)


@pytest.mark.parametrize(
    "content, expected, errors",
    [
        ('{"dependencies": {"a": "1", "b": "2"}, "devDependencies": {"b": "3", "c": "4"}}', [("a", "1"), ("b", "3"), ("c", "4")], 0),
        ('{"name": "x"}', [], 0),
        ('{"dependencies": null, "devDependencies": {}}', [], 0),
        ('{"dependencies": {"a": "1", "a": "2"}}', [("a", "2")], 0),
        ('{"dependencies": {"q\\"uote": "\\u003e1"}}', [('q"uote', ">1")], 0),
        ('{"dependencies": {"a": null}}', [("a", "")], 0),
        ('{"dependencies": {"a": 1}}', [], 1),
        ('{"devDependencies": {"a": {"v": "1"}}}', [], 1),
        ('{"dependencies": ["a"]}', [], 1),
        ('{"dependencies": {"a": "1"', [], 1),
        ("[]", [], 1),
        ("", [], 1),
    ],
)
def test_npm(files, content, expected, errors):
    assert run(files, m.npm(), "web/package.json", content) == (expected, errors)


def test_pip(files):
    content = "numpy\n\n# no\nflask==2.0\r\n a >= 1 \nx>=1,==2\nb~=1\nc<2\nd>3\ne<=4\nf!=1\n-r other.txt\ng[extra]==1 ; python_version > '3'"
    expected = sorted(
        [
            ("numpy", "N/A"), ("flask", "==2.0"), ("a", ">=1"), ("x>=1,", "==2"), ("b", "~=1"),
            ("c", "<2"), ("d", ">3"), ("e", "<=4"), ("f!=1", "N/A"), ("-r other.txt", "N/A"),
            ("g[extra]", "==1 ; python_version > '3'"),
        ]
    )
    assert run(files, m.pip(), "requirements.txt", content) == (expected, 0)
    assert run(files, m.pip(), "requirements.txt", "") == ([], 0)


@pytest.mark.parametrize(
    "content, expected, errors",
    [
        (
            '[tool.poetry.dependencies]\npython = "^3.8"\na = "1"\nt = {version = "2"}\nn = 3\n'
            '[tool.poetry.dev-dependencies]\na = "9"\nb = "2"\n',
            [("a", "9"), ("b", "2"), ("python", "^3.8")],
            0,
        ),
        ('[project]\ndependencies = ["x"]\n', [], 0),
        ('[tool.poetry.dependencies]\nd = 2020-01-01\n', [], 0),
        ("[tool.poetry\n", [], 1),
    ],
)
def test_poetry(files, content, expected, errors):
    assert run(files, m.poetry(), "pyproject.toml", content) == (expected, errors)


@pytest.mark.parametrize(
    "body, expected",
    [
        ('<ItemGroup><PackageReference Include="A" Version="1" /></ItemGroup><ItemGroup><PackageReference Include="B" /></ItemGroup>', [("A", "1"), ("B", "N/A")]),
        ('<ItemGroup><PackageReference Include="A"><Version>2</Version></PackageReference></ItemGroup>', [("A", "N/A")]),
        ('<ItemGroup><Reference Include="L, Version=2.0.0.0, Culture=neutral" Version="1.0" /></ItemGroup>', [("L", "2.0.0.0")]),
        ('<ItemGroup><Reference Include="L, Culture=x" Version="1.0" /></ItemGroup>', [("L", "1.0")]),
        ('<ItemGroup><Reference Include=", Version=1.0" /></ItemGroup>', [("", "1.0")]),
        ('<ItemGroup><Reference Include="L , Version=1 , Version=2" /></ItemGroup>', [("L", "1")]),
        ('<ItemGroup><Reference Include="" /><Reference /><PackageReference Version="1" /></ItemGroup>', []),
        ("<PropertyGroup/>", []),
    ],
)
def test_csproj(files, body, expected):
    assert run(files, m.csproj(), "x/App.csproj", f"<Project>{body}</Project>") == (expected, 0)


def test_csproj_errors(files):
    assert run(files, m.csproj(), "A.csproj", "<Project><ItemGroup>") == ([], 1)
    assert run(files, m.csproj(), "A.csproj", "<Other/>") == ([], 1)


def test_routing(files):
    paths = [
        "pom.xml", "a/b/go.mod", "build.gradle", "x/vendor/go.mod", "node_modules/a/package.json",
        ".github/requirements.txt", "Go.mod", "xgo.mod", "go.mod/readme", "p/.csproj", "pom.xml/",
    ]
    frame = files({p: "" for p in paths})
    from repocensus.operators.extractor import apply_stages

    extractors = m.library_extractors()
    flags = apply_stages(frame, [m.Extractor(e.name, e.route, e.findings, reads_content=False) for e in extractors])
    routed = {
        r.path: [e.name for e in extractors if r[e.routed_flag]]
        for r in flags.select("path", *[e.routed_flag for e in extractors]).collect()
    }
    assert routed == {
        "pom.xml": ["maven"], "a/b/go.mod": ["go_modules"], "build.gradle": ["gradle"],
        "x/vendor/go.mod": [], "node_modules/a/package.json": [], ".github/requirements.txt": [],
        "Go.mod": [], "xgo.mod": [], "go.mod/readme": [], "p/.csproj": ["csproj"], "pom.xml/": ["maven"],
    }


def test_gradle_is_an_error_only(files):
    assert run(files, m.gradle(), "build.gradle", "x") == ([], 1)


def test_repeated_files_are_kept(files):
    frame = files([("r", "go.mod", "require a v1")] * 3)
    assert extract(frame, m.go_modules()).count() == 3


def test_finding_shape(files):
    row = extract(files({"go.mod": 'require a"b v1'}), m.go_modules()).first()
    assert row.asDict() == {
        "name": 'a"b', "type": "Library", "category": "", "path": "go.mod", "repo_name": "repo",
        "properties": '{"Language":"Go","Version":"v1"}',
    }


def test_assembly_parts(spark):
    df = spark.createDataFrame([("A.B ,Culture=x,Version= 3 ",)], "i string")
    assert tuple(df.select(m.assembly_parts(F.col("i")).alias("p")).first().p) == ("A.B", "3")
