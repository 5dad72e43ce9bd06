import json

import pytest
from pyspark.sql import functions as F

from repocensus.functions import blocks, configs
from repocensus.operators import docker, iac
from repocensus.operators.extractor import extract, extract_errors, finding


def rows(files, extractor, path, content):
    found = extract(files({path: content}), extractor).collect()
    return sorted(((r.name, json.loads(r.properties)) for r in found), key=str)


def errors(files, extractor, path, content):
    return extract_errors(files({path: content}), extractor).count()


DOCKERFILE = """
FROM registry-less/tool:3 AS build
# a comment between
COPY . /src
RUN make \\
    # in the middle
    all
label tier="front # not a tag"

FROM alpine
EXPOSE 9000/udp
MAINTAINER Team Seven
CMD ["serve"]
"""


def test_dockerfile(files):
    assert rows(files, docker.dockerfile(), "Dockerfile", DOCKERFILE) == sorted(
        [
            ("FROM", {"alias": "build", "image": "tool", "owner": "registry-less", "version": "3"}),
            ("LABEL", {"arguments": 'tier="front'}),
            ("FROM", {"image": "alpine", "owner": "", "version": ""}),
            ("EXPOSE", {"arguments": "9000/udp"}),
            ("MAINTAINER", {"arguments": "Team Seven"}),
        ],
        key=str,
    )


def test_a_repeated_key_in_a_template_fails_nothing(files):
    text = '{"Resources":{"B":{"Type":"AWS::S3::Bucket","Properties":{"x":1,"x":2}}}}'
    assert [(n, p["x"]) for n, p in rows(files, iac.cloudformation(), "template.json", text)] == [("B", 2)]


@pytest.mark.parametrize(
    "reference, expected",
    [
        ("a/b:1 AS  stage ", {"owner": "a", "image": "b", "version": "1", "alias": "stage"}),
        ("b", {"owner": "", "image": "b", "version": ""}),
        ("b:1:2", {"owner": "", "image": "b", "version": "1:2"}),
        ("r.io/a/b:1", {"owner": "", "image": "", "version": ""}),
        ("b:1 as x", {"owner": "", "image": "b", "version": "1 as x"}),
        ("--platform=linux/amd64 b", {"owner": "--platform=linux", "image": "amd64 b", "version": ""}),
    ],
)
def test_image_references(files, reference, expected):
    assert rows(files, docker.dockerfile(), "x/Dockerfile.dev", f"FROM {reference}\n") == [("FROM", expected)]


def test_dockerfile_continuations_and_errors(files):
    e = docker.dockerfile()
    assert rows(files, e, "Dockerfile", "LABEL a=1 \\\n\n  b=2 \\\\\n c=3") == [("LABEL", {"arguments": "a=1  b=2  c=3"})]
    assert rows(files, e, "Dockerfile", "EXPOSE 1 \\") == [("EXPOSE", {"arguments": "1"})]
    assert errors(files, e, "Dockerfile", "FROM a\n\\\n") == 1
    assert rows(files, e, "Dockerfile", "FROM a\n\\\n") == []
    assert errors(files, e, "Dockerfile", "FROM a\n# " + "x" * 70000 + "\n") == 0
    assert errors(files, e, "Dockerfile", "FROM a\n# " + "x" * 60000 + "\n") == 0
    assert errors(files, e, "Dockerfile", "\n# only a comment\n") == 0
    assert rows(files, e, "Dockerfile", "FROMAGE x\nFROM\n") == [("FROM", {"owner": "", "image": "", "version": ""})]


def test_dockerfile_routing(files):
    names = ["Dockerfile", "p/Dockerfile", "Dockerfile.", "Dockerfile.dev", "dockerfile", "Dockerfile_x", "NotADockerfile"]
    found = extract(files({n: "FROM x" for n in names}), docker.dockerfile()).collect()
    assert sorted(r.path for r in found) == sorted(names[:4])


def test_compose(files):
    e = iac.compose()
    text = "services:\n  web: {image: 'nginx:latest'}\n  db:\n    image: postgres:14\n  built:\n  odd:\n    image: 5\n"
    assert rows(files, e, "A/Docker-Compose.YML", text) == [
        ("built", {"image": ""}), ("db", {"image": "postgres:14"}), ("odd", {"image": "5"}), ("web", {"image": "nginx:latest"}),
    ]
    assert errors(files, e, "compose.yml", "services: [a]\n") == 1
    assert errors(files, e, "compose.yml", "services:\n\t- bad") == 1
    assert errors(files, e, "compose.yml", "a: 1\na: 2\n") == 1
    assert errors(files, e, "compose.yml", "") == 0
    assert rows(files, e, "other.yml", text) == []


def test_cloudformation(files):
    e = iac.cloudformation()
    text = """
AWSTemplateFormatVersion: 2010-09-09
Resources:
  B:
    Type: AWS::S3::Bucket
    Properties: {Name: !Sub "${A}-b", Tags: [{Key: k, Value: 1.50}], Version: 2012-10-17, On: yes}
  F: {Type: AWS::Lambda::Function, Properties: {resource_type: own}}
  N: {Type: X}
"""
    assert rows(files, e, "a/mytemplate.yml", text) == sorted(
        [
            ("B", {"resource_type": "AWS::S3::Bucket", "Name": "${A}-b", "Tags": [{"Key": "k", "Value": 1.5}],
                   "Version": "2012-10-17T00:00:00Z", "On": "yes"}),
            ("F", {"resource_type": "own"}),
            ("N", {"resource_type": "X"}),
        ],
        key=str,
    )
    as_json = '{"Resources": {\t"B": {"Type": "T", "Properties": {"n": 1}}}}'
    assert rows(files, e, "Template.JSON", as_json) == [("B", {"resource_type": "T", "n": 1})]
    assert rows(files, e, "template.yaml", "a: b") == []
    assert errors(files, e, "template.yaml", "a: b") == 0
    assert errors(files, e, "template.yaml", "a: [") == 1
    assert errors(files, e, "template.yaml", "Resources: [1]") == 1


def test_deployment_manager(files):
    e = iac.deployment_manager()
    text = "resources:\n- name: vm\n  type: t\n  properties: {zone: z, n: {a: 1}}\n- type: u\n"
    assert rows(files, e, "x/prod-deployment.yaml", text) == sorted(
        [
            ("vm", {"resource_type": "t", "properties": {"zone": "z", "n": {"a": 1}}}),
            ("", {"resource_type": "u", "properties": None}),
        ],
        key=str,
    )
    assert rows(files, e, "main.jinja", "resources: {{") == []
    assert rows(files, e, "k8s/deployment.yml", "kind: Deployment") == []


TF = r'''
/* block
   comment } */
module "m" {
  source = "./x"   # trailing
  nested { a = 1 }
  list = [1, 2.5, "a\n", { k = true, "q" : null }, ]
}
module "empty" {}
resource "aws_s3_bucket" "b" {
  bucket = "my-${var.env}-b"
  vendor = "mine"
  count  = 1e3
  doc = <<-EOT
    hello
      there
  EOT
  tags = {
    Name = "x"
  }
}
resource "azurerm_group" "g" { location = var.x["}"] }
resource "google_bucket" "g" {
  name = "n"
  rule {
    deep { deeper { x = [ { y = 1 } ] } }
  }
}
resource "other_x" "y" { a = 1 }
locals { z = 1 }
'''


def test_terraform(files):
    assert rows(files, iac.terraform(), "m/main.tf", TF) == sorted(
        [
            ("TF Module", {"source": "./x"}),
            ("AWS Resource", {"resource_type": "aws_s3_bucket", "vendor": "mine", "bucket": '"my-${var.env}-b"',
                              "count": 1000, "doc": "hello\n  there\n", "tags": {"Name": "x"}}),
            ("Azure Resource", {"resource_type": "azurerm_group", "vendor": "Azure", "location": 'var.x["}"]'}),
            ("GCP Resource", {"resource_type": "google_bucket", "vendor": "GCP", "attributes": {"name": "n"}}),
        ],
        key=str,
    )
    assert rows(files, iac.terraform(), "main.TF", TF) == []


def test_own_block_rule(files):
    rule = lambda b: F.when(b["type"] == "provider", finding(F.get(b["labels"], F.lit(0)), "TF Provider", "", None))
    found = extract(files({"a.tf": 'provider "aws" {\n}\nmodule "m" { source = "s" }\n'}), iac.terraform([rule])).collect()
    assert sorted((r.type, r.name) for r in found) == [("TF Module Use", "TF Module"), ("TF Provider", "aws")]


@pytest.mark.parametrize(
    "text",
    [
        'module "m" {\n source = "a"\n',
        'module "m" {\n a = "x\n}\n',
        "stray words here\n",
        "x {\n a = 1\n a = 2\n}\n",
        "x {\n a = (1\n}\n",
        "x {\n a = [1}]\n}\n",
        "x {\n a =\n}\n",
        "x {\n}\n}\n",
        "x { a = 1 } y { b = 2 }\n",
        "x {\n nested { what is this }\n}\n",
        "x {\n a = <<EOT\n no end\n}\n",
        'x {\n a = "${y"\n}\n',
        "x {} /* open",
    ],
)
def test_terraform_syntax_errors_are_silent(files, text):
    good = 'module "m" { source = "s" }\n'
    assert rows(files, iac.terraform(), "main.tf", good) == [("TF Module", {"source": "s"})]
    assert rows(files, iac.terraform(), "main.tf", good + text) == []


def _blocks(spark, text):
    table = spark.createDataFrame([(text,)], "text string")
    for stage in blocks.block_stages(F.col("text"), "b"):
        table = table.withColumns(stage)
    found = table.select("b_blocks").first().b_blocks
    return found and [(b.type, b.labels, {k: json.loads(v) for k, v in b.attributes.items()}) for b in found]


def test_hcl_literals(spark):
    text = r"""b "l" x {
 a = [1,
 2 # c
 ]
 s = "q\"${x("}")}"
 e = "A$${v}%%{w}\U0001F600\t\\"
 n = null
 t = a ? 1 : 2
 f = -1.5
 g = 1.0
 h = 007
 i = 1e3
 j = 99999999999999999999
 k = { "a b" = 1, c : [true, false] /* x */
   d = {}, true = "//no comment", 5 = "#" }
 l = [1 2]
 m = ["${x}"]
 o = [
   "y", // first

   "z"
 ]
 p = "bad \q"
 q = [<<EOT
one # two
EOT
 , "last"]
}
"""
    ((kind, labels, attributes),) = _blocks(spark, text)
    assert (kind, labels) == ("b", ["l", "x"])
    assert attributes == {
        "a": [1, 2], "s": '"q\\"${x("}")}"', "e": "A${v}%{w}\U0001f600\t\\", "n": None, "t": "a ? 1 : 2", "f": -1.5, "g": 1, "h": 7,
        "i": 1000, "j": 1e20, "k": {"a b": 1, "c": [True, False], "d": {}, "true": "//no comment", "5": "#"}, "l": "[1 2]",
        "m": '["${x}"]', "o": ["y", "z"], "p": '"bad \\q"', "q": ["one # two\n", "last"],
    }


@pytest.mark.parametrize(
    "source, value",
    [
        ('"${a["${b["${c["}"]}"]}"]}"', '"${a["${b["${c["}"]}"]}"]}"'),
        ('"%{ if x }{%{ else }}%{ endif }"', '"%{ if x }{%{ else }}%{ endif }"'),
        ("<<-EOT\n    a\n\n      b\n    EOT", "a\n\n  b\n"),
        ("<<EOT\n $${x} {\n EOTX\nEOT", " ${x} {\n EOTX\n"),
        ("<<EOT\n${x} \"\n  EOT", "<<EOT\n${x} \"\n  EOT"),
        ("f(<<A\n }\nA\n, 2)", "f(<<A\n }\nA\n, 2)"),
        ('"a" /* " { */ # }', "a"),
        ("{\n for k, v in m : k => v # {\n }", "{\n for k, v in m : k => v # {\n }"),
        ('"\\\\"', "\\"),
        ('"# // /* "', "# // /* "),
        ("x == y", "x == y"),
        ("[]", []),
        ("{ a = { b = [ { c = 1 } ] } }", {"a": {"b": [{"c": 1}]}}),
    ],
)
def test_hcl_values(spark, source, value):
    for text in (f"b {{\n  a = {source}\n  z = 1\n}}\n", f"b {{\n  a = {source}\n}}", f"# {{\n\nb {{ # x\n  a = {source}\r\n}}\r\n/* }} */"):
        ((_, _, attributes),) = _blocks(spark, text)
        assert attributes["a"] == value


def test_terraform_plan_has_no_python(files, capsys):
    extract(files({"a.tf": TF}), iac.terraform()).explain("formatted")
    plan = capsys.readouterr().out
    assert "Generate" in plan and not any(node in plan for node in ("EvalPython", "PythonUDF", "InArrow", "InPandas"))


def test_long_terraform_files_are_linear(files):
    """Thousands of blocks and one block of thousands of attributes."""
    many = "".join(f'resource "aws_x" "r{i}" {{\n  a = "{i}"\n}}\n' for i in range(3000))
    wide = 'resource "google_y" "w" {\n' + "".join(f"  k{i} = {i}\n" for i in range(3000)) + "}\n"
    found = rows(files, iac.terraform(), "a.tf", many + wide)
    assert len(found) == 3001
    assert sorted(len(p.get("attributes", {})) for _, p in found)[-1] == 3000


@pytest.mark.parametrize(
    "text, expected",
    [
        ("a: 0x1f\nb: 017\nc: 1_000\nd: 1:30\ne: on\nf: ~\ng: .5", {"a": 31, "b": 15, "c": 1000, "d": "1:30", "e": "on", "f": None, "g": 0.5}),
        ("x: &a {k: 1}\ny: {<<: *a, z: 2}", {"x": {"k": 1}, "y": {"k": 1, "z": 2}}),
        ("1: a\ntrue: b", {"1": "a", "true": "b"}),
        ("t: 2001-12-14T21:59:43Z", {"t": "2001-12-14T21:59:43Z"}),
        ("a: !GetAtt x.y\nb: !If [c, 1]\nc: !T {d: e}", {"a": "x.y", "b": ["c", 1], "c": {"d": "e"}}),
    ],
)
def test_yaml_values(text, expected):
    assert json.loads(configs._load_yaml(text)) == expected


def test_aliases_of_aliases_are_an_error(files):
    """A short text that expands to billions of values ends as that file's error; plain aliases are read."""
    bomb = "a0: &a0 [x]\n" + "".join(f"a{i}: &a{i} [" + ", ".join([f"*a{i - 1}"] * 10) + "]\n" for i in range(1, 12)) + "services: {w: {image: i}}\n"
    assert rows(files, iac.compose(), "compose.yml", bomb) == [] and errors(files, iac.compose(), "compose.yml", bomb) == 1
    plain = "x: &x {image: i}\nservices: {a: *x, b: *x}\n"
    assert rows(files, iac.compose(), "compose.yml", plain) == [("a", {"image": "i"}), ("b", {"image": "i"})]


def test_one_python_column_for_all_configuration_files(files):
    from repocensus.plans import scan

    table = files([("r", "compose.yml", "services: {w: {image: i}}"), ("r", "pyproject.toml", '[tool.poetry.dependencies]\na = "1"'), ("r", "template.yaml", "a: ["), ("r", "x.txt", "a: [")])
    plan = scan.scan(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    records = scan.scan_records(table)
    assert {(r.type, r.name) for r in scan.findings_of(records).collect()} >= {("Docker Compose Service", "w"), ("Library", "a")}
    assert [(r.path, r.extractor) for r in scan.errors_of(records).collect()] == [("template.yaml", "cloudformation")]
    one = extract(table, iac.compose())._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(one) if "ArrowEvalPython" in line)
    assert any("Filter" in line and "base_name" not in line for line in one[at + 1 :])
