"""Input tables of the engine derived row by row from the TPC-H-like test tables.

The test tables hold no repositories, so every row of a base table becomes one small file
(or history record) of an imagined repository.  One row gives one file: nothing is grouped
or sampled, and the corpus grows with the tables.
"""

from __future__ import annotations

import gzip
import itertools
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repocensus.schemas import FILES, FINDING_COLUMNS
from repocensus.session import shared_dir
from repocensus.sources.catalogue import Catalogue, Pattern


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(df: DataFrame, repo: str, path: str, content: str) -> DataFrame:
    return spread(df).select(
        F.expr(repo).alias("repo_name"),
        F.expr(path).alias("path"),
        F.expr(content).alias("content"),
        F.lit(None).cast("string").alias("read_error"),
    )


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when a test table arrives as a single row group; large tables stay as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_LINE_REPO = "concat('repo_', l_suppkey)"
_LINE_DIR = "concat('o', l_orderkey, '/l', l_linenumber, '/')"
_ORDER_REPO = "concat('repo_', o_custkey)"
_ORDER_DIR = "concat('o', o_orderkey, '/')"

OPERATOR = (
    "CASE l_linenumber % 7 WHEN 0 THEN '==' WHEN 1 THEN '>=' WHEN 2 THEN '<=' WHEN 3 THEN '~=' "
    "WHEN 4 THEN '>' WHEN 5 THEN '<' ELSE '' END"
)
QTY = "CAST(l_quantity AS INT)"


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh line number lives below a vendor folder and must be ignored."""
    return _files(
        table(spark, sf_dir, "lineitem"),
        _LINE_REPO,
        f"concat({_LINE_DIR}, CASE WHEN l_linenumber = 7 THEN 'vendor/' ELSE '' END, 'requirements.txt')",
        f"""concat('# order ', l_orderkey, '\\n\\n',
            'part-', l_partkey, CASE WHEN {OPERATOR} = '' THEN '' ELSE concat({OPERATOR}, {QTY}) END, '\\n',
            'supp-', l_suppkey, ' >= ', l_linenumber, '  \\r\\n',
            '\\t plain-', l_partkey, '\\n',
            'a', l_suppkey, '>=1,==2\\n',
            CASE WHEN l_linenumber = 3 THEN 'django==4.2\\n' ELSE '' END)""",
    )


def go_mods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(
        table(spark, sf_dir, "lineitem"),
        _LINE_REPO,
        f"concat({_LINE_DIR}, 'go.mod')",
        f"""concat('module example.com/o', l_orderkey, '\\n\\ngo 1.21\\n\\n',
            'require example.com/single', l_partkey, ' v', l_linenumber, '.0.0\\n\\n',
            'require (\\n\\texample.com/p', l_partkey, ' v1.', {QTY}, '.0\\n',
            '\\texample.com/s', l_suppkey, ' v0.', l_linenumber, '.0 // indirect\\n',
            '\\t// note here\\n\\tlonely\\n)\\n\\n',
            'exclude example.com/x v1.0.0\\n\\n',
            'replace (\\n\\texample.com/y => ../y\\n)\\n\\n',
            CASE WHEN l_linenumber = 2 THEN 'require (\\n  github.com/gin-gonic/gin v1.9.1\\n)\\n' ELSE '' END)""",
    )


def dockerfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line number 5 has an empty instruction: the whole file is in error."""
    return _files(
        table(spark, sf_dir, "lineitem"),
        _LINE_REPO,
        f"concat({_LINE_DIR}, CASE WHEN l_linenumber = 6 THEN 'Dockerfile.dev' ELSE 'Dockerfile' END)",
        f"""concat('# build of order ', l_orderkey, '\\n',
            'FROM acme/part-', l_partkey, ':', {QTY}, ' AS stage', l_linenumber, '\\n',
            'RUN apt-get update && \\\\\\n    apt-get install -y curl # tools\\n\\n',
            'from supp-', l_suppkey, '\\n',
            'FROM registry.example.com/acme/base:1\\n',
            'LABEL order="', l_orderkey, '" \\\\\\n      line="', l_linenumber, '"\\n',
            'EXPOSE ', 8000 + l_linenumber, ' # port\\n',
            CASE WHEN l_linenumber = 5 THEN '\\\\\\n' ELSE '' END)""",
    )


def package_jsons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys divisible by 11 have a number as version, those by 13 are cut short."""
    return _files(
        table(spark, sf_dir, "orders"),
        _ORDER_REPO,
        f"concat({_ORDER_DIR}, 'package.json')",
        """concat('{\\n  "name": "o', o_orderkey, '",\\n  "dependencies": {"cust-', o_custkey, '": "^',
            o_orderkey % 10, '", "shared": "1"',
            CASE WHEN o_orderkey % 3 = 0 THEN ', "express": "4.18.2"' ELSE '' END,
            CASE WHEN o_orderkey % 11 = 0 THEN ', "bad": 1' ELSE '' END,
            '},\\n  "devDependencies": {"dev-', o_custkey, '": "~', o_orderkey % 7, '", "shared": "',
            o_orderkey % 5, '"}',
            CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE '\\n}\\n' END)""",
    )


def poms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys divisible by 17 are not well formed."""
    return _files(
        table(spark, sf_dir, "orders"),
        _ORDER_REPO,
        f"concat({_ORDER_DIR}, 'pom.xml')",
        """concat('<?xml version="1.0"?>\\n<!-- build -->\\n<project xmlns="http://maven.apache.org/POM/4.0.0">\\n',
            '<dependencyManagement><dependencies><dependency><groupId>no</groupId></dependency></dependencies></dependencyManagement>',
            '<dependencies>\\n<dependency><groupId>org.cust', o_custkey, '</groupId><artifactId>a', o_orderkey % 9,
            '</artifactId><version>', o_orderkey % 4, '.', o_orderkey % 10, '0</version></dependency>\\n',
            '<dependency><groupId>org.shared</groupId><artifactId>b</artifactId></dependency>\\n</dependencies>',
            CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE '</project>\\n' END)""",
    )


def csprojs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(
        table(spark, sf_dir, "orders"),
        _ORDER_REPO,
        f"concat({_ORDER_DIR}, 'App', o_orderkey, '.csproj')",
        """concat('<Project Sdk="Microsoft.NET.Sdk">\\n<ItemGroup>\\n<PackageReference Include="Cust', o_custkey,
            '" Version="', o_orderkey % 6, '.0" />\\n<PackageReference Include="Shared"><Version>9</Version></PackageReference>\\n',
            '<PackageReference Include=" " Version="1" />\\n</ItemGroup>\\n<ItemGroup>\\n',
            '<Reference Include="Asm', o_orderkey % 8, ', Version=', o_orderkey % 3, '.1.0.0 , Culture=neutral" Version="7" />\\n',
            '<Reference Include="Plain" Version="', o_orderkey % 2, '.5" />\\n</ItemGroup>\\n</Project>\\n')""",
    )


def pyprojects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer keys divisible by 10 are not TOML."""
    return _files(
        table(spark, sf_dir, "customer"),
        "concat('repo_', c_custkey)",
        "concat('c', c_custkey, '/pyproject.toml')",
        """concat('[tool.poetry]\\nname = "c', c_custkey, '"\\n\\n[tool.poetry.dependencies]\\npython = "^3.', c_custkey % 12, '"\\n',
            'lib', c_nationkey, ' = "', c_custkey % 5, '.0"\\nshared = "1"\\n',
            'extra = {version = "2", optional = true}\\n\\n[tool.poetry.dev-dependencies]\\nshared = "', c_custkey % 3, '"\\n',
            CASE WHEN c_custkey % 10 = 0 THEN 'broken = \\n' ELSE '' END)""",
    )


def composes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer keys divisible by 9 have services that are no map."""
    return _files(
        table(spark, sf_dir, "customer"),
        "concat('repo_', c_custkey)",
        "concat('c', c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '/Docker-Compose.yml' ELSE '/compose.yaml' END)",
        """concat('version: "3"\\nservices:',
            CASE WHEN c_custkey % 9 = 0 THEN ' [1, 2]\\n' ELSE concat('\\n  web:\\n    image: acme/web:', c_custkey,
            '\\n    ports:\\n      - 22:22\\n  db', c_nationkey, ':\\n    image: postgres:14\\n  job:\\n    build: .\\n') END)""",
    )


def cloudformations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part keys divisible by 8 are JSON, those by 7 without version and resources."""
    return _files(
        table(spark, sf_dir, "part"),
        "concat('repo_', p_partkey % 50)",
        "concat('p', p_partkey, CASE WHEN p_partkey % 8 = 0 THEN '/Template.json' ELSE '/mytemplate.yaml' END)",
        """CASE WHEN p_partkey % 7 = 0 THEN 'Description: nothing\\n'
            WHEN p_partkey % 8 = 0 THEN concat('{"AWSTemplateFormatVersion": "2010-09-09",\\n\\t"Resources": {"Bucket', p_partkey,
                '": {"Type": "AWS::S3::Bucket", "Properties": {"Size": ', p_size, ', "Label": "', p_name, '"}}}}')
            ELSE concat('AWSTemplateFormatVersion: 2010-09-09\\nResources:\\n  Bucket', p_partkey,
                ':\\n    Type: AWS::S3::Bucket\\n    Properties:\\n      Size: ', p_size, '\\n      Label: !Sub "', p_name,
                '"\\n  Fn', p_partkey, ':\\n    Type: AWS::Lambda::Function\\n    Properties:\\n      resource_type: own\\n      Role: !GetAtt R.Arn\\n') END""",
    )


def deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(
        table(spark, sf_dir, "supplier"),
        "concat('repo_', s_suppkey)",
        "concat('s', s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN '/main.jinja' ELSE '/prod-Deployment.yaml' END)",
        """CASE WHEN s_suppkey % 5 = 0 THEN 'kind: Deployment\\nspec: {}\\n'
            WHEN s_suppkey % 4 = 0 THEN 'resources:\\n- name: {{ broken\\n'
            ELSE concat('resources:\\n- name: vm-', s_suppkey, '\\n  type: compute.v1.instance\\n  properties:\\n    zone: z', s_nationkey,
            '\\n    disks: [a, b]\\n- name: net\\n  type: compute.v1.network\\n') END""",
    )


def terraforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part keys divisible by 19 miss a closing brace."""
    return _files(
        table(spark, sf_dir, "part"),
        "concat('repo_', p_partkey % 50)",
        "concat('p', p_partkey, '/main.tf')",
        """concat('# part ', p_partkey, '\\nmodule "m', p_partkey, '" {\\n  source = "./modules/', p_brand, '"\\n  size   = ', p_size, '\\n}\\n\\n',
            'resource "aws_s3_bucket" "b" {\\n  bucket = "part-', p_partkey, '"\\n  acl    = var.acl\\n  tags = {\\n    Kind = "', p_type, '"\\n  }\\n',
            '  rule {\\n    enabled = true\\n  }\\n}\\n\\n',
            'resource "azurerm_resource_group" "g" {\\n  location = "West $', '{var.where["}"]}"\\n  vendor = "own"\\n}\\n\\n',
            'resource "google_storage_bucket" "g" {\\n  force_destroy = ', p_partkey % 2 = 0, '\\n  days = ', p_size, '\\n}\\n',
            'resource "other_thing" "x" {}\\nmodule "empty" {}\\n',
            CASE WHEN p_partkey % 19 = 0 THEN 'resource "aws_x" "y" {\\n' ELSE '' END)""",
    )


SOURCE_EXTENSIONS = ["py", "go", "JS", "java", "md", "sh", "xyz", "docx"]


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files; one in nine is an extensionless script, one hides below .git."""
    pick = "element_at(array('py', 'go', 'JS', 'java', 'md', 'sh', 'xyz', 'docx'), CAST(doc_id % 8 AS INT) + 1)"
    return _files(
        table(spark, sf_dir, "documents"),
        "source",
        f"""concat('/', source, CASE WHEN doc_id % 10 = 3 THEN '/.github/' ELSE '/src/' END, doc_id,
            CASE WHEN doc_id % 9 = 0 THEN '' ELSE concat('.', {pick}) END)""",
        "CASE WHEN doc_id % 9 = 0 THEN concat('#!/usr/bin/env python3\\n', text) ELSE text END",
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their language as file extension."""
    return _files(
        table(spark, sf_dir, "documents"),
        "source",
        "concat('/', source, '/', doc_id, '.', lang)",
        "text",
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the host as repository and the URL path as file path."""
    return _files(
        table(spark, sf_dir, "pages"),
        "regexp_extract(url, '^https?://([^/]+)', 1)",
        "regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1)",
        "html",
    )


CORPUS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "requirements": requirements,
    "go_mods": go_mods,
    "dockerfiles": dockerfiles,
    "package_jsons": package_jsons,
    "poms": poms,
    "csprojs": csprojs,
    "pyprojects": pyprojects,
    "composes": composes,
    "cloudformations": cloudformations,
    "deployments": deployments,
    "terraforms": terraforms,
    "sources": sources,
}


def all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.union, [make(spark, sf_dir) for make in CORPUS.values()])


_WRITTEN: dict[tuple[str, str], str] = {}


def files_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus as a stored FILES table, written once per application and test folder.

    Scans then see what they see in use: one parquet table instead of a union of projections.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        path = shared_dir(spark, "files")
        corpus = all_files(spark, sf_dir)
        cores = spark.sparkContext.defaultParallelism
        if table(spark, sf_dir, "lineitem").rdd.getNumPartitions() < cores:
            # small test data: mix the kinds of files, as repositories do; large tables are written as read, without a shuffle
            corpus = corpus.repartition(4 * cores)
        corpus.write.option("compression", "zstd").parquet(path)
        _WRITTEN[key] = path
    return spark.read.schema(FILES).parquet(_WRITTEN[key])


def write_tree(files: DataFrame, root: str) -> int:
    """Write every row's ``content`` to ``<root>/<path>``, where the executors are; the number of files."""

    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
        system.create_dir(base)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target, below = base, [name for name in path.split("/") if name]
                for name in below[:-1]:  # from above: failing attempts at a deep folder hold up all that write to one above it
                    target += f"/{name}"
                    system.create_dir(target, recursive=False)
                target += f"/{below[-1]}"
                with system.open_output_stream(target) as out:
                    out.write((content or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return files.select("path", "content").mapInArrow(run, "n BIGINT").agg(F.sum("n")).first()[0] or 0


def write_catalogues(spark: SparkSession, sf_dir: str, root: str) -> None:
    """The parts' patterns as pretty-printed catalogue files, one per brand; every fifth brand's is cut short, one is no JSON file."""
    number = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    pattern = F.struct(
        F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("name"),
        F.lit("Part").alias("type"),
        F.array(F.concat(F.lit("f"), F.col("p_partkey").cast("string")), F.lit("x.y")).alias("file_names"),
        F.struct(F.col("p_size").alias("size"), F.array("p_type").alias("kinds")).alias("properties"),
    )
    name = F.concat(F.translate("p_brand", "#", "-"), F.when(number == 1, ".backup").otherwise(".json"))
    rows = table(spark, sf_dir, "part").select(name.alias("name"), F.when(number % 5 == 0, 9).otherwise(0).alias("cut"), F.to_json(pattern, {"pretty": "true"}).alias("text"))
    _write_arrays(rows, root)


def write_reports(spark: SparkSession, sf_dir: str, root: str) -> int:
    """One pretty-printed vulnerability report per repository, compressed; those of every tenth one are cut short. The number of rows.

    Table columns are shuffled, not reports, and a report is written result by result.
    """

    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
        system.create_dir(base)
        given = ((*row,) for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        written = 0
        for repo, group in itertools.groupby(given, key=lambda row: row[0]):
            folder = f"{base}/repo_name={repo}"
            system.create_dir(folder, recursive=False)
            plain = system.open_output_stream(f"{folder}/report.json.gz", compression=None, buffer_size=1 << 20)
            with plain as out, gzip.GzipFile(fileobj=out, mode="wb", compresslevel=1, mtime=0) as packed:
                left = 50 if repo.endswith("0") else None  # characters
                before = '{\n  "Results" : ['
                for _, results in group:
                    text = f"{before} {results.strip()[1:-1]}"[:left]
                    packed.write(text.encode())
                    before, left = ",", None if left is None else left - len(text)
                    written += 1
                packed.write(" ]\n}"[:left].encode())
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["n"])

    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.where("l_suppkey IS NOT NULL").repartition(parts, "l_suppkey").sortWithinPartitions("l_suppkey")
    rows = _line_reports(dealt).select("repo_name", F.to_json("Results", {"pretty": "true"}).alias("results"))
    return rows.mapInArrow(run, "n BIGINT").agg(F.sum("n")).first()[0] or 0


def _write_arrays(rows: DataFrame, root: str) -> None:
    """Each ``name``'s ``text`` rows as a file of one array without its last ``cut`` characters, written row by row."""

    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
        system.create_dir(base)
        given = ((*row,) for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        written = 0
        for name, group in itertools.groupby(given, key=lambda row: row[0]):
            before = "["
            with system.open_output_stream(f"{base}/{name}", buffer_size=1 << 20) as out:
                for _, cut, text in group:
                    out.write(f"{before} ".encode() if before == "[" else f"{before}, ".encode())
                    before = text
                    written += 1
                end = f"{before} ]"
                out.write(end[: len(end) - cut].encode())
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["n"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.where("name IS NOT NULL").select("name", "cut", "text").repartition(parts, "name").sortWithinPartitions("name")
    dealt.mapInArrow(run, "n BIGINT").agg(F.sum("n")).first()


def write_batches(findings: DataFrame, number: Column, root: str) -> None:
    """Findings as batches, one pretty-printed array per file; batch 7 is cut short. A batch is written row by row."""
    text = F.to_json(F.struct(*FINDING_COLUMNS), {"pretty": "true"}).alias("text")
    name = F.concat(F.lit("batch-"), number.cast("string"), F.lit(".json"))
    _write_arrays(findings.select(name.alias("name"), F.when(number == 7, 2).otherwise(0).alias("cut"), text), root)


def text_catalogue() -> Catalogue:
    """Patterns over documents and pages, covering every kind of rule and both invalid forms."""
    return Catalogue(
        (
            Pattern("Licensed", "Text", "Legal", file_extensions=(".en", "fr"), content_patterns=("license", "MIT|Apache")),
            Pattern("German", "Text", "Language", file_extensions=("de",), properties='{"code":"de"}'),
            Pattern("Document one", "Text", "Name", file_names=("1.en", "1.fr", "1.de", "1.es")),
            Pattern("Sevens", "Text", "Name", file_names=(r"^7+\d\.", "77")),
            Pattern("Mail", "Text", "Contact", file_names=(r"\.es$",), content_patterns=(r"\w@\w",)),
            Pattern("English path", "Page", "Path", path_patterns=("/en/*",)),
            Pattern("Source one", "Text", "Path", path_patterns=("**/src{1,2}/?.*",)),
            Pattern("Both", "Text", "Mixed", path_patterns=("/src1*/**",), file_extensions=("en",)),
            Pattern("Anything", "Text", "Any"),
            Pattern("Invalid names", "Text", "Bad", file_names=("x",), file_extensions=("en",)),
            Pattern("Invalid content", "Text", "Bad", content_patterns=("the",), path_patterns=("*",)),
        )
    )


def part_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern table as large as ``part``; every seventh and eleventh one is unusable."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pattern_id"),
        F.col("p_name").alias("name"),
        F.lit("Part").alias("type"),
        F.col("p_type").alias("category"),
        F.expr(
            "CASE WHEN p_partkey % 7 = 0 THEN array(p_name) WHEN p_partkey % 2 = 0 "
            "THEN array(replace(p_name, ' ', '.'), replace(p_name, ' ', '_')) END"
        ).alias("file_names"),
        F.expr("CASE WHEN p_partkey % 5 = 0 THEN array(concat('**/', p_brand, '/*')) END").alias("path_patterns"),
        F.expr(
            "CASE WHEN p_partkey % 2 = 1 AND p_partkey % 11 <> 0 OR p_partkey % 7 = 0 "
            "THEN array(concat('.', lower(p_brand)), 'txt') END"
        ).alias("file_extensions"),
        F.expr("CASE WHEN p_partkey % 3 = 0 OR p_partkey % 11 = 0 THEN array(p_type) END").alias("content_patterns"),
        F.lit(None).cast("string").alias("properties"),
    )


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per part, below its brand, named after it."""
    return table(spark, sf_dir, "part").select(
        F.expr("concat('repo_', p_partkey % 50)").alias("repo_name"),
        F.expr(
            "concat('p', p_partkey, '/', p_brand, '/', p_name, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('.', lower(p_brand)) END)"
        ).alias("path"),
        F.col("p_type").alias("content"),
        F.lit(None).cast("string").alias("read_error"),
    )


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories of events (busy) and of orders only, plus some without any history."""
    busy = table(spark, sf_dir, "events").select(F.expr("concat('repo_', user_id % 20)").alias("repo_name"))
    quiet = table(spark, sf_dir, "supplier").select(F.expr("concat('repo_', s_suppkey)").alias("repo_name"))
    return busy.union(quiet).distinct()


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit per event, in the zone of its user; every fourth one is listed twice."""
    events = table(spark, sf_dir, "events")
    once = events.select(
        F.expr("concat('repo_', user_id % 20)").alias("repo_name"),
        F.col("event_id").cast("string").alias("hash"),
        F.expr("concat('u', user_id, '@example.com')").alias("author_email"),
        F.col("ts").cast("timestamp_ntz").alias("author_when"),
        F.col("ts").cast("timestamp_ntz").alias("committer_when"),
        F.expr("CAST((user_id % 5 - 2) * 60 AS INT)").alias("tz_offset_minutes"),
    )
    return once.union(once.where("CAST(hash AS BIGINT) % 4 = 0"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a tag: annotated, lightweight (commit time only), never undated."""
    return table(spark, sf_dir, "orders").select(
        F.expr("concat('repo_', o_custkey % 40)").alias("repo_name"),
        F.expr("concat('v', o_orderkey)").alias("tag_name"),
        F.expr("CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS TIMESTAMP_NTZ) END").alias("tagger_when"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("committer_when"),
    )


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.expr("concat('repo_', o_custkey % 40)").alias("repo_name"),
        F.expr("concat('refs/heads/b', o_orderkey)").alias("ref_name"),
        F.expr(
            "element_at(array('branch', 'remote', 'tag', 'note'), CAST(o_orderkey % 4 AS INT) + 1)"
        ).alias("ref_kind"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("author_when"),
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository listings: each order re-lists its customer's repository."""
    return table(spark, sf_dir, "orders").select(
        F.expr("concat('group/c', o_custkey)").alias("full_name"),
        F.expr(
            "CASE o_custkey % 4 WHEN 0 THEN concat('git@host:group/c', o_custkey, '.git') "
            "WHEN 1 THEN concat('https://host/group/c', o_custkey, '.git') "
            "WHEN 2 THEN concat('git@a:b:c', o_custkey) ELSE concat('ssh://host/c', o_custkey) END"
        ).alias("clone_url"),
        F.col("o_orderkey").alias("batch"),
        F.expr("concat('{\"status\":\"', o_orderstatus, '\"}')").alias("payload"),
    )


def vulnerability_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report per line item: a result with two vulnerabilities and an empty one."""
    return _line_reports(spread(table(spark, sf_dir, "lineitem"))).select("repo_name", "Results")


def damaged_reports(spark: SparkSession, sf_dir: str, where: str = "l_linenumber = 4") -> DataFrame:
    """The reports, some of them as a reader leaves what it cannot read."""
    bad = F.expr(where)
    return _line_reports(spread(table(spark, sf_dir, "lineitem"))).select(
        "repo_name", F.when(~bad, F.col("Results")).alias("Results"), F.when(bad, F.lit("{cut off")).alias("_corrupt_record")
    )


def _line_reports(lines: DataFrame) -> DataFrame:
    vuln = lambda n, sev: (
        f"named_struct('VulnerabilityID', concat('CVE-', l_orderkey, '-', {n}), 'PkgName', concat('part-', l_partkey), "
        f"'InstalledVersion', CAST({QTY} AS STRING), 'FixedVersion', '9', 'Severity', {sev}, "
        f"'Title', concat('flaw ', {n}), 'Description', CAST(NULL AS STRING))"
    )
    return lines.select(
        "*",
        F.expr(_LINE_REPO).alias("repo_name"),
        F.expr(
            "array(named_struct('Target', concat('o', l_orderkey), 'Class', 'lang', 'Type', l_linestatus, 'Vulnerabilities', array("
            + vuln("l_linenumber", "CASE WHEN l_returnflag = 'R' THEN 'LOW' ELSE 'HIGH' END")
            + ", "
            + vuln("99", "'CRITICAL'")
            + ")), named_struct('Target', 'none', 'Class', 'os', 'Type', 'x', 'Vulnerabilities', NULL))"
        ).alias("Results"),
    )
