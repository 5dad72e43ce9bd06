"""Library dependencies from package manifests, one column expression per format."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from repocensus.functions.props import props
from repocensus.functions.text import (
    ASCII_BLANK,
    BLANK,
    after,
    before,
    drop_comment_lines,
    is_ascii,
    is_blank,
    matches,
    trim_lines,
    trim_ws,
)
from repocensus.operators.extractor import CONFIG, Extractor, each, finding, no_findings

# Any of these anywhere in a path keeps a manifest from being read.
IGNORED_IN_PATH = ["node_modules", "vendor", ".git"]
# Requirement operators in the order they are looked for.
REQUIREMENT_OPERATORS = ["==", ">=", "<=", "~=", ">", "<"]
NO_VERSION = "N/A"

_PAIRS = "array<struct<name:string,version:string>>"


def manifest_path() -> Column:
    path = F.col("path")
    return ~reduce(or_, [path.contains(d) for d in IGNORED_IN_PATH])


def named(file_name: str) -> Column:
    return manifest_path() & (F.col("base_name") == file_name)


def _pair(name: Column, version: Column) -> Column:
    return F.struct(name.alias("name"), version.alias("version"))


def _libraries(pairs: Column, language: str, *steps: Callable[[Column], Column]) -> dict:
    """Findings of (name, version) pairs, or of what ``steps`` make pairs of."""
    library = lambda p: finding(
        p["name"], "Library", "", props(Language=F.lit(language), Version=p["version"])
    )
    return each(pairs, *steps, library)


def _or_empty(array: Column, ddl: str) -> Column:
    return F.coalesce(array, F.array().cast(ddl))


def maven() -> Extractor:
    """Direct ``project/dependencies/dependency`` entries of a pom."""
    schema = (
        "dependencies ARRAY<STRUCT<dependency: ARRAY<STRUCT<groupId: STRING, artifactId: STRING, "
        "version: STRING>>>>, _corrupt STRING"
    )
    options = {
        "ignoreSurroundingSpaces": "false",
        "ignoreNamespace": "true",
        "columnNameOfCorruptRecord": "_corrupt",
    }
    pom = F.col("__maven_doc")
    dependencies = F.flatten(
        F.transform(
            pom["dependencies"],
            lambda d: _or_empty(
                d["dependency"], "array<struct<groupId:string,artifactId:string,version:string>>"
            ),
        )
    )
    text = lambda c: F.coalesce(c, F.lit(""))
    pairs = F.transform(
        dependencies,
        lambda d: _pair(
            F.concat(text(d["groupId"]), F.lit(":"), text(d["artifactId"])), text(d["version"])
        ),
    )
    return Extractor(
        name="maven",
        route=named("pom.xml"),
        stages=[{"__maven_doc": F.from_xml(F.col("content"), schema, options)}],
        **_libraries(_or_empty(pairs, _PAIRS), "Java"),
        error=_xml_error(pom["_corrupt"], "project", "pom.xml"),
    )


def _xml_error(corrupt: Column, root: str, what: str) -> Column:
    # declarations, comments and a doctype may precede the root element
    prolog = r"(?s)\A(?:[^<]++|<!--.*?-->|<[?!][^>]*+>)*+<(?:[\w.-]+:)?([\w.-]+)"
    found = F.regexp_extract(F.col("content"), prolog, 1)
    return F.when(
        corrupt.isNotNull() | (found != root), F.lit(f"failed to parse {what}: not a {root} document")
    )


def go_modules() -> Extractor:
    """``require`` lines and blocks; comments inside a block count like any two words."""
    body, entries = F.col("__go_text"), F.col("__go_entries")
    block = r"(?dm)^require \([^\n]*+((?s:.*?))(?:^\)[^\n]*+|\z)"
    in_blocks = F.array_join(matches(body, block, 1), "\n")
    single = F.array_join(
        matches(F.regexp_replace(body, block, ""), r"(?dm)^require (.*)$", 1), "\n"
    )
    # blanks inside a line collapse to one space, which then separates name and version
    joined = F.concat(in_blocks, F.lit("\n"), single)
    spaced = F.when(
        is_ascii(F.col("__go_joined")), F.regexp_replace("__go_joined", f"{ASCII_BLANK}++", " ")
    ).otherwise(F.regexp_replace("__go_joined", f"{BLANK}++", " "))
    found = matches(entries, r"(?dm)^ ?(?!require \()([^ \n]++ [^ \n]++)", 1)
    pair = lambda e: _pair(F.substring_index(e, " ", 1), F.substring_index(e, " ", -1))
    return Extractor(
        name="go_modules",
        route=named("go.mod"),
        stages=[
            {"__go_text": trim_lines(F.col("content"))},
            {"__go_joined": joined},
            {"__go_entries": spaced},
        ],
        **_libraries(found, "Go", pair),
    )


def npm() -> Extractor:
    """Runtime and development dependencies; development wins on the same name."""
    doc = F.col("__npm_doc")
    runtime, dev = F.col("__npm_runtime"), F.col("__npm_dev")
    # a string-to-string object as JSON text; possessive, so that long objects stay cheap
    string = r'"(?:[^"\\]|\\.)*+"'
    flat = rf"(?s)\A\s*\{{\s*(?:{string}\s*:\s*(?:{string}|null)\s*,?\s*)*+\}}\s*\z"
    bad = lambda c: F.coalesce(c.isNotNull() & ~c.rlike(flat), F.lit(False))
    schema = "dependencies STRING, devDependencies STRING, _corrupt STRING"
    members = lambda c: F.coalesce(
        F.transform(
            F.map_entries(F.from_json(c, "MAP<STRING, STRING>")),
            lambda e: _pair(e["key"], F.coalesce(e["value"], F.lit(""))),
        ),
        F.array().cast(_PAIRS),
    )
    names = lambda pairs: F.transform(pairs, lambda p: p["name"])
    return Extractor(
        name="npm",
        route=named("package.json"),
        stages=[
            {
                "__npm_doc": F.from_json(
                    F.col("content"), schema, {"columnNameOfCorruptRecord": "_corrupt"}
                )
            },
            {
                "__npm_runtime": members(doc["dependencies"]),
                "__npm_dev": members(doc["devDependencies"]),
            },
        ],
        **_libraries(
            F.concat(
                F.filter(
                    _last_of_each(runtime), lambda p: ~F.array_contains(names(dev), p["name"])
                ),
                _last_of_each(dev),
            ),
            "Node.js",
        ),
        error=F.when(
            doc.isNull()
            | doc["_corrupt"].isNotNull()
            | ~trim_ws(F.col("content")).endswith("}")
            | bad(doc["dependencies"])
            | bad(doc["devDependencies"]),
            F.lit("failed to parse package.json: not an object of string versions"),
        ),
    )


def _last_of_each(pairs: Column) -> Column:
    """Pairs without the earlier ones of a repeated name (repeats are rare, so checked first)."""
    names = F.transform(pairs, lambda p: p["name"])
    repeated = F.size(F.array_distinct(names)) < F.size(names)
    last_only = F.filter(
        pairs,
        lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), p["name"]),
    )
    return F.when(repeated, last_only).otherwise(pairs)


def pip() -> Extractor:
    """Requirement lines; the operator is the first of the fixed list found anywhere in a line."""
    text = drop_comment_lines(trim_lines(F.col("content")))
    kept = F.filter(F.split(F.col("__pip_text"), "\n"), lambda l: l != "")

    def pair(line: Column) -> Column:
        split = F.when(F.lit(False), _pair(line, line))
        for op in REQUIREMENT_OPERATORS:
            split = split.when(
                line.contains(op),
                _pair(
                    trim_ws(before(line, op)),
                    F.concat(F.lit(op), trim_ws(after(line, op))),
                ),
            )
        return split.otherwise(_pair(line, F.lit(NO_VERSION)))

    return Extractor(
        name="pip",
        route=named("requirements.txt"),
        stages=[{"__pip_text": text}],
        **_libraries(kept, "Python", pair),
    )


def poetry() -> Extractor:
    """String-valued Poetry dependencies; development wins on the same name."""
    doc = F.col(CONFIG)
    parsed = F.from_json(
        doc["json"],
        "tool STRUCT<poetry: STRUCT<dependencies: MAP<STRING, VARIANT>, "
        "`dev-dependencies`: MAP<STRING, VARIANT>>>",
    )
    poetry_tool = F.col("__poetry_parsed")["tool"]["poetry"]

    def strings(members: Column) -> Column:
        kept = F.map_filter(members, lambda k, v: F.schema_of_variant(v) == "STRING")
        text = F.transform_values(kept, lambda k, v: F.variant_get(v, "$", "string"))
        return F.coalesce(text, F.create_map().cast("map<string,string>"))

    runtime, dev = strings(poetry_tool["dependencies"]), strings(poetry_tool["dev-dependencies"])
    merged = F.map_concat(
        F.map_filter(runtime, lambda k, v: ~F.map_contains_key(dev, k)), dev
    )
    pairs = F.transform(F.map_entries(merged), lambda e: _pair(e["key"], e["value"]))
    return Extractor(
        name="poetry",
        route=named("pyproject.toml"),
        stages=[{"__poetry_parsed": parsed}],
        config="toml",
        **_libraries(pairs, "Python"),
        error=F.concat(F.lit("failed to parse pyproject.toml: "), doc["error"]),
    )


def csproj() -> Extractor:
    """NuGet ``PackageReference`` and assembly ``Reference`` items of every ItemGroup."""
    item = "array<struct<_Include:string,_Version:string>>"
    schema = (
        "ItemGroup ARRAY<STRUCT<PackageReference: ARRAY<STRUCT<_Include: STRING, _Version: STRING>>, "
        "Reference: ARRAY<STRUCT<_Include: STRING, _Version: STRING>>>>, _corrupt STRING"
    )
    options = {
        "ignoreSurroundingSpaces": "false",
        "ignoreNamespace": "true",
        "columnNameOfCorruptRecord": "_corrupt",
    }
    doc = F.col("__csproj_doc")
    items = lambda kind: F.filter(
        F.coalesce(
            F.flatten(F.transform(doc["ItemGroup"], lambda g: _or_empty(g[kind], item))),
            F.array().cast(item),
        ),
        lambda i: ~is_blank(i["_Include"]),
    )
    first_given = lambda *versions: F.coalesce(
        *[F.when(~is_blank(v), v) for v in versions], F.lit(NO_VERSION)
    )
    packages = F.transform(
        items("PackageReference"), lambda i: _pair(i["_Include"], first_given(i["_Version"]))
    )

    def assembly(i: Column) -> Column:
        parts = assembly_parts(i["_Include"])
        return _pair(parts["name"], first_given(parts["version"], i["_Version"]))

    return Extractor(
        name="csproj",
        route=manifest_path() & F.col("base_name").endswith(".csproj"),
        stages=[{"__csproj_doc": F.from_xml(F.col("content"), schema, options)}],
        **_libraries(F.concat(packages, F.transform(items("Reference"), assembly)), "C#"),
        error=_xml_error(doc["_corrupt"], "Project", ".csproj"),
    )


def assembly_parts(include: Column) -> Column:
    """struct(name, version) of an assembly reference; the first ``Version=`` part wins."""
    parts = F.split(include, r"\s*,\s*")
    tagged = F.filter(F.slice(parts, 2, 1 << 30), lambda p: p.startswith("Version="))
    version = trim_ws(F.substr(F.get(tagged, F.lit(0)), F.lit(len("Version=") + 1)))
    return F.struct(
        trim_ws(F.get(parts, F.lit(0))).alias("name"),
        F.coalesce(version, F.lit("")).alias("version"),
    )


def gradle() -> Extractor:
    """Gradle builds are recognised as manifests but not read: an error, never a finding."""
    return Extractor(
        name="gradle",
        route=named("build.gradle"),
        findings=no_findings(),
        error=F.lit("unsupported package file"),
        reads_content=False,
    )


def library_extractors() -> list[Extractor]:
    return [maven(), go_modules(), npm(), pip(), poetry(), csproj(), gradle()]
