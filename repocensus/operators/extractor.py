"""Extractors: a route over path columns plus column expressions over the file's content.

An extractor never shuffles.  It adds staged columns (each computed once per routed file),
an array of findings and an optional error text; :func:`extract` runs one of them,
:func:`repocensus.plans.scan.scan` runs all of them in the same pass over the files.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repocensus.functions.configs import config_document
from repocensus.functions.paths import with_path_columns
from repocensus.schemas import FINDING_CORE_ARRAY


# struct(json, error) of a configuration file, read once for all extractors that route it.
CONFIG = "__config"
ITEM = "__item"


@dataclass(frozen=True)
class Extractor:
    """``stages`` are evaluated in order, each after the previous one, only for routed files.

    With ``items``, findings are what ``steps`` make of each of them, one after the other (see :func:`each`).
    """

    name: str
    route: Column
    findings: Column
    stages: list[dict[str, Column]] = field(default_factory=list)
    error: Column | None = None
    reads_content: bool = True
    config: str | None = None  # "yaml" or "toml": the stages find the file's document in CONFIG
    items: Column | None = None
    steps: tuple[Callable[[Column], Column], ...] = ()

    @property
    def routed_flag(self) -> str:
        return f"__{self.name}_route"


def each(items: Column, *steps: Callable[[Column], Column]) -> dict:
    """An extractor's ``findings`` by one finding for each item, and its items and steps.

    A scan by several extractors builds the array; one extractor alone has its items as rows first and then the steps as
    plain columns, which Spark compiles, and leaves out if nobody reads them.
    """
    return {"findings": reduce(F.transform, steps, items), "items": items, "steps": steps}


def finding(
    name: Column | str, type: str, category: str, properties: Column | None
) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    bag = F.lit(None).cast("string") if properties is None else properties
    return F.struct(
        name.alias("name"), F.lit(type).alias("type"), F.lit(category).alias("category"),
        bag.alias("properties"),
    )


def no_findings() -> Column:
    return F.array().cast(FINDING_CORE_ARRAY)


def apply_stages(files: DataFrame, extractors: list[Extractor]) -> DataFrame:
    """Path columns, route flags and every stage column of the given extractors.

    ``content`` is kept only for files some content-reading extractor wants, so that rows
    stay small from here on; ``first_line`` survives for interpreter lines.
    """
    staged = with_path_columns(files).withColumns(
        {e.routed_flag: F.coalesce(e.route, F.lit(False)) for e in extractors}
    )
    if "content" in files.columns:
        wanted = F.lit(False)
        for e in extractors:
            if e.reads_content:
                wanted = wanted | F.col(e.routed_flag)
        content = F.col("content")
        staged = staged.withColumns(
            {
                "first_line": F.when(
                    content.startswith("#!"), F.substring_index(content, "\n", 1)
                ).otherwise(F.lit("")),
                "content": F.when(wanted, content),
            }
        )
    kinds = {kind: [F.col(e.routed_flag) for e in extractors if e.config == kind] for kind in ("toml", "yaml")}
    routed = [F.when(reduce(Column.__or__, flags), kind) for kind, flags in kinds.items() if flags]
    if routed:
        staged = staged.withColumn(CONFIG, config_document(F.col("content"), F.coalesce(*routed)))
    depth = max((len(e.stages) for e in extractors), default=0)
    for level in range(depth):
        staged = staged.withColumns(
            {
                column: F.when(F.col(e.routed_flag), value)
                for e in extractors
                if level < len(e.stages)
                for column, value in e.stages[level].items()
            }
        )
    return staged


def guarded_findings(e: Extractor) -> Column:
    """The extractor's findings; none for other files or when the file is in error."""
    usable = F.col(e.routed_flag)
    if e.error is not None:
        usable = usable & e.error.isNull()
    return F.coalesce(F.when(usable, e.findings), no_findings())


def guarded_error(e: Extractor) -> Column:
    if e.error is None:
        return F.lit(None).cast("string")
    return F.when(F.col(e.routed_flag), e.error)


def _routed(files: DataFrame, e: Extractor) -> DataFrame:
    """The extractor's columns over its own files: the route is a filter on the scan, below everything else."""
    return apply_stages(with_path_columns(files).where(e.route).select(*files.columns), [e])


def extract(files: DataFrame, e: Extractor) -> DataFrame:
    """Findings of one extractor over a file table."""
    routed = _routed(files, e)
    if e.items is None:
        rows = routed.select("path", "repo_name", F.inline(guarded_findings(e)))
    else:
        # no filter: Spark would work out the error a second time for it, before anything else
        items = e.items if e.error is None else F.when(e.error.isNull(), e.items)
        rows = item_rows(routed.select("path", "repo_name", F.explode(items).alias(ITEM)), e).select("path", "repo_name", f"{ITEM}.*")
    return rows.select("name", "type", "category", "path", "repo_name", "properties")


def item_rows(rows: DataFrame, e: Extractor) -> DataFrame:
    """Rows with an item in ITEM, which the extractor's steps turn into a finding; it stays NULL where it is."""
    for step in e.steps:
        rows = rows.withColumn(ITEM, step(F.col(ITEM)))
    return rows


def extract_errors(files: DataFrame, e: Extractor) -> DataFrame:
    """One row per file the extractor could not read; its findings are dropped, nothing else is."""
    routed = _routed(files, e)
    return routed.select(
        "repo_name", "path", F.lit(e.name).alias("extractor"), guarded_error(e).alias("message")
    ).where(F.col("message").isNotNull())
