"""Compose services and cloud resources from infrastructure-as-code files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from repocensus.functions.blocks import block_stages
from repocensus.functions.props import Json, json_members, json_object, json_text, overlay, props
from repocensus.operators.extractor import CONFIG, Extractor, finding, no_findings

# Which files each format is read from (compared in lower case).
COMPOSE_FILES = ["docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml"]
CLOUDFORMATION_ENDINGS = ["template.yml", "template.yaml", "template.json"]
DEPLOYMENT_ENDINGS = ["deployment.yaml", "deployment.yml", "main.jinja"]
# Resource prefix, finding name and category of each provider.
PROVIDERS = [("aws_", "AWS"), ("azurerm_", "Azure"), ("google_", "GCP")]


def _ends_with_any(column: str, endings: list[str]) -> Column:
    route = F.col(column).endswith(endings[0])
    for ending in endings[1:]:
        route = route | F.col(column).endswith(ending)
    return route


def _typed(json_doc: Column, schema: str) -> Column:
    return F.from_json(json_doc, schema + ", _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"})


def _empty(doc: Column) -> Column:
    return F.coalesce(doc["json"] == "null", F.lit(False))


def compose() -> Extractor:
    route = F.lower("base_name").isin(COMPOSE_FILES)
    doc, typed = F.col(CONFIG), F.col("__compose_typed")
    services = F.map_entries(typed["services"])
    return Extractor(
        name="compose",
        route=route,
        config="yaml",
        stages=[{"__compose_typed": _typed(doc["json"], "services MAP<STRING, STRUCT<image: STRING>>")}],
        findings=F.coalesce(
            F.transform(
                services,
                lambda s: finding(
                    s["key"], "Docker Compose Service", "",
                    props(image=F.coalesce(s["value"]["image"], F.lit(""))),
                ),
            ),
            no_findings(),
        ),
        error=F.when(
            doc["error"].isNotNull() | (typed["_corrupt"].isNotNull() & ~_empty(doc)),
            F.concat(
                F.lit("failed to parse compose file: "),
                F.coalesce(doc["error"], F.lit("services are not a map of services")),
            ),
        ),
    )


def cloudformation() -> Extractor:
    """Template resources; a property named ``resource_type`` wins over the resource's own type."""
    route = _ends_with_any("lower_path", CLOUDFORMATION_ENDINGS)
    doc, typed = F.col(CONFIG), F.col("__cfn_typed")
    # JSON that is not YAML (tabs, for instance) is still read as JSON
    text = F.coalesce(doc["json"], F.col("content"))
    schema = (
        "AWSTemplateFormatVersion STRING, Resources MAP<STRING, STRUCT<Type: STRING, Properties: STRING>>"
    )

    def row(r: Column) -> Column:
        own = json_text(F.coalesce(r["value"]["Type"], F.lit("")))
        members = F.coalesce(
            json_members(r["value"]["Properties"]), F.create_map().cast("map<string,string>")
        )
        return finding(
            r["key"], "CloudFormation Resource", "AWS",
            json_object(overlay({"resource_type": own}, members)),
        )

    malformed = F.exists(
        F.map_values(typed["Resources"]),
        lambda r: r["Properties"].isNotNull() & ~r["Properties"].startswith("{"),
    )
    return Extractor(
        name="cloudformation",
        route=route,
        config="yaml",
        stages=[{"__cfn_typed": _typed(text, schema)}],
        findings=F.coalesce(
            F.transform(F.map_entries(typed["Resources"]), row), no_findings()
        ),
        error=F.when(
            (typed.isNull() | typed["_corrupt"].isNotNull() | F.coalesce(malformed, F.lit(False)))
            & ~_empty(doc),
            F.lit("not a readable template"),
        ),
    )


def deployment_manager() -> Extractor:
    """Deployment Manager resources; anything unreadable is silently nothing."""
    route = _ends_with_any("lower_path", DEPLOYMENT_ENDINGS)
    doc, typed = F.col(CONFIG), F.col("__gdm_typed")
    schema = "resources ARRAY<STRUCT<name: STRING, type: STRING, properties: STRING>>"

    def row(r: Column) -> Column:
        text = lambda c: F.coalesce(c, F.lit(""))
        bag = F.create_map(
            F.lit("resource_type"), json_text(text(r["type"])),
            F.lit("properties"),
            F.coalesce(json_object(json_members(r["properties"])), F.lit("null")),
        )
        return finding(text(r["name"]), "Deployment Manager Resource", "GCP", json_object(bag))

    return Extractor(
        name="deployment_manager",
        route=route,
        config="yaml",
        stages=[{"__gdm_typed": _typed(doc["json"], schema)}],
        findings=F.when(
            typed["_corrupt"].isNull(), F.coalesce(F.transform(typed["resources"], row), no_findings())
        ).otherwise(no_findings()),
    )


# A block rule turns one block struct(type, labels, attributes) into a finding or NULL.
BlockRule = Callable[[Column], Column]


def module_use(block: Column) -> Column:
    source = F.coalesce(F.try_element_at(block["attributes"], F.lit("source")), F.lit("null"))
    return F.when(
        (block["type"] == "module") & (F.size(block["attributes"]) > 0),
        finding("TF Module", "TF Module Use", "", props(source=Json(source))),
    )


def provider_resource(prefix: str, vendor: str) -> BlockRule:
    """Resources of one provider: attributes win over ``resource_type`` and ``vendor``,
    except for Google, where they stay nested below ``attributes``."""

    def rule(block: Column) -> Column:
        label = F.get(block["labels"], F.lit(0))
        own = {"resource_type": json_text(label), "vendor": F.lit(f'"{vendor}"')}
        if vendor == "GCP":
            nested = {**own, "attributes": json_object(block["attributes"])}
            bag = props(**{k: Json(v) for k, v in nested.items()})
        else:
            bag = json_object(overlay(own, block["attributes"]))
        return F.when(
            (block["type"] == "resource") & label.startswith(prefix),
            finding(f"{vendor} Resource", "Terraform Resource Use", vendor, bag),
        )

    return rule


def terraform(extra_rules: Sequence[BlockRule] = ()) -> Extractor:
    """Every rule over every top-level block; a file with a syntax error is silently nothing."""
    route = F.col("path").endswith(".tf")
    rules = [module_use, *[provider_resource(*p) for p in PROVIDERS], *extra_rules]
    rows = F.transform(
        F.col("__tf_blocks"), lambda b: F.array_compact(F.array(*[rule(b) for rule in rules]))
    )
    return Extractor(
        name="terraform",
        route=route,
        stages=block_stages(F.when(route, F.col("content")), "__tf"),
        findings=F.coalesce(F.flatten(rows), no_findings()),
    )


def config_extractors() -> list[Extractor]:
    return [terraform(), compose(), cloudformation(), deployment_manager()]
