"""URL filter by path-template trees (operator 7).

Every host has a tree of path segments. Segments with digits are generalised by shape; below a node with more
than MAX_CHILDREN different segments, those with less than a tenth of the node's pages become one wildcard.
Sibling branches that pass two tests, close shares of what lies below them and no significant
difference of their labels, are merged, among the children of every node and level by level from the top: children of
merged branches are siblings then. Merges are followed through, and the smallest of the connected branches names them. A template is rejected if enough of its pages are labelled and its blocked
share, smoothed towards its host's (and that towards all pages'), reaches REJECT.

Labels are the verdicts of the given rules (or a table of them); pages under a rule follow the rule.
Null urls and urls without ``://`` have empty host and path and are allowed unless a rule says otherwise;
repeated rows are judged alike; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repocensus.llm.tables import ascii_lower, stored

# (verdict, host, path) of the standing rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DEPTH = 4
MAX_CHILDREN = 12
HEAVY = 0.1
SMOOTHING = 5.0
MIN_LABELLED = 5
REJECT = 0.8
FAR_APART = 0.25
Z = 1.96


# Tried at the start of a run of letters only, and without going back: linear in the path.
HEX_RUN = "(?<![A-Fa-f])(?:[A-Fa-f]*+<n>){3,}+[A-Fa-f]*+"

def parsed(pages: DataFrame) -> DataFrame:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce("url", F.lit(""))
    return pages.select("page_id", ascii_lower(F.regexp_extract(url, pattern, 1)).alias("host"), F.regexp_extract(url, pattern, 2).alias("path"))


def rule_of(rules) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(path))
        text, verdict = F.when(fits, F.lit(host + path)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def _generalised(shapes: DataFrame) -> DataFrame:
    """Adds ``t1`` ... : the template up to each level. ``shapes`` has ``host``, ``segments`` and ``n`` (pages)."""
    for level in range(1, DEPTH + 1):
        above = F.col(f"t{level - 1}") if level > 1 else F.lit("")
        last = F.array_join(F.slice("segments", level, F.greatest(F.size("segments"), F.lit(1))), "/")  # the deepest level takes the rest
        own = F.coalesce(F.get("segments", F.lit(level - 1)) if level < DEPTH else last, F.lit(""))
        shapes = stored(shapes.withColumn("above", above).withColumn("own", own), "url-level")
        nodes = shapes.groupBy("host", "above", "own").agg(F.sum("n").alias("pages"))
        sizes = nodes.groupBy("host", "above").agg(F.count("*").alias("children"), F.sum("pages").alias("all_pages"))
        # Only nodes with many children need a look at their segments.
        wide = sizes.where(F.col("children") > MAX_CHILDREN)
        light = nodes.join(wide, ["host", "above"]).where(F.col("pages") < HEAVY * F.col("all_pages")).select("host", "above", "own", F.lit(True).alias("wild"))
        segment = F.when(F.col("wild"), "<*>").otherwise(F.col("own"))
        template = F.when(F.size("segments") < level, F.col("above")).otherwise(F.concat("above", F.lit("/"), segment))
        shapes = shapes.join(light, ["host", "above", "own"], "left").withColumn(f"t{level}", template).drop("above", "own", "wild")
    return shapes


def _smallest(edges: pa.Table) -> pa.Table:
    """The smallest connected member of every branch in a node's edges (``low``, ``high``)."""
    least: dict[str, str] = {}

    def find(branch):
        while least.setdefault(branch, branch) != branch:
            branch = least[branch]
        return branch

    for low, high in zip(edges.column("low").to_pylist(), edges.column("high").to_pylist(), strict=True):
        x, y = sorted((find(low), find(high)))
        least[y] = x
    own = list(least)
    node = {c: [edges.column(c)[0].as_py()] * len(own) for c in ("host", "above")}
    return pa.table(node | {"own": own, "merged": [find(x) for x in own]})


def _merged(branches: DataFrame) -> DataFrame:
    """(``host``, ``above``, ``own``, ``merged``) of the branches that are merged, from (``host``, ``above``, ``own``, ``below``, ``n``, ``labelled``, ``blocked``).

    A node has few branches after generalising (heavy ones and a wildcard), so its pairs are few.
    """
    node = ["host", "above"]
    totals = branches.groupBy(*node, "own").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
    shares = branches.groupBy(*node, "own", "below").agg(F.sum("n").alias("part")).join(totals.select(*node, "own", "n"), [*node, "own"])
    share = stored(shares.select(*node, "own", "below", (F.col("part") / F.col("n")).alias("share")), "url-shares")
    low, high = (share.select(*node, "below", F.col("own").alias(side), F.col("share").alias(f"{side}_share")) for side in ("low", "high"))
    common = (
        low.join(high, [*node, "below"]).where("low < high")
        .groupBy(*node, "low", "high").agg(F.sum(F.least("low_share", "high_share")).alias("common"))
        .where(F.col("common") >= 1 - FAR_APART)
    )
    sides = common.join(totals.select(*node, F.col("own").alias("low"), F.col("labelled").alias("n1"), F.col("blocked").alias("k1")), [*node, "low"]).join(
        totals.select(*node, F.col("own").alias("high"), F.col("labelled").alias("n2"), F.col("blocked").alias("k2")), [*node, "high"]
    )
    both = "(k1 + k2) / (n1 + n2)"
    alike = f"n1 = 0 AND n2 = 0 OR n1 > 0 AND n2 > 0 AND abs(k1 / n1 - k2 / n2) <= {Z} * sqrt({both} * (1 - {both}) * (1 / n1 + 1 / n2))"
    edges = sides.where(alike).select(*node, "low", "high")
    return edges.groupBy(*node).applyInArrow(_smallest, "host string, above string, own string, merged string")


def templates(labelled: DataFrame) -> DataFrame:
    """One row per (``host``, ``shape``): ``template``, ``labelled``, ``blocked``, ``purity``, ``rejected``.

    ``labelled`` has ``host``, ``path`` and ``blocked`` (1, 0 or null).
    """
    shape = F.regexp_replace(F.regexp_replace("path", "[0-9]+", "<n>"), HEX_RUN, "<h>")
    shapes = labelled.groupBy("host", shape.alias("shape")).agg(
        F.count("*").alias("n"), F.count("blocked").alias("labelled"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("blocked")
    )
    segments = F.filter(F.split(F.col("shape"), "/"), lambda s: s != "")
    named = stored(_generalised(shapes.withColumn("segments", segments)), "url-shapes").withColumn("template", F.lit(""))
    for level in range(1, DEPTH + 1):
        before = F.char_length(f"t{level - 1}") if level > 1 else F.lit(0)
        rest = lambda start: F.substring(f"t{DEPTH}", start + 1, F.char_length(f"t{DEPTH}"))
        own = F.substring(f"t{level}", before + 1, F.char_length(f"t{level}"))
        rows = named.withColumnRenamed("template", "above").withColumn("own", own).withColumn("below", rest(F.char_length(f"t{level}")))
        # Shapes that end above have no branch here.
        merged = _merged(rows.where("own <> ''"))
        joined = rows.join(merged, ["host", "above", "own"], "left").withColumn("template", F.concat("above", F.coalesce("merged", "own")))
        named = stored(joined.drop("above", "own", "below", "merged"), "url-merged")
    per = stored(named.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")), "url-templates")
    everywhere = per.agg(F.try_divide(F.sum("blocked"), F.sum("labelled"))).first()[0] or 0.0
    hosts = per.groupBy("host").agg(((F.sum("blocked") + SMOOTHING * everywhere) / (F.sum("labelled") + SMOOTHING)).alias("host_share"))
    purity = (F.col("blocked") + SMOOTHING * F.col("host_share")) / (F.col("labelled") + SMOOTHING)
    judged = per.join(hosts, "host").withColumn("purity", purity).withColumn("rejected", (F.col("labelled") >= MIN_LABELLED) & (purity >= REJECT))
    return named.select("host", "shape", "template").join(judged, ["host", "template"])


def judged_urls(pages: DataFrame, rules=tuple(RULES), labels: DataFrame | None = None) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``template``, ``purity``, ``verdict``; ``labels`` (``page_id``, ``blocked``) replace the rules' ones."""
    text, verdict = rule_of(rules)
    rows = stored(parsed(pages).withColumn("rule", text).withColumn("by_rule", verdict), "urls")
    if labels is None:
        known = rows.withColumn("blocked", F.when(F.col("by_rule") == "block", 1).when(F.col("by_rule") == "allow", 0))
    else:
        known = rows.join(labels.select("page_id", F.col("blocked").cast("int").alias("blocked")), "page_id", "left")
    shape = F.regexp_replace(F.regexp_replace("path", "[0-9]+", "<n>"), HEX_RUN, "<h>")
    found = stored(templates(known).select("host", "shape", "template", "purity", "rejected"), "url-verdicts")
    method = F.when(F.col("rejected"), "block").otherwise("allow")
    return rows.withColumn("shape", shape).join(found, ["host", "shape"], "left").select(
        "page_id", "host", "path", "rule", "template", "purity", F.coalesce("by_rule", method).alias("verdict")
    )


def url_query(pages: DataFrame) -> DataFrame:
    return judged_urls(pages.select("page_id", "url"))
