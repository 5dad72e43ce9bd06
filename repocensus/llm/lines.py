"""Line dedup by a log-template tree (operator 1).

Lines are parsed at fixed depth: by their number of tokens, then by their first LEAD tokens, where tokens with
digits are fields already. A leaf with several different lines is generalised by how many of them have each token at
its place. The number that at least SIMILAR of a line's tokens reach is the size of the lines like it; tokens that
fewer lines have become fields, however many those are. Lines whose number is one stand for themselves. Two lines of
one template therefore agree in at least SIMILAR of their places, and more values of a field never make it constant.

A template found in MIN_DOCS documents or more recurs: its lines are dropped, but for those of the
first document (smallest ``doc_id``, null last) that has it. Lines with fewer than MIN_TOKENS tokens are not
generalised: they are leaves of their own, recurring as they are but for tokens with digits. Lines without tokens and
short lines of nothing but such tokens are no template. Everything is DataFrame functions; a leaf is never gathered, its tokens are counted.

Null text: no lines, empty result text. Repeated rows are documents of their own: the later ones lose their
lines. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repocensus.llm.tables import Scope, stored

LEAD = 3
MIN_TOKENS = 8
MIN_DOCS = 2
SIMILAR = 0.8
FIELD = "<*>"


def _raw_lines(text: Column) -> Column:
    """The lines of a text, white space in them as single blanks."""
    # Patterns are slow, plain searches fast: texts and lines in which a pattern can't match are left as they are. A
    # blank alone is no match of this one.
    text = F.coalesce(text, F.lit(""))
    odd = reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in ("  ", "\t", "\x0b", "\x0c", "\r")])
    single = F.when(odd, F.regexp_replace(text, r"\x20[\x20\x09\x0B-\x0D]++|[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*+", " ")).otherwise(text)
    return F.split(single, "\n", -1)


def _masked(line: Column) -> Column:
    """A line with FIELD for tokens with digits."""
    fields = F.regexp_replace(line, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*", FIELD)
    return F.trim(F.when(line.rlike("[0-9]"), fields).otherwise(line))


def _lines(docs: DataFrame) -> DataFrame:
    """``locator``, ``doc_id``, ``line`` (0-based) and ``masked`` of every line that can have a template."""
    # Masked before lines are rows of their own, as a filter on rows would be evaluated with its own copy of the patterns.
    rows = docs.select("locator", "doc_id", F.posexplode(F.transform(_raw_lines(F.col("text")), _masked)).alias("line", "masked"))
    # The number of tokens is that of blanks and one; no array is needed to know it.
    tokens = F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    short = F.col("tokens") < MIN_TOKENS
    lead = F.when(short, F.col("masked")).otherwise(F.substring_index("masked", " ", LEAD))
    named = F.replace(F.replace("masked", F.lit(FIELD), F.lit("")), F.lit(" "), F.lit("")) != ""
    return rows.withColumn("tokens", tokens).where(~short | named).withColumn("leaf", F.xxhash64("tokens", lead))


def recurring_lines(docs: DataFrame) -> DataFrame:
    """(``locator``, ``line``) of the lines to drop; ``docs`` has ``locator``, ``doc_id`` and ``text``."""
    # Tables that later ones replace are deleted as soon as these are written.
    spark, until_templates, until_named = docs.sparkSession, Scope(), Scope()
    lines = _lines(docs)
    with until_named:
        ids = stored(lines.select("locator", "doc_id", "line", "leaf", F.xxhash64("masked").alias("same")), "lines")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("locator").alias("locator"))).alias("first")
    with until_named:
        variants = stored(ids.groupBy("leaf", "same").agg(F.min(F.struct("locator", "line")).alias("sample"), F.count("*").alias("n")), "line-variants", shuffles_go=True)
    busy = variants.groupBy("leaf").agg(F.count("*").alias("kinds")).where("kinds > 1").select("leaf")

    # One sample of each different line of the busy leaves, as tokens; of a document only the lines that are samples.
    wanted = variants.join(busy, "leaf", "left_semi").select("sample.locator", F.struct("sample.line", "leaf", "same").alias("w"))
    of_doc = wanted.groupBy("locator").agg(F.collect_list("w").alias("wanted"))
    cut = docs.join(of_doc, "locator").select(_raw_lines(F.col("text")).alias("lines"), "wanted")
    samples = cut.select(F.explode(F.transform("wanted", lambda w: F.struct(w["leaf"], w["same"], _masked(F.get("lines", w["line"])).alias("masked")))).alias("s"))
    split = samples.select("s.leaf", "s.same", F.posexplode(F.split("s.masked", " ", -1)).alias("place", "token"))
    with until_templates:
        tokens = stored(split.select("leaf", "same", "place", F.xxhash64("token").alias("token")), "line-tokens", shuffles_go=True)
    counts = tokens.groupBy("leaf", "place", "token").agg(F.count("*").alias("lines"))
    counted = tokens.join(counts, ["leaf", "place", "token"])
    # Places come in order, so that equal templates have equal hashes.
    of_line = counted.groupBy("leaf", "same").agg(F.sort_array(F.collect_list(F.struct("place", "token", "lines"))).alias("t"))
    reached = F.get(F.sort_array("t.lines"), (F.size("t") - F.ceil(F.size("t") * SIMILAR)).cast("int"))
    kept = F.transform(F.filter("t", lambda x: x.lines >= F.col("alike")), lambda x: F.struct(x.place, x.token))
    general = of_line.withColumn("alike", reached).where("alike > 1").select("leaf", "same", F.xxhash64("leaf", kept).alias("template"))
    every = variants.select("leaf", "same").join(general, ["leaf", "same"], "left")
    with until_named:
        of_variant = stored(every.select("leaf", "same", F.coalesce("template", F.xxhash64("leaf", "same")).alias("template")), "line-templates", shuffles_go=True)
    until_templates.delete(spark)
    named = stored(ids.join(of_variant, ["leaf", "same"]).select("locator", "doc_id", "line", "template"), "line-named", shuffles_go=True)
    until_named.delete(spark)
    # Documents of a template: first and last differ exactly if there are two or more.
    per_doc = named.groupBy("template", "locator").agg(F.min("doc_id").alias("doc_id"))
    owners = per_doc.groupBy("template").agg(first, F.count("*").alias("docs")).where(F.col("docs") >= MIN_DOCS)
    return (
        named.join(owners.select("template", F.col("first.locator").alias("owner")), "template")
        .where("locator <> owner")
        .select("locator", "line")
    )


def deduplicated_lines(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_lines``, ``dropped`` (0-based line numbers) and ``text`` without them, for every row."""
    staged = stored(docs.select(F.monotonically_increasing_id().alias("locator"), "doc_id", "text"), "line-docs")
    drop = recurring_lines(staged).groupBy("locator").agg(F.sort_array(F.collect_list("line")).alias("dropped"))
    joined = staged.join(drop, "locator", "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    rest = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("dropped", i)), "\n")
    return joined.select("doc_id", F.size(lines).cast("long").alias("n_lines"), "dropped", F.when(F.size("dropped") > 0, rest).otherwise(F.coalesce("text", F.lit(""))).alias("text"))


def line_query(docs: DataFrame) -> DataFrame:
    found = deduplicated_lines(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
