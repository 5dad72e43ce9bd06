"""Labels for texts by their words: weights fitted to labelled texts in Spark, scores by a join.

A multinomial naive Bayes model with Laplace smoothing over every word of every labelled row. Bounds on rows and words are
for callers that want a smaller model; without them nothing is left out. Scoring covers every word of every text. The weights
are a table of at most a row for each word and label. Those of the most frequent words lie apart: they meet the words of a text
where these are, so that only words beside them are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repocensus.operators.ordering import written

COMMON = 50_000  # words that are looked up without a shuffle


def words(text: Column) -> Column:
    """Lower-case runs of letters and of punctuation."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+|[^\p{L}\s\d]+"), F.lit(0))


@dataclass(frozen=True)
class TextModel:
    """(word, label, weight) of all words and (label, prior, unknown) of each label.

    ``common`` words have a weight for each label in one row, by label; ``rare`` are the rows of all others.
    """

    weights: DataFrame
    common: DataFrame
    rare: DataFrame
    labels: DataFrame


def fit(labelled: DataFrame, rows: int | None = None, most_words: int | None = None) -> TextModel:
    """A model of (``text``, ``label``) rows: all of them and all their words, unless bounded.

    ``rows`` keeps at most so many texts of each label (those with the smallest hash), ``most_words`` the most frequent words.
    """
    chosen = labelled.where("label IS NOT NULL").select("text", "label")
    if rows is not None:
        chosen = _smallest_hashes(chosen, rows)
    counts = written(chosen.select("label", F.explode(words(F.col("text"))).alias("word")).groupBy("word", "label").agg(F.count("*").alias("n")), "words")
    frequent = lambda most: counts.groupBy("word").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "word").limit(most).select("word")
    if most_words is not None:
        counts = counts.join(written(frequent(most_words), "vocabulary"), "word")
    common = written(frequent(COMMON), "common")
    size = counts.select("word").distinct().count()
    totals = counts.groupBy("label").agg(F.sum("n").alias("total"))
    texts = written(chosen.groupBy("label").agg(F.count("*").alias("texts")), "labelled")
    every = texts.agg(F.sum("texts")).scalar()
    floor = F.log(F.lit(1.0) / (F.coalesce("total", F.lit(0)) + size + 1))
    labels = texts.join(totals, "label", "left").select("label", F.log(F.col("texts") / every).alias("prior"), floor.alias("unknown"), "total")
    # Weights are what a word says beyond an unknown one, so that rows of words a label never has are not needed.
    weight = F.log((F.col("n") + 1.0) / (F.col("total") + size + 1)) - F.col("unknown")
    weights = counts.join(labels.select("label", "total", "unknown"), "label").select("word", "label", weight.alias("weight"))
    weights = written(weights, "weights")
    labels = written(labels.drop("total"), "labels")
    names = [r["label"] for r in labels.select("label").orderBy("label").collect()]  # a few
    by_label = F.map_from_entries(F.collect_list(F.struct("label", "weight")))
    one_each = weights.join(common, "word", "left_semi").groupBy("word").agg(by_label.alias("by_label"))
    every_label = F.array(*[F.coalesce(F.try_element_at("by_label", F.lit(name)), F.lit(0.0)) for name in names]).cast("array<double>")
    return TextModel(
        weights,
        written(one_each.select("word", every_label.alias("weights")), "common"),
        written(weights.join(common, "word", "left_anti"), "rare"),
        labels,
    )


def _smallest_hashes(given: DataFrame, rows: int) -> DataFrame:
    # The smallest hashes by label, first in parts of it, so that no task sees a label's texts.
    hashed = given.withColumn("h", F.xxhash64("text", "label"))
    part = Window.partitionBy("label", F.pmod("h", F.lit(64))).orderBy("h", "text")
    some = hashed.withColumn("n", F.row_number().over(part)).where(F.col("n") <= rows)
    return some.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("h", "text"))).where(F.col("n") <= rows)


def predicted(texts: DataFrame, model: TextModel, key: str) -> DataFrame:
    """(``key``, ``label``) of the most probable label of each text, by name among equals."""
    # A text's words lie in one task: what is shuffled is a number for each text and label, and the words that are not common.
    found = texts.select(key, words(F.col("text")).alias("words"))
    n = model.labels.count()
    looked_up = found.select(key, F.explode_outer("words").alias("word")).join(model.common, "word", "left")
    sums = F.array(*[F.sum(F.get("weights", F.lit(i))) for i in range(n)]).cast("array<double>")
    sizes = looked_up.groupBy(key).agg(F.count("word").alias("all"), sums.alias("sums"))
    others = found.select(key, F.explode("words").alias("word")).join(model.common, "word", "left_anti").join(model.rare, "word")
    known = others.groupBy(key, "label").agg(F.sum("weight").alias("known"))
    labels = model.labels.agg(F.array_sort(F.collect_list(F.struct("label", "prior", "unknown")))).scalar()
    scored = sizes.select("*", F.posexplode(labels).alias("at", "by")).select(key, "all", F.get("sums", F.col("at")).alias("sum"), "by.*")
    scored = scored.join(known, [key, "label"], "left")
    score = F.col("prior") + F.col("all") * F.col("unknown") + (F.coalesce("sum", F.lit(0.0)) + F.coalesce("known", F.lit(0.0)))
    return scored.groupBy(key).agg(F.max_by("label", F.struct(score, F.col("label"))).alias("label"))
