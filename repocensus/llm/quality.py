"""Host-level quality rules (operator 5).

Each document is measured once by an Arrow function (only counts leave it). Failures of four soft
rules are summed by host, each host's failure rates are shrunk towards the corpus by a beta prior
fitted to the hosts themselves, and the hosts' verdicts are joined back to the documents.

* A document goes if it breaks a base rule, or two soft rules, or a soft rule for which its host
  is flagged. A document that breaks no rule stays, whatever its host.
* Null text: no words, so it fails the base rule. Null source: a host of its own. Repeated rows are
  judged row by row. An empty table gives an empty result. Columns other than ``doc_id``,
  ``text`` and ``source`` are only carried, inside ``doc``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repocensus.llm.tables import arrow_batches, stored, utf8

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
HOST_LIMIT = 0.3
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

SOFT_RULES = {
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "repeats": "100 * n_repeat_words > 20 * n_words",
}


def repeated_words(words: list[bytes]) -> int:
    """Words lying in a window of three words that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    pairs = ids[:-1] * len(seen) + ids[1:]
    if len(seen) > 2_000_000:  # three ids would not fit 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(seen) + ids[2:]
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    twice = times[which] > 1
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= twice
    return int(inside.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """COUNTS of one UTF-8 text."""
    words = text.split()
    joined = b"".join(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(joined.decode("utf-8", "replace")),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def _counts(texts: pa.Array) -> pa.Array:
    rows = [measure(t.as_py()) for t in texts]
    columns = list(zip(*rows, strict=True)) or [[]] * len(COUNTS)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], COUNTS)


def measured(docs: DataFrame) -> DataFrame:
    """``doc`` (the whole row), ``host`` and COUNTS of every document, as a stored table."""
    arrow_batches(docs.sparkSession)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("source").alias("host"), _counts(utf8()).alias("n")
    )
    return rows.select("doc", "host", "n.*")


def host_verdicts(counts: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: ``host``, ``n_docs``, and per soft rule ``rate_<rule>`` (shrunk) and ``bad_<rule>``.

    The prior's mean is the failure rate of all documents; its strength comes from the variance of
    the hosts' rates beyond what binomial noise explains (at least 1, at most 10,000 documents).
    """
    hosts = stored(
        counts.groupBy("host").agg(
            F.count("*").alias("n_docs"),
            *[F.sum(F.expr(f"CAST({rule} AS INT)")).alias(f"f_{name}") for name, rule in SOFT_RULES.items()],
        ),
        "hosts",
    )
    fitted = [
        x
        for name in SOFT_RULES
        for x in (
            (F.sum(f"f_{name}") / F.sum("n_docs")).alias(f"m_{name}"),
            F.var_pop(F.col(f"f_{name}") / F.col("n_docs")).alias(f"v_{name}"),
        )
    ]
    prior = hosts.agg(F.avg(1 / F.col("n_docs")).alias("noise"), *fitted).first()
    columns = []
    for name in SOFT_RULES:
        mean = prior[f"m_{name}"] or 0.0
        spread = mean * (1 - mean)
        beyond = (prior[f"v_{name}"] or 0.0) - spread * (prior["noise"] or 0.0)
        strength = min(max(spread / beyond - 1, 1.0), 10_000.0) if beyond > 0 else 10_000.0
        rate = (F.col(f"f_{name}") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
        columns += [rate.alias(f"rate_{name}"), (rate > host_limit).alias(f"bad_{name}")]
    return hosts.select("host", "n_docs", *columns)


def host_quality(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """Every document as ``doc`` with COUNTS, ``base_failed``, ``broken`` (names of soft rules) and ``kept``."""
    counts = stored(measured(docs), "quality")
    hosts = stored(host_verdicts(counts, host_limit), "host-verdicts").withColumnRenamed("host", "of_host")
    base = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"
    broken = F.filter(F.array(*[F.expr(f"IF({rule}, '{name}', NULL)") for name, rule in SOFT_RULES.items()]), lambda x: x.isNotNull())
    flagged = " OR ".join(f"({rule}) AND bad_{name}" for name, rule in SOFT_RULES.items())
    judged = counts.join(hosts, F.col("host").eqNullSafe(F.col("of_host")), "left").select(
        "doc", "host", *COUNTS, F.expr(base).alias("base_failed"), broken.alias("broken"), F.expr(flagged).alias("host_failed")
    )
    kept = ~F.col("base_failed") & ~F.col("host_failed") & (F.size("broken") < 2)
    return judged.withColumn("kept", kept)


def quality_stage(docs: DataFrame) -> DataFrame:
    """The documents that pass."""
    return host_quality(docs).where("kept").select("doc.*")


def quality_query(docs: DataFrame) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    # Other columns are not staged.
    slim = docs.select("doc_id", "text", "source")
    return host_quality(slim).select(F.col("doc.doc_id").alias("doc_id"), *columns[1:])


QUALITY_SQL = r"""
WITH words AS (
  SELECT doc_id, source, COALESCE(text, '') AS text,
         regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (
  SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) - COUNT(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS times FROM (
    SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3))),
repeats AS (
  SELECT doc_id, COUNT(DISTINCT spot) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS spot FROM windows WHERE times > 1) GROUP BY doc_id),
counts AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    COALESCE(n_lines, 0) AS n_lines, CAST(COALESCE(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(COALESCE(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
rules AS (
  SELECT *, (word_chars < 2 * n_words OR word_chars > 15 * n_words) AS r1, 10 * n_symbols > n_words AS r2,
    10 * n_dup_lines > 3 * n_lines AS r3, 100 * n_repeat_words > 20 * n_words AS r4 FROM counts),
hosts AS (
  SELECT source, r, COUNT(*) AS n, SUM(CAST(broke AS INT)) AS f
  FROM (SELECT source, unnest([1, 2, 3, 4]) AS r, unnest([r1, r2, r3, r4]) AS broke FROM rules) GROUP BY source, r),
prior AS (
  SELECT r, SUM(f) / SUM(n) AS m, var_pop(f / n) - SUM(f) / SUM(n) * (1 - SUM(f) / SUM(n)) * AVG(1 / n) AS beyond
  FROM hosts GROUP BY r),
strengths AS (
  SELECT r, m, CASE WHEN beyond > 0 THEN LEAST(GREATEST(m * (1 - m) / beyond - 1, 1.0), 10000.0) ELSE 10000.0 END AS k FROM prior),
bad AS (SELECT source, r, (f + m * k) / (n + k) > 0.3 AS bad FROM hosts JOIN strengths USING (r)),
flags AS (
  SELECT source, bool_or(bad AND r = 1) AS b1, bool_or(bad AND r = 2) AS b2, bool_or(bad AND r = 3) AS b3,
    bool_or(bad AND r = 4) AS b4 FROM bad GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ((r1 AND b1) OR (r2 AND b2) OR (r3 AND b3) OR (r4 AND b4))
    AND CAST(r1 AS INT) + CAST(r2 AS INT) + CAST(r3 AS INT) + CAST(r4 AS INT) < 2 AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM rules) d
JOIN flags f ON d.source IS NOT DISTINCT FROM f.source
"""
