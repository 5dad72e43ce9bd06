"""The operators' registered queries: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from repocensus.llm import exact, lines, lm, mixing, packing, phrases, pii, quality, repair, simhash, suffixes, tokens, urls
from repocensus.plans.registry import Entry

ENTRIES: dict[str, Entry] = {}


def _over(table: str, name: str, query: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(spark.read.parquet(f"{sf_dir}/{table}.parquet"))

    ENTRIES[name] = Entry(run, sql)


_over("documents", "op2_simhash_pivots", simhash.simhash_query)
_over("documents", "op4_exact_dedup", exact.exact_query, exact.EXACT_SQL)
_over("documents", "op5_host_quality", quality.quality_query, quality.QUALITY_SQL)
_over("documents", "op6_packing", packing.packed)
_over("documents", "op9_mixing", mixing.mix_query)
_over("documents", "op3_personal_data", pii.pii_query)
_over("pages", "op7_url_templates", urls.url_query)
_over("documents", "op8_token_counts", tokens.token_query)
_over("documents", "op10_kneser_ney", lm.lm_query)
_over("documents", "op1_line_templates", lines.line_query)
_over("conversations", "op11_cyk_repair", repair.repair_query, repair.REPAIR_SQL)
_over("documents", "op12_suffix_merge", suffixes.suffix_dedup, suffixes.SUFFIX_SQL)
_over("documents", "op13_phrase_automata", phrases.phrase_query, phrases.PHRASE_SQL)
