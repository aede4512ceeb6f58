"""The queries of this subpackage and their DuckDB oracles, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from convoylake.llm import (
    byte_bpe,
    decontaminate,
    html_extract,
    kneser_ney,
    language_id,
    license_scan,
    lm_scoring,
    ngram_jaccard,
    rabitq,
    ranked_search,
    spelling,
    suffix_dedup,
    token_counts,
)

# imported here, so that a missing library shows as this package's import error and not as a query's
MODULES = (html_extract, ngram_jaccard, decontaminate, rabitq, suffix_dedup, byte_bpe, lm_scoring, language_id, license_scan, kneser_ney, ranked_search, spelling, token_counts)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {}
    for module in MODULES:
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for module in MODULES:
        found |= module.ORACLES
    return found
