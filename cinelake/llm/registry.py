"""Queries and DuckDB statements of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cinelake.llm import (
    centroids,
    decontaminate,
    exact_repeats,
    pieces,
    quality_rules,
    secret_scan,
    sharding,
    simhash,
    suffix_tree,
    surrogates,
    weak_labels,
    whitening,
    word_repeats,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_surrogates": surrogates.query,
    "op2_simhash": simhash.query,
    "op3_weak_labels": weak_labels.query,
    "op4_sharding": sharding.query,
    "op5_suffix_tree": suffix_tree.query,
    "op6_pieces": pieces.query,
    "op7_secret_scan": secret_scan.query,
    "op8_exact_repeats": exact_repeats.query,
    "op9_decontaminate": decontaminate.query,
    "op10_quality_rules": quality_rules.query,
    "op11_centroids": centroids.query,
    "op12_word_repeats": word_repeats.query,
    "op13_whitening": whitening.query,
}

#: SQL has no XXH64, CRC-32 or search for pieces, and is too slow for the exact repeats of whole tables: those
#: queries are tested against plain Python.
ORACLE_SQL: dict[str, str] = {
    "op7_secret_scan": secret_scan.SQL,
    "op9_decontaminate": decontaminate.SQL,
    "op11_centroids": centroids.SQL,
    "op12_word_repeats": word_repeats.SQL,
}
