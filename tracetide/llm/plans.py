"""Registered queries of the corpus operators: name -> (query, DuckDB twin or None)."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tracetide.llm import (
    chat,
    decontaminate,
    filter_audit,
    html_extract,
    language,
    licenses,
    line_dedup,
    ngram_join,
    packing,
    quality,
    token_files,
    toxicity,
    whitening,
)
from tracetide.llm.common import ship

Query = Callable[[SparkSession, str], DataFrame]


def _shipped(query: Query) -> Query:
    """The query, with this package in reach of the workers."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


_ALL: dict[str, tuple[Query, str | None]] = {
    "op1_ngram_jaccard_join": (ngram_join.op1_ngram_jaccard_join, None),
    "op2_decontamination": (decontaminate.op2_decontamination, decontaminate.SQL),
    "op3_language_id": (language.op3_language_id, None),
    "op4_token_files": (token_files.op4_token_files, None),
    "op5_html_extraction": (html_extract.op5_html_extraction, None),
    "op6_quality_rules": (quality.op6_quality_rules, quality.SQL),
    "op7_line_dedup": (line_dedup.op7_line_dedup, line_dedup.SQL),
    "op8_license_scan": (licenses.op8_license_scan, licenses.SQL),
    "op9_toxicity": (toxicity.op9_toxicity, None),
    "op10_packing": (packing.op10_packing, None),
    "op11_chat_formatting": (chat.op11_chat_formatting, None),
    "op12_filter_audit": (filter_audit.op12_filter_audit, filter_audit.SQL),
    "op13_embedding_whitening": (whitening.op13_embedding_whitening, None),
}
QUERIES = {name: (_shipped(query), sql) for name, (query, sql) in _ALL.items()}
