"""A training corpus from raw documents: rules, line dedup, near duplicates, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracetide.llm import decontaminate, line_dedup, ngram_join, packing, quality
from tracetide.llm.common import scratch, ship, staged
from tracetide.session import remove, work_path

#: (name, function): each takes (spark, docs, sf_dir) and returns the next stage's documents; the last packs them.
STAGES = [
    ("quality_rules", quality.stage),
    ("line_dedup", line_dedup.stage),
    ("ngram_jaccard_join", ngram_join.stage),
    ("decontamination", decontaminate.stage),
    ("packing", packing.stage),
]

#: Token packing has no SQL form; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again by the next.

    Null and empty texts fail the quality rules and go there. Rows that repeat an id are rows of their own until the join,
    which keeps the smallest id of each group; rows without an id are never near duplicates. Very long texts pass whole, an
    empty table gives an empty result, and columns of any names are carried up to the last stage, which returns pieces.
    What a stage wrote on its way, and the documents it read, are deleted as soon as its own result is written.
    """
    ship(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        path = work_path(spark, name)
        with scratch(spark):
            docs = staged(stage(spark, docs, sf_dir), name, path)
        remove(spark, before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
