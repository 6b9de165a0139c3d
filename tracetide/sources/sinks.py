"""Writers for metric tables and per-capture reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITION = ("profile", "duration_label")


def sink_metrics(metrics: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Per-capture metrics, partitioned by condition (parquet) or as one table with header (csv)."""
    if fmt == "parquet":
        metrics.write.mode("overwrite").partitionBy(*PARTITION).parquet(path)
    else:
        metrics.write.mode("overwrite").option("header", True).csv(path)


def report_documents(metrics: DataFrame) -> DataFrame:
    """One JSON document per capture holding all its metrics; nulls are written."""
    body = F.to_json(F.struct(*metrics.columns), {"ignoreNullFields": "false"})
    return metrics.select("filename", body.alias("document"))


def sink_report_json(metrics: DataFrame, path: str) -> None:
    report_documents(metrics).select("document").write.mode("overwrite").text(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """A line for each row, in a folder for each capture name: its document, and rows that continue it in any order."""
    documents.select("filename", "document").write.mode("overwrite").partitionBy("filename").text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(filename, document) of written documents."""
    return spark.read.schema("value string, filename string").text(path).select("filename", F.col("value").alias("document"))


def sink_qc_report(lines: DataFrame, path: str) -> None:
    """Write report lines (section, place, filename, line) as text in their order: part files follow one another."""
    lines.orderBy("section", "place", "filename").select("line").write.mode("overwrite").text(path)
