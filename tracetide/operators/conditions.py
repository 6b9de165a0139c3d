"""Condition tables: one row per profile and duration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import (
    DURATIONS, PROFILES, duration_group, duration_rank, profile_rank, with_capture_name,
)
from ..functions.text import median_iqr_cell

# Metric columns of the flow table with the decimals they are shown with.
FLOW_TABLE = {
    "flows": None,
    "flows_per_min": 2,
    "median_bytes_per_flow": None,
    "median_dur_s": 4,
    "median_pkts_per_flow": None,
}


def condition_cells(spark: SparkSession, profiles=PROFILES, durations=DURATIONS) -> DataFrame:
    """Every profile and duration, built from the fixed lists alone."""
    return spark.range(1).select(F.explode(F.array(*map(F.lit, profiles))).alias("profile")).select(
        "profile", F.explode(F.array(*map(F.lit, durations))).alias("duration")
    )


def valid_runs(rows: DataFrame) -> DataFrame:
    """Rows with a parsed name, not truncated and without an error text."""
    return rows.where(
        (F.coalesce("profile", F.lit("")) != "")
        & (F.coalesce("duration_label", F.lit("")) != "")
        & (F.coalesce(F.col("capinfos_truncated").cast("int"), F.lit(0)) != 1)
        & (F.trim(F.coalesce("error", F.lit(""))) == "")
    )


def condition_stats(metrics: DataFrame) -> DataFrame:
    """Median and IQR of each metric per condition. Input: one row per capture."""
    quart = {c: F.percentile(F.col(c).cast("double"), F.lit([0.25, 0.5, 0.75])) for c in FLOW_TABLE}
    grouped = (
        valid_runs(metrics)
        .groupBy("profile", duration_group(F.col("duration_label")).alias("duration"))
        .agg(F.count(F.lit(1)).alias("runs"), *[q.alias(f"_{c}") for c, q in quart.items()])
    )
    cols = []
    for c in FLOW_TABLE:
        cols.append(F.col(f"_{c}")[1].alias(f"{c}_med"))
        cols.append((F.col(f"_{c}")[2] - F.col(f"_{c}")[0]).alias(f"{c}_iqr"))
    return grouped.select("profile", "duration", "runs", *cols)


def condition_table(metrics: DataFrame) -> DataFrame:
    """All nine conditions in report order; an empty one has 0 runs and null values."""
    grid = condition_cells(metrics.sparkSession)
    stats = condition_stats(metrics)
    out = grid.join(stats, ["profile", "duration"], "left").fillna(0, ["runs"])
    return out.orderBy(profile_rank(F.col("profile")), duration_rank(F.col("duration")))


def condition_text(table: DataFrame) -> DataFrame:
    """The same table as report cells."""
    return table.select(
        "profile", "duration",
        *[
            median_iqr_cell(F.col(f"{c}_med"), F.col(f"{c}_iqr"), digits).alias(c)
            for c, digits in FLOW_TABLE.items()
        ],
    )


def condition_coverage(captures: DataFrame) -> DataFrame:
    """Every condition with its number of captures, 0 included."""
    named = with_capture_name(captures)
    have = named.groupBy("profile", duration_group(F.col("duration_label")).alias("duration")).agg(
        F.count(F.lit(1)).alias("captures")
    )
    return condition_cells(captures.sparkSession).join(have, ["profile", "duration"], "left").fillna(0, ["captures"])


def matrix_coverage(captures: DataFrame, runs: int = 5) -> DataFrame:
    """Deviations from one capture per profile, duration and run.

    Input: one row per capture file. Status is missing, extra or duplicated; a file
    whose name does not parse is extra.
    """
    want = condition_cells(captures.sparkSession).select(
        "profile", "duration", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run_idx"), F.lit(1).alias("want")
    )
    named = with_capture_name(captures).withColumn("duration", duration_group(F.col("duration_label")))
    # names that do not parse have null keys: they match no cell and stay apart
    odd = F.when(F.col("profile").isNull() | F.col("run_idx").isNull(), F.col("filename"))
    have = named.groupBy("profile", "duration", "run_idx", odd.alias("_odd")).agg(
        F.count(F.lit(1)).alias("have"), F.min("filename").alias("filename")
    )
    status = (
        F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("have") > 1, "duplicated")
    )
    both = want.join(have, ["profile", "duration", "run_idx"], "full_outer").withColumn("status", status)
    return both.where(F.col("status").isNotNull()).select(
        "profile", "duration", "run_idx", F.coalesce("have", F.lit(0)).alias("have"), "filename", "status"
    )


def report_order(rows: DataFrame) -> DataFrame:
    """Captures by profile, duration and name in report order, with their place."""
    dur = duration_group(F.col("duration_label"))
    return rows.withColumns(
        {"profile_place": profile_rank(F.col("profile")), "duration_place": duration_rank(dur)}
    ).orderBy("profile_place", "duration_place", "filename")
