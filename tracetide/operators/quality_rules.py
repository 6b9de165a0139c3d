"""Rule-based quality control of capture summaries, and manifest checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import CAPTURE_NAME, duration_seconds
from ..functions.numbers import fixed_text, lenient_float, lenient_int

# The 14 component groups of a run manifest.
MANIFEST_GROUPS = (
    "hypervisor", "host_platform", "vm_image_id", "snapshot_id", "guest_os_build", "virtual_hardware",
    "network_configuration", "capture_point", "capture_interface", "capture_toolchain",
    "agent_versioning", "run_parameters", "artifacts", "llm_configuration",
)


def _joined(reasons: list[Column], sep: str) -> Column:
    return F.array_join(F.array_compact(F.array(*reasons)), sep)


def duration_reason(tolerance: float = 0.05) -> Column:
    """Text when a known duration lies outside target * (1 -/+ tolerance); bounds are inside."""
    name = F.trim("filename")
    label = F.when(name.rlike(CAPTURE_NAME), F.regexp_extract(name, CAPTURE_NAME, 2))
    target = duration_seconds(label).cast("double")
    secs = lenient_float(F.trim(F.col("capture_duration_s").cast("string")))
    lo, hi = target * (1 - tolerance), target * (1 + tolerance)
    text = F.concat(
        F.lit("duration_out_of_range("), fixed_text(secs, 1), F.lit("s not in ["),
        fixed_text(lo, 1), F.lit(","), fixed_text(hi, 1), F.lit("])"),
    )
    return F.when(secs.isNotNull() & target.isNotNull() & ~secs.between(lo, hi), text)


def qc_flags(summary: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Severity (hard, soft or null) and reason text of every capture.

    Hard: truncated or with an error; a duration reason is only added to these.
    Soft: not hard, and totals that do not add up or a duration out of range.
    """
    err = F.trim(F.coalesce(F.col("error"), F.lit("")))
    truncated = lenient_int(F.col("capinfos_truncated").cast("string")) == 1
    consistent = lenient_int(F.trim(F.col("totals_consistent").cast("string")), -1)
    out = summary.select(
        F.trim(F.coalesce("filename", F.lit(""))).alias("filename"),
        duration_reason(tolerance).alias("duration_reason"),
        _joined([F.when(truncated, "capinfos_truncated=1"), F.when(err != "", F.concat(F.lit("error="), err))], "; ").alias("_hard"),
        F.when(consistent == 0, "totals_consistent=0").alias("_totals"),
    )
    hard = F.col("_hard") != ""
    soft = _joined([F.col("_totals"), F.col("duration_reason")], "; ")
    hard_text = _joined([F.col("_hard"), F.col("duration_reason")], "; ")
    return out.select(
        "filename",
        "duration_reason",
        F.when(hard, "hard").when(soft != "", "soft").alias("severity"),
        F.when(hard, hard_text).when(soft != "", soft).alias("reasons"),
    )


def qc_duration(summary: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Captures whose duration is out of range, with the reason; unknown labels and durations have none."""
    return qc_flags(summary, tolerance).where(F.col("duration_reason").isNotNull()).select("filename", "duration_reason")


def qc_hard(summary: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Captures to record again: cut short or with an error, and why."""
    return qc_flags(summary, tolerance).where(F.col("severity") == "hard").select("filename", "reasons")


def qc_soft(summary: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Captures to look at: totals that do not fit or a duration out of range; never one of the hard list."""
    return qc_flags(summary, tolerance).where(F.col("severity") == "soft").select("filename", "reasons")


def qc_union(hard: DataFrame, soft: DataFrame) -> DataFrame:
    """Both lists in one table; a hard capture is never soft."""
    return hard.withColumn("severity", F.lit("hard")).unionByName(soft.withColumn("severity", F.lit("soft")))


def qc_report(flagged: DataFrame, source: str) -> DataFrame:
    """Report lines with their order: a head, two sections, ``None.`` for an empty one.

    Columns section, place (0 for heads, 1 for entries), filename and line. Sort by
    the first three to write the text.
    """
    spark = flagged.sparkSession
    entries = flagged.select(
        F.when(F.col("severity") == "hard", 1).otherwise(2).alias("section"),
        F.lit(1).alias("place"),
        "filename",
        F.concat(F.lit("- "), "filename", F.lit(": "), "reasons").alias("line"),
    )
    heads = spark.range(1).select(
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("section"), F.lit(f"QC report for: {source}").alias("line")),
                F.struct(F.lit(1).alias("section"), F.lit("== Captures to re-capture (hard failures) ==").alias("line")),
                F.struct(F.lit(2).alias("section"), F.lit("== Suspicious captures (soft flags; review) ==").alias("line")),
            )
        ).alias("h")
    ).select("h.section", F.lit(0).alias("place"), F.lit("").alias("filename"), "h.line")
    used = entries.groupBy("section").agg(F.count(F.lit(1)).alias("_n"))
    none = (
        heads.where(F.col("section") > 0).join(used, "section", "left").where(F.col("_n").isNull())
        .select("section", F.lit(1).alias("place"), F.lit("").alias("filename"), F.lit("None.").alias("line"))
    )
    return heads.unionByName(entries).unionByName(none)


def qc_text(report: DataFrame) -> DataFrame:
    """The lines of a report with the empty lines before its sections; sort by section, place and filename."""
    blank = report.where(F.col("section") > 0).select("section").distinct().select(
        "section", F.lit(-1).alias("place"), F.lit("").alias("filename"), F.lit("").alias("line")
    )
    return report.unionByName(blank)


def manifest_check(manifests: DataFrame) -> DataFrame:
    """Missing component groups of each run manifest, and whether its checksums are there.

    Input: run id, the 14 group columns as text and ``artifact_checksums``.
    """
    gaps = [F.when(F.trim(F.coalesce(F.col(g), F.lit(""))) == "", F.lit(g)) for g in MANIFEST_GROUPS]
    missing = F.array_compact(F.array(*gaps))
    sums = F.trim(F.coalesce("artifact_checksums", F.lit("")))
    return manifests.select(
        "run_id",
        F.size(missing).alias("missing_groups"),
        F.array_join(missing, ",").alias("missing"),
        (sums != "").alias("has_checksums"),
        ((F.size(missing) == 0) & (sums != "")).alias("complete"),
    )


def error_policy(parts: list[Column], abort: bool = False) -> Column:
    """Error text of a row: the parts joined, or a failure of the job at the first one."""
    text = _joined(parts, " | ")
    if abort:
        return F.when(text != "", F.raise_error(F.concat(F.lit("aborted on error: "), text))).otherwise(text)
    return text
