"""Inter-arrival gaps in capture order and in time order, and burstiness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flows import unidir_flows
from .ordered import every_capture, exact_percentiles, neighbours, packet_chunk, second_chunk, stitched

CAP = "filename"


def capture_order_gaps(packets: DataFrame) -> DataFrame:
    """Gap of each packet to the one before it in the capture; steps back in time are dropped."""
    pairs = neighbours(packets, [CAP], "packet_no", "ts_us", packet_chunk(F.col("packet_no")))
    return pairs.select(CAP, (F.col("cur") - F.col("prev")).alias("gap_us")).where(F.col("gap_us") >= 0)


def gap_summary(gaps: DataFrame, weight: str | None = None) -> DataFrame:
    """Count, mean, median, p95 and largest gap per capture, in seconds."""
    pct = exact_percentiles(gaps, [CAP], "gap_us", {"median": 0.5, "p95": 0.95}, weight)
    return pct.select(
        CAP, F.col("n").alias("gaps"),
        F.round(F.col("sum") / F.col("n") / 1e6, 9).alias("mean_s"),
        (F.col("median") / 1e6).alias("median_s"), F.round(F.col("p95") / 1e6, 9).alias("p95_s"),
        (F.col("max") / 1e6).alias("max_s"),
    )


def iat_capture_order(packets: DataFrame) -> DataFrame:
    """Gap statistics of every capture; one without gaps has 0 of them and nulls."""
    return every_capture(packets, gap_summary(capture_order_gaps(packets)), ["gaps"])


def gap_count(packets: DataFrame, threshold_ms: float = 100.0) -> DataFrame:
    """Gaps above the threshold; every capture has a row."""
    over = capture_order_gaps(packets).groupBy(CAP).agg(
        F.count_if(F.col("gap_us") > threshold_ms * 1000.0).alias("gaps_over_threshold")
    )
    return packets.select(CAP).distinct().join(over, CAP, "left").fillna(0, ["gaps_over_threshold"])


def sorted_gaps(rows: DataFrame, time: str) -> DataFrame:
    """Gaps between time-sorted rows as (capture, gap_us, n).

    Equal times are counted first: they give gaps of zero, and only the distinct
    times need an order. Counts are formed before the shuffle, so a second that holds a
    whole capture moves at most one row for each task and microsecond.
    """
    placed = rows.select(CAP, F.col(time).alias("cur"), second_chunk(F.col(time)).alias("_chunk"))
    times = placed.groupBy(CAP, "_chunk", "cur").agg(F.count(F.lit(1)).alias("n")).repartition(CAP, "_chunk")
    pairs = stitched(times.withColumn("_order", F.col("cur")), [CAP])
    steps = pairs.select(CAP, (F.col("cur") - F.col("prev")).alias("gap_us"), F.lit(1).cast("bigint").alias("n"))
    ties = times.where(F.col("n") > 1).select(CAP, F.lit(0).cast("bigint").alias("gap_us"), (F.col("n") - 1).alias("n"))
    return steps.unionByName(ties)


def packet_gaps(packets: DataFrame) -> DataFrame:
    return sorted_gaps(packets.where(F.col("ts_us") > 0), "ts_us")


def newflow_gaps(packets: DataFrame, unidir: DataFrame | None = None) -> DataFrame:
    """Gaps between flow starts; ``unidir`` is the table of one-way flows where it is known already."""
    return sorted_gaps(unidir_flows(packets) if unidir is None else unidir, "seen_us")


def iat_sorted(packets: DataFrame) -> DataFrame:
    """Gaps between usable times in order; a capture with fewer than two has 0 of them and nulls."""
    return every_capture(packets, gap_summary(packet_gaps(packets), "n"), ["gaps"])


def newflow_iat(packets: DataFrame) -> DataFrame:
    """Gaps between the starts of one-way flows in order; every capture has a row."""
    return every_capture(packets, gap_summary(newflow_gaps(packets), "n"), ["gaps"])


def burstiness(gaps: DataFrame, captures: DataFrame, name: str) -> DataFrame:
    """(s - m) / (s + m) over positive gaps; 0 with fewer than two of them.

    Positive gaps are steps between distinct times, so each counts once.
    """
    m, s = F.avg("gap_us"), F.stddev_samp("gap_us")
    b = F.when(F.count(F.lit(1)) >= 2, F.round((s - m) / (s + m), 6))
    stats = gaps.where(F.col("gap_us") > 0).groupBy(CAP).agg(b.alias(name))
    return captures.join(stats, CAP, "left").fillna(0.0, [name])


def burstiness_report(packets: DataFrame, unidir: DataFrame | None = None) -> DataFrame:
    """Burstiness of packets and of new flows; every capture has a row, 0 with too little data."""
    captures = packets.select(CAP).distinct()
    first = burstiness(packet_gaps(packets), captures, "burstiness_pkt_iat")
    return burstiness(newflow_gaps(packets, unidir), first, "burstiness_newflow_iat")
