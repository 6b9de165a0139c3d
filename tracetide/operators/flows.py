"""Bidirectional and one-way flows and their per-capture metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import with_capture_name
from ..functions.net import TCP, UDP, bidir_key
from ..session import settled
from .ordered import every_capture, exact_percentiles, top_n

CAP = "filename"
BIDIR = [CAP, "proto", "ip1", "port1", "ip2", "port2"]
UNIDIR = [CAP, "ip_version", "src", "dst", "sport", "dport", "proto"]


def flow_packets(packets: DataFrame) -> DataFrame:
    """Packets that belong to a flow: protocol number TCP or UDP, addresses and ports known."""
    complete = (
        F.col("proto_num").isin(TCP, UDP)
        & F.col("src").isNotNull() & F.col("dst").isNotNull()
        & F.col("sport").isNotNull() & F.col("dport").isNotNull()
        & F.col("ts_us").isNotNull() & F.col("frame_len").isNotNull()
    )
    return packets.where(complete).withColumn("proto", F.when(F.col("proto_num") == TCP, "tcp").otherwise("udp"))


def bidir_flows(packets: DataFrame) -> DataFrame:
    """One row per unordered endpoint pair of a capture.

    Packets are summed up by direction first, so a pair is put in order once for each direction, not for each packet.
    """
    ends = ["ip1", "port1", "ip2", "port2"]
    oneway = flow_packets(packets).groupBy(CAP, "proto", "src", "sport", "dst", "dport").agg(
        F.sum("frame_len").alias("bytes"),
        F.count(F.lit(1)).alias("packets"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
    )
    pair = settled(oneway, _pair=F.struct(*bidir_key()))
    keyed = pair.select(CAP, "proto", *(F.col(f"_pair.{c}") for c in ends), "bytes", "packets", "first_us", "last_us")
    return keyed.groupBy(*BIDIR).agg(
        F.sum("bytes").alias("bytes"),
        F.sum("packets").alias("packets"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        (F.max("last_us") - F.min("first_us")).alias("dur_us"),
    )


def _long_metrics(flows: DataFrame) -> DataFrame:
    pairs = F.create_map(
        F.lit("bytes"), F.col("bytes"), F.lit("dur_us"), F.col("dur_us"), F.lit("packets"), F.col("packets")
    )
    return flows.select(CAP, F.explode(pairs).alias("metric", "value"))


def flow_medians(flows: DataFrame) -> DataFrame:
    """Flow count and exact medians of bytes, duration and packets per capture."""
    med = exact_percentiles(_long_metrics(flows), [CAP, "metric"], "value", {"med": 0.5})

    def one(metric: str):
        return F.max(F.when(F.col("metric") == metric, F.col("med")))

    return med.groupBy(CAP).agg(
        F.max("n").alias("flows"),
        one("bytes").alias("median_bytes_per_flow"),
        (one("dur_us") / 1e6).alias("median_dur_s"),
        one("packets").alias("median_pkts_per_flow"),
    )


def flow_metrics(packets: DataFrame, tool_log: DataFrame | None = None) -> DataFrame:
    """Flow structure of each capture. A capture without flows keeps its row with nulls."""
    if tool_log is None:
        tool_log = packets.groupBy(CAP).agg(
            ((F.max("ts_us") - F.min("ts_us")) / 1e6).alias("capture_duration_s"),
            F.lit(0).alias("capinfos_truncated"),
            F.lit("").alias("capinfos_stderr"),
            F.lit("").alias("error"),
        )
    rows = tool_log.join(flow_medians(bidir_flows(packets)), CAP, "left").fillna(0, ["flows"])
    minutes = F.col("capture_duration_s") / 60.0
    return with_capture_name(rows, allow_pcap=True).select(
        CAP, "profile", "duration_label", "duration_requested_min", "run_idx", "capture_duration_s",
        "capinfos_truncated", "capinfos_stderr", "flows",
        F.when(F.col("capture_duration_s") > 0, F.round(F.col("flows") / minutes, 6)).alias("flows_per_min"),
        "median_bytes_per_flow", "median_dur_s", "median_pkts_per_flow",
        F.coalesce("error", F.lit("")).alias("error"),
        F.col(CAP).alias("path"),
    )


def unidir_flows(packets: DataFrame) -> DataFrame:
    """One-way flows.

    A flow starts at its first packet, or at the first one with a usable time when
    that one has none, and ends at the last usable time in capture order.
    """
    rows = packets.where(
        F.col("src").isNotNull() & F.col("dst").isNotNull()
        & F.col("sport").isNotNull() & F.col("dport").isNotNull()
        & F.col("proto_num").isin(TCP, UDP)
    ).withColumn("proto", F.when(F.col("proto_num") == TCP, "TCP").otherwise("UDP"))
    usable = F.when(F.col("ts_us") > 0, F.col("packet_no"))
    agg = rows.groupBy(*UNIDIR).agg(
        F.min("packet_no").alias("first_no"),
        F.min_by("ts_us", "packet_no").alias("seen_us"),
        F.coalesce(F.min_by("ts_us", usable), F.lit(0)).alias("start_us"),
        F.coalesce(F.max_by("ts_us", usable), F.lit(0)).alias("end_us"),
        F.sum("frame_len").alias("bytes"),
        F.count(F.lit(1)).alias("packets"),
    )
    ordered = (F.col("start_us") > 0) & (F.col("end_us") >= F.col("start_us"))
    return agg.withColumn("dur_us", F.when(ordered, F.col("end_us") - F.col("start_us")).otherwise(0))


def unidir_summary(packets: DataFrame, unidir: DataFrame | None = None) -> DataFrame:
    """Totals, rate and medians of the one-way flows of every capture; all are 0 where there is none.

    ``unidir`` is the table of one-way flows where it is known already.
    """
    span = packets.where(F.col("ts_us") > 0).groupBy(CAP).agg(
        ((F.max("ts_us") - F.min("ts_us")) / 6e7).alias("_minutes")
    )
    flows = unidir_flows(packets) if unidir is None else unidir
    total = flows.groupBy(CAP).agg(F.sum("bytes").alias("bytes_total"), F.sum("packets").alias("packets_total"))
    found = (
        flow_medians(flows).join(total, CAP).join(span, CAP, "left")
        .select(
            CAP, "flows", "bytes_total", "packets_total",
            F.when(F.col("_minutes") > 0, F.round(F.col("flows") / F.col("_minutes"), 6)).otherwise(0.0).alias("flows_per_min"),
            "median_bytes_per_flow", "median_dur_s", "median_pkts_per_flow",
        )
    )
    return every_capture(packets, found, found.columns[1:])


def top_flows(packets: DataFrame, n: int = 15, unidir: DataFrame | None = None) -> DataFrame:
    """Largest one-way flows of each capture; equal sizes keep first-seen order."""
    best = top_n(unidir_flows(packets) if unidir is None else unidir, [CAP], [F.desc("bytes"), F.asc("first_no")], n)
    return best.select(*UNIDIR, "rank", "bytes", "packets", (F.col("dur_us") / 1e6).alias("duration_s"))
