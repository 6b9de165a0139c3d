"""Per-capture packet summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import with_capture_name
from .ordered import attach_small, exact_percentiles, top_n

CAP = "filename"


def layer_port(columns: list[str], layer: str, side: str) -> Column:
    """The port of one layer (``tcp``, ``udp``) and side (``s``, ``d``).

    Where the export has both port pairs, each layer has its own; a packet with a TCP
    and a UDP layer counts for both. Else the one pair belongs to TCP before UDP.
    """
    if f"{layer}_{side}port" in columns:
        return F.col(f"{layer}_{side}port")
    mine = F.col("is_tcp") if layer == "tcp" else F.col("is_udp") & ~F.col("is_tcp")
    return F.when(mine, F.col(f"{side}port"))


def dst443_flags(columns: list[str]) -> dict[str, Column]:
    """Packets to port 443; the destination side only: one direction of the encrypted traffic."""
    return {
        f"{layer}_dst443": F.col(f"is_{layer}") & F.coalesce(layer_port(columns, layer, "d") == 443, F.lit(False))
        for layer in ("udp", "tcp")
    }


def proto_count_columns(columns: list[str] = ()) -> list[Column]:
    """Independent class counts: a packet may belong to several classes. ``columns`` are those of the packets."""
    tcp, udp, icmp = F.col("is_tcp"), F.col("is_udp"), F.col("is_icmp")
    to_443 = dst443_flags(columns)
    return [
        F.count_if(tcp).alias("tcp_pkts"),
        F.count_if(udp).alias("udp_pkts"),
        F.count_if(icmp).alias("icmp_pkts"),
        F.count_if(~(tcp | udp | icmp)).alias("other_pkts"),
        F.count_if(to_443["udp_dst443"]).alias("udp443_pkts"),
        F.count_if(to_443["tcp_dst443"]).alias("tcp443_pkts"),
    ]


def proto_counts(packets: DataFrame) -> DataFrame:
    """Packets of each class per capture, and those to port 443. No packets, no row."""
    return packets.groupBy(CAP).agg(*proto_count_columns(packets.columns))


# Error text of a capture whose lengths cannot be summed.
NO_FRAMES = "tshark_frame_len_parse_failed"


def _joined_errors(*parts: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*(F.nullif(p, F.lit("")) for p in parts))), " | ")


def _totals_chain(told: DataFrame) -> dict[str, Column]:
    """Totals by source from supplied (frames, bytes, _told_error) and counted (_frames, _bytes) values."""
    known = F.col("frames").isNotNull() & F.col("bytes").isNotNull()
    seen = F.coalesce(F.col("_frames") > 0, F.lit(False))
    return {
        "packets_total": F.when(known, F.col("frames")).when(seen, F.col("_frames")).otherwise(0),
        "bytes_total": F.when(known, F.col("bytes")).when(seen, F.col("_bytes")).otherwise(0),
        "totals_source": F.when(known, "tshark_io_stat").when(seen, "tshark_frame_len").otherwise("error"),
        "_totals_error": _joined_errors(
            F.coalesce("_told_error", F.lit("")) if "_told_error" in told.columns else F.lit(""),
            F.when(~known & ~seen, NO_FRAMES).otherwise(""),
        ),
    }


def capture_totals(packets: DataFrame, supplied: DataFrame | None = None) -> DataFrame:
    """Frames and bytes of each capture with the source they come from.

    ``supplied`` (filename, frames, bytes and perhaps error) are totals of an outside
    tool. They win; counted packets are the second choice, and 0 with source ``error``
    the last. With an error column the result has one, too.
    """
    counted = packets.groupBy(CAP).agg(F.count("frame_len").alias("_frames"), F.sum("frame_len").alias("_bytes"))
    none = {c: F.lit(None).cast("bigint") for c in ("frames", "bytes")}
    with_error = supplied is not None and "error" in supplied.columns
    if supplied is None:
        both = counted.withColumns(none)
    else:
        both = supplied.withColumnRenamed("error", "_told_error").join(counted, CAP, "full_outer")
    chain = _totals_chain(both)
    errors = [chain["_totals_error"].alias("error")] if with_error else []
    return both.select(CAP, *(chain[c].alias(c) for c in ("packets_total", "bytes_total", "totals_source")), *errors)


def totals_consistent(total: Column, *parts: Column) -> Column:
    summed = parts[0]
    for p in parts[1:]:
        summed = summed + p
    return F.when(total > 0, (total == summed).cast("int")).otherwise(0)


def mean_bps(bytes_total: Column, duration_s: Column) -> Column:
    return F.when((duration_s > 0) & (bytes_total > 0), bytes_total * 8.0 / duration_s)


def capture_bounds(packets: DataFrame) -> DataFrame:
    return packets.groupBy(CAP).agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


def peak_mbps_1s(packets: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Largest one-second byte sum; the bins start at the first frame of the capture.

    ``bounds`` are those of `capture_bounds` where they are known already.
    """
    bounds = capture_bounds(packets) if bounds is None else bounds
    anchored = attach_small(packets.select(CAP, "ts_us", "frame_len"), bounds, [CAP])
    bins = anchored.groupBy(CAP, F.floor((F.col("ts_us") - F.col("first_us")) / 1_000_000).alias("bin")).agg(
        F.sum("frame_len").alias("bytes")
    )
    peak = F.max("bytes")
    return bins.groupBy(CAP).agg(F.when(peak > 0, peak * 8.0 / 1e6).alias("peak_mbps_1s"))


def per_second_peaks(packets: DataFrame) -> DataFrame:
    """Peak and average rates; the bins are whole epoch seconds."""
    secs = packets.groupBy(CAP, F.floor(F.col("ts_us") / 1_000_000).alias("sec")).agg(
        F.sum("frame_len").alias("bytes"),
        F.count(F.lit(1)).alias("pkts"),
        F.min("packet_no").alias("first_no"),
        F.max("packet_no").alias("last_no"),
        F.min_by("ts_us", "packet_no").alias("head_us"),
        F.max_by("ts_us", "packet_no").alias("tail_us"),
    )
    span = (F.max_by("tail_us", "last_no") - F.min_by("head_us", "first_no")) / 1e6
    return secs.groupBy(CAP).agg(
        (F.max("bytes") * 8).alias("peak_bps"),
        F.max("pkts").alias("peak_pps"),
        F.when(span > 0, F.round(F.sum("bytes") * 8 / span, 6)).alias("average_bps"),
        F.when(span > 0, F.round(F.sum("pkts") / span, 6)).alias("average_pps"),
    )


def port_pairs(packets: DataFrame, *more: Column) -> DataFrame:
    """Packets by the destination ports of both layers: count, first packet, and the aggregates ``more``."""
    named = {f"_{layer}": layer_port(packets.columns, layer, "d") for layer in ("tcp", "udp")}
    return packets.withColumns(named).groupBy(CAP, *named).agg(F.count(F.lit(1)).alias("n"), F.min("packet_no").alias("first_no"), *more)


def dst_port_counts(pairs: DataFrame) -> DataFrame:
    """Destination ports by layer with their count and first packet, from `port_pairs`."""
    ports = F.array(*(F.struct(F.lit(layer).alias("l4"), F.col(f"_{layer}").alias("dport")) for layer in ("tcp", "udp")))
    long = pairs.select(CAP, "n", "first_no", F.inline(ports)).where(F.col("dport").isNotNull())
    return long.groupBy(CAP, "l4", "dport").agg(F.sum("n").alias("n"), F.min("first_no").alias("first_no"))


def _best_ports(pairs: DataFrame) -> DataFrame:
    best = F.struct("n", -F.col("first_no"))
    return dst_port_counts(pairs).groupBy(CAP).agg(
        *[
            agg
            for l4 in ("udp", "tcp")
            for agg in (
                F.max_by("dport", F.when(F.col("l4") == l4, best)).alias(f"top_{l4}_dport"),
                F.coalesce(F.max(F.when(F.col("l4") == l4, F.col("n"))), F.lit(0)).alias(f"top_{l4}_dport_pkts"),
            )
        ]
    )


def top_dst_port(packets: DataFrame) -> DataFrame:
    """Most frequent destination port per capture, TCP and UDP apart; ties go to the first seen."""
    captures = packets.select(CAP).distinct()
    return captures.join(_best_ports(port_pairs(packets)), CAP, "left").fillna(0, ["top_udp_dport_pkts", "top_tcp_dport_pkts"])


def top_ports_both_sides(packets: DataFrame, n: int = 10) -> DataFrame:
    """Most used ports counting source and destination; ties go to the first seen, the source side before the other."""
    names = [(layer, side) for layer in ("tcp", "udp") for side in ("s", "d")]
    known = packets.select(CAP, "packet_no", *(layer_port(packets.columns, layer, side).alias(f"_{layer}{side}") for layer, side in names))
    sides = [F.struct(F.lit(layer).alias("l4"), F.lit("sd".index(side)).alias("side"), F.col(f"_{layer}{side}").alias("port")) for layer, side in names]
    ports = known.select(CAP, "packet_no", F.inline(F.array(*sides))).where(F.col("port").isNotNull())
    counts = ports.groupBy(CAP, "l4", "port").agg(
        F.count(F.lit(1)).alias("n"), F.min("packet_no").alias("first_no"), F.min_by("side", F.struct("packet_no", "side")).alias("side")
    )
    return top_n(counts, [CAP, "l4"], [F.desc("n"), F.asc("first_no"), F.asc("side")], n).select(CAP, "l4", "rank", "port", "n")


def packet_size_stats(packets: DataFrame, length: str | None = None) -> DataFrame:
    """Mean, median, p95 and largest packet per capture: captured lengths where the export has them, else wire lengths."""
    length = length or ("cap_len" if "cap_len" in packets.columns else "frame_len")
    pct = exact_percentiles(packets, [CAP], length, {"median_bytes": 0.5, "p95_bytes": 0.95})
    return pct.select(
        CAP, F.round(F.col("sum") / F.col("n"), 6).alias("mean_bytes"), "median_bytes",
        F.round("p95_bytes", 6).alias("p95_bytes"), F.col("max").alias("max_bytes"),
    )


def capture_span(packets: DataFrame) -> DataFrame:
    """Span in capture order, and the range of the usable timestamps."""
    good = F.when(F.col("ts_us") > 0, F.col("ts_us"))
    first, last = F.min_by("ts_us", "packet_no"), F.max_by("ts_us", "packet_no")
    return packets.groupBy(CAP).agg(
        first.alias("start_us"),
        last.alias("end_us"),
        ((last - first) / 1e6).alias("duration_s"),
        F.min(good).alias("min_nonzero_us"),
        F.max(good).alias("max_nonzero_us"),
    )


def ts_trust(packets: DataFrame) -> DataFrame:
    """How far the timestamps can be used: zero share, series flag, duration and its reason."""
    good = F.when(F.col("ts_us") > 0, F.col("ts_us"))
    base = packets.groupBy(CAP).agg(
        F.count(F.lit(1)).alias("packets"),
        F.count_if(F.col("ts_us") <= 0).alias("zero_ts"),
        F.min(good).alias("min_us"),
        F.max(good).alias("max_us"),
        F.sum("frame_len").alias("bytes"),
    )
    span = F.coalesce(F.col("max_us") - F.col("min_us"), F.lit(0))
    return base.select(
        CAP,
        "packets",
        "zero_ts",
        F.round(F.col("zero_ts") / F.col("packets"), 6).alias("zero_share"),
        (F.col("zero_ts") * 2 <= F.col("packets")).alias("series_ok"),
        "min_us",
        "max_us",
        (span / 1e6).alias("duration_s"),
        F.when(span > 0, "duration_bucket").otherwise("fallback_invalid_ts").alias("duration_reason"),
        F.when(span > 0, F.round(F.col("bytes") * 8 / (span / 1e6), 6)).otherwise(0.0).alias("avg_bps"),
    )


_COUNTS = ["tcp_pkts", "udp_pkts", "icmp_pkts", "other_pkts", "udp443_pkts", "tcp443_pkts"]


def summary_pairs(packets: DataFrame) -> DataFrame:
    """`port_pairs` with all that `capture_summary` counts: one pass serves its counts, bounds and ports if this is pinned."""
    return port_pairs(
        packets,
        F.count("frame_len").alias("_frames"),
        F.sum("frame_len").alias("_bytes"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        *proto_count_columns(packets.columns),
    )


def capture_summary(
    packets: DataFrame, tool_log: DataFrame | None = None, folder: str = "", totals: DataFrame | None = None, peaks: DataFrame | None = None,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """The whole summary row of each capture.

    ``tool_log`` (filename, capture_duration_s, capinfos_truncated, capinfos_stderr,
    error) comes from the capture tool; without it the duration is the span of the
    timestamps and nothing is truncated. ``totals`` (filename, frames, bytes, error) and
    ``peaks`` (filename, peak_mbps_1s, error) are read from the tool's statistics
    tables; totals that it could not give are counted, and errors of all tools are
    joined. A capture that only a tool knows keeps its row.

    ``pairs`` are the `summary_pairs` of the packets where they are known already.
    """
    counts = _COUNTS
    pairs = summary_pairs(packets) if pairs is None else pairs
    bounds = pairs.groupBy(CAP).agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    base = pairs.groupBy(CAP).agg(
        F.sum("_frames").alias("_frames"),
        F.sum("_bytes").alias("_bytes"),
        ((F.max("last_us") - F.min("first_us")) / 1e6).alias("_span_s"),
        *(F.sum(c).alias(c) for c in counts),
    )
    if tool_log is None:
        base = base.withColumns({
            "capture_duration_s": F.col("_span_s"),
            "capinfos_truncated": F.lit(0),
            "capinfos_stderr": F.lit(""),
            "error": F.lit(""),
        })
    else:
        base = base.join(tool_log, CAP, "full_outer")
    if totals is None:
        base = base.withColumns({c: F.lit(None).cast("bigint") for c in ("frames", "bytes")})
    else:
        base = base.join(totals.withColumnRenamed("error", "_told_error"), CAP, "full_outer")
    base = base.withColumns(_totals_chain(base))
    if peaks is None:
        peaks = peak_mbps_1s(packets, bounds).withColumn("_peak_error", F.lit(""))
    else:
        peaks = peaks.withColumnRenamed("error", "_peak_error")
    full = base.join(peaks, CAP, "left").join(_best_ports(pairs), CAP, "left")
    full = full.fillna(0, [*counts, "top_udp_dport_pkts", "top_tcp_dport_pkts", "capinfos_truncated"]).fillna("", ["capinfos_stderr"])
    # without a statistics table nothing failed that could be told
    failed = F.col("_totals_error") if totals is not None else F.lit("")
    return with_capture_name(full).select(
        CAP, "profile", "duration_label", "duration_requested_min", "run_idx", "capture_duration_s",
        "packets_total", "bytes_total",
        F.round(mean_bps(F.col("bytes_total"), F.col("capture_duration_s")), 6).alias("mean_bps"),
        "peak_mbps_1s", *counts,
        "top_udp_dport", "top_udp_dport_pkts", "top_tcp_dport", "top_tcp_dport_pkts",
        "capinfos_truncated", "capinfos_stderr", "totals_source",
        totals_consistent(F.col("packets_total"), *[F.col(c) for c in counts[:4]]).alias("totals_consistent"),
        _joined_errors(F.coalesce("error", F.lit("")), failed, F.coalesce("_peak_error", F.lit(""))).alias("error"),
        F.concat(F.lit(folder), F.col(CAP)).alias("path"),
    )
