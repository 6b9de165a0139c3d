"""Whole per-capture reports as nested documents.

Each part of a document is a table with a row for each capture; the parts meet in joins on the capture. Lists are the
report's own, bounded by top-n or by the time steps of a capture. Raw lists are whole: they are cut into pages, the first
stands in the document, each later one in a row of its own; packets are never gathered. A document maps names to values of
different kinds, so values are variants, and a name whose condition does not hold is left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pin
from . import captures as cap
from . import diversity, distributions, flows, locality, series, tcp, timing

CAP = "filename"
TOP = 15
PAGE = 1 << 17  # values of a raw list in one row
CONTINUES = "continues_at"  # fixed value: in a row that continues a document, the place of the first value of its lists
# Names of the report's counters and the dimensions behind them; those counted by number.
COUNTERS = {
    "eth_types": "eth_type", "ip_versions": "ip_version", "ip_protocols": "ip_protocol", "app_protocols_heuristic": "app_protocol",
    "http_methods_heuristic": "http_method", "http_hosts_heuristic": "http_host", "quic_versions_heuristic": "quic_form",
    "top_src_ips": "src_ip", "top_dst_ips": "dst_ip", "top_ip_pairs": "ip_pair",
    "top_tcp_src_ports": "tcp_src_port", "top_tcp_dst_ports": "tcp_dst_port", "top_udp_src_ports": "udp_src_port", "top_udp_dst_ports": "udp_dst_port",
    "tcp_flags": "tcp_flags", "dns_queries": "dns_query", "icmp": "icmp_type",
}
NUMBERS = ("eth_type", "tcp_src_port", "tcp_dst_port", "udp_src_port", "udp_dst_port")
# Names of the raw lists, their metric and what its unit is divided by.
RAW_LISTS = {
    "flows_duration_seconds_list": ("dur_us", 1e6), "flows_bytes_list": ("bytes", None), "flows_packets_list": ("packets", None),
    "packet_iat_seconds_list": ("pkt_gap_us", 1e6), "newflow_iat_seconds_list": ("newflow_gap_us", 1e6),
}
UNRELIABLE = "NOT_RELIABLE_TOO_MANY_ZERO_TIMESTAMPS"  # fixed value
TCP_NOTE = "Heurística simple basada en next_seq por flujo direccional."  # fixed value


def _ordered(place: str | Column, value: Column, only: Column | None = None) -> Column:
    """The values of a capture in the order of `place`, an array."""
    pair = F.struct((F.col(place) if isinstance(place, str) else place).alias("p"), value.alias("v"))
    return F.transform(F.array_sort(F.collect_list(pair if only is None else F.when(only, pair))), lambda x: x["v"])


def _variant(value: Column, kind: str) -> Column:
    """Nested values become variant objects, plain ones variants."""
    nested = kind.startswith(("struct", "array", "map"))
    return F.to_variant_object(value) if nested else value.cast("variant")


def document(rows: DataFrame, entries: dict[str, Column], only: dict[str, Column] | None = None) -> DataFrame:
    """(filename, document): the entries as one JSON object. Null values are written, entries whose `only` fails are not."""
    kinds = dict(rows.select(*(c.alias(n) for n, c in entries.items())).dtypes)
    pairs = []
    for name, value in entries.items():
        shape = kinds[name]
        holds = (only or {}).get(name, F.lit(True))
        told = value if shape == "variant" else _variant(value, shape)
        pairs.append(F.struct(F.lit(name).alias("name"), told.alias("value"), holds.alias("holds")))
    held = F.transform(F.filter(F.array(*pairs), lambda p: p["holds"]), lambda p: F.struct(p["name"], p["value"]))
    body = F.to_json(F.map_from_entries(held), {"ignoreNullFields": "false"})
    return rows.select(CAP, body.alias("document"))


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, CAP, "left"), parts)


def _pairs(listed: Column, kind: str) -> Column:
    return F.transform(listed, lambda x: F.array(x["value"].cast(kind).cast("variant"), x["n"].cast("variant")))


def counter_lists(packets: DataFrame, n: int = TOP) -> DataFrame:
    """A column for each counter: pairs of value and count, most frequent first."""
    top = diversity.top_values(packets, n)
    columns = []
    for name, dim in COUNTERS.items():
        listed = _ordered("rank", F.struct("value", "n"), F.col("dim") == dim)
        columns.append(_pairs(listed, "bigint" if dim in NUMBERS else "string").alias(name))
    return top.groupBy(CAP).agg(*columns)


def raw_pages(packets: DataFrame, limit: int | None = None, unidir: DataFrame | None = None, page: int = PAGE) -> DataFrame:
    """(filename, metric, page, values): the raw lists in pages of at most `page` values; with `limit` only the first values of each list."""
    rows = distributions.raw_samples(packets, limit, unidir=unidir)
    if limit is not None:
        rows = rows.where(F.col("pos") <= limit)
    place = F.floor((F.col("pos") - 1) / page).alias("page")
    return rows.groupBy(CAP, "metric", place).agg(_ordered("pos", F.col("value")).alias("values"))


def _raw_entry(values: Column, unit: float | None) -> Column:
    return F.transform(values, lambda v: v / unit) if unit else values


def raw_lists(pages: DataFrame) -> DataFrame:
    """A column for each raw list: its first page."""
    found = pages.where(F.col("page") == 0).groupBy(CAP).agg(*(
        F.any_value(F.when(F.col("metric") == metric, F.col("values")), ignoreNulls=True).alias(name) for name, (metric, _) in RAW_LISTS.items()
    ))
    return found.select(CAP, *(_raw_entry(F.col(name), unit).alias(name) for name, (_, unit) in RAW_LISTS.items()))


def raw_rest(pages: DataFrame, page: int = PAGE) -> DataFrame:
    """(filename, document): a row for each later page of a raw list, its values and the place of the first of them."""
    later = pages.where(F.col("page") > 0)
    entries = {CONTINUES: F.col("page") * page, **{name: _raw_entry(F.col("values"), unit) for name, (_, unit) in RAW_LISTS.items()}}
    return document(later, entries, {name: F.col("metric") == metric for name, (metric, _) in RAW_LISTS.items()})


def flow_list(packets: DataFrame, n: int = TOP, unidir: DataFrame | None = None) -> DataFrame:
    top = flows.top_flows(packets, n, unidir)
    row = F.struct("ip_version", "src", "dst", "sport", "dport", "proto", "bytes", "packets", F.col("duration_s").alias("duration"))
    return top.groupBy(CAP).agg(_ordered("rank", row).alias("top_flows_unidirectional"))


def _by_window(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """A map from window length to the values of its windows in order."""
    lists = rows.groupBy(CAP, "window_s").agg(_ordered("k", value).alias("v"))
    pair = F.struct(F.col("window_s").cast("string").alias("w"), F.col("v"))
    return lists.groupBy(CAP).agg(F.map_from_entries(F.array_sort(F.collect_list(pair))).alias(name))


def throughput_lists(packets: DataFrame, bucket_s: int = 1) -> DataFrame:
    """Bucket series, their summary, window rates and the summary of these."""
    line = pin(series.bucket_series(packets, bucket_s))
    lists = line.groupBy(CAP).agg(_ordered("idx", F.col("t_s")).alias("times"), _ordered("idx", F.round("mbps", 6)).alias("mbps"))
    windows = series.window_throughput(line, bucket_s)
    rates = _by_window(windows, F.round("mean_bps", 6), "windowed_throughput_bps")
    found = series.window_throughput_summary(windows)
    four = F.struct(*(F.col(f"{c}_mbps").alias(c) for c in ("mean", "p95", "p99", "max")))
    short = found.groupBy(CAP).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("window_s").cast("string").alias("w"), four.alias("v"))))).alias("windowed_throughput_summary_mbps")
    )
    return _together([lists, series.bucket_summary(line, bucket_s), rates, short, series.autocorr_lag1(line)])


def statistics_report(packets: DataFrame, bucket_s: int = 1, top: int = TOP, raw_limit: int | None = None, given_ip: str | None = None, bad_frames: DataFrame | None = None, page: int = PAGE) -> DataFrame:
    """(filename, document): the statistics report of every capture.

    Raw lists are whole unless `raw_limit` is given. A list of more than `page` values goes on in further rows of its capture,
    objects with the values of one page under the list's name and the place of the first of them under `continues_at`.
    `bad_frames` (filename, bad_frames) are frames that the export could not give; without it there are none. Series are
    left out, with the reason in their place, where more than half of the times are missing.
    """
    local = pin(locality.local_ip(packets, given_ip))
    unidir = pin(flows.unidir_flows(packets))  # five parts read it
    pages = pin(raw_pages(packets, raw_limit, unidir, page))  # the documents and their further rows
    sizes = packets.groupBy(CAP).agg(F.coalesce(F.sum("frame_len"), F.lit(0)).alias("bytes"), F.round(F.avg("frame_len"), 6).alias("avg_size"))
    named = flows.unidir_summary(packets, unidir).select(CAP, "flows", F.col("flows_per_min"), "median_bytes_per_flow", "median_dur_s", "median_pkts_per_flow")
    fresh = _by_window(series.window_new_flows(packets, unidir=unidir), F.col("flows_per_min"), "windowed_newflows_per_min")
    parts = [
        cap.ts_trust(packets), sizes, throughput_lists(packets, bucket_s), named, diversity.dst_diversity(packets), diversity.domain_diversity(packets),
        timing.burstiness_report(packets, unidir), counter_lists(packets, top), locality.outbound_ports(packets, local), raw_lists(pages), fresh, flow_list(packets, top, unidir),
    ]
    if bad_frames is not None:
        parts.append(bad_frames)
    rows = _together(parts)
    none = F.array().cast("array<array<variant>>")
    reliable = F.to_variant_object(F.struct(
        F.coalesce("times", F.array().cast("array<bigint>")).alias("times_seconds_from_start"), F.coalesce("mbps", F.array().cast("array<double>")).alias("mbps"),
    ))
    seconds = lambda c: F.col(c) / 1e6
    entries = {
        "packets": F.col("packets"), "bytes": F.col("bytes"), "avg_packet_size": F.col("avg_size"), "bucket_seconds": F.lit(bucket_s),
        "duration_bucket_seconds": F.col("duration_s"), "duration_ts_seconds": F.col("duration_s"), "duration_used_seconds": F.col("duration_s"),
        "duration_reason": F.col("duration_reason"), "throughput_avg_bps": F.col("avg_bps"),
        **{f"throughput_{k}_mbps_bucket": F.col(f"{k}_mbps") for k in ("peak", "p95", "p99")},
        "windowed_throughput_summary_mbps": F.coalesce("windowed_throughput_summary_mbps", F.create_map().cast("map<string, struct<mean: double, p95: double, p99: double, max: double>>")),
        "timestamps_zero": F.col("zero_ts"), "timestamps_zero_ratio": F.col("zero_share"),
        "ts_nonzero_min": seconds("min_us"), "ts_nonzero_max": seconds("max_us"),
        "flows_total": F.col("flows"), "flows_per_min": F.col("flows_per_min"),
        **{c: F.col(c) for c in ("unique_dst_ips", "entropy_dst_ips", "unique_dns_domains", "entropy_dns_domains", "burstiness_pkt_iat", "burstiness_newflow_iat")},
        "autocorr_lag1_throughput_bps": F.coalesce("autocorr_lag1", F.lit(0.0)),
        **{c: F.coalesce(c, none) for c in COUNTERS},
        **{c: F.col(c) for c in (
            "local_ip", "local_ip_source", "tcp_outbound_total_pkts", "udp_outbound_total_pkts", "tcp_outbound_dport_443_pkts",
            "udp_outbound_dport_443_pkts", "udp_outbound_dport_53_pkts")},
        "bad_frames": F.lit(0) if bad_frames is None else F.coalesce("bad_frames", F.lit(0)),
        **{c: F.coalesce(c, F.array().cast("array<double>" if unit else "array<bigint>")) for c, (_, unit) in RAW_LISTS.items()},
        "median_bytes_per_flow": F.col("median_bytes_per_flow"), "median_flow_duration_s": F.col("median_dur_s"), "median_pkts_per_flow": F.col("median_pkts_per_flow"),
        "throughput_series": F.when(F.col("series_ok"), reliable).otherwise(F.lit(UNRELIABLE).cast("variant")),
        "windowed_throughput_bps": F.col("windowed_throughput_bps"), "windowed_newflows_per_min": F.col("windowed_newflows_per_min"),
        "top_flows_unidirectional": F.coalesce(
            "top_flows_unidirectional",
            F.array().cast("array<struct<ip_version: string, src: string, dst: string, sport: int, dport: int, proto: string, bytes: bigint, packets: bigint, duration: double>>")),
    }
    only = {c: F.col(c).isNotNull() for c in ("windowed_throughput_bps", "windowed_newflows_per_min")}
    return document(rows, entries, only).unionByName(raw_rest(pages, page))


def quality_report(packets: DataFrame, gap_ms: float = 100.0, conns: DataFrame | None = None, top: int = 10) -> DataFrame:
    """(filename, document): the quality report of every capture, over captured lengths where the export has them.

    `conns` (filename, document) are summaries of connection logs as JSON; a capture without one gets a note.
    """
    from ..functions import net

    length = "cap_len" if "cap_len" in packets.columns else "frame_len"
    own = packets.withColumn("frame_len", F.col(length))
    counts = own.groupBy(CAP).agg(F.count(F.lit(1)).alias("total_packets"), F.coalesce(F.sum("frame_len"), F.lit(0)).alias("total_bytes"))

    def tally(name: Column, column: str) -> DataFrame:
        """A map from value to count; values of one name are added up."""
        found = own.select(CAP, name.alias("name")).where(F.col("name").isNotNull()).groupBy(CAP, "name").agg(F.count(F.lit(1)).alias("n"))
        return found.groupBy(CAP).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias(column))

    ports = cap.top_ports_both_sides(own, top)
    row = F.struct("port", F.col("n").alias("count"))
    port_lists = ports.groupBy(CAP).agg(*(_ordered("rank", row, F.col("l4") == p).alias(f"top_{p}_ports") for p in ("tcp", "udp")))
    parts = [
        counts, cap.capture_span(own), timing.iat_capture_order(own), timing.gap_count(own, gap_ms), cap.packet_size_stats(own), cap.per_second_peaks(own),
        tally(net.ether_type_name(F.col("eth_type")), "ethertypes"), tally(net.ip_protocol_name(F.col("proto_num")), "ip_protocols"), port_lists, tcp.tcp_seq_quality(own),
        diversity.duplicate_packets(own).select(CAP, "duplicates"),
    ]
    if conns is not None:
        parts.append(conns.select(CAP, F.col("document").alias("_conns")))
    rows = _together(parts)
    empty = F.array().cast("array<struct<port: int, count: bigint>>")
    tallies = F.create_map().cast("map<string, bigint>")
    body = F.struct(
        "total_packets", "total_bytes", (F.col("start_us") / 1e6).alias("capture_start_ts"), (F.col("end_us") / 1e6).alias("capture_end_ts"),
        F.col("duration_s").alias("duration_seconds"), "gaps_over_threshold", F.lit(float(gap_ms)).alias("gap_threshold_ms"),
        F.struct("mean_s", "median_s", "p95_s", "max_s").alias("inter_arrival"),
        F.struct("mean_bytes", "median_bytes", "p95_bytes", "max_bytes").alias("packet_sizes"),
        F.struct("peak_bps", "peak_pps", "average_bps", "average_pps").alias("throughput"),
        F.coalesce("duplicates", F.lit(0)).alias("duplicates_approx"),
        F.struct(
            F.coalesce("ethertypes", tallies).alias("ethertypes"), F.coalesce("ip_protocols", tallies).alias("ip_protocols"),
            F.coalesce("top_tcp_ports", empty).alias("top_tcp_ports"), F.coalesce("top_udp_ports", empty).alias("top_udp_ports"),
        ).alias("protocols"),
        F.struct("retransmissions", "out_of_order", F.lit(TCP_NOTE).alias("note")).alias("tcp_quality"),
    )
    note = F.to_variant_object(F.struct(F.lit("Zeek no se ejecutó / no está disponible.").alias("note")))
    log = note if conns is None else F.coalesce(F.try_parse_json("_conns"), note)
    return document(rows, {"scapy": body, "zeek": log})


def document_paths(documents: DataFrame, depth: int = 8) -> DataFrame:
    """(filename, path, number, text): a row for each leaf of the documents, an empty list or object included.

    Paths read like `a.b[3].c`. Numbers stand in `number`, other values as text, null in neither. Lists of a row that
    continues a document are numbered from their place in it.
    """
    level = documents.select(CAP, F.lit("").alias("path"), F.parse_json("document").alias("v"))
    level = level.withColumn("start", F.coalesce(F.try_variant_get("v", f"$.{CONTINUES}", "bigint"), F.lit(0)))
    out = None
    for at in range(depth):
        kind = F.schema_of_variant("v")
        told = level.select(CAP, "path", "start", "v", kind.alias("kind"))
        inner = F.col("kind").startswith("OBJECT<") & (F.col("kind") != "OBJECT<>") | F.col("kind").startswith("ARRAY<") & ((F.col("kind") != "ARRAY<VOID>") | (F.col("start") > 0))
        # a list of nulls has the type of an empty one, and so do empty lists: these are leaves; a later page is never empty
        number = F.when(F.col("kind").isin("BIGINT", "DOUBLE", "FLOAT") | F.col("kind").startswith("DECIMAL"), F.try_variant_get("v", "$", "double"))
        text = F.when(F.col("kind").isin("STRING", "BOOLEAN"), F.try_variant_get("v", "$", "string")).when(F.col("kind").isin("OBJECT<>", "ARRAY<VOID>"), F.to_json("v"))
        leaves = told.where(~inner).select(CAP, "path", number.alias("number"), text.alias("text"))
        out = leaves if out is None else out.unionByName(leaves)
        each = documents.sparkSession.tvf.variant_explode(F.col("v").outer())
        grown = told.where(inner).select(CAP, F.col("path").alias("parent"), "start", "v").lateralJoin(each)
        if at == 0:
            grown = grown.where((F.col("start") == 0) | ~F.col("key").eqNullSafe(CONTINUES))
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), (F.col("pos") + F.col("start")).cast("string"), F.lit("]")))
        step = step.when(F.col("parent") == "", F.col("key")).otherwise(F.concat(F.lit("."), F.col("key")))
        level = grown.select(CAP, F.concat("parent", step).alias("path"), "start", F.col("value").alias("v"))
    return out
