"""Registered queries over readers, writers and streams.

Each writes data derived from the given tables to the shared folder and reads it
back with the operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.captures import capture_summary
from ..operators.diversity import top_values
from ..operators.flows import flow_metrics
from ..session import work_path
from ..sources import logs, sinks
from ..sources import packets as reader
from ..sources.adapter import packets
from ..streaming import live
from .capture_plans import SUMMARY
from .flow_plans import METRICS
from .oracle_base import with_packets
from .series_plans import COUNTER


def export_lines(spark, sf) -> DataFrame:
    """Packets as quoted export lines with every fault the reader has to deal with."""
    k, num = F.col("k"), F.col("proto_num")
    v6, arp = k % 29 == 0, k % 23 == 0
    when = F.concat(
        F.floor(F.col("ts_us") / 1_000_000).cast("string"), F.lit("."), F.lpad((F.col("ts_us") % 1_000_000).cast("string"), 6, "0"), F.lit("000")
    )

    def v4(c):
        return F.when(~v6 & ~arp, F.col(c)).otherwise("")

    def six(c):
        return F.when(v6 & ~arp, F.concat(F.lit("fe80::"), F.replace(c, F.lit("."), F.lit(":")))).otherwise("")

    def port(n, c):
        return F.when((num == n) & ~((n == 6) & (k % 31 == 0)), F.col(c).cast("string")).otherwise("")

    proto = F.when(F.col("is_icmp") & F.col("is_udp"), "1,17").otherwise(num.cast("string"))
    fields = [
        F.when(k % 19 == 0, "n/a").otherwise(when), v4("src"), v4("dst"), six("src"), six("dst"),
        port(6, "sport"), port(6, "dport"), port(17, "sport"), port(17, "dport"),
        F.when(~v6 & ~arp, proto).otherwise(""), F.when(v6 & ~arp, num.cast("string")).otherwise(""), F.col("frame_len").cast("string"),
    ]
    quoted = F.transform(F.array(*fields), lambda f: F.concat(F.lit('"'), f, F.lit('"')))
    kept = F.when(k % 17 == 0, F.slice(quoted, 1, 7)).otherwise(quoted)
    return packets(spark, sf).select("filename", F.array_join(kept, ",").alias("value"), "packet_no")


def _export(spark, sf) -> str:
    path = work_path(spark, "export")
    # captures in three part files each, in the order of their packets
    lines = export_lines(spark, sf).repartitionByRange(3, "packet_no").sortWithinPartitions("filename", "packet_no")
    lines.drop("packet_no").write.partitionBy("filename").text(path)
    return path


def scan_packets(spark, sf):
    rows = reader.scan_packets(spark, _export(spark, sf))
    return rows.groupBy(
        "filename", "proto_num", "ip_version", "is_tcp", "is_udp", "is_icmp", "src", "dst", "sport", "dport"
    ).agg(F.count(F.lit(1)).alias("packets"), F.sum("frame_len").alias("bytes"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
          F.sum("packet_no").alias("places"), F.min_by("ts_us", "packet_no").alias("early_us"))


def scan_packet_fields(spark, sf):
    """Write packets with a header, read them back, and count the values of every dimension."""
    path = work_path(spark, "field-export")
    p = packets(spark, sf)
    when = F.concat(F.floor(F.col("ts_us") / 1_000_000).cast("string"), F.lit("."), F.lpad((F.col("ts_us") % 1_000_000).cast("string"), 6, "0"))
    fields = {
        "eth.type": F.concat(F.lit("0x"), F.lpad(F.hex("eth_type"), 4, "0")), "frame.time_epoch": when, "frame.len": F.col("frame_len"),
        "ip.src": F.col("src"), "ip.dst": F.col("dst"), "ip.proto": F.col("proto_num"),
        **{f"{n}.{s}port": F.when(F.col("proto_num") == k, F.col(c)) for n, k in (("tcp", 6), ("udp", 17)) for s, c in (("src", "sport"), ("dst", "dport"))},
        "tcp.seq": F.col("tcp_seq"), "tcp.len": F.col("payload_len"), "tcp.flags": F.concat(F.lit("0x"), F.lower(F.hex("tcp_flags"))),
        "icmp.type": F.col("icmp_type"), "dns.qry.name": F.col("dns_qname"), "tcp.payload": F.lower(F.hex("payload")),
    }
    lines = p.repartitionByRange(3, "packet_no").sortWithinPartitions("filename", "packet_no")
    lines.select("filename", *(c.cast("string").alias(n) for n, c in fields.items())).write.partitionBy("filename").option("header", True).option("quoteAll", True).csv(path)
    return top_values(reader.scan_packet_fields(spark, path))


EXPORTED = r"""
x AS (SELECT *, k % 29 = 0 AND k % 23 <> 0 AS v6, k % 29 <> 0 AND k % 23 <> 0 AS v4 FROM
  (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY packet_no) - 1 AS place FROM packets) WHERE k % 17 <> 0 AND k % 19 <> 0),
y AS (SELECT filename, ts_us, frame_len, place, CASE WHEN v4 AND NOT (is_icmp AND is_udp) OR v6 THEN proto_num END::INT AS proto_num, CASE WHEN v4 THEN 'IPv4' WHEN v6 THEN 'IPv6' END AS ip_version,
  (proto_num = 6 AND (v4 OR v6 OR k % 31 <> 0)) AS is_tcp, (proto_num = 17 OR (v4 AND is_icmp AND is_udp)) AS is_udp, ((v4 OR v6) AND proto_num = 1) AS is_icmp,
  CASE WHEN v4 THEN src WHEN v6 THEN 'fe80::' || replace(src, '.', ':') END AS src, CASE WHEN v4 THEN dst WHEN v6 THEN 'fe80::' || replace(dst, '.', ':') END AS dst,
  CASE WHEN proto_num <> 6 OR k % 31 <> 0 THEN sport END::INT AS sport, CASE WHEN proto_num <> 6 OR k % 31 <> 0 THEN dport END::INT AS dport FROM x)
SELECT filename, proto_num, ip_version, is_tcp, is_udp, is_icmp, src, dst, sport, dport, count(*) AS packets, sum(frame_len)::BIGINT AS bytes, min(ts_us) AS first_us, max(ts_us) AS last_us,
  sum(place)::BIGINT AS places, arg_min(ts_us, place) AS early_us FROM y GROUP BY ALL"""


def scan_captures(spark, sf):
    return reader.scan_captures(spark, _export(spark, sf), "part-*", recursive=True).select("filename")


def _summary(spark, sf):
    return capture_summary(packets(spark, sf))


def sink_metrics(spark, sf):
    path = work_path(spark, "metrics")
    sinks.sink_metrics(_summary(spark, sf), path)
    return spark.read.parquet(path)


def scan_summaries(spark, sf):
    path = work_path(spark, "summaries")
    sinks.sink_metrics(flow_metrics(packets(spark, sf)), path, "csv")
    out = logs.scan_summaries(spark, path, "flows")
    return out.drop("capinfos_stderr", "path")


def sink_summary_json(spark, sf):
    path = work_path(spark, "report")
    metrics = _summary(spark, sf)
    sinks.sink_report_json(metrics, path)
    back = spark.read.schema(metrics.schema).json(path)
    return back.select("filename", "profile", "packets_total", "bytes_total", "mean_bps", "peak_mbps_1s", "top_udp_dport", "totals_consistent")


def stream_window_throughput(spark, sf):
    """Windows that the watermark has closed; open ones stay in the state."""
    out = live.drain(live.window_throughput(live.event_stream(spark, sf)), mode="append", label="windows")
    return out.withColumn("mean_bps", F.round("mean_bps", 6))


def stream_flow_activity(spark, sf):
    """Phases that the watermark has closed."""
    return live.drain(live.flow_activity(live.event_stream(spark, sf)), mode="append", label="activity")


def stream_flow_activity_steps(spark, sf):
    """The same where packets come in four parts, in order of time, and the stream starts again for each of them."""
    p = packets(spark, sf)
    inbox, folder = work_path(spark, "packet-parts"), work_path(spark, "activity-steps")
    # seconds since the first packet of all at which a part ends
    ends = [120, 600, 1800, None]
    start = 1_704_067_200
    begin, out = 0, None
    for end in ends:
        seconds = F.col("ts_us") / 1_000_000 - start
        part = p.where((seconds >= begin) & (F.lit(True) if end is None else seconds < end))
        part.write.mode("append").parquet(inbox)
        stream = live.with_event_time(spark.readStream.schema(p.schema).parquet(inbox))
        out = live.drain(live.flow_activity(stream), mode="append", folder=folder)
        begin = end
    return out


#: The watermark after the last row: its time in milliseconds less ten minutes.
CLOSED = "((SELECT max(ts_us) FROM packets) // 1000 - 600000) * 1000"
ACTIVITY = with_packets("""
        , f AS (SELECT filename, CASE proto_num WHEN 6 THEN 'tcp' ELSE 'udp' END AS proto, src < dst OR (src = dst AND sport <= dport) AS o, src, dst, sport, dport, ts_us, frame_len
          FROM packets WHERE proto_num IN (6, 17) AND sport IS NOT NULL),
        g AS (SELECT filename, proto, CASE WHEN o THEN src ELSE dst END AS ip1, (CASE WHEN o THEN sport ELSE dport END)::INT AS port1, CASE WHEN o THEN dst ELSE src END AS ip2,
          (CASE WHEN o THEN dport ELSE sport END)::INT AS port2, ts_us, frame_len FROM f),
        h AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w > 30000000 THEN 1 ELSE 0 END AS n FROM g WINDOW w AS (PARTITION BY filename, proto, ip1, port1, ip2, port2 ORDER BY ts_us)),
        i AS (SELECT *, sum(n) OVER (PARTITION BY filename, proto, ip1, port1, ip2, port2 ORDER BY ts_us) AS s FROM h)
        SELECT filename, proto, ip1, port1, ip2, port2, sum(frame_len)::BIGINT AS bytes, count(*) AS packets, min(ts_us) AS first_us, max(ts_us) AS last_us FROM i GROUP BY filename, proto, ip1, port1, ip2, port2, s HAVING max(ts_us) + 30000000 <= """ + CLOSED)
QUERIES = {
    "scan_packets": (scan_packets, with_packets("," + EXPORTED)),
    "scan_packet_fields": (scan_packet_fields, with_packets("," + COUNTER)),
    "scan_captures": (scan_captures, with_packets("SELECT DISTINCT filename FROM packets")),
    "sink_metrics": (sink_metrics, with_packets("," + SUMMARY + " SELECT * FROM summary")),
    "scan_summaries": (scan_summaries, with_packets(
        "," + METRICS + " SELECT filename, profile, CASE duration_label WHEN '1h' THEN '60m' ELSE duration_label END AS duration_label, duration_requested_min, run_idx, capture_duration_s, "
        "capinfos_truncated, flows, flows_per_min, median_bytes_per_flow, median_dur_s, median_pkts_per_flow, error FROM metrics")),
    "sink_summary_json": (sink_summary_json, with_packets(
        "," + SUMMARY + " SELECT filename, profile, packets_total, bytes_total, mean_bps, peak_mbps_1s, top_udp_dport, totals_consistent FROM summary")),
    "stream_window_throughput": (stream_window_throughput, with_packets(
        "SELECT filename, (ts_us // 300000000) * 300000000 AS start_us, sum(frame_len)::BIGINT AS bytes, count(*) AS packets, "
        f"round(sum(frame_len)::BIGINT * 8.0::DOUBLE / 300, 6) AS mean_bps FROM packets GROUP BY 1, 2 HAVING start_us + 300000000 <= {CLOSED}")),
    "stream_flow_activity": (stream_flow_activity, ACTIVITY),
    "stream_flow_activity_steps": (stream_flow_activity_steps, ACTIVITY),
}
