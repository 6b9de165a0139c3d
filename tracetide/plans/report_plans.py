"""Registered queries over whole report documents, tool statistics and exports with all their fields.

The documents are written as JSON, read back as text, and every leaf of them is a row: path, number, text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import captures as cap
from ..operators import diversity, reports
from ..session import work_path
from ..sources import logs, sinks
from ..sources import packets as reader
from ..sources.adapter import packets, packets_with_jitter, packets_with_lost_times
from .capture_plans import COUNTS, NAMED, PEAK, TOPPORT
from .flow_plans import UNI_Z
from .oracle_base import with_packets
from .quality_plans import TOOLS, tool_rows
from .series_plans import AUTO, BURST, CAPTURE_GAPS, CHUNKS, COUNTER, ENTROPY, LOCAL, NEWFLOW_GAPS, NEWFLOWS, SERIES1, SORTED_GAPS, TCP


def sparse_times(spark, sf) -> DataFrame:
    """Packets some of whose times are lost, most of them in a few captures."""
    p = packets_with_lost_times(spark, sf)
    few = F.col("filename").contains("Gamer5m") & (F.col("k") % 13 != 1)
    return p.withColumn("ts_us", F.when(few, 0).otherwise(F.col("ts_us")))


def _written(spark, documents: DataFrame, label: str) -> DataFrame:
    path = work_path(spark, label)
    sinks.write_documents(documents, path)
    return reports.document_paths(sinks.read_documents(spark, path))


def sink_report_json(spark, sf):
    return _written(spark, reports.statistics_report(sparse_times(spark, sf)), "report")


def sink_quality_json(spark, sf):
    return _written(spark, reports.quality_report(packets_with_jitter(spark, sf)), "quality-report")


_LIST_DIMS = "(VALUES " + ", ".join(f"('{name}', '{dim}', {str(dim in reports.NUMBERS).lower()})" for name, dim in reports.COUNTERS.items()) + ")"
_RAW_DIMS = "(VALUES " + ", ".join(f"('{name}', '{metric}', {unit or 1.0}::DOUBLE)" for name, (metric, unit) in reports.RAW_LISTS.items()) + ")"
_COUNTER_CTES = COUNTER.rsplit("SELECT * FROM ranked", 1)[0].rstrip()
_AUTO_CTES = AUTO.replace("\nSELECT filename", ",\nauto AS (SELECT filename", 1) + ")"
_TRUSTED = SERIES1.replace("FROM packets_z WHERE ts_us > 0)", "FROM packets_z WHERE ts_us > 0 AND filename IN (SELECT filename FROM trust WHERE ok))")


def leaves(scalars: str, texts: str, lists: str) -> str:
    """Rows (filename, path, number, text) of wide tables and of lists that are rows already."""
    return f"""
SELECT filename, path, number, NULL AS text FROM (SELECT filename, COLUMNS(* EXCLUDE (filename))::DOUBLE FROM ({scalars})) UNPIVOT INCLUDE NULLS (number FOR path IN (COLUMNS(* EXCLUDE (filename))))
UNION ALL SELECT filename, path, NULL, text FROM ({texts}) UNPIVOT INCLUDE NULLS (text FOR path IN (COLUMNS(* EXCLUDE (filename))))
{lists}"""


STATISTICS = (
    ", trust AS (SELECT filename, count(*) AS packets, sum(frame_len)::BIGINT AS bytes, round(avg(frame_len), 6) AS avg_size, count(*) FILTER (WHERE ts_us <= 0) AS zero, "
    "min(ts_us) FILTER (WHERE ts_us > 0) AS lo, max(ts_us) FILTER (WHERE ts_us > 0) AS hi, count(*) FILTER (WHERE ts_us <= 0) * 2 <= count(*) AS ok FROM packets_z GROUP BY 1),"
    + UNI_Z + "," + SORTED_GAPS + "," + NEWFLOW_GAPS + "," + _TRUSTED + "," + CHUNKS + "," + NEWFLOWS + "," + _AUTO_CTES + "," + _COUNTER_CTES + "," + LOCAL + f""",
fl AS (SELECT filename, count(*) AS flows, quantile_cont(bytes, 0.5) AS mb, quantile_cont(dur_us, 0.5) / 1e6 AS md, quantile_cont(packets, 0.5) AS mp FROM unidir GROUP BY 1),
dd AS (SELECT filename, count(*) AS u, {ENTROPY} AS h FROM (SELECT filename, dst, count(*) AS n, sum(count(*)) OVER (PARTITION BY filename)::DOUBLE AS tot FROM packets GROUP BY 1, 2) GROUP BY 1),
dn AS (SELECT filename, count(*) AS u, {ENTROPY} AS h FROM (SELECT filename, regexp_extract(dns_qname, '[^.]+[.][^.]+$') AS dom, count(*) AS n, sum(count(*)) OVER (PARTITION BY filename)::DOUBLE AS tot
  FROM packets WHERE dns_qname IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
bp AS (SELECT filename, {BURST} AS x FROM gaps WHERE gap_us > 0 GROUP BY 1), bn AS (SELECT filename, {BURST} AS x FROM ngaps WHERE gap_us > 0 GROUP BY 1),
bs AS (SELECT filename, round(max(bytes) * 8 / 1e6, 6) AS peak, round(quantile_cont(bytes, 0.95) * (8 / 1e6), 6) AS p95, round(quantile_cont(bytes, 0.99) * (8 / 1e6), 6) AS p99 FROM series GROUP BY 1),
ob AS (SELECT filename, count(*) FILTER (WHERE p.is_tcp) AS a, count(*) FILTER (WHERE NOT p.is_tcp) AS b, count(*) FILTER (WHERE p.is_tcp AND dport = 443) AS c,
  count(*) FILTER (WHERE NOT p.is_tcp AND dport = 443) AS d, count(*) FILTER (WHERE NOT p.is_tcp AND dport = 53) AS e
  FROM packets p JOIN best USING (filename) WHERE p.src = best.local_ip AND p.packet_no >= best.known_from_no AND dport IS NOT NULL GROUP BY 1),
raw AS (SELECT filename, metric, value, pos FROM (
  SELECT filename, unnest(['bytes', 'dur_us', 'packets']) AS metric, unnest([bytes, dur_us, packets]) AS value, row_number() OVER (PARTITION BY filename ORDER BY first_no) AS pos FROM unidir
  UNION ALL SELECT filename, 'pkt_gap_us', gap, pos FROM (SELECT filename, ts_us - lag(ts_us) OVER o AS gap, row_number() OVER o - 1 AS pos FROM packets_z WHERE ts_us > 0 WINDOW o AS (PARTITION BY filename ORDER BY ts_us, packet_no)) WHERE pos > 0
  UNION ALL SELECT filename, 'newflow_gap_us', gap, pos FROM (SELECT filename, seen_us - lag(seen_us) OVER o AS gap, row_number() OVER o - 1 AS pos FROM unidir WINDOW o AS (PARTITION BY filename ORDER BY seen_us, first_no)) WHERE pos > 0)),
dims AS (SELECT * FROM {_LIST_DIMS} d(name, dim, num)), rawdims AS (SELECT * FROM {_RAW_DIMS} d(name, metric, unit)),
tf AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY bytes DESC, first_no) - 1 AS i FROM unidir QUALIFY i < 15),
ws AS (SELECT filename, window_s, round(avg(bytes) * (8.0::DOUBLE / window_s / 1e6), 6) AS mean, round(quantile_cont(bytes, 0.95) * (8.0::DOUBLE / window_s / 1e6), 6) AS p95,
  round(quantile_cont(bytes, 0.99) * (8.0::DOUBLE / window_s / 1e6), 6) AS p99, round(max(bytes) * (8.0::DOUBLE / window_s / 1e6), 6) AS max FROM w GROUP BY 1, 2)
""" + leaves(
        """SELECT t.filename, packets, bytes, avg_size AS avg_packet_size, 1 AS bucket_seconds, coalesce(hi - lo, 0) / 1e6 AS duration_bucket_seconds, coalesce(hi - lo, 0) / 1e6 AS duration_ts_seconds,
  coalesce(hi - lo, 0) / 1e6 AS duration_used_seconds, CASE WHEN hi > lo THEN round(bytes * 8 / ((hi - lo) / 1e6), 6) ELSE 0.0 END AS throughput_avg_bps,
  bs.peak AS throughput_peak_mbps_bucket, bs.p95 AS throughput_p95_mbps_bucket, bs.p99 AS throughput_p99_mbps_bucket, zero AS timestamps_zero, round(zero / packets, 6) AS timestamps_zero_ratio,
  lo / 1e6 AS ts_nonzero_min, hi / 1e6 AS ts_nonzero_max, coalesce(flows, 0) AS flows_total, CASE WHEN hi > lo THEN round(flows / ((hi - lo) / 6e7), 6) ELSE 0.0 END AS flows_per_min,
  dd.u AS unique_dst_ips, dd.h AS entropy_dst_ips, coalesce(dn.u, 0) AS unique_dns_domains, coalesce(dn.h, 0) AS entropy_dns_domains, coalesce(bp.x, 0) AS burstiness_pkt_iat, coalesce(bn.x, 0) AS burstiness_newflow_iat,
  coalesce(autocorr_lag1, 0) AS autocorr_lag1_throughput_bps, coalesce(ob.a, 0) AS tcp_outbound_total_pkts, coalesce(ob.b, 0) AS udp_outbound_total_pkts, coalesce(ob.c, 0) AS tcp_outbound_dport_443_pkts,
  coalesce(ob.d, 0) AS udp_outbound_dport_443_pkts, coalesce(ob.e, 0) AS udp_outbound_dport_53_pkts, 0 AS bad_frames, mb AS median_bytes_per_flow, md AS median_flow_duration_s, mp AS median_pkts_per_flow
  FROM trust t LEFT JOIN bs USING (filename) LEFT JOIN fl USING (filename) LEFT JOIN dd USING (filename) LEFT JOIN dn USING (filename) LEFT JOIN bp USING (filename) LEFT JOIN bn USING (filename)
  LEFT JOIN auto USING (filename) LEFT JOIN ob USING (filename)""",
        """SELECT t.filename, CASE WHEN hi > lo THEN 'duration_bucket' ELSE 'fallback_invalid_ts' END AS duration_reason, local_ip, local_ip_source FROM trust t LEFT JOIN local USING (filename)""",
        f"""
UNION ALL SELECT filename, name || '[' || (rank - 1) || '][0]', CASE WHEN num THEN value::DOUBLE END, CASE WHEN NOT num THEN value END FROM ranked JOIN dims USING (dim) WHERE rank <= 15
UNION ALL SELECT filename, name || '[' || (rank - 1) || '][1]', n, NULL FROM ranked JOIN dims USING (dim) WHERE rank <= 15
UNION ALL SELECT filename, name, NULL, '[]' FROM trust, dims WHERE (filename, dim) NOT IN (SELECT filename, dim FROM ranked)
UNION ALL SELECT filename, name || '[' || (pos - 1) || ']', value / unit, NULL FROM raw JOIN rawdims USING (metric)
UNION ALL SELECT filename, name, NULL, '[]' FROM trust, rawdims WHERE (filename, metric) NOT IN (SELECT filename, metric FROM raw)
UNION ALL SELECT filename, 'throughput_series.times_seconds_from_start[' || idx || ']', idx, NULL FROM series
UNION ALL SELECT filename, 'throughput_series.mbps[' || idx || ']', round(bytes * 8 / 1e6, 6), NULL FROM series
UNION ALL SELECT filename, 'throughput_series', NULL, '{reports.UNRELIABLE}' FROM trust WHERE NOT ok
UNION ALL SELECT filename, 'windowed_throughput_bps.' || window_s || '[' || k || ']', round(bytes * 8.0::DOUBLE / window_s, 6), NULL FROM w
UNION ALL SELECT filename, 'windowed_newflows_per_min.' || window_s || '[' || k || ']', round(coalesce(n, 0) / (window_s / 60.0::DOUBLE), 6), NULL FROM alln LEFT JOIN hit USING (filename, window_s, k)
UNION ALL SELECT filename, 'windowed_throughput_summary_mbps.' || window_s || '.' || unnest(['mean', 'p95', 'p99', 'max']), unnest([mean, p95, p99, max]), NULL FROM ws
UNION ALL SELECT filename, 'windowed_throughput_summary_mbps', NULL, '{{}}' FROM trust WHERE filename NOT IN (SELECT filename FROM w)
UNION ALL SELECT filename, 'top_flows_unidirectional[' || i || '].' || unnest(['sport', 'dport', 'bytes', 'packets', 'duration']), unnest([sport, dport, bytes, packets, dur_us / 1e6]), NULL FROM tf
UNION ALL SELECT filename, 'top_flows_unidirectional[' || i || '].' || unnest(['ip_version', 'src', 'dst', 'proto']), NULL, unnest([ip_version, src, dst, proto]) FROM tf""",
    )
)
_LOST = "CASE WHEN k % 13 = 0 THEN 0 ELSE ts_us END AS ts_us"

QUALITY = (
    "," + CAPTURE_GAPS.replace("{src}", "packets_j") + "," + TCP.split("SELECT filename, coalesce(sum(re)")[0].rstrip() + """,
t AS (SELECT filename, count(*) AS n, sum(frame_len)::BIGINT AS b, arg_min(ts_us, packet_no) AS a, arg_max(ts_us, packet_no) AS z, round(avg(frame_len), 6) AS me, quantile_cont(frame_len, 0.5) AS md,
  round(quantile_cont(frame_len, 0.95), 6) AS p95, max(frame_len) AS mx FROM packets_j GROUP BY 1),
g AS (SELECT filename, count(*) FILTER (WHERE gap_us > 100000) AS over, round(avg(gap_us) / 1e6, 9) AS me, quantile_cont(gap_us, 0.5) / 1e6 AS md, round(quantile_cont(gap_us, 0.95) / 1e6, 9) AS p95, max(gap_us) / 1e6 AS mx FROM gaps GROUP BY 1),
s AS (SELECT filename, max(b) * 8 AS pb, max(n) AS pp FROM (SELECT filename, ts_us // 1000000 AS sec, sum(frame_len)::BIGINT AS b, count(*) AS n FROM packets_j GROUP BY 1, 2) GROUP BY 1),
d AS (SELECT filename, sum(c - 1) AS dup FROM (SELECT filename, count(*) AS c FROM packets_j GROUP BY filename, frame_len, src, dst, proto_num, sport, dport, tcp_seq, tcp_flags, payload_len, icmp_type, dns_qname, http_text, quic_hex) GROUP BY 1),
q AS (SELECT filename, coalesce(sum(re), 0) AS re, coalesce(sum(oo), 0) AS oo FROM (SELECT DISTINCT filename FROM packets) LEFT JOIN ends USING (filename) GROUP BY 1),
ps AS (SELECT filename, CASE WHEN is_tcp THEN 'tcp' ELSE 'udp' END AS l4, unnest([sport, dport]) AS port, unnest([packet_no * 2, packet_no * 2 + 1]) AS o FROM packets WHERE sport IS NOT NULL),
pr AS (SELECT filename, l4, port, count(*) AS n, row_number() OVER (PARTITION BY filename, l4 ORDER BY count(*) DESC, min(o)) - 1 AS i FROM ps GROUP BY 1, 2, 3 QUALIFY i < 10)
""" + leaves(
        """SELECT filename, n AS "scapy.total_packets", b AS "scapy.total_bytes", a / 1e6 AS "scapy.capture_start_ts", z / 1e6 AS "scapy.capture_end_ts", (z - a) / 1e6 AS "scapy.duration_seconds",
  over AS "scapy.gaps_over_threshold", 100.0 AS "scapy.gap_threshold_ms", g.me AS "scapy.inter_arrival.mean_s", g.md AS "scapy.inter_arrival.median_s", g.p95 AS "scapy.inter_arrival.p95_s", g.mx AS "scapy.inter_arrival.max_s",
  t.me AS "scapy.packet_sizes.mean_bytes", t.md AS "scapy.packet_sizes.median_bytes", t.p95 AS "scapy.packet_sizes.p95_bytes", t.mx AS "scapy.packet_sizes.max_bytes",
  pb AS "scapy.throughput.peak_bps", pp AS "scapy.throughput.peak_pps", CASE WHEN z > a THEN round((b * 8)::DOUBLE / ((z - a) / 1e6), 6) END AS "scapy.throughput.average_bps",
  CASE WHEN z > a THEN round(n::DOUBLE / ((z - a) / 1e6), 6) END AS "scapy.throughput.average_pps", dup AS "scapy.duplicates_approx", re AS "scapy.tcp_quality.retransmissions", oo AS "scapy.tcp_quality.out_of_order"
  FROM t JOIN g USING (filename) JOIN s USING (filename) JOIN d USING (filename) JOIN q USING (filename)""",
        f"""SELECT filename, '{reports.TCP_NOTE}' AS "scapy.tcp_quality.note", 'Zeek no se ejecutó / no está disponible.' AS "zeek.note" FROM t""",
        """
UNION ALL SELECT filename, 'scapy.protocols.ethertypes.IPv4', count(*), NULL FROM packets GROUP BY 1
UNION ALL SELECT filename, 'scapy.protocols.ip_protocols.' || CASE proto_num WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'ICMP' END, count(*), NULL FROM packets GROUP BY 1, 2
UNION ALL SELECT filename, 'scapy.protocols.top_' || l4 || '_ports[' || i || '].' || unnest(['port', 'count']), unnest([port, n]), NULL FROM pr""",
    )
)


RULE = "|-------------------------------|"


def statistics_runs(spark, sf, per_second: bool = False) -> DataFrame:
    """What the statistics tool says of each capture: ruled tables, cut files, failures, and output without a table."""
    p = packets(spark, sf)
    if per_second:
        start = p.groupBy("filename").agg(F.min("ts_us").alias("t0"))
        lines = p.join(start, "filename").groupBy("filename", F.floor((F.col("ts_us") - F.col("t0")) / 1_000_000).alias("s"))
        lines = lines.agg(F.count(F.lit(1)).alias("frames"), F.sum("frame_len").alias("bytes"))
    else:
        lines = p.groupBy("filename").agg(F.lit(0).cast("bigint").alias("s"), F.count(F.lit(1)).alias("frames"), F.sum("frame_len").alias("bytes"))
    row = F.format_string("| %5d <> %5d | %6d | %,11d |", "s", F.col("s") + 1, "frames", "bytes")
    body = lines.groupBy("filename").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", row.alias("r")))), lambda x: x["r"]), "\n").alias("rows"))
    table = F.concat(
        F.lit(f"\n=================================\n| IO Statistics                 |\n| Duration: 300.0 secs          |\n{RULE}\n| Interval      | Frames | Bytes |\n{RULE}\n"),
        "rows", F.lit("\n=================================\n"))
    name = F.col("filename")
    cut, broken, bare = name.contains("Gamer"), name.contains("Web5m"), name.contains("Admin1h")
    return body.select(
        "filename",
        F.when(cut, 2).when(broken, 1).otherwise(0).alias("exit_code"),
        F.when(cut | broken, "").when(bare, "nothing to show\n| 7 |\n").otherwise(table).alias("stdout"),
        F.when(cut, "tool: The file appears to have been cut short in the middle of a packet.\n").when(broken, " no such file \n").otherwise("").alias("stderr"),
    )


def capture_totals_log(spark, sf):
    """Totals from the tool's table, from counted packets, or from nothing."""
    known = packets(spark, sf).where(~F.col("filename").contains("Web5m"))
    return cap.capture_totals(known, logs.decode_io_totals(statistics_runs(spark, sf)))


def capture_summary_log(spark, sf):
    """The summary row where all parts come from logs, errors joined."""
    p = packets(spark, sf)
    totals, peaks = logs.decode_io_totals(statistics_runs(spark, sf)), logs.decode_io_peaks(statistics_runs(spark, sf, per_second=True))
    out = cap.capture_summary(p.where(~F.col("filename").contains("Web5m")), logs.decode_tool_log(tool_rows(spark, sf)), totals=totals, peaks=peaks)
    return out.select("filename", "profile", "packets_total", "bytes_total", "mean_bps", "peak_mbps_1s", "tcp_pkts", "top_tcp_dport", "totals_source", "totals_consistent", "error")


RUNS = """
known AS (SELECT filename, count(*) AS n, sum(frame_len)::BIGINT AS b, filename LIKE '%Gamer%' AS cut, filename LIKE '%Web5m%' AS broken, filename LIKE '%Admin1h%' AS bare FROM packets GROUP BY 1),
chain AS (SELECT filename, CASE WHEN broken THEN 0 ELSE n END AS packets_total, CASE WHEN broken THEN 0 ELSE b END AS bytes_total,
  CASE WHEN broken THEN 'error' WHEN cut OR bare THEN 'tshark_frame_len' ELSE 'tshark_io_stat' END AS totals_source,
  CASE WHEN cut THEN 'tshark_truncated(io,stat,0)' WHEN broken THEN 'tshark_io_stat_0_failed(exit=1): no such file | tshark_frame_len_parse_failed'
       WHEN bare THEN 'tshark_io_stat_0_parse_failed' ELSE '' END AS error FROM known)"""
LOGGED = RUNS + "," + TOOLS + "," + PEAK + "," + TOPPORT + ", names AS (SELECT DISTINCT filename FROM packets)," + NAMED + ", c AS (SELECT filename, " + COUNTS + """ FROM packets GROUP BY 1)
SELECT p.filename, profile, packets_total, bytes_total, round(CASE WHEN capture_duration_s > 0 AND bytes_total > 0 THEN bytes_total * 8.0::DOUBLE / capture_duration_s END, 6) AS mean_bps,
  CASE WHEN NOT (cut OR broken OR bare) THEN peak_mbps_1s END AS peak_mbps_1s, CASE WHEN broken THEN 0 ELSE tcp_pkts END AS tcp_pkts, CASE WHEN NOT broken THEN top_tcp_dport END AS top_tcp_dport, totals_source,
  (NOT broken AND packets_total = tcp_pkts + udp_pkts + icmp_pkts + other_pkts)::INT AS totals_consistent,
  concat_ws(' | ', nullif(tool.error, ''), nullif(chain.error, ''), CASE WHEN cut THEN 'tshark_truncated(io,stat,1)' WHEN broken THEN 'tshark_io_stat_1_failed(exit=1): no such file' END) AS error
FROM parsed p JOIN chain USING (filename) JOIN known USING (filename) JOIN tool USING (filename) JOIN peak USING (filename) JOIN top USING (filename) JOIN c USING (filename)"""


def tunnelled_export(spark, sf) -> DataFrame:
    """Packets written with all fields and read back: some have a UDP layer around TCP, lengths are cut at 96 bytes, and contents have a hash."""
    path = work_path(spark, "full-export")
    p = packets(spark, sf).withColumn("tunnel", (F.col("proto_num") == 6) & (F.col("k") % 7 == 0))
    when = F.concat(F.floor(F.col("ts_us") / 1_000_000).cast("string"), F.lit("."), F.lpad((F.col("ts_us") % 1_000_000).cast("string"), 6, "0"))
    tcp, udp, outer = F.col("proto_num") == 6, F.col("proto_num") == 17, F.col("tunnel")
    fields = {
        "frame.time_epoch": when, "frame.len": F.col("frame_len"), "frame.cap_len": F.least("frame_len", F.lit(96)), "ip.src": F.col("src"), "ip.dst": F.col("dst"),
        "ip.proto": F.when(outer, "17,6").otherwise(F.col("proto_num").cast("string")),
        "tcp.srcport": F.when(tcp, F.col("sport")), "tcp.dstport": F.when(tcp, F.col("dport")),
        "udp.srcport": F.when(outer, 4500).when(udp, F.col("sport")), "udp.dstport": F.when(outer, F.when(F.col("k") % 2 == 0, 443).otherwise(4500)).when(udp, F.col("dport")),
        "frame.md5_hash": F.md5(F.concat_ws("|", "src", "dst", F.col("frame_len").cast("string"), F.col("k").cast("string")).cast("binary")),
    }
    lines = p.repartitionByRange(3, "packet_no").sortWithinPartitions("filename", "packet_no")
    lines.select("filename", *(c.cast("string").alias(n) for n, c in fields.items())).write.partitionBy("filename").option("header", True).option("quoteAll", True).csv(path)
    return reader.scan_packet_fields(spark, path)


def exported_counts(spark, sf):
    """Classes, ports, captured lengths and duplicates of each capture of the export."""
    p = tunnelled_export(spark, sf)
    parts = [cap.proto_counts(p), cap.top_dst_port(p), cap.packet_size_stats(p), diversity.duplicate_packets(p)]
    return parts[0].join(parts[1], "filename").join(parts[2], "filename").join(parts[3], "filename")


def exported_dst443(spark, sf):
    p = tunnelled_export(spark, sf)
    return p.groupBy(*(c.alias(n) for n, c in cap.dst443_flags(p.columns).items())).agg(F.count(F.lit(1)).alias("pkts"), F.sum("cap_len").alias("bytes"))


def exported_ports(spark, sf):
    return cap.top_ports_both_sides(tunnelled_export(spark, sf))


TUNNELS = """
x AS (SELECT *, proto_num = 6 AND k % 7 = 0 AS tun, least(frame_len, 96) AS cap_len FROM packets),
y AS (SELECT filename, packet_no, cap_len, frame_len, src, dst, k, proto_num, proto_num = 6 AS t, proto_num = 17 OR tun AS u, CASE WHEN proto_num = 6 THEN sport END::INT AS ts, CASE WHEN proto_num = 6 THEN dport END::INT AS td,
  CASE WHEN tun THEN 4500 WHEN proto_num = 17 THEN sport END::INT AS us, CASE WHEN tun THEN CASE WHEN k % 2 = 0 THEN 443 ELSE 4500 END WHEN proto_num = 17 THEN dport END::INT AS ud FROM x)"""
EXPORTED = TUNNELS + """,
c AS (SELECT filename, count(*) FILTER (WHERE t) AS tcp_pkts, count(*) FILTER (WHERE u) AS udp_pkts, count(*) FILTER (WHERE proto_num = 1) AS icmp_pkts, 0::BIGINT AS other_pkts,
  count(*) FILTER (WHERE u AND ud = 443) AS udp443_pkts, count(*) FILTER (WHERE t AND td = 443) AS tcp443_pkts, round(avg(cap_len), 6) AS mean_bytes, quantile_cont(cap_len, 0.5) AS median_bytes,
  round(quantile_cont(cap_len, 0.95), 6) AS p95_bytes, max(cap_len) AS max_bytes, count(*) AS total, count(*) - count(DISTINCT src || '|' || dst || '|' || frame_len || '|' || k) AS duplicates FROM y GROUP BY 1),
pt AS (SELECT filename, td AS top_tcp_dport, count(*) AS top_tcp_dport_pkts FROM y WHERE td IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY filename ORDER BY count(*) DESC, min(packet_no)) = 1),
pu AS (SELECT filename, ud AS top_udp_dport, count(*) AS top_udp_dport_pkts FROM y WHERE ud IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY filename ORDER BY count(*) DESC, min(packet_no)) = 1)
SELECT c.*, top_udp_dport, coalesce(top_udp_dport_pkts, 0) AS top_udp_dport_pkts, top_tcp_dport, coalesce(top_tcp_dport_pkts, 0) AS top_tcp_dport_pkts FROM c LEFT JOIN pt USING (filename) LEFT JOIN pu USING (filename)"""
EXPORTED_PORTS = TUNNELS + """,
z AS (SELECT filename, unnest(['tcp', 'tcp', 'udp', 'udp']) AS l4, unnest([ts, td, us, ud]) AS port, packet_no * 2 + unnest([0, 1, 0, 1]) AS o FROM y),
r AS (SELECT filename, l4, row_number() OVER (PARTITION BY filename, l4 ORDER BY count(*) DESC, min(o))::INT AS rank, port, count(*) AS n FROM z WHERE port IS NOT NULL GROUP BY 1, 2, port QUALIFY rank <= 10)
SELECT * FROM r"""

QUERIES = {
    "sink_report_json": (sink_report_json, with_packets(STATISTICS).replace(_LOST, "CASE WHEN k % 13 = 0 OR (filename LIKE '%Gamer5m%' AND k % 13 <> 1) THEN 0 ELSE ts_us END AS ts_us")),
    "sink_quality_json": (sink_quality_json, with_packets(QUALITY).replace("WITH", "WITH RECURSIVE", 1)),
    "capture_totals_log": (capture_totals_log, with_packets("," + RUNS + " SELECT * FROM chain")),
    "capture_summary_log": (capture_summary_log, with_packets("," + LOGGED)),
    "exported_counts": (exported_counts, with_packets("," + EXPORTED)),
    "exported_dst443": (exported_dst443, with_packets(
        "," + TUNNELS + " SELECT u AND coalesce(ud = 443, false) AS udp_dst443, t AND coalesce(td = 443, false) AS tcp_dst443, count(*) AS pkts, sum(cap_len)::BIGINT AS bytes FROM y GROUP BY 1, 2")),
    "exported_ports": (exported_ports, with_packets("," + EXPORTED_PORTS)),
}
