"""Registered queries over packets: names, counts, totals and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import naming
from ..operators import captures as cap
from ..operators import conditions, diversity
from ..sources.adapter import packets, packets_with_lost_times, table
from .oracle_base import with_packets

NAME_COLUMNS = """
  CASE WHEN a IS NULL THEN NULL WHEN starts_with(a, 'admin') THEN 'admin' WHEN starts_with(a, 'gamer') THEN 'gamer'
       WHEN starts_with(a, 'web') OR starts_with(a, 'normal') THEN 'regular' ELSE a END AS profile,
  d AS duration_label,
  CASE d WHEN '5m' THEN 5 WHEN '15m' THEN 15 WHEN '60m' THEN 60 WHEN '1h' THEN 60 END AS duration_requested_min, r AS run_idx"""

NAMED = r"""
named AS (
  SELECT filename, CASE WHEN ok THEN lower(regexp_extract(filename, rx, 1)) END AS a,
         CASE WHEN ok THEN regexp_extract(filename, rx, 2) END AS d,
         CASE WHEN ok THEN TRY_CAST(regexp_extract(filename, rx, 3) AS INTEGER) END AS r
  FROM (SELECT filename, '^capturaAgente([A-Za-z]+)(\d+m|1h)(\d+)\.pcapng$' AS rx,
               regexp_matches(filename, '^capturaAgente([A-Za-z]+)(\d+m|1h)(\d+)\.pcapng$') AS ok FROM names)
), parsed AS (SELECT filename, """ + NAME_COLUMNS + r"""
  FROM named)"""

COUNTS = """
  count(*) FILTER (WHERE is_tcp) AS tcp_pkts, count(*) FILTER (WHERE is_udp) AS udp_pkts,
  count(*) FILTER (WHERE is_icmp) AS icmp_pkts, count(*) FILTER (WHERE NOT (is_tcp OR is_udp OR is_icmp)) AS other_pkts,
  count(*) FILTER (WHERE is_udp AND dport = 443) AS udp443_pkts, count(*) FILTER (WHERE is_tcp AND dport = 443) AS tcp443_pkts"""

PEAK = """
peak AS (
  SELECT filename, CASE WHEN max(b) > 0 THEN max(b) * 8.0 / 1e6 END AS peak_mbps_1s FROM (
    SELECT p.filename, (p.ts_us - f.t0) // 1000000 AS bin, sum(frame_len)::BIGINT AS b
    FROM packets p JOIN (SELECT filename, min(ts_us) AS t0 FROM packets GROUP BY 1) f USING (filename) GROUP BY 1, 2) GROUP BY 1)"""

TOPPORT = """
ports AS (
  SELECT filename, l4, dport, n, row_number() OVER (PARTITION BY filename, l4 ORDER BY n DESC, first_no) AS rn FROM (
    SELECT filename, CASE WHEN is_tcp THEN 'tcp' ELSE 'udp' END AS l4, dport, count(*) AS n, min(packet_no) AS first_no
    FROM packets WHERE dport IS NOT NULL AND (is_tcp OR is_udp) GROUP BY 1, 2, 3)
), top AS (
  SELECT c.filename, u.dport::INT AS top_udp_dport, coalesce(u.n, 0) AS top_udp_dport_pkts,
         t.dport::INT AS top_tcp_dport, coalesce(t.n, 0) AS top_tcp_dport_pkts
  FROM (SELECT DISTINCT filename FROM packets) c
  LEFT JOIN ports u ON u.filename = c.filename AND u.l4 = 'udp' AND u.rn = 1
  LEFT JOIN ports t ON t.filename = c.filename AND t.l4 = 'tcp' AND t.rn = 1)"""

SUMMARY = "base AS (SELECT filename, count(*) AS packets_total, sum(frame_len)::BIGINT AS bytes_total," \
    "(max(ts_us) - min(ts_us)) / 1e6 AS capture_duration_s, " + COUNTS + " FROM packets GROUP BY 1), " + PEAK + ", " + TOPPORT + """,
names AS (SELECT DISTINCT filename FROM packets), """ + NAMED + """,
summary AS (
  SELECT p.filename, profile, duration_label, duration_requested_min, run_idx, capture_duration_s, packets_total, bytes_total,
         round(CASE WHEN capture_duration_s > 0 AND bytes_total > 0 THEN bytes_total * 8.0::DOUBLE / capture_duration_s END, 6) AS mean_bps,
         peak_mbps_1s, tcp_pkts, udp_pkts, icmp_pkts, other_pkts, udp443_pkts, tcp443_pkts,
         top_udp_dport, top_udp_dport_pkts, top_tcp_dport, top_tcp_dport_pkts, 0 AS capinfos_truncated, '' AS capinfos_stderr,
         'tshark_frame_len' AS totals_source,
         (packets_total = tcp_pkts + udp_pkts + icmp_pkts + other_pkts)::INT AS totals_consistent, '' AS error, p.filename AS path
  FROM parsed p JOIN base USING (filename) JOIN peak USING (filename) JOIN top USING (filename))"""


def _odd_names(spark, sf):
    """Capture names of the events, and names that break the scheme in several ways."""
    p = packets(spark, sf).select("filename", "k").distinct()
    return p.select(
        F.when(F.col("k") % 7 == 0, F.replace("filename", F.lit("Agente"), F.lit("agent")))
        .when(F.col("k") % 7 == 1, F.replace("filename", F.lit("Web"), F.lit("NormalUser")))
        .when(F.col("k") % 7 == 2, F.replace("filename", F.lit("Gamer"), F.lit("Backup")))
        .when(F.col("k") % 7 == 3, F.replace("filename", F.lit("15m"), F.lit("30m")))
        .when(F.col("k") % 7 == 4, F.replace("filename", F.lit(".pcapng"), F.lit(".pcap")))
        .otherwise(F.col("filename")).alias("filename")
    ).distinct()


ODD_NAMES = """
names AS (SELECT DISTINCT CASE k % 7 WHEN 0 THEN replace(filename, 'Agente', 'agent') WHEN 1 THEN replace(filename, 'Web', 'NormalUser')
   WHEN 2 THEN replace(filename, 'Gamer', 'Backup') WHEN 3 THEN replace(filename, '15m', '30m')
   WHEN 4 THEN replace(filename, '.pcapng', '.pcap') ELSE filename END AS filename FROM packets)"""


def parse_capture_name(spark, sf):
    return naming.with_capture_name(_odd_names(spark, sf))


def map_profile(spark, sf):
    agents = packets(spark, sf).select(
        F.concat(F.regexp_extract("filename", "Agente([A-Za-z]+?)[0-9]", 1), (F.col("k") % 3).cast("string")).alias("agent")
    )
    return agents.groupBy("agent").agg(F.count(F.lit(1)).alias("n")).select("agent", naming.map_profile(F.col("agent")).alias("profile"), "n")


def duration_target(spark, sf):
    label = F.regexp_extract("filename", r"(\d+m|1h)\d+\.pcapng$", 1)
    rows = packets(spark, sf).select(label.alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(
        "label", naming.duration_minutes(F.col("label")).alias("minutes"),
        naming.duration_seconds(F.col("label")).alias("seconds"), naming.duration_group(F.col("label")).alias("grouped"), "n",
    )


def capture_totals(spark, sf):
    p = packets(spark, sf)
    # totals of an outside tool that are missing for some captures
    told = p.groupBy("filename").agg(F.count(F.lit(1)).alias("frames"), F.sum("frame_len").alias("bytes"), F.min("k").alias("k"))
    told = told.select("filename", F.when(F.col("filename").contains("Gamer"), None).otherwise(F.col("frames")).alias("frames"), "bytes")
    return cap.capture_totals(p, told)


def totals_consistent(spark, sf):
    p = packets(spark, sf).groupBy("filename").agg(F.count("frame_len").alias("packets_total"), *cap.proto_count_columns())
    parts = [F.col(c) for c in ("tcp_pkts", "udp_pkts", "icmp_pkts", "other_pkts")]
    return p.select("filename", "packets_total", cap.totals_consistent(F.col("packets_total"), *parts).alias("totals_consistent"))


def mean_throughput(spark, sf):
    p = packets_with_lost_times(spark, sf).groupBy("filename", "src").agg(
        F.sum("frame_len").alias("bytes"), ((F.max("ts_us") - F.min("ts_us")) / 1e6).alias("secs")
    )
    return p.select("filename", "src", F.round(cap.mean_bps(F.col("bytes"), F.col("secs")), 6).alias("mean_bps"))


def dst443_flags(spark, sf):
    p = packets(spark, sf)
    return p.groupBy(*(c.alias(n) for n, c in cap.dst443_flags(p.columns).items())).agg(F.count(F.lit(1)).alias("pkts"), F.sum("frame_len").alias("bytes"))


def matrix_coverage(spark, sf):
    return conditions.matrix_coverage(_odd_names(spark, sf).unionByName(packets(spark, sf).where(F.col("filename").contains("Web5m")).select("filename").distinct()))


def report_order(spark, sf):
    rows = naming.with_capture_name(packets(spark, sf).select("filename").distinct())
    return conditions.report_order(rows).select("filename", "profile", "duration_label", "profile_place", "duration_place")


QUERIES = {
    "parse_capture_name": (parse_capture_name, with_packets("," + ODD_NAMES + "," + NAMED + " SELECT * FROM parsed")),
    "map_profile": (map_profile, with_packets(
        ", x AS (SELECT regexp_extract(filename, 'Agente([A-Za-z]+?)[0-9]', 1) || CAST(k % 3 AS VARCHAR) AS agent FROM packets), "
        "y AS (SELECT agent, lower(agent) AS a, count(*) AS n FROM x GROUP BY 1) SELECT agent, CASE WHEN starts_with(a, 'admin') THEN 'admin' "
        "WHEN starts_with(a, 'gamer') THEN 'gamer' WHEN starts_with(a, 'web') OR starts_with(a, 'normal') THEN 'regular' ELSE a END AS profile, n FROM y")),
    "duration_target": (duration_target, with_packets(
        r", x AS (SELECT regexp_extract(filename, '(\d+m|1h)\d+\.pcapng$', 1) AS label, count(*) AS n FROM packets GROUP BY 1) "
        "SELECT label, CASE label WHEN '5m' THEN 5 WHEN '15m' THEN 15 ELSE 60 END AS minutes, "
        "CASE label WHEN '5m' THEN 300 WHEN '15m' THEN 900 ELSE 3600 END AS seconds, CASE label WHEN '1h' THEN '60m' ELSE label END AS grouped, n FROM x")),
    "proto_counts": (lambda s, d: cap.proto_counts(packets(s, d)),
                     with_packets("SELECT filename, " + COUNTS + " FROM packets GROUP BY 1")),
    "capture_totals": (capture_totals, with_packets(
        "SELECT filename, count(*) AS packets_total, sum(frame_len)::BIGINT AS bytes_total, "
        "CASE WHEN filename LIKE '%Gamer%' THEN 'tshark_frame_len' ELSE 'tshark_io_stat' END AS totals_source FROM packets GROUP BY 1")),
    "totals_consistent": (totals_consistent, with_packets(
        ", b AS (SELECT filename, count(*) AS packets_total, " + COUNTS + " FROM packets GROUP BY 1) SELECT filename, packets_total, "
        "(packets_total = tcp_pkts + udp_pkts + icmp_pkts + other_pkts)::INT AS totals_consistent FROM b")),
    "mean_throughput": (mean_throughput, with_packets(
        ", b AS (SELECT filename, src, sum(frame_len)::BIGINT AS b, (max(ts_us) - min(ts_us)) / 1e6 AS d FROM packets_z GROUP BY 1, 2) "
        "SELECT filename, src, round(CASE WHEN d > 0 AND b > 0 THEN b * 8.0::DOUBLE / d END, 6) AS mean_bps FROM b")),
    "peak_mbps_1s": (lambda s, d: cap.peak_mbps_1s(packets(s, d)), with_packets("," + PEAK + " SELECT * FROM peak")),
    "per_second_peaks": (lambda s, d: cap.per_second_peaks(packets(s, d)), with_packets(
        ", s AS (SELECT filename, ts_us // 1000000 AS sec, sum(frame_len)::BIGINT AS b, count(*) AS n FROM packets GROUP BY 1, 2), "
        "t AS (SELECT filename, (arg_max(ts_us, packet_no) - arg_min(ts_us, packet_no)) / 1e6 AS d FROM packets GROUP BY 1) "
        "SELECT filename, (max(b) * 8)::BIGINT AS peak_bps, max(n) AS peak_pps, round((sum(b) * 8)::DOUBLE / any_value(d), 6) AS average_bps, "
        "round(sum(n)::DOUBLE / any_value(d), 6) AS average_pps FROM s JOIN t USING (filename) GROUP BY 1")),
    "top_dst_port": (lambda s, d: cap.top_dst_port(packets(s, d)), with_packets("," + TOPPORT + " SELECT * FROM top")),
    "dst443_flags": (dst443_flags, with_packets(
        "SELECT coalesce(is_udp AND dport = 443, false) AS udp_dst443, coalesce(is_tcp AND dport = 443, false) AS tcp_dst443, "
        "count(*) AS pkts, sum(frame_len)::BIGINT AS bytes FROM packets GROUP BY 1, 2")),
    "capture_summary": (lambda s, d: cap.capture_summary(packets(s, d)), with_packets("," + SUMMARY + " SELECT * FROM summary")),
    "top_ports_both_sides": (lambda s, d: cap.top_ports_both_sides(packets(s, d)), with_packets(
        ", x AS (SELECT filename, CASE WHEN is_tcp THEN 'tcp' ELSE 'udp' END AS l4, unnest([sport, dport])::INT AS port, "
        "unnest([packet_no * 2, packet_no * 2 + 1]) AS o FROM packets WHERE sport IS NOT NULL), "
        "y AS (SELECT filename, l4, port, count(*) AS n, min(o) AS o FROM x GROUP BY 1, 2, 3), "
        "z AS (SELECT filename, l4, row_number() OVER (PARTITION BY filename, l4 ORDER BY n DESC, o)::INT AS rank, port, n FROM y) "
        "SELECT * FROM z WHERE rank <= 10")),
    "packet_size_stats": (lambda s, d: cap.packet_size_stats(packets(s, d)), with_packets(
        "SELECT filename, round(avg(frame_len), 6) AS mean_bytes, quantile_cont(frame_len, 0.5) AS median_bytes, "
        "round(quantile_cont(frame_len, 0.95), 6) AS p95_bytes, max(frame_len) AS max_bytes FROM packets GROUP BY 1")),
    "capture_span": (lambda s, d: cap.capture_span(packets_with_lost_times(s, d)), with_packets(
        "SELECT filename, arg_min(ts_us, packet_no) AS start_us, arg_max(ts_us, packet_no) AS end_us, "
        "(arg_max(ts_us, packet_no) - arg_min(ts_us, packet_no)) / 1e6 AS duration_s, min(ts_us) FILTER (WHERE ts_us > 0) AS min_nonzero_us, "
        "max(ts_us) FILTER (WHERE ts_us > 0) AS max_nonzero_us FROM packets_z GROUP BY 1")),
    "ts_trust": (lambda s, d: cap.ts_trust(packets_with_lost_times(s, d)), with_packets(
        ", x AS (SELECT filename, count(*) AS packets, count(*) FILTER (WHERE ts_us <= 0) AS zero_ts, min(ts_us) FILTER (WHERE ts_us > 0) AS min_us, "
        "max(ts_us) FILTER (WHERE ts_us > 0) AS max_us, sum(frame_len)::BIGINT AS b FROM packets_z GROUP BY 1) "
        "SELECT filename, packets, zero_ts, round(zero_ts / packets, 6) AS zero_share, zero_ts / packets <= 0.5 AS series_ok, min_us, max_us, "
        "coalesce(max_us - min_us, 0) / 1e6 AS duration_s, CASE WHEN max_us > min_us THEN 'duration_bucket' ELSE 'fallback_invalid_ts' END AS duration_reason, "
        "CASE WHEN max_us > min_us THEN round(b * 8 / ((max_us - min_us) / 1e6), 6) ELSE 0.0 END AS avg_bps FROM x")),
    "matrix_coverage": (matrix_coverage, with_packets(
        "," + ODD_NAMES.replace("names AS", "odd AS") + ", names AS (SELECT filename FROM odd UNION ALL SELECT DISTINCT filename FROM packets WHERE filename LIKE '%Web5m%'),"
        + NAMED + """, n2 AS (SELECT *, CASE duration_label WHEN '1h' THEN '60m' ELSE duration_label END AS duration FROM parsed),
        want AS (SELECT * FROM (VALUES ('regular'), ('gamer'), ('admin')) a(profile), (VALUES ('5m'), ('15m'), ('60m')) b(duration), (SELECT unnest(range(1, 6))::INT AS run_idx)),
        have AS (SELECT profile, duration, run_idx, count(*) AS have, min(filename) AS filename FROM n2 WHERE profile IS NOT NULL GROUP BY 1, 2, 3)
        SELECT * FROM (SELECT coalesce(w.profile, h.profile) AS profile, coalesce(w.duration, h.duration) AS duration, coalesce(w.run_idx, h.run_idx) AS run_idx,
          coalesce(have, 0) AS have, filename, CASE WHEN have IS NULL THEN 'missing' WHEN w.profile IS NULL THEN 'extra' WHEN have > 1 THEN 'duplicated' END AS status
          FROM want w FULL JOIN have h USING (profile, duration, run_idx)) WHERE status IS NOT NULL
        UNION ALL SELECT profile, duration, run_idx, 1, filename, 'extra' FROM n2 WHERE profile IS NULL""")),
    "report_order": (report_order, with_packets(
        ", names AS (SELECT DISTINCT filename FROM packets)," + NAMED + " SELECT filename, profile, duration_label, "
        "CASE profile WHEN 'regular' THEN 1 WHEN 'gamer' THEN 2 ELSE 3 END::BIGINT AS profile_place, "
        "CASE duration_label WHEN '5m' THEN 1 WHEN '15m' THEN 2 ELSE 3 END::BIGINT AS duration_place FROM parsed")),
    "duplicate_packets": (lambda s, d: diversity.duplicates(table(s, d, "documents"), ["source"], F.col("text")),
                          "SELECT source, sum(n)::BIGINT AS total, sum(n - 1)::BIGINT AS duplicates FROM (SELECT source, text, count(*) AS n "
                          "FROM documents WHERE text IS NOT NULL GROUP BY 1, 2) GROUP BY 1"),
}
