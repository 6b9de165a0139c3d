"""Registered queries over gaps, series, diversity, distributions and locality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distributions, diversity, locality, series, sketches, tcp, timing
from ..session import work_path
from ..sources.adapter import packets, packets_with_jitter, packets_with_lost_times, table
from .flow_plans import UNI, UNI_Z
from .oracle_base import with_packets

GAP_STATS = """SELECT filename, count(*) AS gaps, round(avg(gap_us) / 1e6, 9) AS mean_s, quantile_cont(gap_us, 0.5) / 1e6 AS median_s,
  round(quantile_cont(gap_us, 0.95) / 1e6, 9) AS p95_s, max(gap_us) / 1e6 AS max_s FROM gaps GROUP BY 1"""
CAPTURE_GAPS = """
lagged AS (SELECT filename, ts_us - lag(ts_us) OVER (PARTITION BY filename ORDER BY packet_no) AS gap_us FROM {src}),
gaps AS (SELECT * FROM lagged WHERE gap_us >= 0)"""
SORTED_GAPS = """
gaps AS (SELECT * FROM (SELECT filename, ts_us - lag(ts_us) OVER (PARTITION BY filename ORDER BY ts_us, packet_no) AS gap_us
  FROM packets_z WHERE ts_us > 0) WHERE gap_us IS NOT NULL)"""
NEWFLOW_GAPS = """
ngaps AS (SELECT * FROM (SELECT filename, seen_us - lag(seen_us) OVER (PARTITION BY filename ORDER BY seen_us, first_no) AS gap_us
  FROM unidir) WHERE gap_us IS NOT NULL)"""
BURST = "CASE WHEN count(*) >= 2 THEN round((stddev_samp(gap_us) - avg(gap_us)) / (stddev_samp(gap_us) + avg(gap_us)), 6) END"

SERIES = """
pos AS (SELECT filename, ts_us // ({b} * 1000000) AS bucket, frame_len FROM packets_z WHERE ts_us > 0),
ends AS (SELECT filename, min(bucket) AS lo, max(bucket) AS hi FROM pos GROUP BY 1),
dense AS (SELECT filename, lo, unnest(range(lo, hi + 1)) AS bucket FROM ends),
filled AS (SELECT filename, bucket, sum(frame_len)::BIGINT AS b FROM pos GROUP BY 1, 2),
series AS (SELECT d.filename, bucket - lo AS idx, coalesce(b, 0) AS bytes FROM dense d LEFT JOIN filled f USING (filename, bucket))"""
SERIES1, SERIES10 = SERIES.replace("{b}", "1"), SERIES.replace("{b}", "10")
CHUNKS = """
w AS (SELECT filename, window_s, idx // window_s AS k, sum(bytes)::BIGINT AS bytes FROM series, (SELECT unnest([300, 900, 3600]) AS window_s) GROUP BY 1, 2, 3)"""
NEWFLOWS = """
t0 AS (SELECT filename, min(ts_us) FILTER (WHERE ts_us > 0) AS t0 FROM packets_z GROUP BY 1),
hit AS (SELECT filename, window_s, (seen_us - t0) // (window_s * 1000000::BIGINT) AS k, count(*) AS n
  FROM unidir JOIN t0 USING (filename), (SELECT unnest([300, 900, 3600]) AS window_s) WHERE seen_us > 0 GROUP BY 1, 2, 3),
alln AS (SELECT filename, window_s, unnest(range(0, max(k) + 1)) AS k FROM hit WHERE k >= 0 GROUP BY 1, 2)"""
AUTO = """
x AS (SELECT filename, idx, bytes::DOUBLE AS v, avg(bytes) OVER (PARTITION BY filename) AS m, lag(bytes) OVER (PARTITION BY filename ORDER BY idx)::DOUBLE AS pv FROM series)
SELECT filename, CASE WHEN count(*) >= 3 AND sum((v - m) * (v - m)) > 0 THEN round(sum((v - m) * (pv - m)) / sum((v - m) * (v - m)), 6) ELSE 0.0 END AS autocorr_lag1
FROM x GROUP BY 1"""

APP = """CASE WHEN 443 IN (sport, dport) AND is_udp THEN 'QUIC/HTTP3' WHEN 443 IN (sport, dport) THEN 'HTTPS' WHEN 80 IN (sport, dport) THEN 'HTTP'
  WHEN 53 IN (sport, dport) THEN 'DNS' ELSE 'UNKNOWN' END"""
COUNTER = """
apps AS (SELECT *, """ + APP + """ AS app FROM (SELECT * REPLACE (coalesce(sport, -1) AS sport, coalesce(dport, -1) AS dport) FROM packets)),
long AS (
  SELECT filename, packet_no, 'eth_type' AS dim, '2048' AS value FROM apps
  UNION ALL SELECT filename, packet_no, 'ip_version', 'IPv4' FROM apps
  UNION ALL SELECT filename, packet_no, 'ip_protocol', CASE proto_num WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'ICMP' END FROM apps
  UNION ALL SELECT filename, packet_no, 'app_protocol', app FROM apps
  UNION ALL SELECT filename, packet_no, 'http_method', split_part(http_text, ' ', 1) FROM apps WHERE http_text IS NOT NULL
  UNION ALL SELECT filename, packet_no, 'http_host', regexp_extract(http_text, 'Host: ([^\\r\\n]+)', 1) FROM apps WHERE http_text IS NOT NULL
  UNION ALL SELECT filename, packet_no, 'quic_form', 'LONG_HDR' FROM apps WHERE starts_with(quic_hex, 'C')
  UNION ALL SELECT filename, packet_no, 'src_ip', src FROM apps
  UNION ALL SELECT filename, packet_no, 'dst_ip', dst FROM apps
  UNION ALL SELECT filename, packet_no, 'ip_pair', src || '->' || dst FROM apps
  UNION ALL SELECT filename, packet_no, 'tcp_src_port', sport::VARCHAR FROM apps WHERE is_tcp
  UNION ALL SELECT filename, packet_no, 'tcp_dst_port', dport::VARCHAR FROM apps WHERE is_tcp
  UNION ALL SELECT filename, packet_no, 'udp_src_port', sport::VARCHAR FROM apps WHERE proto_num = 17
  UNION ALL SELECT filename, packet_no, 'udp_dst_port', dport::VARCHAR FROM apps WHERE proto_num = 17
  UNION ALL SELECT filename, packet_no, 'tcp_flags', CASE tcp_flags WHEN 0 THEN '' WHEN 1 THEN 'F' WHEN 2 THEN 'S' ELSE 'FS' END FROM apps WHERE is_tcp
  UNION ALL SELECT filename, packet_no, 'dns_query', dns_qname FROM apps WHERE dns_qname IS NOT NULL
  UNION ALL SELECT filename, packet_no, 'icmp_type', icmp_type::VARCHAR FROM apps WHERE icmp_type IS NOT NULL
), cnt AS (SELECT filename, dim, value, count(*) AS n, min(packet_no) AS first_no FROM long GROUP BY 1, 2, 3),
ranked AS (SELECT filename, dim, row_number() OVER (PARTITION BY filename, dim ORDER BY n DESC, first_no)::INT AS rank, value, n FROM cnt)
SELECT * FROM ranked WHERE rank <= 15"""

ENTROPY = "round(-sum((n / tot) * log2(n / tot)) + 0.0, 6)"
VALUES_LONG = """
vals AS (SELECT filename, 'bytes' AS metric, bytes AS value FROM unidir UNION ALL SELECT filename, 'dur_us', dur_us FROM unidir
  UNION ALL SELECT filename, 'packets', packets FROM unidir
  UNION ALL SELECT filename, 'pkt_gap_us', gap_us FROM gaps UNION ALL SELECT filename, 'newflow_gap_us', gap_us FROM ngaps)"""
DISTRIBUTION = UNI_Z + "," + SORTED_GAPS + "," + NEWFLOW_GAPS + "," + VALUES_LONG

LOCAL = """
num AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY packet_no) AS pos,
   (starts_with(src, '10.') OR starts_with(src, '192.168.')) AS private FROM packets),
cut AS (SELECT filename, min(packet_no) AS known_from_no FROM num WHERE pos >= 200 AND private GROUP BY 1),
cand AS (SELECT filename, src, known_from_no, count(*) AS n, min(packet_no) AS f FROM num JOIN cut USING (filename)
   WHERE private AND packet_no <= known_from_no GROUP BY 1, 2, 3),
best AS (SELECT filename, src AS local_ip, 'inferred' AS local_ip_source, known_from_no FROM cand
   QUALIFY row_number() OVER (PARTITION BY filename ORDER BY n DESC, f) = 1),
local AS (SELECT c.filename, local_ip, local_ip_source, known_from_no FROM (SELECT DISTINCT filename FROM packets) c LEFT JOIN best USING (filename))"""


def _series(spark, sf, b=1):
    return series.bucket_series(packets_with_lost_times(spark, sf), b)


def bucket_series(spark, sf):
    out = _series(spark, sf, 10)
    return out.withColumns({"mbps": F.round("mbps", 6), "bps": F.round("bps", 6)})


def window_throughput(spark, sf):
    return series.window_throughput(_series(spark, sf)).withColumn("mean_bps", F.round("mean_bps", 6))


def _stored(spark, sketches, label):
    """Sketches written to the shared folder and read again, as a later day would find them."""
    path = work_path(spark, label)
    sketches.write.parquet(path)
    return spark.read.parquet(path)


PROBS = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p99": 0.99}


def percentiles_sketch(spark, sf):
    """Percentiles from stored sketches of each month, and whether each is within the stated error of its exact rank."""
    rows = table(spark, sf, "lineitem").select("l_returnflag", F.trunc("l_shipdate", "month").alias("month"), "l_extendedprice")
    parts = _stored(spark, sketches.quantile_sketches(rows, ["l_returnflag", "month"], "l_extendedprice"), "quantile-sketches")
    found = sketches.approximate_percentiles(sketches.merged_quantiles(parts, ["l_returnflag"]), ["l_returnflag"], PROBS)
    value = F.col("l_extendedprice")
    below = [F.count_if(value < F.col(p)).alias(f"{p}_lt") for p in PROBS] + [F.count_if(value <= F.col(p)).alias(f"{p}_le") for p in PROBS]
    ranks = rows.join(found, "l_returnflag").groupBy("l_returnflag", "n").agg(*below)
    slack = 2 * sketches.quantile_error()
    near = [
        ((F.col(f"{p}_lt") / F.col("n") <= q + slack) & (F.col(f"{p}_le") / F.col("n") >= q - slack)).alias(f"{p}_near") for p, q in PROBS.items()
    ]
    return ranks.select("l_returnflag", "n", *near)


def percentiles_capture_sketch(spark, sf):
    """Packet lengths of each capture from stored sketches of each minute; a sketch of so few values is exact."""
    p = packets(spark, sf).withColumn("minute", F.floor(F.col("ts_us") / 60_000_000))
    parts = _stored(spark, sketches.quantile_sketches(p, ["filename", "minute"], "frame_len"), "length-sketches")
    found = sketches.approximate_percentiles(sketches.merged_quantiles(parts, ["filename"]), ["filename"], {"p50": 0.5, "p95": 0.95})
    ranked = p.join(found, "filename").groupBy("filename", "n").agg(*(
        F.count_if(F.col("frame_len") < F.col(c)).alias(f"{c}_lt") for c in ("p50", "p95")), *(F.count_if(F.col("frame_len") <= F.col(c)).alias(f"{c}_le") for c in ("p50", "p95")))
    slack = 2 * sketches.quantile_error()
    return ranked.select("filename", "n", *(((F.col(f"{c}_lt") / F.col("n") <= q + slack) & (F.col(f"{c}_le") / F.col("n") >= q - slack)).alias(f"{c}_near") for c, q in (("p50", 0.5), ("p95", 0.95))))


def dst_diversity_sketch(spark, sf):
    """Exact destinations of each capture, and whether the merged sketches of its minutes come near."""
    p = packets(spark, sf).withColumn("minute", F.floor(F.col("ts_us") / 60_000_000))
    parts = _stored(spark, sketches.distinct_sketches(p.where(F.col("src").isNotNull() & F.col("dst").isNotNull()), ["filename", "minute"], "dst"), "distinct-sketches")
    found = sketches.approximate_distinct(sketches.merged_distinct(parts, ["filename"]), ["filename"])
    exact = diversity.dst_diversity(p).select("filename", "unique_dst_ips")
    off = F.abs(F.coalesce("approx_distinct", F.lit(0)) - F.col("unique_dst_ips"))
    return exact.join(found, "filename", "left").select("filename", "unique_dst_ips", (off <= 4 * sketches.distinct_error() * F.col("unique_dst_ips")).alias("near"))


def distinct_parts_sketch(spark, sf):
    """The same over many values: parts of each ship mode, by merged sketches of each month."""
    rows = table(spark, sf, "lineitem").select("l_returnflag", F.trunc("l_shipdate", "month").alias("month"), "l_orderkey")
    parts = _stored(spark, sketches.distinct_sketches(rows, ["l_returnflag", "month"], "l_orderkey"), "distinct-sketches")
    found = sketches.approximate_distinct(sketches.merged_distinct(parts, ["l_returnflag"]), ["l_returnflag"])
    exact = rows.groupBy("l_returnflag", "l_orderkey").agg(F.lit(1).alias("one")).groupBy("l_returnflag").agg(F.count("one").alias("orders"))
    off = F.abs(F.col("approx_distinct") - F.col("orders"))
    return exact.join(found, "l_returnflag").select("l_returnflag", "orders", (off <= 4 * sketches.distinct_error() * F.col("orders")).alias("near"))


def outbound_ports(spark, sf):
    p = packets(spark, sf)
    return locality.outbound_ports(p, locality.local_ip(p))


TCP = """
segs AS (SELECT filename, src, dst, sport, dport, tcp_seq AS s, CASE WHEN payload_len = 0 AND tcp_flags > 0 THEN 1 ELSE payload_len END AS l,
  row_number() OVER (PARTITION BY filename, src, dst, sport, dport ORDER BY packet_no) AS pos FROM packets WHERE is_tcp),
walk AS (SELECT filename, src, dst, sport, dport, pos, (s + l) % 4294967296 AS nxt, 0 AS re, 0 AS oo FROM segs WHERE pos = 1
  UNION ALL SELECT g.filename, g.src, g.dst, g.sport, g.dport, g.pos, CASE WHEN l > 0 AND s = nxt THEN (s + l) % 4294967296 ELSE nxt END,
    re + (l > 0 AND s < nxt)::INT, oo + (l > 0 AND s > nxt)::INT
  FROM walk w JOIN segs g ON g.filename = w.filename AND g.src = w.src AND g.dst = w.dst AND g.sport = w.sport AND g.dport = w.dport AND g.pos = w.pos + 1),
ends AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY filename, src, dst, sport, dport ORDER BY pos DESC) = 1)
SELECT filename, coalesce(sum(re), 0)::BIGINT AS retransmissions, coalesce(sum(oo), 0)::BIGINT AS out_of_order
FROM (SELECT DISTINCT filename FROM packets) LEFT JOIN ends USING (filename) GROUP BY 1"""


RAW = (
    ", r AS (SELECT filename, bytes, dur_us, packets, row_number() OVER (PARTITION BY filename ORDER BY first_no) AS pos FROM unidir), "
        "g AS (SELECT filename, ts_us - lag(ts_us) OVER w AS v, row_number() OVER w - 1 AS pos FROM packets_z WHERE ts_us > 0 WINDOW w AS (PARTITION BY filename ORDER BY ts_us, packet_no)), "
        "h AS (SELECT filename, seen_us - lag(seen_us) OVER w AS v, row_number() OVER w - 1 AS pos FROM unidir WINDOW w AS (PARTITION BY filename ORDER BY seen_us, first_no)), "
        "u AS (SELECT filename, 'bytes' AS metric, bytes AS value, pos FROM r UNION ALL SELECT filename, 'dur_us', dur_us, pos FROM r UNION ALL SELECT filename, 'packets', packets, pos FROM r "
        "UNION ALL SELECT filename, 'pkt_gap_us', v, pos FROM g WHERE pos > 0 UNION ALL SELECT filename, 'newflow_gap_us', v, pos FROM h WHERE pos > 0) SELECT * FROM u"
)


def packets_in_few_moments(spark, sf):
    """Packets whose clock ticks once a minute: many share a time."""
    p = packets(spark, sf)
    return p.withColumn("ts_us", F.floor(F.col("ts_us") / 60_000_000) * 60_000_000 + F.col("k") % 2)


QUERIES = {
    "tcp_seq_quality": (lambda s, d: tcp.tcp_seq_quality(packets(s, d)), with_packets("," + TCP).replace("WITH", "WITH RECURSIVE", 1)),
    "tcp_seq_quality_chunked": (lambda s, d: tcp.tcp_seq_quality(packets(s, d), bits=7, long_from=1), with_packets("," + TCP).replace("WITH", "WITH RECURSIVE", 1)),
    "percentiles_sketch": (percentiles_sketch, "SELECT l_returnflag, count(*) AS n, " + ", ".join(f"true AS {p}_near" for p in PROBS) + " FROM lineitem GROUP BY 1"),
    "percentiles_capture_sketch": (percentiles_capture_sketch, with_packets("SELECT filename, count(*) AS n, true AS p50_near, true AS p95_near FROM packets GROUP BY 1")),
    "dst_diversity_sketch": (dst_diversity_sketch, with_packets("SELECT filename, count(DISTINCT dst) AS unique_dst_ips, true AS near FROM packets GROUP BY 1")),
    "distinct_sketch": (distinct_parts_sketch, "SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, true AS near FROM lineitem GROUP BY 1"),
    "iat_capture_order": (lambda s, d: timing.iat_capture_order(packets_with_jitter(s, d)),
                          with_packets("," + CAPTURE_GAPS.replace("{src}", "packets_j") + GAP_STATS)),
    "gap_count": (lambda s, d: timing.gap_count(packets(s, d)), with_packets(
        "," + CAPTURE_GAPS.replace("{src}", "packets") + ", c AS (SELECT DISTINCT filename FROM packets), g AS (SELECT filename, "
        "count(*) FILTER (WHERE gap_us > 100000) AS n FROM gaps GROUP BY 1) SELECT filename, coalesce(n, 0) AS gaps_over_threshold FROM c LEFT JOIN g USING (filename)")),
    "iat_sorted": (lambda s, d: timing.iat_sorted(packets_with_lost_times(s, d)), with_packets("," + SORTED_GAPS + GAP_STATS)),
    "newflow_iat": (lambda s, d: timing.newflow_iat(packets(s, d)), with_packets(
        "," + UNI + "," + NEWFLOW_GAPS.replace("ngaps", "gaps") + GAP_STATS)),
    "burstiness": (lambda s, d: timing.burstiness_report(packets_with_lost_times(s, d)), with_packets(
        "," + UNI_Z + "," + SORTED_GAPS + "," + NEWFLOW_GAPS + ", c AS (SELECT DISTINCT filename FROM packets), "
        f"a AS (SELECT filename, {BURST} AS x FROM gaps WHERE gap_us > 0 GROUP BY 1), b AS (SELECT filename, {BURST} AS y FROM ngaps WHERE gap_us > 0 GROUP BY 1) "
        "SELECT filename, coalesce(x, 0.0) AS burstiness_pkt_iat, coalesce(y, 0.0) AS burstiness_newflow_iat FROM c LEFT JOIN a USING (filename) LEFT JOIN b USING (filename)")),
    "bucket_series": (bucket_series, with_packets(
        "," + SERIES10 + " SELECT filename, idx, idx * 10 AS t_s, bytes, round(bytes * 8 / 1e7, 6) AS mbps, round(bytes * 8.0::DOUBLE / 10, 6) AS bps FROM series")),
    "bucket_summary": (lambda s, d: series.bucket_summary(_series(s, d), packets=packets_with_lost_times(s, d)), with_packets(
        "," + SERIES1 + " SELECT filename, count(*) AS buckets, round(max(bytes) * 8 / 1e6, 6) AS peak_mbps, round(quantile_cont(bytes, 0.95) * (8 / 1e6), 6) AS p95_mbps, "
        "round(quantile_cont(bytes, 0.99) * (8 / 1e6), 6) AS p99_mbps FROM series GROUP BY 1")),
    "window_throughput": (window_throughput, with_packets(
        "," + SERIES1 + "," + CHUNKS + " SELECT filename, window_s, k, bytes, round(bytes * 8.0::DOUBLE / window_s, 6) AS mean_bps FROM w")),
    "window_throughput_summary": (lambda s, d: series.window_throughput_summary(series.window_throughput(_series(s, d))), with_packets(
        "," + SERIES1 + "," + CHUNKS + " SELECT filename, window_s, count(*) AS windows, " + ", ".join(
            f"round({e} * (8.0::DOUBLE / window_s / 1e6), 6) AS {n}_mbps" for n, e in (
                ("mean", "avg(bytes)"), ("p95", "quantile_cont(bytes, 0.95)"), ("p99", "quantile_cont(bytes, 0.99)"), ("max", "max(bytes)")))
        + " FROM w GROUP BY 1, 2")),
    "window_new_flows": (lambda s, d: series.window_new_flows(packets_with_lost_times(s, d)), with_packets(
        "," + UNI_Z + "," + NEWFLOWS + " SELECT filename, window_s, k, coalesce(n, 0) AS new_flows, round(coalesce(n, 0) / (window_s / 60.0::DOUBLE), 6) AS flows_per_min "
        "FROM alln LEFT JOIN hit USING (filename, window_s, k)")),
    "autocorr_lag1": (lambda s, d: series.autocorr_lag1(_series(s, d), packets_with_lost_times(s, d)), with_packets("," + SERIES1 + "," + AUTO)),
    "top_values": (lambda s, d: diversity.top_values(packets(s, d)), with_packets("," + COUNTER)),
    "dst_diversity": (lambda s, d: diversity.dst_diversity(packets(s, d)), with_packets(
        ", c AS (SELECT filename, dst, count(*) AS n, sum(count(*)) OVER (PARTITION BY filename)::DOUBLE AS tot FROM packets GROUP BY 1, 2) "
        f"SELECT filename, count(*) AS unique_dst_ips, {ENTROPY} AS entropy_dst_ips FROM c GROUP BY 1")),
    "domain_diversity": (lambda s, d: diversity.domain_diversity(packets(s, d)), with_packets(
        ", c AS (SELECT filename, regexp_extract(dns_qname, '[^.]+[.][^.]+$') AS dom, count(*) AS n, sum(count(*)) OVER (PARTITION BY filename)::DOUBLE AS tot "
        "FROM packets WHERE dns_qname IS NOT NULL GROUP BY 1, 2), e AS (SELECT filename, count(*) AS u, " + ENTROPY + " AS h FROM c GROUP BY 1) "
        "SELECT filename, coalesce(u, 0) AS unique_dns_domains, coalesce(h, 0.0) AS entropy_dns_domains FROM (SELECT DISTINCT filename FROM packets) LEFT JOIN e USING (filename)")),
    "distribution_tables": (lambda s, d: distributions.cumulative_tables(distributions.metric_values(packets_with_lost_times(s, d))), with_packets(
        "," + DISTRIBUTION + ", c AS (SELECT filename, metric, value, count(*) AS n FROM vals GROUP BY 1, 2, 3), "
        "r AS (SELECT *, sum(n) OVER (PARTITION BY filename, metric ORDER BY value)::BIGINT AS cum_n, sum(n) OVER (PARTITION BY filename, metric) AS t FROM c) "
        "SELECT filename, metric, value, n, cum_n, round(cum_n / t, 6) AS ecdf, round(1 - cum_n / t, 6) AS ccdf FROM r")),
    "histograms": (lambda s, d: distributions.histogram(distributions.metric_values(packets_with_lost_times(s, d))), with_packets(
        "," + DISTRIBUTION + ", e AS (SELECT filename, metric, min(value) AS lo, max(value) AS hi, CASE WHEN metric IN ('bytes', 'dur_us') THEN 50 WHEN metric = 'packets' "
        "THEN 60 ELSE 80 END AS bins FROM vals GROUP BY 1, 2), b AS (SELECT filename, metric, CASE WHEN hi > lo THEN least(((value - lo) * bins) // (hi - lo), bins - 1) "
        "ELSE bins // 2 END AS bin, count(*) AS n FROM vals JOIN e USING (filename, metric) GROUP BY 1, 2, 3), a AS (SELECT filename, metric, unnest(range(0, bins)) AS bin FROM e) "
        "SELECT filename, metric, bin, coalesce(n, 0) AS n FROM a LEFT JOIN b USING (filename, metric, bin)")),
    "raw_samples": (lambda s, d: distributions.raw_samples(packets_with_lost_times(s, d)), with_packets("," + UNI_Z + RAW)),
    "raw_samples_hot": (lambda s, d: distributions.raw_samples(packets_in_few_moments(s, d), most=8), with_packets(
        ", packets_m AS (SELECT * REPLACE (ts_us // 60000000 * 60000000 + k % 2 AS ts_us) FROM packets)," + UNI.replace("FROM packets ", "FROM packets_m ") + RAW.replace("packets_z", "packets_m"))),
    "local_ip": (lambda s, d: locality.local_ip(packets(s, d)), with_packets("," + LOCAL + " SELECT * FROM local")),
    "outbound_ports": (outbound_ports, with_packets(
        "," + LOCAL + ", o AS (SELECT p.filename, p.is_tcp, p.dport FROM packets p JOIN best b ON p.filename = b.filename AND p.src = b.local_ip AND p.packet_no >= b.known_from_no "
        "WHERE p.dport IS NOT NULL), s AS (SELECT filename, count(*) FILTER (WHERE is_tcp) AS a, count(*) FILTER (WHERE NOT is_tcp) AS b, count(*) FILTER (WHERE is_tcp AND dport = 443) AS c, "
        "count(*) FILTER (WHERE NOT is_tcp AND dport = 443) AS d, count(*) FILTER (WHERE NOT is_tcp AND dport = 53) AS e FROM o GROUP BY 1) "
        "SELECT filename, local_ip, local_ip_source, coalesce(a, 0) AS tcp_outbound_total_pkts, coalesce(b, 0) AS udp_outbound_total_pkts, coalesce(c, 0) AS tcp_outbound_dport_443_pkts, "
        "coalesce(d, 0) AS udp_outbound_dport_443_pkts, coalesce(e, 0) AS udp_outbound_dport_53_pkts FROM local LEFT JOIN s USING (filename)")),
}
