"""Registered queries over flows, percentiles and condition tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import net
from ..operators import captures as cap
from ..operators import conditions, flows
from ..operators.ordered import exact_percentiles
from ..sources.adapter import packets, packets_with_lost_times, table
from .capture_plans import NAMED
from .oracle_base import with_packets

BIDIR = """
bidir AS (
  SELECT filename, CASE proto_num WHEN 6 THEN 'tcp' ELSE 'udp' END AS proto,
    CASE WHEN src < dst OR (src = dst AND sport <= dport) THEN src ELSE dst END AS ip1,
    (CASE WHEN src < dst OR (src = dst AND sport <= dport) THEN sport ELSE dport END)::INT AS port1,
    CASE WHEN src < dst OR (src = dst AND sport <= dport) THEN dst ELSE src END AS ip2,
    (CASE WHEN src < dst OR (src = dst AND sport <= dport) THEN dport ELSE sport END)::INT AS port2,
    sum(frame_len)::BIGINT AS bytes, count(*) AS packets, min(ts_us) AS first_us, max(ts_us) AS last_us, max(ts_us) - min(ts_us) AS dur_us
  FROM packets WHERE proto_num IN (6, 17) AND sport IS NOT NULL AND dport IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6)"""

METRICS = BIDIR + """,
names AS (SELECT DISTINCT filename FROM packets), """ + NAMED + """,
fm AS (SELECT filename, count(*) AS flows, quantile_cont(bytes, 0.5) AS median_bytes_per_flow, quantile_cont(dur_us, 0.5) / 1e6 AS median_dur_s,
         quantile_cont(packets, 0.5) AS median_pkts_per_flow FROM bidir GROUP BY 1),
spans AS (SELECT filename, (max(ts_us) - min(ts_us)) / 1e6 AS capture_duration_s FROM packets GROUP BY 1),
metrics AS (SELECT p.filename, profile, duration_label, duration_requested_min, run_idx, capture_duration_s, 0 AS capinfos_truncated, '' AS capinfos_stderr,
   coalesce(flows, 0) AS flows, CASE WHEN capture_duration_s > 0 THEN round(coalesce(flows, 0) / (capture_duration_s / 60.0::DOUBLE), 6) END AS flows_per_min,
   median_bytes_per_flow, median_dur_s, median_pkts_per_flow, '' AS error, p.filename AS path
   FROM parsed p JOIN spans USING (filename) LEFT JOIN fm USING (filename))"""

_M = ("flows", "flows_per_min", "median_bytes_per_flow", "median_dur_s", "median_pkts_per_flow")
CONDITIONS = METRICS + """,
cond AS (SELECT profile, CASE duration_label WHEN '1h' THEN '60m' ELSE duration_label END AS duration, count(*) AS runs, """ + ", ".join(
    f"round(quantile_cont({m}::DOUBLE, 0.5), 6) AS {m}_med, round(quantile_cont({m}::DOUBLE, 0.75) - quantile_cont({m}::DOUBLE, 0.25), 6) AS {m}_iqr" for m in _M
) + """ FROM metrics GROUP BY 1, 2),
grid AS (SELECT * FROM (VALUES ('regular'), ('gamer'), ('admin')) a(profile), (VALUES ('5m'), ('15m'), ('60m')) b(duration))"""

UNIDIR = """
uni AS (
  SELECT filename, ip_version, src, dst, sport::INT AS sport, dport::INT AS dport, CASE proto_num WHEN 6 THEN 'TCP' ELSE 'UDP' END AS proto,
    min(packet_no) AS first_no, arg_min(ts_us, packet_no) AS seen_us,
    coalesce(arg_min(ts_us, packet_no) FILTER (WHERE ts_us > 0), 0) AS start_us, coalesce(arg_max(ts_us, packet_no) FILTER (WHERE ts_us > 0), 0) AS end_us,
    sum(frame_len)::BIGINT AS bytes, count(*) AS packets
  FROM {src} WHERE proto_num IN (6, 17) AND sport IS NOT NULL AND dport IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6, 7
), unidir AS (SELECT *, CASE WHEN start_us > 0 AND end_us >= start_us THEN end_us - start_us ELSE 0 END AS dur_us FROM uni)"""
UNI = UNIDIR.replace("{src}", "packets")
UNI_Z = UNIDIR.replace("{src}", "packets_z")


def condition_table(spark, sf):
    """The nine conditions over all captures."""
    m = flows.flow_metrics(packets(spark, sf))
    t = conditions.condition_table(m)
    return t.select(*[F.round(c, 6).alias(c) if c.endswith(("_med", "_iqr")) else F.col(c) for c in t.columns])


def condition_grid(spark, sf):
    names = packets(spark, sf).select("filename").distinct()
    return conditions.condition_coverage(names)


def condition_cells_text(spark, sf):
    """Report cells of the integer metrics."""
    m = flows.flow_metrics(packets(spark, sf))
    return conditions.condition_text(conditions.condition_table(m)).select("profile", "duration", "flows", "median_bytes_per_flow", "median_pkts_per_flow")


def condition_cells_float(spark, sf):
    """Report cells of the metrics with decimals."""
    return conditions.condition_text(condition_table(spark, sf)).select("profile", "duration", "flows_per_min", "median_dur_s")


def bidir_key(spark, sf):
    p = flows.flow_packets(packets(spark, sf)).select("proto", *net.bidir_key())
    return p.groupBy("proto", "ip1", "port1", "ip2", "port2").agg(F.count(F.lit(1)).alias("packets"))


def unidir_key(spark, sf):
    p = packets(spark, sf).withColumn("src", F.when(F.col("k") % 11 != 0, F.col("src")))
    keyed = p.select("src", "dst", net.directional_flow_label(F.col("proto_num")).alias("l4"), "sport", "dport")
    return keyed.groupBy("src", "dst", "l4", "sport", "dport").agg(F.count(F.lit(1)).alias("packets"))


def percentiles(spark, sf):
    probs = {f"p{int(p * 100)}": p for p in (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)}
    out = exact_percentiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", probs)
    return out.select("l_returnflag", "n", *[F.round(p, 6).alias(p) for p in probs])


_PCT = ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 6) AS p{int(p * 100)}" for p in (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0))
_INT_CELL = ("CASE WHEN {m}_med IS NULL THEN '--' WHEN {m}_iqr IS NULL OR {m}_iqr = 0 THEN round_even({m}_med, 0)::BIGINT::VARCHAR "
             "ELSE round_even({m}_med, 0)::BIGINT || ' [' || round_even({m}_iqr, 0)::BIGINT || ']' END AS {m}")
_FLOAT_CELL = ("CASE WHEN {m}_med IS NULL THEN '--' WHEN {m}_iqr IS NULL OR {m}_iqr = 0 THEN printf('%.{d}f', {m}_med) "
               "ELSE printf('%.{d}f', {m}_med) || ' [' || printf('%.{d}f', {m}_iqr) || ']' END AS {m}")

QUERIES = {
    "bidir_key": (bidir_key, with_packets("," + BIDIR + " SELECT proto, ip1, port1, ip2, port2, sum(packets)::BIGINT AS packets FROM bidir GROUP BY 1, 2, 3, 4, 5")),
    "unidir_key": (unidir_key, with_packets(
        ", x AS (SELECT CASE WHEN k % 11 <> 0 THEN src END AS src, dst, is_tcp, is_udp, proto_num, sport::INT AS sport, dport::INT AS dport FROM packets) "
        "SELECT src, dst, CASE WHEN src IS NULL THEN 'L2' WHEN is_tcp THEN 'TCP' WHEN is_udp THEN 'UDP' ELSE 'IP-' || CAST(proto_num AS VARCHAR) END AS l4, "
        "sport, dport, count(*) AS packets FROM x GROUP BY 1, 2, 3, 4, 5")),
    "bidir_flows": (lambda s, d: flows.bidir_flows(packets(s, d)), with_packets("," + BIDIR + " SELECT * FROM bidir")),
    "flow_metrics": (lambda s, d: flows.flow_metrics(packets(s, d)), with_packets("," + METRICS + " SELECT * FROM metrics")),
    "condition_table": (condition_table, with_packets(
        "," + CONDITIONS + " SELECT profile, duration, coalesce(runs, 0) AS runs, " + ", ".join(f"{m}_med, {m}_iqr" for m in _M)
        + " FROM grid LEFT JOIN cond USING (profile, duration)")),
    "condition_grid": (condition_grid, with_packets(
        ", names AS (SELECT DISTINCT filename FROM packets)," + NAMED + ", h AS (SELECT profile, "
        "CASE duration_label WHEN '1h' THEN '60m' ELSE duration_label END AS duration, count(*) AS captures FROM parsed GROUP BY 1, 2) "
        "SELECT profile, duration, coalesce(captures, 0) AS captures FROM (VALUES ('regular'), ('gamer'), ('admin')) a(profile) "
        "CROSS JOIN (VALUES ('5m'), ('15m'), ('60m')) b(duration) LEFT JOIN h USING (profile, duration)")),
    "fmt_median_iqr": (condition_cells_text, with_packets(
        "," + CONDITIONS + " SELECT profile, duration, " + ", ".join(_INT_CELL.format(m=m) for m in ("flows", "median_bytes_per_flow", "median_pkts_per_flow"))
        + " FROM grid LEFT JOIN cond USING (profile, duration)")),
    "fmt_median_iqr_float": (condition_cells_float, with_packets(
        "," + CONDITIONS + " SELECT profile, duration, " + _FLOAT_CELL.format(m="flows_per_min", d=2) + ", " + _FLOAT_CELL.format(m="median_dur_s", d=4)
        + " FROM grid LEFT JOIN cond USING (profile, duration)")),
    "unidir_flows": (lambda s, d: flows.unidir_flows(packets_with_lost_times(s, d)), with_packets("," + UNI_Z + " SELECT * FROM unidir")),
    "unidir_summary": (lambda s, d: flows.unidir_summary(packets_with_lost_times(s, d)), with_packets(
        "," + UNI_Z + ", m AS (SELECT filename, (max(ts_us) - min(ts_us)) / 6e7 AS m FROM packets_z WHERE ts_us > 0 GROUP BY 1) "
        "SELECT filename, count(*) AS flows, sum(bytes)::BIGINT AS bytes_total, sum(packets)::BIGINT AS packets_total, "
        "CASE WHEN any_value(m) > 0 THEN round(count(*) / any_value(m), 6) ELSE 0.0 END AS flows_per_min, quantile_cont(bytes, 0.5) AS median_bytes_per_flow, "
        "quantile_cont(dur_us, 0.5) / 1e6 AS median_dur_s, quantile_cont(packets, 0.5) AS median_pkts_per_flow FROM unidir LEFT JOIN m USING (filename) GROUP BY 1")),
    "top_flows": (lambda s, d: flows.top_flows(packets(s, d)), with_packets(
        "," + UNI + ", r AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY bytes DESC, first_no)::INT AS rank FROM unidir) "
        "SELECT filename, ip_version, src, dst, sport, dport, proto, rank, bytes, packets, dur_us / 1e6 AS duration_s FROM r WHERE rank <= 15")),
    "percentiles": (percentiles, f"SELECT l_returnflag, count(l_extendedprice) AS n, {_PCT} FROM lineitem GROUP BY 1"),
}
