"""Registered queries over quality rules, tool logs, features and anomaly scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import naming
from ..operators import anomaly, quality_rules
from ..operators.captures import capture_summary, summary_pairs
from ..operators.flows import flow_metrics
from ..session import pin, work_path
from ..sources.adapter import packets, table
from ..sources.logs import decode_tool_log
from ..sources.packets import numbered_lines
from ..sources.sinks import sink_qc_report
from .capture_plans import COUNTS, NAMED, PEAK, SUMMARY
from .flow_plans import METRICS
from .oracle_base import with_packets

CUT = "The file appears to have been cut short in the middle of a packet. (will continue anyway)"


def tool_rows(spark, sf):
    """Output of the capture tool for every capture: some cut short, some failing, some with odd durations."""
    per = packets(spark, sf).groupBy("filename").agg(
        (F.max("ts_us") - F.min("ts_us")).alias("span"), (F.min("packet_no") % 45).alias("c")
    )
    c = F.col("c")
    ms = F.expr("(span * (94 + 3 * (c % 5))) div 100000")
    secs = F.concat((F.expr("(span * (94 + 3 * (c % 5))) div 100000000")).cast("string"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))
    return per.select(
        "filename",
        F.when(c % 7 == 0, 1).when(c % 7 == 1, 2).otherwise(0).alias("exit_code"),
        F.concat(F.lit("File name:\t"), "filename", F.lit("\nCapture duration:   "), secs, F.lit(" seconds\n")).alias("stdout"),
        F.when(c % 7 == 0, CUT).when(c % 7 == 1, "cannot open").when(c % 7 == 2, "was cut short in the middle of a packet").otherwise("").alias("stderr"),
    )


TOOLS = f"""
tool AS (SELECT filename, c, CASE WHEN c % 7 <> 1 THEN (((span * (94 + 3 * (c % 5))) // 100000000)::VARCHAR || '.' || lpad(((span * (94 + 3 * (c % 5))) // 100000 % 1000)::VARCHAR, 3, '0'))::DOUBLE END AS capture_duration_s,
  (c % 7 = 0)::INT AS capinfos_truncated, CASE WHEN c % 7 = 0 THEN '{CUT}' ELSE '' END AS capinfos_stderr,
  CASE WHEN c % 7 = 1 THEN 'capinfos_failed(exit=2): cannot open' ELSE '' END AS error
  FROM (SELECT filename, max(ts_us) - min(ts_us) AS span, min(packet_no) % 45 AS c FROM packets GROUP BY 1))"""

FLAGS = TOOLS + ", b AS (SELECT filename, count(*) AS n, " + COUNTS + """ FROM packets GROUP BY 1),
q AS (SELECT filename, capinfos_truncated AS tr, error, capture_duration_s AS s, (n = tcp_pkts + udp_pkts + icmp_pkts + other_pkts) AS ok,
   CASE regexp_extract(filename, '(\\d+m|1h)\\d+\\.pcapng$', 1) WHEN '5m' THEN 300.0 WHEN '15m' THEN 900.0 ELSE 3600.0 END::DOUBLE AS t FROM tool JOIN b USING (filename)),
r AS (SELECT *, CASE WHEN s IS NOT NULL AND NOT (s BETWEEN t * (1 - 0.05::DOUBLE) AND t * (1 + 0.05::DOUBLE)) THEN 'duration_out_of_range(' || printf('%.1f', s) || 's not in ['
   || printf('%.1f', t * (1 - 0.05::DOUBLE)) || ',' || printf('%.1f', t * (1 + 0.05::DOUBLE)) || '])' END AS duration_reason FROM q),
flags AS (SELECT filename, duration_reason, CASE WHEN tr = 1 OR error <> '' THEN 'hard' WHEN NOT ok OR duration_reason IS NOT NULL THEN 'soft' END AS severity,
   CASE WHEN tr = 1 OR error <> '' THEN concat_ws('; ', CASE WHEN tr = 1 THEN 'capinfos_truncated=1' END, CASE WHEN error <> '' THEN 'error=' || error END, duration_reason)
        ELSE nullif(concat_ws('; ', CASE WHEN NOT ok THEN 'totals_consistent=0' END, duration_reason), '') END AS reasons FROM r)"""


def summary_with_tools(spark, sf):
    return capture_summary(packets(spark, sf), decode_tool_log(tool_rows(spark, sf)))


def qc_union(spark, sf):
    s = summary_with_tools(spark, sf)
    return quality_rules.qc_union(quality_rules.qc_hard(s), quality_rules.qc_soft(s))


def qc_report(spark, sf):
    return quality_rules.qc_report(quality_rules.qc_flags(summary_with_tools(spark, sf)).where(F.col("severity").isNotNull()), "captures")


def qc_report_text(spark, sf):
    """The report written as text and read line by line."""
    path = work_path(spark, "qc-report")
    sink_qc_report(quality_rules.qc_text(qc_report(spark, sf)), path)
    lines = numbered_lines(spark.read.text(path).withColumn("filename", F.lit("report")))
    return lines.select(F.col("packet_no").alias("line_no"), F.col("value").alias("line"))


def manifest_check(spark, sf):
    k = F.regexp_extract("props", "[0-9]+", 0).cast("bigint")
    cols = [F.when((k + i) % 9 > 0, F.concat(F.lit("v"), k.cast("string"))).alias(g) for i, g in enumerate(quality_rules.MANIFEST_GROUPS)]
    rows = table(spark, sf, "events").select(F.col("event_id").alias("run_id"), *cols, F.when(k % 4 > 0, "sha256:x").otherwise(" ").alias("artifact_checksums"))
    return quality_rules.manifest_check(rows)


_GROUP_LIST = "[" + ", ".join(f"CASE WHEN (k + {i}) % 9 = 0 THEN '{g}' END" for i, g in enumerate(quality_rules.MANIFEST_GROUPS)) + "]"


def joined_runs(spark, sf):
    """All captures, each with its duration."""
    p = packets(spark, sf)
    captures = pin(capture_summary(p, pairs=pin(summary_pairs(p))))
    # the summary knows the spans of the captures: flows need no further pass for them
    spans = captures.select("filename", "capture_duration_s", "capinfos_truncated", "capinfos_stderr", "error")
    return anomaly.join_capture_flows(captures, flow_metrics(p, spans), None)


def run_features(spark, sf):
    return anomaly.run_features(joined_runs(spark, sf), digits=6)


def join_capture_flows(spark, sf):
    """Valid captures of all durations, and those of an hour once more by themselves."""
    tools = decode_tool_log(tool_rows(spark, sf))
    p = packets(spark, sf)
    captures, metrics = pin(capture_summary(p, tools)), pin(flow_metrics(p))
    every = anomaly.join_capture_flows(captures, metrics, None)
    hour = anomaly.join_capture_flows(captures, metrics, "1h").withColumn("duration", F.lit("1h only"))
    names = ["filename", "profile", "duration", "packets_total", "bytes_total", "flows", "median_bytes_per_flow", "median_pkts_per_flow"]
    return every.select(*names).unionByName(hour.select(*names))


_LOGS = {"log_bytes": "bytes_total", "log_pkts": "packets_total", "log_mean_bps": "mean_bps", "log_peak_mbps": "peak_mbps_1s"}
_LOGS2 = {"log_flows_per_min": "flows_per_min", "log_med_bytes_flow": "median_bytes_per_flow", "log_med_dur": "median_dur_s", "log_med_pkts_flow": "median_pkts_per_flow"}
FEATURES = SUMMARY + "," + METRICS.replace("names AS (SELECT DISTINCT filename FROM packets), " + NAMED + ",", "") + """,
j AS (SELECT s.*, flows, flows_per_min, median_bytes_per_flow, median_dur_s, median_pkts_per_flow, (tcp_pkts + greatest(udp_pkts - udp443_pkts, 0) + udp443_pkts + icmp_pkts + other_pkts)::DOUBLE AS tot
   FROM summary s JOIN metrics m ON s.filename = m.filename),
feats AS (SELECT filename, profile, CASE duration_label WHEN '1h' THEN '60m' ELSE duration_label END AS duration, """ + ", ".join(f"round(ln(1.0::DOUBLE + {c}), 6) AS {k}" for k, c in _LOGS.items()) + """,
   round(tcp_pkts / tot, 6) AS tcp_pct, round(greatest(udp_pkts - udp443_pkts, 0) / tot, 6) AS udp_pct, round(udp443_pkts / tot, 6) AS udp443_pct, round(icmp_pkts / tot, 6) AS icmp_pct, """ + ", ".join(
    f"round(ln(1.0::DOUBLE + {c}), 6) AS {k}" for k, c in _LOGS2.items()) + " FROM j)"


def robust_scale(spark, sf):
    train = anomaly.training_sets(pin(run_features(spark, sf)))
    out = anomaly.robust_scale(train, anomaly.scale_table(train), digits=4)
    return out.select("model", "filename", *anomaly.FEATURES)


TRAINED = FEATURES + """,
tr AS (SELECT duration || '/mixed' AS model, * FROM feats UNION ALL SELECT duration || '/regular_only', * FROM feats WHERE profile = 'regular'),
sc AS (SELECT model, """ + ", ".join(
    f"quantile_cont({f}, 0.5) AS {f}_m, quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25) AS {f}_q" for f in anomaly.FEATURES) + """ FROM tr GROUP BY 1)"""
_SCALED = {f: f"({f} - {f}_m) / CASE WHEN {f}_q = 0 THEN 1.0 ELSE {f}_q END" for f in anomaly.FEATURES}
SCALED = TRAINED + " SELECT model, filename, " + ", ".join(f"round({c}, 4) AS {f}" for f, c in _SCALED.items()) + " FROM tr JOIN sc USING (model)"


def forest_sql(features, trees: int, sample: int = anomaly.SAMPLE) -> str:
    """CTEs of a forest over ``fit`` (model, seed, key, features) and of the scores of ``rows`` (model, seed, key, profile, features).

    ``grown`` has a row for each training row and node it passes, ``nodes`` one for each node, ``scores`` one for each scored row.
    """
    names = ", ".join(f"f{i}" for i in range(len(features)))
    own = ", ".join(f"{f} AS f{i}" for i, f in enumerate(features))
    listed = "[" + names + "]"
    wide = ", ".join(f"max(f{i}) OVER n AS h{i}, min(f{i}) OVER n AS l{i}" for i in range(len(features)))
    opened = "list_filter([" + ", ".join(f"CASE WHEN h{i} > l{i} THEN {i + 1} END" for i in range(len(features))) + "], lambda x: x IS NOT NULL)"
    lows, highs = ("[" + ", ".join(f"{c}{i}" for i in range(len(features))) + "]" for c in "lh")
    path = "CASE WHEN {n} <= 1 THEN 0.0::DOUBLE WHEN {n} = 2 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * (ln({n} - 1.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 2.0::DOUBLE * ({n} - 1.0::DOUBLE) / {n} END"
    digits = "('0x' || substr(md5(seed || ':' || tree || ':' || code), {at}, 8))::BIGINT"
    # a node's feature and cut, seen from each of its rows
    seen = f"""SELECT *, CASE WHEN leaf THEN NULL ELSE opened[({digits.format(at=1)}) % len(opened) + 1] END AS f, {digits.format(at=9)} / 4294967296.0::DOUBLE AS share
      FROM (SELECT *, depth >= lim OR len(opened) = 0 AS leaf FROM (SELECT *, {opened} AS opened, {lows} AS lows, {highs} AS highs
        FROM (SELECT *, count(*) OVER n AS size, {wide} FROM {{src}} WINDOW n AS (PARTITION BY model, seed, tree, code))))"""
    cut = "CASE WHEN lows[f] + share * (highs[f] - lows[f]) >= highs[f] THEN lows[f] ELSE lows[f] + share * (highs[f] - lows[f]) END"
    return f"""
placed AS (SELECT *, count(*) OVER (PARTITION BY model, seed) AS pool FROM (
  SELECT model, seed, key, {own}, row_number() OVER (PARTITION BY model, seed ORDER BY md5(key || ':' || seed), key) - 1 AS place FROM fit) WHERE place < {trees * sample}),
dealt AS (SELECT model, seed, t AS tree, key, {names} FROM placed, (SELECT unnest(range(0, {trees})) AS t)
  WHERE CASE WHEN pool = {trees * sample} THEN place // {sample} = t ELSE ((place - t * {sample}) % pool + pool) % pool < {sample} END),
sized AS (SELECT *, count(*) OVER (PARTITION BY model, seed, tree) AS total FROM dealt),
grown AS (SELECT model, seed, tree, key, total, {names}, 1::BIGINT AS code, 0 AS depth, ceil(log2(greatest(total, 2)))::INT AS lim FROM sized
  UNION ALL SELECT model, seed, tree, key, total, {names}, 2 * code + ({listed}[f] > {cut})::INT, depth + 1, lim FROM ({seen.format(src="grown")}) WHERE NOT leaf),
nodes AS (SELECT DISTINCT model, seed, tree, code, f, CASE WHEN f IS NOT NULL THEN {cut} END AS cut, CASE WHEN f IS NULL THEN (depth + {path.format(n="size")}) / greatest({path.format(n="total")}, 1e-300) END AS path, total
  FROM ({seen.format(src="grown")})),
shaped AS (SELECT * REPLACE (CASE WHEN total <= 1 AND f IS NULL THEN 0.0 ELSE path END AS path) FROM nodes),
falling AS (SELECT r.model, r.seed, r.key, r.profile, {", ".join(f"r.{f} AS f{i}" for i, f in enumerate(features))}, n.tree, n.code, n.f, n.cut, n.path FROM rows r JOIN shaped n ON r.model = n.model AND r.seed = n.seed AND n.code = 1
  UNION ALL SELECT w.model, w.seed, w.key, w.profile, {", ".join(f"w.f{i}" for i in range(len(features)))}, n.tree, n.code, n.f, n.cut, n.path
  FROM falling w JOIN shaped n ON w.model = n.model AND w.seed = n.seed AND w.tree = n.tree AND n.code = 2 * w.code + ([{", ".join(f"w.f{i}" for i in range(len(features)))}][w.f] > w.cut)::INT WHERE w.f IS NOT NULL),
scores AS (SELECT model, seed, key, profile, -pow(2.0::DOUBLE, -avg(path)) AS score FROM falling WHERE f IS NULL GROUP BY 1, 2, 3, 4)"""


def baselines_sql(seeds, threshold: str) -> str:
    """CTEs of runs scored under both baselines of their duration, with thresholds and flags: ``flagged``."""
    fit = ", ".join(f"{c} AS {f}" for f, c in _SCALED.items())
    both = "(SELECT *, unnest([duration || '/regular_only', duration || '/mixed']) AS model FROM feats)"
    return TRAINED + f""",
fit AS (SELECT model, s AS seed, filename AS key, {fit} FROM tr JOIN sc USING (model), (SELECT unnest({list(seeds)})::INT AS s)),
rows AS (SELECT model, s AS seed, filename AS key, profile, {fit} FROM {both} JOIN sc USING (model), (SELECT unnest({list(seeds)})::INT AS s)),""" + forest_sql(anomaly.FEATURES, anomaly.TREES) + f""",
thr AS (SELECT model, seed, {threshold} AS threshold FROM scores WHERE model LIKE '%/mixed' OR profile = 'regular' GROUP BY 1, 2),
flagged AS (SELECT model, seed, key AS filename, profile, score, threshold, score < threshold AS flagged FROM scores JOIN thr USING (model, seed))"""


def iforest_fit(spark, sf):
    train = anomaly.training_sets(pin(run_features(spark, sf)))
    nodes = anomaly.iforest_fit(anomaly.robust_scale(train, anomaly.scale_table(train)))
    inner = F.col("feature") >= 0
    return nodes.groupBy("model", "seed", "tree").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(~inner).alias("leaves"), F.sum(F.when(inner, F.col("feature")).otherwise(0)).alias("features"),
        F.round(F.sum("cut"), 4).alias("cuts"), F.round(F.sum("path"), 6).alias("paths"),
    )


def iforest_score(spark, sf):
    """Every embedding scored by a forest trained on all embeddings."""
    dims = list(range(16))
    rows = table(spark, sf, "embeddings").select(
        F.lit("all").alias("model"), F.col("vec_id").cast("string").alias("vec_id"), F.col("label").cast("string").alias("profile"),
        *[F.aggregate(F.slice("embedding", i * 4 + 1, 4), F.lit(0.0), lambda a, x: a + x).alias(f"d{i}") for i in dims],
    )
    feats = [f"d{i}" for i in dims]
    nodes = anomaly.iforest_fit(rows, feats, key="vec_id", trees=100)
    return anomaly.iforest_score(rows, nodes, feats, key="vec_id").withColumn("score", F.round("score", 6))


def _price_scores(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("profile"), F.col("o_totalprice").alias("score"), "o_custkey"
    )


def score_threshold(spark, sf):
    s = _price_scores(spark, sf)
    low = anomaly.score_threshold(s, ["model"]).select("model", F.lit("min_train").alias("mode"), F.round("threshold", 6).alias("threshold"))
    q = anomaly.score_threshold(s, ["model"], mode="quantile", q=0.05).select("model", F.lit("quantile").alias("mode"), F.round("threshold", 6).alias("threshold"))
    return low.unionByName(q)


def flagged_rate(spark, sf):
    s = _price_scores(spark, sf)
    thr = anomaly.score_threshold(s.where(F.col("profile") == "F"), ["model"], mode="quantile", q=0.05)
    return anomaly.flagged_rate(s, thr, ["model"], ["profile"]).withColumn("flagged_rate", F.round("flagged_rate", 6))


def score_baselines(spark, sf):
    out = anomaly.score_baselines(run_features(spark, sf))
    return out.select("model", "seed", "filename", "profile", F.round("score", 6).alias("score"), F.round("threshold", 6).alias("threshold"), "flagged")


def baseline_compare(spark, sf):
    out = anomaly.baseline_compare(anomaly.score_baselines(run_features(spark, sf)))
    return out.withColumns({c: F.round(c, 6) for c in ("gamer_flagged_pct", "admin_flagged_pct")})


def seed_sweep(spark, sf):
    out = anomaly.baseline_rates(anomaly.score_baselines(run_features(spark, sf), seeds=(0, 1, 2), mode="quantile"))
    return out.withColumn("flagged_rate", F.round("flagged_rate", 6))


def recursive(body: str) -> str:
    return with_packets(body).replace("WITH", "WITH RECURSIVE", 1)


QUERIES = {
    "scan_tool_log": (lambda s, d: decode_tool_log(tool_rows(s, d)), with_packets("," + TOOLS + " SELECT * EXCLUDE (c) FROM tool")),
    "qc_duration": (lambda s, d: quality_rules.qc_duration(summary_with_tools(s, d)), with_packets("," + FLAGS + " SELECT filename, duration_reason FROM flags WHERE duration_reason IS NOT NULL")),
    "qc_hard": (lambda s, d: quality_rules.qc_hard(summary_with_tools(s, d)), with_packets("," + FLAGS + " SELECT filename, reasons FROM flags WHERE severity = 'hard'")),
    "qc_soft": (lambda s, d: quality_rules.qc_soft(summary_with_tools(s, d)), with_packets("," + FLAGS + " SELECT filename, reasons FROM flags WHERE severity = 'soft'")),
    "qc_union": (qc_union, with_packets("," + FLAGS + " SELECT filename, reasons, severity FROM flags WHERE severity IS NOT NULL")),
    "qc_report": (qc_report, with_packets(
        "," + FLAGS + " SELECT CASE severity WHEN 'hard' THEN 1 ELSE 2 END AS section, 1 AS place, filename, '- ' || filename || ': ' || reasons AS line FROM flags WHERE severity IS NOT NULL "
        "UNION ALL SELECT 0, 0, '', 'QC report for: captures' UNION ALL SELECT 1, 0, '', '== Captures to re-capture (hard failures) ==' "
        "UNION ALL SELECT 2, 0, '', '== Suspicious captures (soft flags; review) =='")),
    "qc_report_text": (qc_report_text, with_packets(
        "," + FLAGS + ", l AS (SELECT CASE severity WHEN 'hard' THEN 1 ELSE 2 END AS section, 1 AS place, filename, '- ' || filename || ': ' || reasons AS line FROM flags WHERE severity IS NOT NULL "
        "UNION ALL SELECT * FROM (VALUES (0, 0, '', 'QC report for: captures'), (1, -1, '', ''), (1, 0, '', '== Captures to re-capture (hard failures) =='), "
        "(2, -1, '', ''), (2, 0, '', '== Suspicious captures (soft flags; review) =='))) SELECT row_number() OVER (ORDER BY section, place, filename) - 1 AS line_no, line FROM l")),
    "manifest_check": (manifest_check, "WITH e AS (SELECT event_id, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM events), "
        f"m AS (SELECT event_id AS run_id, k, list_filter({_GROUP_LIST}, lambda x: x IS NOT NULL) AS l FROM e) "
        "SELECT run_id, len(l)::INT AS missing_groups, array_to_string(l, ',') AS missing, k % 4 > 0 AS has_checksums, len(l) = 0 AND k % 4 > 0 AS complete FROM m"),
    "join_capture_flows": (join_capture_flows, with_packets(
        "," + TOOLS + "," + METRICS + ", s AS (SELECT filename, count(*) AS packets_total, sum(frame_len)::BIGINT AS bytes_total FROM packets GROUP BY 1) "
        ", a AS (SELECT s.filename, profile, CASE duration_label WHEN '1h' THEN '60m' ELSE duration_label END AS duration, packets_total, bytes_total, flows, median_bytes_per_flow, median_pkts_per_flow "
        "FROM s JOIN metrics m USING (filename) JOIN tool t USING (filename) WHERE t.capinfos_truncated = 0 AND t.error = '') "
        "SELECT * FROM a UNION ALL SELECT * REPLACE ('1h only' AS duration) FROM a WHERE duration = '60m'")),
    "run_features": (run_features, with_packets("," + FEATURES + " SELECT * FROM feats")),
    "robust_scale": (robust_scale, with_packets("," + SCALED)),
    "iforest_fit": (iforest_fit, recursive(
        "," + baselines_sql([0], "min(score)") + " SELECT model, seed, tree::INT AS tree, count(*) AS nodes, count(*) FILTER (WHERE f IS NULL) AS leaves, sum(coalesce(f - 1, 0))::BIGINT AS features, "
        "round(sum(coalesce(cut, 0)), 4) AS cuts, round(sum(coalesce(path, 0)), 6) AS paths FROM shaped GROUP BY 1, 2, 3")),
    "iforest_score": (iforest_score, "WITH RECURSIVE rows AS (SELECT 'all' AS model, 0 AS seed, vec_id::VARCHAR AS key, label::VARCHAR AS profile, " + ", ".join(
        f"(((0.0::DOUBLE + embedding[{i * 4 + 1}]) + embedding[{i * 4 + 2}]) + embedding[{i * 4 + 3}]) + embedding[{i * 4 + 4}] AS d{i}" for i in range(16))
        + " FROM embeddings), fit AS (SELECT * FROM rows)," + forest_sql([f"d{i}" for i in range(16)], 100) + " SELECT model, seed, key AS vec_id, profile, round(score, 6) AS score FROM scores"),
    "score_threshold": (score_threshold, "SELECT o_orderpriority AS model, 'min_train' AS mode, round(min(o_totalprice) - 1e-12, 6) AS threshold FROM orders GROUP BY 1 "
        "UNION ALL SELECT o_orderpriority, 'quantile', round(quantile_cont(o_totalprice, 0.05), 6) FROM orders GROUP BY 1"),
    "flagged_rate": (flagged_rate, "WITH t AS (SELECT o_orderpriority AS model, quantile_cont(o_totalprice, 0.05) AS thr FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) "
        "SELECT model, o_orderstatus AS profile, round(avg((o_totalprice < thr)::INT), 6) AS flagged_rate FROM orders JOIN t ON model = o_orderpriority GROUP BY 1, 2"),
    "score_baselines": (score_baselines, recursive(
        "," + baselines_sql([0], "min(score) - 1e-12") + " SELECT model, seed, filename, profile, round(score, 6) AS score, round(threshold, 6) AS threshold, flagged FROM flagged")),
    "baseline_compare": (baseline_compare, recursive(
        "," + baselines_sql([0], "min(score) - 1e-12") + " SELECT model, seed, round(avg(flagged::INT * 100.0) FILTER (WHERE profile = 'gamer'), 6) AS gamer_flagged_pct, "
        "round(avg(flagged::INT * 100.0) FILTER (WHERE profile = 'admin'), 6) AS admin_flagged_pct FROM flagged GROUP BY 1, 2")),
    "seed_sweep": (seed_sweep, recursive(
        "," + baselines_sql([0, 1, 2], "quantile_cont(score, 0.05)") + " SELECT model, seed, profile, count(*) AS runs, round(avg(flagged::INT), 6) AS flagged_rate FROM flagged GROUP BY 1, 2, 3")),
}
