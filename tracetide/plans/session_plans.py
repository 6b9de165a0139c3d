"""Registered queries over session results, session logs and connection logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.net import app_protocol
from ..operators import sessions
from ..operators.flows import bidir_flows
from ..session import work_path
from ..sources.adapter import packets, table
from ..sources.logs import scan_conn_log as read_conn_log
from ..sources.logs import scan_session_log as read_session_log
from .flow_plans import BIDIR
from .oracle_base import with_packets


def results(spark, sf) -> DataFrame:
    """Conversation turns as nested session results."""
    n = F.char_length("text")
    error = F.create_map(F.lit("exec"), F.col("text"))
    return table(spark, sf, "conversations").select(
        F.concat(F.lit("host"), (F.col("conv_id") % 20).cast("string")).alias("host"),
        F.concat(F.lit("10.1.0."), (F.col("conv_id") % 20).cast("string")).alias("ip"),
        F.concat_ws("-", F.lit("s"), F.col("conv_id"), F.col("turn")).alias("session_id"),
        (n % 5 > 0).alias("ok"),
        F.array_repeat(error, (n % 3).cast("int")).alias("errors"),
        F.struct(
            F.when(n % 2 == 0, "open").otherwise("closed").alias("state"), F.col("text").alias("banner"), F.lit(None).cast("string").alias("error")
        ).alias("precheck"),
        F.round(n / 10, 2).alias("duration_s"),
        (F.col("conv_id") * 1000 + F.col("turn")).cast("double").alias("ts"),
    )


RESULTS = """
WITH res AS (SELECT 's-' || conv_id || '-' || turn AS session_id, 'host' || conv_id % 20 AS host, '10.1.0.' || conv_id % 20 AS ip, length(text) AS n, text, conv_id * 1000 + turn AS ts FROM conversations),
st AS (SELECT session_id, host, ip, CASE WHEN n % 5 = 0 THEN 'FAIL' WHEN n % 3 = 0 THEN 'OK' ELSE 'WARN' END AS status, round(n / 10, 2) AS duration_s, (n % 3)::INT AS errs,
  CASE WHEN n % 2 = 0 THEN 'open' ELSE 'closed' END AS precheck_state, CASE WHEN n > 60 THEN left(text, 60) || '…' ELSE text END AS banner, ts FROM res)"""


def session_status(spark, sf):
    return sessions.session_status(results(spark, sf))


def host_rollup(spark, sf):
    return sessions.host_rollup(sessions.session_status(results(spark, sf), keep=("ts",)))


def log_events(spark, sf) -> DataFrame:
    """Conversation turns as log events of the six kinds."""
    r = F.char_length("text") % 6

    def only(i, col):
        return F.when(r == i, col)

    yes, net = F.lit(True), r >= 3
    good = F.char_length("text") % 4 > 0
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).cast("double").alias("ts"),
        F.concat(F.lit("host"), (F.col("conv_id") % 20).cast("string")).alias("host"),
        F.concat_ws("-", F.lit("s"), F.col("conv_id"), F.col("turn")).alias("session_id"),
        only(0, F.array(F.lit("uptime"), F.col("role"))).alias("commands"),
        only(0, F.col("text")).alias("stdout_snippet"),
        only(1, F.lit("pulled:/var/log/a->b")).alias("sftp"),
        only(2, F.lit("to:10.0.0.1")).alias("syslog_sent"),
        only(3, yes).alias("icmp"), only(4, yes).alias("dns"), only(5, yes).alias("http"),
        F.when(net, good).alias("ok"),
        F.when(net & ~good, F.col("text")).alias("err"),
    )


def scan_session_log(spark, sf):
    """Write the log as JSON lines, read it back and count per host and kind."""
    path = work_path(spark, "session-log")
    log_events(spark, sf).write.json(path)
    return read_session_log(spark, path).groupBy("host", "event_kind").agg(
        F.count(F.lit(1)).alias("events"), F.count_if("ok").alias("ok_events"),
        F.sum(F.size("commands")).alias("commands"), F.sum(F.char_length("err")).alias("err_chars"),
    )


def session_event_union(spark, sf):
    both = sessions.session_event_union(log_events(spark, sf), results(spark, sf).drop("ok", "errors", "precheck"))
    return both.groupBy("host", "record").agg(
        F.count(F.lit(1)).alias("rows"), F.count("commands").alias("with_commands"), F.count("duration_s").alias("with_duration")
    )


def connections(spark, sf) -> DataFrame:
    """Bidirectional flows as connection-log rows; short ones have no duration, some no bytes."""
    f = bidir_flows(packets(spark, sf))
    app = app_protocol(F.col("proto") == "udp", F.col("port1"), F.col("port2"))
    return f.select(
        F.concat_ws(",", "filename", "proto", "ip1", "port1", "ip2", "port2").alias("conn_key"),
        F.col("ip1").alias("orig_h"), F.col("ip2").alias("resp_h"),
        F.when(app == "UNKNOWN", "-").otherwise(F.lower(app)).alias("service"),
        F.when(F.col("packets") % 4 == 0, "-").otherwise(F.col("bytes").cast("string")).alias("orig_bytes"),
        F.when(F.col("packets") % 3 == 0, "-").otherwise(F.col("packets").cast("string")).alias("resp_bytes"),
        F.when(F.col("dur_us") == 0, "-").otherwise(F.floor(F.col("dur_us") / 1000).cast("string")).alias("duration"),
    )


CONNS = BIDIR + """,
conns AS (SELECT filename || ',' || proto || ',' || ip1 || ',' || port1 || ',' || ip2 || ',' || port2 AS conn_key, ip1 AS orig_h, ip2 AS resp_h,
  CASE WHEN 443 IN (port1, port2) THEN CASE proto WHEN 'udp' THEN 'quic/http3' ELSE 'https' END WHEN 80 IN (port1, port2) THEN 'http' WHEN 53 IN (port1, port2) THEN 'dns' ELSE '-' END AS service,
  CASE WHEN packets % 4 = 0 THEN 0 ELSE bytes END AS ob, CASE WHEN packets % 3 = 0 THEN 0 ELSE packets END AS rb, CASE WHEN dur_us = 0 THEN 0 ELSE dur_us // 1000 END::DOUBLE AS d FROM bidir)"""


def conn_summary(spark, sf):
    return sessions.conn_summary(connections(spark, sf))


def conn_top(spark, sf):
    return sessions.conn_top(connections(spark, sf).withColumnRenamed("conn_key", "conn_no"))


def scan_conn_log(spark, sf):
    """Write the connections as three tab-separated logs, one with its columns in another order, read them and count."""
    path = work_path(spark, "conn-log")
    c = connections(spark, sf).withColumn("log", F.pmod(F.xxhash64("conn_key"), F.lit(3)))
    fields = ("id.orig_h", "id.resp_h", "service", "orig_bytes", "resp_bytes", "duration")
    turned = ("id.resp_h", "id.orig_h", *fields[2:])

    def note(names):
        return F.array(F.lit("#separator \\x09"), F.lit("#path\tconn"), F.lit("\t".join(("#fields", *names))))

    head = spark.range(3).select(F.col("id").alias("log"), F.posexplode(F.when(F.col("id") == 1, note(turned)).otherwise(note(fields))).alias("line", "value"))
    # a row without its last field is short and must be padded
    first, second = (F.when(F.col("log") == 1, F.col(b)).otherwise(F.col(a)) for a, b in (("orig_h", "resp_h"), ("resp_h", "orig_h")))
    short = F.concat_ws("\t", first, second, "service", "orig_bytes", "resp_bytes")
    text = F.when(F.col("duration") == "-", short).otherwise(F.concat_ws("\t", short, "duration"))
    lines = head.unionByName(c.select("log", F.lit(9).alias("line"), text.alias("value")))
    lines.repartition("log").sortWithinPartitions("log", "line").drop("line").write.partitionBy("log").text(path)
    rows = read_conn_log(spark, path)
    return rows.groupBy("orig_h", "resp_h", "service").agg(
        F.count(F.lit(1)).alias("conns"), F.count_if(F.col("duration") != "").alias("with_duration"),
        F.sum(F.col("orig_bytes").try_cast("bigint")).alias("orig_bytes"),
    )



QUERIES = {
    "session_status": (session_status, RESULTS + " SELECT * EXCLUDE (ts) FROM st"),
    "host_rollup": (host_rollup, RESULTS + " SELECT host, count(*) AS sessions, arg_max(session_id, ts) AS last_session, arg_max(status, ts) AS last_status, "
        "arg_max(duration_s, ts) AS last_duration_s, arg_max(errs, ts) AS last_errs FROM st GROUP BY 1"),
    "scan_session_log": (scan_session_log, "WITH t AS (SELECT 'host' || conv_id % 20 AS host, length(text) % 6 AS r, length(text) % 4 > 0 AS g, text FROM conversations) "
        "SELECT host, ['commands', 'sftp', 'syslog', 'icmp', 'dns', 'http'][r + 1] AS event_kind, count(*) AS events, count(*) FILTER (WHERE r >= 3 AND g) AS ok_events, "
        "CASE WHEN r = 0 THEN 2 * count(*) END AS commands, sum(CASE WHEN r >= 3 AND NOT g THEN length(text) END)::BIGINT AS err_chars FROM t GROUP BY host, r"),
    "session_event_union": (session_event_union, "WITH t AS (SELECT 'host' || conv_id % 20 AS host, length(text) % 6 = 0 AS c FROM conversations) "
        "SELECT host, 'event' AS record, count(*) AS rows, count(*) FILTER (WHERE c) AS with_commands, 0 AS with_duration FROM t GROUP BY 1 "
        "UNION ALL SELECT host, 'result', count(*), 0, count(*) FROM t GROUP BY 1"),
    "conn_summary": (conn_summary, with_packets("," + CONNS + " SELECT count(*) AS total_connections, round(sum(ob + rb)::DOUBLE, 6) AS total_conn_bytes, round(avg(d), 9) AS avg_conn_duration_s, "
        "count(DISTINCT resp_h) AS unique_servers, count(DISTINCT orig_h) AS unique_clients, quantile_cont(d, 0.5) AS median_conn_duration_s FROM conns")),
    "conn_top": (conn_top, with_packets("," + CONNS + ", l AS (SELECT 'service' AS dim, service AS value, conn_key FROM conns UNION ALL SELECT 'server', resp_h, conn_key FROM conns "
        "UNION ALL SELECT 'client', orig_h, conn_key FROM conns), c AS (SELECT dim, value, count(*) AS n, min(conn_key) AS f FROM l GROUP BY 1, 2), "
        "r AS (SELECT dim, row_number() OVER (PARTITION BY dim ORDER BY n DESC, f)::INT AS rank, value, n FROM c) SELECT * FROM r WHERE rank <= 10")),
    "scan_conn_log": (scan_conn_log, with_packets("," + CONNS + " SELECT orig_h, resp_h, service, count(*) AS conns, count(*) FILTER (WHERE d <> 0 OR conn_key IN "
        "(SELECT filename || ',' || proto || ',' || ip1 || ',' || port1 || ',' || ip2 || ',' || port2 FROM bidir WHERE dur_us > 0)) AS with_duration, "
        "sum(CASE WHEN ob > 0 THEN ob END)::BIGINT AS orig_bytes FROM conns GROUP BY 1, 2, 3")),
}
