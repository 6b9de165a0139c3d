"""Registered queries over row-level functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import net, numbers, text
from ..operators.quality_rules import error_policy as error_text
from ..sources.adapter import START_US, packets, table
from ..sources.packets import endpoints
from .oracle_base import with_packets


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("bigint"))


EVENTS = "WITH e AS (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM events)"


def lenient_numbers(spark, sf):
    k, v = F.col("k"), F.col("value").cast("string")
    token = (
        F.when(k % 7 == 0, v).when(k % 7 == 1, F.concat(k.cast("string"), F.lit(".9"))).when(k % 7 == 2, "abc")
        .when(k % 7 == 3, "").when(k % 7 == 4, F.concat(k.cast("string"), F.lit(",17")))
        .when(k % 7 == 5, F.concat(F.lit("1,"), k.cast("string"), F.lit(" frames")))
    )
    t = F.col("token")
    return _events(spark, sf).select("event_id", token.alias("token")).select(
        "event_id", numbers.lenient_int(t).alias("as_int"), numbers.lenient_int(t, -1).alias("as_int_or_minus"),
        numbers.lenient_float(t).alias("as_float"), numbers.digits_int(t).alias("digits"), numbers.strict_int(t).alias("strict"),
    )


def normalise_ts(spark, sf):
    p = packets(spark, sf)
    k, us = F.col("k"), F.col("ts_us")
    per = F.when(k % 2 == 0, F.lit(1_000_000_000).cast("bigint"))
    ticks = F.when(k % 2 == 0, us * 1000).otherwise(us)
    pair = k % 3 == 1
    out = net.epoch_micros(
        F.when(k % 3 == 0, F.floor(us / 1_000_000)), F.when(k % 3 == 0, us % 1_000_000),
        F.when(pair, F.shiftright(ticks, 32)), F.when(pair, ticks.bitwiseAND((1 << 32) - 1)), per,
    )
    return p.select("packet_no", out.alias("ts_us"))


def endpoint_coalesce(spark, sf):
    k = F.col("k")
    raw = packets(spark, sf).select(
        "packet_no",
        F.when(k % 3 == 0, F.col("src")).otherwise("").alias("ip_src"), F.when(k % 3 == 0, F.col("dst")).otherwise("").alias("ip_dst"),
        F.when(k % 3 == 1, F.concat(F.lit("fe80::"), k.cast("string"))).alias("ipv6_src"),
        F.when(k % 3 == 1, F.lit("fe80::1")).alias("ipv6_dst"),
        F.when(k % 5 == 0, "1,17").when(k % 3 == 0, F.col("proto_num").cast("string")).alias("ip_proto"),
        F.when(k % 3 == 1, F.col("proto_num").cast("string")).otherwise("").alias("ipv6_nxt"),
    )
    ends = endpoints()
    return raw.select("packet_no", *[c.alias(n) for n, c in ends.items()]).where(
        F.col("src").isNotNull() & F.col("dst").isNotNull()
    )


def proto_names(spark, sf):
    k = F.col("k")
    version = F.when(k % 3 == 0, "IPv4").when(k % 3 == 1, "IPv6")
    num = (F.col("event_id") % 64).cast("int")
    eth = F.element_at(F.array(*[F.lit(x) for x in (0x0800, 0x86DD, 0x0806, 0x8847, 0x8100, 0x88CC)]), (k % 6 + 1).cast("int"))
    rows = _events(spark, sf).select(version.alias("v"), num.alias("n"), eth.alias("e"))
    return rows.groupBy("v", "n", "e").agg(F.count(F.lit(1)).alias("pkts")).select(
        "v", "n", "e", "pkts", net.proto_name(F.col("v"), F.col("n")).alias("proto_name"),
        net.ether_type_name(F.col("e")).alias("ether_name"), net.ip_protocol_name(F.col("n")).alias("ip_name"),
    )


_PORTS = (443, 80, 53, 123, 22, 25, 587, 110, 995, 143, 993, 3389, 40000)


def app_protocol(spark, sf):
    ports = F.array(*map(F.lit, _PORTS))
    k, eid = F.col("k"), F.col("event_id")
    head = F.when(k % 4 == 0, "GET /a").when(k % 4 == 1, "PUT it").when(k % 4 == 2, "POST x")
    rows = _events(spark, sf).select(
        F.element_at(ports, (k % 13 + 1).cast("int")).alias("sport"), F.element_at(ports, (eid % 13 + 1).cast("int")).alias("dport"),
        (F.col("user_id") % 2 == 0).alias("is_udp"), F.encode(head, "UTF-8").alias("payload"), (k % 4).alias("form"),
    )
    app = net.app_protocol(F.col("is_udp"), F.col("sport"), F.col("dport"), F.col("payload"))
    return rows.select("sport", "dport", "is_udp", "form", app.alias("app")).groupBy("sport", "dport", "is_udp", "form", "app").agg(
        F.count(F.lit(1)).alias("pkts")
    )


def http_fields(spark, sf):
    url = F.col("url")
    method = F.element_at(F.array(*[F.lit(m) for m in ("GET", "POST", "OPTIONS", "PATCH")]), (F.col("page_id") % 4 + 1).cast("int"))
    host = F.regexp_extract(url, "^https?://([^/]+)", 1)
    path = F.regexp_replace(url, "^https?://[^/]+", "")
    request = F.concat(method, F.lit(" "), path, F.lit(" HTTP/1.1\r\nAccept: */*\r\nHOST:  "), host, F.lit("\r\n\r\n"), F.col("html"))
    t = net.payload_text(F.encode(request, "UTF-8"))
    return table(spark, sf, "pages").select("page_id", net.http_method(t).alias("method"), net.http_host(t).alias("host"))


def quic_long_header(spark, sf):
    digest = F.unhex(F.sha2("text", 256))
    return table(spark, sf, "documents").select("doc_id", net.quic_form(digest).alias("quic_form"))


def dns_base_domain(spark, sf):
    host = F.concat(F.regexp_extract("url", "^https?://([^/]+)", 1), F.when(F.col("page_id") % 2 == 0, ".").otherwise(""))
    name = F.when(F.col("page_id") % 5 == 0, "localhost").otherwise(host)
    return table(spark, sf, "pages").select("page_id", net.dns_base_domain(name).alias("base_domain"))


def is_private_ip(spark, sf):
    first = F.element_at(F.array(*map(F.lit, (10, 172, 192, 169, 198, 203, 100, 127, 250, 8))), (F.col("k") % 10 + 1).cast("int"))
    second = F.element_at(F.array(*map(F.lit, (0, 16, 168, 254, 18, 31, 51, 88, 32, 255))), (F.col("user_id") % 10 + 1).cast("int"))
    third = F.element_at(F.array(*map(F.lit, (0, 1, 2, 100, 113))), (F.col("event_id") % 5 + 1).cast("int"))
    ip = F.concat_ws(".", first, second, third, (F.col("k") % 12).cast("string"))
    ip = F.when(F.col("event_id") % 97 == 0, F.concat(ip, F.lit(".7"))).otherwise(ip)
    return _events(spark, sf).select("event_id", ip.alias("ip")).withColumn("is_private", net.is_private_ip(F.col("ip")))


def tcp_seg_len(spark, sf):
    p = packets(spark, sf).where("is_tcp")
    return p.select("packet_no", net.tcp_segment_length(F.col("payload_len"), F.col("tcp_flags")).alias("seg_len"))


def human_units(spark, sf):
    n = F.floor(F.col("l_extendedprice") * F.pow(F.lit(10.0), F.col("l_linenumber") * 2 - 3))
    n = F.when(F.col("l_orderkey") % 50 != 0, n)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", n.cast("bigint").alias("n")).select(
        "l_orderkey", "l_linenumber", text.human_bytes(F.col("n")).alias("bytes_text"), text.human_bps(F.col("n") * 8.0).alias("rate_text")
    )


def clean_label(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", text.clean_label(F.col("text")).alias("label"), text.clean_session_id(F.col("text")).alias("session_id")
    )


def snippet(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", text.snippet(F.col("text"), 60).alias("short"), text.snippet(F.col("text"), 80).alias("page"),
        text.stdout_field(F.col("text")).alias("stdout_snippet"), text.output_text(F.col("text"), 200).alias("capped"),
    )


def error_policy(spark, sf):
    k = F.col("k")
    parts = [F.when(k % 2 == 0, "tshark_truncated(tcp)"), F.when(k % 3 == 0, "tshark_truncated(udp)"), F.when(k % 5 == 0, "parse_failed")]
    return packets(spark, sf).select("packet_no", error_text(parts).alias("error"))


_CASE_PORTS = "[" + ",".join(map(str, _PORTS)) + "]"


def _ladder(x, step, units):
    sql, cur = "", x
    for u in units[:-1]:
        sql += f" WHEN {cur} < {step} THEN printf('%.2f', {cur}) || ' {u}'"
        cur = f"({cur} / {step})"
    return f"CASE WHEN {x} IS NULL THEN 'n/a'{sql} ELSE printf('%.2f', {cur}) || ' {units[-1]}' END"


QUERIES = {
    "lenient_numbers": (lenient_numbers, EVENTS + """, t AS (SELECT event_id, CASE k % 7 WHEN 0 THEN value::VARCHAR WHEN 1 THEN k || '.9' WHEN 2 THEN 'abc' WHEN 3 THEN ''
        WHEN 4 THEN k || ',17' WHEN 5 THEN '1,' || k || ' frames' END AS x FROM e)
        SELECT event_id, coalesce(trunc(TRY_CAST(x AS DOUBLE))::BIGINT, 0) AS as_int, coalesce(trunc(TRY_CAST(x AS DOUBLE))::BIGINT, -1) AS as_int_or_minus,
        TRY_CAST(x AS DOUBLE) AS as_float, coalesce(TRY_CAST(regexp_replace(x, '\\D', '', 'g') AS BIGINT), 0) AS digits,
        CASE WHEN regexp_full_match(x, '[0-9]+') THEN x::BIGINT END AS strict FROM t"""),
    "normalise_ts": (normalise_ts, with_packets("SELECT packet_no, CASE WHEN k % 3 = 2 THEN 0 ELSE ts_us END AS ts_us FROM packets")),
    "endpoint_coalesce": (endpoint_coalesce, with_packets(
        "SELECT packet_no, CASE k % 3 WHEN 0 THEN src ELSE 'fe80::' || k END AS src, CASE k % 3 WHEN 0 THEN dst ELSE 'fe80::1' END AS dst, "
        "(CASE WHEN k % 3 = 0 AND k % 5 = 0 THEN NULL ELSE proto_num END)::INT AS proto_num FROM packets WHERE k % 3 < 2")),
    "proto_names": (proto_names, EVENTS + """, r AS (SELECT CASE k % 3 WHEN 0 THEN 'IPv4' WHEN 1 THEN 'IPv6' END AS v, (event_id % 64)::INT AS n,
        [2048, 34525, 2054, 34887, 33024, 35020][k % 6 + 1] AS e, count(*) AS pkts FROM e GROUP BY 1, 2, 3)
        SELECT v, n, e, pkts, CASE WHEN v IS NULL THEN 'UNKNOWN' WHEN n = 6 THEN 'TCP' WHEN n = 17 THEN 'UDP' WHEN v = 'IPv4' AND n = 1 THEN 'ICMP'
          WHEN v = 'IPv6' AND n = 58 THEN 'ICMPv6' ELSE v || '_' || n END AS proto_name,
        CASE e WHEN 2048 THEN 'IPv4' WHEN 34525 THEN 'IPv6' WHEN 2054 THEN 'ARP' WHEN 34887 THEN 'MPLS' WHEN 33024 THEN '802.1Q' ELSE '0x88cc' END AS ether_name,
        CASE n WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 41 THEN 'ENCAP-IPv6' WHEN 47 THEN 'GRE' WHEN 50 THEN 'ESP' WHEN 51 THEN 'AH'
          WHEN 58 THEN 'ICMPv6' ELSE n::VARCHAR END AS ip_name FROM r"""),
    "app_protocol": (app_protocol, EVENTS + f""", r AS (SELECT {_CASE_PORTS}[k % 13 + 1] AS sport, {_CASE_PORTS}[event_id % 13 + 1] AS dport, user_id % 2 = 0 AS is_udp, k % 4 AS form FROM e),
        p AS (SELECT *, [sport, dport] AS l FROM r)
        SELECT sport, dport, is_udp, form, CASE WHEN list_contains(l, 443) THEN CASE WHEN is_udp THEN 'QUIC/HTTP3' ELSE 'HTTPS' END WHEN list_contains(l, 80) THEN 'HTTP'
          WHEN list_contains(l, 53) THEN 'DNS' WHEN list_contains(l, 123) THEN 'NTP' WHEN list_contains(l, 22) THEN 'SSH' WHEN list_has_any(l, [25, 587]) THEN 'SMTP'
          WHEN list_has_any(l, [110, 995]) THEN 'POP3' WHEN list_has_any(l, [143, 993]) THEN 'IMAP' WHEN list_contains(l, 3389) THEN 'RDP' WHEN form < 3 THEN 'HTTP' ELSE 'UNKNOWN' END AS app,
          count(*) AS pkts FROM p GROUP BY ALL"""),
    "http_fields": (http_fields, "SELECT page_id, ['GET', 'POST', 'OPTIONS', NULL][page_id % 4 + 1] AS method, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages"),
    "quic_long_header": (quic_long_header, "SELECT doc_id, CASE WHEN sha256(text)[1] IN ('c', 'd', 'e', 'f') THEN 'LONG_HDR' END AS quic_form FROM documents"),
    "dns_base_domain": (dns_base_domain, "WITH h AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS h FROM pages) SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'localhost' "
        "WHEN regexp_matches(h, '[.]') THEN regexp_extract(h, '[^.]+[.][^.]+$') ELSE h END AS base_domain FROM h"),
    "is_private_ip": (is_private_ip, EVENTS + """, p AS (SELECT event_id, [10, 172, 192, 169, 198, 203, 100, 127, 250, 8][k % 10 + 1] AS a, [0, 16, 168, 254, 18, 31, 51, 88, 32, 255][user_id % 10 + 1] AS b,
        [0, 1, 2, 100, 113][event_id % 5 + 1] AS c, k % 12 AS d FROM e), q AS (SELECT *, ((a::BIGINT * 256 + b) * 256 + c) * 256 + d AS v FROM p)
        SELECT event_id, a || '.' || b || '.' || c || '.' || d || CASE WHEN event_id % 97 = 0 THEN '.7' ELSE '' END AS ip,
        event_id % 97 <> 0 AND (a IN (10, 127) OR a >= 240 OR v BETWEEN 2851995648 AND 2852061183 OR v BETWEEN 2886729728 AND 2887778303 OR (v BETWEEN 3221225472 AND 3221225727 AND d NOT IN (9, 10))
          OR v BETWEEN 3221225984 AND 3221226239 OR v BETWEEN 3232235520 AND 3232301055 OR v BETWEEN 3323068416 AND 3323199487 OR v BETWEEN 3325256704 AND 3325256959
          OR v BETWEEN 3405803776 AND 3405804031) AS is_private FROM q"""),
    "tcp_seg_len": (tcp_seg_len, with_packets("SELECT packet_no, CASE WHEN payload_len = 0 AND tcp_flags > 0 THEN 1 ELSE payload_len END AS seg_len FROM packets WHERE is_tcp")),
    "human_units": (human_units, "WITH n AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 50 <> 0 THEN floor(l_extendedprice * pow(10.0::DOUBLE, l_linenumber * 2 - 3))::BIGINT::DOUBLE END AS n FROM lineitem) "
        "SELECT l_orderkey, l_linenumber, " + _ladder("n", "1024.0::DOUBLE", text.BYTE_UNITS) + " AS bytes_text, " + _ladder("(n * 8.0::DOUBLE)", "1000.0::DOUBLE", text.RATE_UNITS) + " AS rate_text FROM n"),
    "clean_label": (clean_label, r"SELECT conv_id, turn, rtrim(regexp_replace(text, '[^\p{L}\p{N} ._-]', '', 'g')) AS label, regexp_replace(text, '[^\p{L}\p{N}_-]', '', 'g') AS session_id FROM conversations"),
    "snippet": (snippet, "SELECT conv_id, turn, CASE WHEN length(text) > 60 THEN left(text, 60) || '…' ELSE text END AS short, CASE WHEN length(text) > 80 THEN left(text, 80) || '…' ELSE text END AS page, "
        "left(text, 10000) AS stdout_snippet, CASE WHEN length(text) > 200 THEN left(text, 200) || chr(10) || '...TRUNCATED(' || length(text) || ' bytes)...' ELSE text END AS capped FROM conversations"),
    "error_policy": (error_policy, with_packets(
        "SELECT packet_no, concat_ws(' | ', CASE WHEN k % 2 = 0 THEN 'tshark_truncated(tcp)' END, CASE WHEN k % 3 = 0 THEN 'tshark_truncated(udp)' END, CASE WHEN k % 5 = 0 THEN 'parse_failed' END) AS error FROM packets")),
}
