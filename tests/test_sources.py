"""Readers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from tracetide.operators import captures, diversity, flows
from tracetide.sources import logs, sinks
from tracetide.sources.packets import scan_captures, scan_packet_fields, scan_packets


def quoted(*fields):
    return ",".join(f'"{f}"' for f in fields)


EXPORT = "\n".join([
    quoted("10.000001500", "10.0.0.1", "10.0.0.2", "", "", "1", "2", "", "", "6", "", "60"),
    quoted("10.5", "10.0.0.2", "10.0.0.1", "", "", "2", "1", "", "", "6", "", "40"),
    quoted("11", "10.0.0.1", "10.0.0.2", "", "", "1"),  # short
    quoted("x", "10.0.0.1", "10.0.0.2", "", "", "1", "2", "", "", "6", "", "60"),  # no time
    quoted("12", "", "", "", "", "", "", "", "", "", "", "42"),  # no address
    quoted("13", "", "", "fe80::1", "fe80::2", "", "", "53", "54", "", "17", "90"),
    quoted("14", "10.0.0.1", "10.0.0.2", "", "", "", "", "7", "8", "1,17", "", "70"),  # quoted header
    quoted("15", "10.0.0.1", "10.0.0.2", "", "", "", "", "", "", "6", "", "50"),  # TCP without ports
    quoted("16", "10.0.0.1", "10.0.0.2", "", "", "1", "2", "", "", "6", "", "4x"),  # bad length
    quoted("10.5", "10.0.0.1", "10.0.0.1", "", "", "9", "8", "", "", "6", "", "30"),  # same time, same address
]) + "\n"


def test_export_rows(spark, tmp_path):
    (tmp_path / "capturaAgenteWeb5m1.pcapng.csv").write_text(EXPORT)
    p = scan_packets(spark, str(tmp_path)).orderBy("packet_no")
    rows = p.collect()
    assert [r["frame_len"] for r in rows] == [60, 40, 42, 90, 70, 50, 30]  # order of the file
    assert {r["filename"] for r in rows} == {"capturaAgenteWeb5m1.pcapng"}
    assert rows[0]["ts_us"] == 10_000_001 and rows[3]["ip_version"] == "IPv6" and rows[3]["dport"] == 54
    nested = rows[4]
    assert nested["proto_num"] is None and nested["is_icmp"] and nested["is_udp"] and not nested["is_tcp"]
    got = sorted((r["proto"], r["bytes"]) for r in flows.bidir_flows(p).collect())
    assert got == [("tcp", 30), ("tcp", 100), ("udp", 90)]
    counts = captures.proto_counts(p).first()
    assert (counts["tcp_pkts"], counts["udp_pkts"], counts["icmp_pkts"], counts["other_pkts"]) == (4, 2, 1, 1)


@pytest.mark.parametrize("split", [128 << 20, 256])
def test_packets_of_a_capture_in_several_files(spark, tmp_path, split):
    """Numbers follow files, splits and lines without gaps."""
    folder = tmp_path / "filename=capturaAgenteWeb5m1.pcapng"
    folder.mkdir()
    for part in range(3):
        lines = [quoted(str(100 + 10 * part + i), "10.0.0.1", "10.0.0.2", "", "", "1", "2", "", "", "6", "", "60") for i in range(10)]
        (folder / f"part-{part}.csv").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        rows = scan_packets(spark, str(tmp_path)).orderBy("packet_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["packet_no"] for r in rows] == list(range(30))
    assert [r["ts_us"] for r in rows] == [(100 + i) * 1_000_000 for i in range(30)]


def test_exports_with_named_fields(spark, tmp_path):
    """Fields in another order; absent ones are null."""
    (tmp_path / "capturaAgenteWeb5m1.pcapng.csv").write_text(
        '"ip.proto","frame.len","frame.time_epoch","ip.src","ip.dst","tcp.srcport","tcp.dstport","udp.srcport","udp.dstport","tcp.flags","frame.cap_len","tcp.payload"\n'
        '"6,17","90","1.5","10.0.0.1","10.0.0.2","1","2","3","4","0x0012","64","47:45:54:20"\n'
        '"17","50","2.5","10.0.0.1","10.0.0.2","","","3","4","","","zz"\n'
    )
    a, b = scan_packet_fields(spark, str(tmp_path)).orderBy("packet_no").collect()
    assert (a["tcp_sport"], a["tcp_dport"], a["udp_sport"], a["udp_dport"], a["tcp_flags"], a["cap_len"]) == (1, 2, 3, 4, 18, 64)
    assert a["is_tcp"] and a["is_udp"] and bytes(a["payload"]) == b"GET " and a["proto_num"] is None
    assert (b["cap_len"], b["payload"], b["eth_type"], b["tcp_seq"], b["dns_qname"], b["udp_sport"], b["dport"]) == (50, None, None, None, None, 3, 4)
    from tracetide.operators import diversity

    assert diversity.domain_diversity(scan_packet_fields(spark, str(tmp_path))).first()["unique_dns_domains"] == 0


def test_conn_logs_with_other_column_orders(spark, tmp_path):
    (tmp_path / "a.log").write_text("#fields\tid.orig_h\tid.resp_h\tservice\tduration\nc\ts\tdns\t0.5\n")
    (tmp_path / "b.log").write_text("#fields\tservice\tid.resp_h\tid.orig_h\n-\ts\tc\nhttp\ts\n")
    rows = sorted(((r["orig_h"], r["resp_h"], r["service"], r["duration"]) for r in logs.scan_conn_log(spark, str(tmp_path)).collect()), key=repr)
    assert rows == [("", "s", "http", None), ("c", "s", "dns", "0.5"), ("c", "s", None, None)]


def test_captures_are_listed_without_reading(spark, tmp_path):
    for d in ("a", "b"):
        (tmp_path / d).mkdir()
    for f in ("capturaAgenteWeb5m2.pcapng", "capturaAgenteWeb5m1.pcapng", "a/capturaAgenteGamer5m1.pcapng", "b/other.txt"):
        (tmp_path / f).write_text("x")
    flat = scan_captures(spark, str(tmp_path))
    assert [r["filename"] for r in flat.collect()] == ["capturaAgenteWeb5m1.pcapng", "capturaAgenteWeb5m2.pcapng"]
    assert scan_captures(spark, str(tmp_path), recursive=True).count() == 3
    with pytest.raises(FileNotFoundError):
        scan_captures(spark, str(tmp_path), "*.none")


def test_tool_log(spark):
    cut = "x appears to have been cut short in the middle of a packet ... will continue anyway"
    rows = [("a", 0, "Capture duration:   12.5 seconds", ""), ("b", 1, "Capture duration: 3 seconds", cut), ("c", 2, "", "no such file"), ("d", 0, "nothing", None)]
    got = {r["filename"]: tuple(r)[1:] for r in logs.decode_tool_log(spark.createDataFrame(rows, "filename string, exit_code int, stdout string, stderr string")).collect()}
    assert got == {
        "a": (12.5, 0, "", ""), "b": (3.0, 1, cut, ""),
        "c": (None, 0, "", "capinfos_failed(exit=2): no such file"), "d": (None, 0, "", ""),
    }


@pytest.mark.parametrize("head", ["#separator \\x09\n#fields\tts\tid.orig_h\tid.resp_h\tservice\tduration\torig_bytes\tresp_bytes\n", "ts\tid.orig_h\tid.resp_h\tservice\tduration\torig_bytes\tresp_bytes\n"])
def test_conn_log(spark, tmp_path, head):
    (tmp_path / "conn.log").write_text(head + "1\tc\ts\tdns\t0.5\t10\t20\n\n2\tc\ts\t-\t-\t-\t7\n3\td\ts\thttp\n#close\n")
    rows = logs.scan_conn_log(spark, str(tmp_path)).orderBy("conn_no").collect()
    assert [(r["orig_h"], r["service"], r["duration"], r["resp_bytes"]) for r in rows] == [
        ("c", "dns", "0.5", "20"), ("c", None, None, "7"), ("d", "http", "", ""),
    ]
    from tracetide.operators.sessions import conn_summary, conn_top

    s = conn_summary(logs.scan_conn_log(spark, str(tmp_path))).first()
    assert (s["total_connections"], s["unique_servers"], s["unique_clients"], s["total_conn_bytes"], s["median_conn_duration_s"]) == (3, 1, 2, 37.0, 0.25)
    top = [(r["dim"], r["value"], r["n"]) for r in conn_top(logs.scan_conn_log(spark, str(tmp_path))).where("rank = 1").orderBy("dim").collect()]
    assert top == [("client", "c", 2), ("server", "s", 3), ("service", "dns", 1)]


def test_session_log_kinds(spark, tmp_path):
    base = {"ts": 1.5, "host": "h", "session_id": "s"}
    extra = [
        {"commands": ["ls"], "stdout_snippet": "x"}, {"sftp": "pulled"}, {"syslog_sent": "to"},
        {"icmp": True, "ip": "1", "ok": False, "err": "e"}, {"dns": True, "ns": "n", "qname": "q", "ok": True}, {"http": True, "url": "u", "code": 200, "ok": True},
    ]
    (tmp_path / "h.jsonl").write_text("\n".join(json.dumps({**base, **e}) for e in extra))
    rows = logs.scan_session_log(spark, str(tmp_path))
    assert sorted(r["event_kind"] for r in rows.collect()) == ["commands", "dns", "http", "icmp", "sftp", "syslog"]


def test_metric_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("c1", "admin", "5m", 1.5, None), ("c2", "gamer", "1h", None, "bad")],
        "filename string, profile string, duration_label string, mean_bps double, error string",
    )
    sinks.sink_metrics(df, str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m"))
    assert back.select(*df.columns).exceptAll(df).isEmpty() and back.count() == 2
    assert "PartitionFilters: [isnotnull(profile" in back.where("profile = 'admin'")._jdf.queryExecution().executedPlan().toString()
    docs = {r["filename"]: json.loads(r["document"]) for r in sinks.report_documents(df).collect()}
    assert docs["c1"] == {"filename": "c1", "profile": "admin", "duration_label": "5m", "mean_bps": 1.5, "error": None}


def test_summary_normalisation(spark, tmp_path):
    head = ",".join(c.split()[0] for c in logs.FLOW_COLUMNS.split(", "))
    (tmp_path / "f.csv").write_text(head + "\nn,admin,1h,60,1,3600.5,,,12,0.2,,x,3,,/p\n")
    r = logs.scan_summaries(spark, str(tmp_path), "flows").first()
    assert (r["duration_label"], r["capinfos_truncated"], r["error"], r["flows"], r["median_bytes_per_flow"], r["median_dur_s"]) == ("60m", 0, "", 12, None, None)


TABLE = """
=====================================
| IO Statistics                     |
| Duration: 12.5 secs               |
| Interval | Frames |     Bytes     |
|-----------------------------------|
|  0 <> 10 |  1,024 |    1,234,567  |
| 10 <> 12 |     20 |        9,000  |
=====================================
"""


def test_statistics_tables(spark):
    rows = [
        ("ok", 0, TABLE, ""), ("cut", 2, TABLE, "x: The file appears to have been cut short in the middle of a packet.\n"), ("bad", 1, "", " broken \n"),
        ("none", 0, "| 5 |\nno table", ""), ("null", 0, None, None), ("crlf", 0, "|1 <> 2|7|900|\r\n", None),
    ]
    runs = spark.createDataFrame(rows, "filename string, exit_code int, stdout string, stderr string")
    totals = {r.filename: tuple(r)[1:] for r in logs.decode_io_totals(runs).collect()}
    assert totals == {
        "ok": (1024, 1234567, ""), "cut": (None, None, "tshark_truncated(io,stat,0)"), "bad": (None, None, "tshark_io_stat_0_failed(exit=1): broken"),
        "none": (None, None, "tshark_io_stat_0_parse_failed"), "null": (None, None, "tshark_io_stat_0_parse_failed"), "crlf": (7, 900, ""),
    }
    peaks = {r.filename: tuple(r)[1:] for r in logs.decode_io_peaks(runs).collect()}
    assert peaks["ok"] == (1234567 * 8 / 1e6, "") and peaks["cut"] == (None, "tshark_truncated(io,stat,1)") and peaks["none"] == (None, "")
    one = spark.createDataFrame([("bad", 1, 5, 60), ("none", 1, 5, 40)], "filename string, packet_no long, ts_us long, frame_len long")
    chain = {r.filename: tuple(r)[1:] for r in captures.capture_totals(one, logs.decode_io_totals(runs)).collect()}
    assert chain["bad"] == (1, 60, "tshark_frame_len", "tshark_io_stat_0_failed(exit=1): broken") and chain["ok"][2] == "tshark_io_stat"
    assert chain["cut"] == (0, 0, "error", "tshark_truncated(io,stat,0) | tshark_frame_len_parse_failed")


def test_both_layers_of_a_tunnel_count(spark, tmp_path):
    """A TCP packet inside UDP: each layer has its ports; equal hashes are duplicates."""
    head = ["frame.time_epoch", "frame.len", "frame.cap_len", "ip.src", "ip.dst", "ip.proto", "tcp.srcport", "tcp.dstport", "udp.srcport", "udp.dstport", "frame.md5_hash"]
    lines = [
        quoted(*head), quoted("1.0", "900", "96", "a", "b", "17,6", "50", "80", "51", "443", "AA"), quoted("1.1", "900", "96", "a", "b", "6", "50", "443", "", "", "aa"),
        quoted("1.2", "50", "50", "a", "b", "17", "", "", "53", "443", "bb"), quoted("1.3", "50", "50", "a", "b", "1", "", "", "", "", ""), quoted("1.4", "50", "50", "a", "b", "1", "", "", "", "", ""),
    ]
    (tmp_path / "c.csv").write_text("\n".join(lines) + "\n")
    p = scan_packet_fields(spark, str(tmp_path))
    counts = captures.proto_counts(p).first()
    assert (counts.tcp_pkts, counts.udp_pkts, counts.icmp_pkts, counts.udp443_pkts, counts.tcp443_pkts) == (2, 2, 2, 2, 1)
    top = captures.top_dst_port(p).first()
    assert (top.top_udp_dport, top.top_udp_dport_pkts, top.top_tcp_dport, top.top_tcp_dport_pkts) == (443, 2, 80, 1)
    assert captures.packet_size_stats(p).first().max_bytes == 96
    dup = diversity.duplicate_packets(p).first()
    assert (dup.total, dup.duplicates) == (5, 1)
