"""Report documents over odd captures, and their leaves."""

import json

import pytest
from pyspark.sql import functions as F

from tracetide.operators import reports
from tracetide.sources import sinks

SCHEMA = (
    "filename string, packet_no long, ts_us long, frame_len long, proto_num int, ip_version string, eth_type int, is_tcp boolean, is_udp boolean, is_icmp boolean, "
    "src string, dst string, sport int, dport int, tcp_seq long, payload_len long, tcp_flags int, icmp_type int, dns_qname string, payload binary"
)
S = 1_700_000_000_000_000


def packet(name, no, ts, size=100, proto=6, src="10.0.0.1", dst="1.1.1.1", sport=5000, dport=443, seq=0):
    tcp, udp = proto == 6, proto == 17
    ports = (sport, dport) if tcp or udp else (None, None)
    return (name, no, ts, size, proto, "IPv4", 2048, tcp, udp, proto == 1, src, dst, *ports, seq if tcp else None, 10 if tcp else None, 0 if tcp else None, None, None, None)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [packet("a", k, S + k * 400_000, 100 + k, seq=10 * k) for k in range(5)]
    rows += [packet("lost", k, S if k == 0 else 0, proto=17) for k in range(3)]
    rows += [packet("icmp", 0, S, proto=1)]
    rows += [("void", 0, S, 60, None, None, 2054, False, False, False, None, None, None, None, None, None, None, None, None, None)]
    packets = spark.createDataFrame(rows, SCHEMA)
    bad = spark.createDataFrame([("a", 3)], "filename string, bad_frames long")
    conns = spark.createDataFrame([("a", '{"total_connections": 7}'), ("icmp", "broken")], "filename string, document string")
    found = {
        "statistics": reports.statistics_report(packets, bad_frames=bad, raw_limit=2),
        "quality": reports.quality_report(packets, conns=conns),
    }
    return {k: {r.filename: json.loads(r.document) for r in v.collect()} for k, v in found.items()}


def test_every_capture_has_a_document(docs):
    assert set(docs["statistics"]) == set(docs["quality"]) == {"a", "lost", "icmp", "void"}


def test_statistics_of_a_plain_capture(docs):
    a = docs["statistics"]["a"]
    assert (a["packets"], a["bytes"], a["flows_total"], a["bad_frames"]) == (5, 510, 1, 3)
    assert a["throughput_series"] == {"times_seconds_from_start": [0, 1], "mbps": [0.002424, 0.001656]}
    assert a["top_tcp_dst_ports"] == [[443, 5]] and a["ip_protocols"] == [["TCP", 5]] and a["http_hosts_heuristic"] == []
    assert a["packet_iat_seconds_list"] == [0.4, 0.4]  # cut at the limit of two
    assert list(a["windowed_throughput_bps"]) == ["300", "3600", "900"]
    assert a["top_flows_unidirectional"][0] == {
        "ip_version": "IPv4", "src": "10.0.0.1", "dst": "1.1.1.1", "sport": 5000, "dport": 443, "proto": "TCP", "bytes": 510, "packets": 5, "duration": 1.6,
    }


@pytest.fixture(scope="module")
def long_packets(spark):
    """A capture with more values in every raw list than the report once held: each packet is a flow of its own."""
    rows = spark.range(50_004).select(
        F.lit("long").alias("filename"), F.col("id").alias("packet_no"), (S + F.col("id") * 1000).alias("ts_us"), (60 + F.col("id") % 7).alias("frame_len"),
        F.lit(17).alias("proto_num"), F.lit("IPv4").alias("ip_version"), F.lit(2048).alias("eth_type"), F.lit(False).alias("is_tcp"), F.lit(True).alias("is_udp"), F.lit(False).alias("is_icmp"),
        F.concat(F.lit("10.0.0."), (F.col("id") % 2).cast("string")).alias("src"), F.lit("1.1.1.1").alias("dst"), (F.col("id") / 2).cast("int").alias("sport"), F.lit(443).alias("dport"),
        *(F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in "tcp_seq long,payload_len long,tcp_flags int,icmp_type int,dns_qname string,payload binary".split(","))),
    )
    return rows.localCheckpoint()


@pytest.fixture(scope="module")
def long_documents(long_packets):
    return reports.statistics_report(long_packets).localCheckpoint()


def test_raw_lists_are_whole(long_documents):
    found = long_documents.collect()
    assert len(found) == 1
    d = json.loads(found[0].document)
    assert d["packet_iat_seconds_list"] == d["newflow_iat_seconds_list"] == [0.001] * 50_003
    assert d["flows_bytes_list"] == [60 + k % 7 for k in range(50_004)] and d["flows_packets_list"] == [1] * 50_004
    assert d["flows_duration_seconds_list"] == [0.0] * 50_004


def test_later_pages_are_rows_of_their_own(spark, long_packets, long_documents, tmp_path):
    found = reports.statistics_report(long_packets, page=20_000)
    sinks.write_documents(found, str(tmp_path / "docs"))
    back = sinks.read_documents(spark, str(tmp_path / "docs"))
    parts = [json.loads(r.document) for r in back.collect()]
    assert sorted(d.get("continues_at", 0) for d in parts) == [0] + [20_000] * 5 + [40_000] * 5
    for name in reports.RAW_LISTS:
        assert sorted((d.get("continues_at", 0), len(d[name])) for d in parts if name in d)[:2] == [(0, 20_000), (20_000, 20_000)]
    paths = reports.document_paths(back).collect()
    sizes = {r.path: r.number for r in paths if r.path.startswith("flows_bytes_list")}
    assert sizes == {f"flows_bytes_list[{k}]": 60 + k % 7 for k in range(50_004)}
    whole = reports.document_paths(long_documents).collect()
    assert sorted(map(str, paths)) == sorted(map(str, whole))


def test_pages_of_nulls_keep_their_places(spark):
    df = spark.createDataFrame([("one", '{"continues_at": 4, "a": [null, null]}'), ("two", '{"continues_at": 4, "a": [null, 0.5]}')], "filename string, document string")
    found = {(r.filename, r.path): (r.number, r.text) for r in reports.document_paths(df).collect()}
    assert found == {("one", "a[4]"): (None, None), ("one", "a[5]"): (None, None), ("two", "a[4]"): (None, None), ("two", "a[5]"): (0.5, None)}


def test_a_capture_without_times_says_so(docs):
    lost = docs["statistics"]["lost"]
    assert lost["throughput_series"] == reports.UNRELIABLE and lost["duration_reason"] == "fallback_invalid_ts"
    assert "windowed_throughput_bps" not in lost and lost["windowed_throughput_summary_mbps"] == {} and lost["throughput_peak_mbps_bucket"] is None


def test_captures_without_flows_or_addresses(docs):
    for name in ("icmp", "void"):
        d = docs["statistics"][name]
        assert d["flows_total"] == 0 and d["flows_bytes_list"] == [] and d["top_flows_unidirectional"] == [] and "windowed_newflows_per_min" not in d
    assert docs["statistics"]["void"]["top_src_ips"] == [] and docs["statistics"]["void"]["unique_dst_ips"] == 0


def test_quality_documents(docs):
    q = docs["quality"]
    a = q["a"]["scapy"]
    assert a["total_bytes"] == 510 and a["gaps_over_threshold"] == 4 and a["duplicates_approx"] == 0
    assert a["protocols"]["top_tcp_ports"] == [{"port": 5000, "count": 5}, {"port": 443, "count": 5}]
    assert a["tcp_quality"]["retransmissions"] == 0 and q["a"]["zeek"] == {"total_connections": 7}
    assert q["lost"]["scapy"]["duplicates_approx"] == 2 and "note" in q["icmp"]["zeek"] and "note" in q["lost"]["zeek"]
    assert q["void"]["scapy"]["protocols"] == {"ethertypes": {"ARP": 1}, "ip_protocols": {}, "top_tcp_ports": [], "top_udp_ports": []}


def test_leaves_of_documents(spark, tmp_path):
    text = '{"a": {"b": [1, {"c": "x"}, [], null, true]}, "e": {}, "f": 0.5, "g": null}'
    df = spark.createDataFrame([("one", text)], "filename string, document string")
    sinks.write_documents(df, str(tmp_path / "docs"))
    back = sinks.read_documents(spark, str(tmp_path / "docs"))
    assert [tuple(r) for r in back.collect()] == [("one", text)]
    rows = {r.path: (r.number, r.text) for r in reports.document_paths(back).collect()}
    assert rows == {
        "a.b[0]": (1.0, None), "a.b[1].c": (None, "x"), "a.b[2]": (None, "[]"), "a.b[3]": (None, None), "a.b[4]": (None, "true"),
        "e": (None, "{}"), "f": (0.5, None), "g": (None, None),
    }
    assert reports.document_paths(back.where(F.lit(False))).count() == 0
