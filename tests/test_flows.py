"""Flow and capture operators on literal packets."""

from pyspark.sql import functions as F

from tracetide.operators import captures, conditions, flows, locality, series, timing
from tracetide.sources.adapter import packets

SCHEMA = (
    "filename string, packet_no long, ts_us long, frame_len long, proto_num int, ip_version string, is_tcp boolean, is_udp boolean, "
    "is_icmp boolean, src string, dst string, sport int, dport int"
)


def pkt(no, ts, size, proto, src, dst, sp, dp, name="c"):
    return (name, no, ts, size, proto, "IPv4", proto == 6, proto == 17, proto == 1, src, dst, sp, dp)


def test_both_directions_are_one_flow(spark):
    rows = [
        pkt(1, 10, 100, 6, "10.0.0.9", "10.0.0.10", 5, 80),
        pkt(2, 30, 50, 6, "10.0.0.10", "10.0.0.9", 80, 5),
        pkt(3, 20, 10, 17, "10.0.0.9", "10.0.0.10", 5, 80),  # other protocol
        pkt(4, 40, 10, 6, "h", "h", 9, 10),  # same address, ports decide
        pkt(5, 50, 10, 6, "h", "h", 10, 9),
        pkt(6, 60, 10, 1, "10.0.0.9", "10.0.0.10", None, None),
        pkt(7, 70, 10, 6, None, "x", 1, 2),
        pkt(8, 80, 10, 6, "x", "y", None, 2),
        pkt(9, 90, 10, None, "x", "y", 1, 2),
    ]
    got = {tuple(r)[1:] for r in flows.bidir_flows(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {
        ("tcp", "10.0.0.10", 80, "10.0.0.9", 5, 150, 2, 10, 30, 20),  # address order is text order
        ("udp", "10.0.0.10", 80, "10.0.0.9", 5, 10, 1, 20, 20, 0),
        ("tcp", "h", 9, "h", 10, 20, 2, 40, 50, 10),
    }


def test_capture_without_flows_keeps_its_row(spark):
    df = spark.createDataFrame([pkt(1, 0, 10, 1, "a", "b", None, None, "capturaAgenteWeb5m1.pcapng")], SCHEMA)
    r = flows.flow_metrics(df).first()
    assert (r["flows"], r["flows_per_min"], r["median_bytes_per_flow"], r["profile"]) == (0, None, None, "regular")


def test_swapping_directions_changes_nothing(spark, sf_dir):
    p = packets(spark, sf_dir)
    q = p.withColumns({"src": F.col("dst"), "dst": F.col("src"), "sport": F.col("dport"), "dport": F.col("sport")})
    a, b = flows.bidir_flows(p), flows.bidir_flows(q)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert a.agg(F.sum("packets")).first()[0] == p.where("proto_num IN (6, 17)").count()


def test_top_port_ties_go_to_the_first_seen(spark):
    rows = [pkt(i, i, 10, 17, "a", "b", 1, port) for i, port in enumerate([53, 443, 443, 53, 80])]
    r = captures.top_dst_port(spark.createDataFrame(rows, SCHEMA)).first()
    assert (r["top_udp_dport"], r["top_udp_dport_pkts"], r["top_tcp_dport"], r["top_tcp_dport_pkts"]) == (53, 2, None, 0)


def test_peak_bins_start_at_the_first_frame(spark):
    rows = [pkt(1, 900_000, 100, 6, "a", "b", 1, 2), pkt(2, 1_800_000, 100, 6, "a", "b", 1, 2), pkt(3, 1_950_000, 10, 6, "a", "b", 1, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert captures.peak_mbps_1s(df).first()["peak_mbps_1s"] == 200 * 8 / 1e6
    r = captures.per_second_peaks(df).first()
    assert (r["peak_bps"], r["peak_pps"]) == (110 * 8, 2)


def test_one_way_flow_with_lost_times(spark):
    rows = [pkt(1, 0, 5, 17, "a", "b", 1, 2), pkt(2, 70, 5, 17, "a", "b", 1, 2), pkt(3, 50, 5, 17, "a", "b", 1, 2), pkt(4, 0, 5, 17, "a", "b", 1, 2)]
    r = flows.unidir_flows(spark.createDataFrame(rows, SCHEMA)).first()
    assert (r["seen_us"], r["start_us"], r["end_us"], r["dur_us"], r["packets"]) == (0, 70, 50, 0, 4)


def test_untrusted_times_give_no_series(spark):
    rows = [pkt(i, 0 if i < 3 else 5_000_000 + i * 1_000_000, 10, 6, "a", "b", 1, 2) for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    trust = captures.ts_trust(df).first()
    assert not trust["series_ok"] and trust["zero_ts"] == 3
    assert series.bucket_series(df).isEmpty()


def test_series_keeps_all_bytes_and_gaps_sum_to_the_span(spark, sf_dir):
    p = packets(spark, sf_dir)
    s = series.bucket_series(p).groupBy("filename").agg(F.sum("bytes").alias("b"), (F.max("idx") + 1 == F.count("idx")).alias("dense"))
    t = p.groupBy("filename").agg(F.sum("frame_len").alias("b2"), (F.max("ts_us") - F.min("ts_us")).alias("span"))
    g = timing.packet_gaps(p).groupBy("filename").agg(F.sum(F.col("gap_us") * F.col("n")).alias("gaps"))
    rows = s.join(t, "filename").join(g, "filename").collect()
    assert len(rows) == 45 and all(r["b"] == r["b2"] and r["dense"] and r["gaps"] == r["span"] for r in rows)


def test_burstiness_and_autocorrelation_limits(spark):
    steady = spark.createDataFrame([pkt(i, 1_000_000 * (i + 1), 10, 6, "a", "b", 1, 2) for i in range(6)], SCHEMA)
    r = timing.burstiness_report(steady).first()
    assert r["burstiness_pkt_iat"] == -1.0 and r["burstiness_newflow_iat"] == 0.0
    assert series.autocorr_lag1(series.bucket_series(steady)).first()["autocorr_lag1"] == 0.0


def test_local_address_is_decided_on_the_prefix(spark):
    # packet 4 is the first from a private source that is at least packet 3
    srcs = ["10.0.0.1", "10.0.0.2", "8.8.8.8", "10.0.0.2", "10.0.0.1", "10.0.0.1"]
    df = spark.createDataFrame([pkt(10 * i, i, 1, 6, s, "x", 1, 443) for i, s in enumerate(srcs)], SCHEMA)
    r = locality.local_ip(df, min_packets=3).first()
    assert (r["local_ip"], r["local_ip_source"], r["known_from_no"]) == ("10.0.0.2", "inferred", 30)
    assert locality.local_ip(df).first()["local_ip"] is None
    given = locality.outbound_ports(df, locality.local_ip(df, "10.0.0.1")).first()
    assert (given["local_ip_source"], given["tcp_outbound_dport_443_pkts"], given["udp_outbound_total_pkts"]) == ("arg", 3, 0)


def test_coverage_reports_every_deviation(spark):
    names = [f"capturaAgente{a}{d}{r}.pcapng" for a in ("Web", "Gamer", "Admin") for d in ("5m", "15m", "1h") for r in range(1, 6)]
    names.remove("capturaAgenteWeb5m2.pcapng")
    names += ["capturaAgenteGamer15m6.pcapng", "capturaAgenteNormal5m1.pcapng", "notes.txt", "other.txt"]
    got = conditions.matrix_coverage(spark.createDataFrame([(n,) for n in names], "filename string")).collect()
    assert sorted((r["status"], r["profile"], r["run_idx"]) for r in got if r["profile"]) == [
        ("duplicated", "regular", 1), ("extra", "gamer", 6), ("missing", "regular", 2),
    ]
    assert sorted(r["filename"] for r in got if not r["profile"]) == ["notes.txt", "other.txt"]


def test_a_capture_without_data_keeps_its_row(spark):
    """One packet without addresses and time beside a capture with data."""
    from tracetide.operators import diversity

    odd = ("d", 1, 0, 60, None, None, False, False, False, None, None, None, None)
    df = spark.createDataFrame([pkt(1, 1_000_000, 10, 6, "a", "b", 1, 2), pkt(2, 5_000_000, 10, 6, "b", "a", 2, 1), odd], SCHEMA)
    rows = series.bucket_series(df)
    got = {
        "dst": diversity.dst_diversity(df), "capture": timing.iat_capture_order(df), "sorted": timing.iat_sorted(df), "new": timing.newflow_iat(df),
        "flows": flows.unidir_summary(df), "auto": series.autocorr_lag1(rows, df), "buckets": series.bucket_summary(rows, packets=df),
    }
    got = {k: {r["filename"]: tuple(r)[1:] for r in v.collect()} for k, v in got.items()}
    assert all(set(v) == {"c", "d"} for v in got.values())
    empty = {k: v["d"] for k, v in got.items()}
    assert empty["dst"] == (0, 0.0) and empty["auto"] == (0.0,) and empty["buckets"] == (0, None, None, None)
    assert empty["capture"] == empty["sorted"] == empty["new"] == (0, None, None, None, None)
    assert empty["flows"] == (0, 0, 0, 0.0, 0.0, 0.0, 0.0)


def test_autocorrelation_of_a_nearly_constant_series(spark):
    """Differences of large sums are exact."""
    big = 1_000_000_000_000
    values = [big + (i % 2) for i in range(1000)]
    rows = [("c", i, v) for i, v in enumerate(values)]
    got = series.autocorr_lag1(spark.createDataFrame(rows, "filename string, idx long, bytes long")).first()["autocorr_lag1"]
    low = [v - big for v in values]
    mean = sum(low) / len(low)
    want = sum((a - mean) * (b - mean) for a, b in zip(low, low[1:], strict=False)) / sum((a - mean) ** 2 for a in low)
    assert got == round(want, 6)
