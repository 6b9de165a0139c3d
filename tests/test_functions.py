"""Row-level functions on edge values."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from tracetide.functions import naming, net, numbers, text


def one(spark, schema, rows, col):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_fixed_text_rounds_like_binary(spark):
    rnd = random.Random(4)
    xs = [0.0, 1.125, 2.675, 0.005, 1.005, 99.995, 0.125, 1e15 + 0.5, 1e12 + 0.125, 3.5, -2.5]
    xs += [rnd.random() * 10 ** rnd.randint(-3, 9) for _ in range(500)] + [rnd.randint(0, 10**7) / 1024 for _ in range(500)]
    for digits in (1, 2, 4):
        got = one(spark, "x double", [(x,) for x in xs], numbers.fixed_text(F.col("x"), digits))
        assert got == [f"{x:.{digits}f}" for x in xs]


def test_lenient_numbers(spark):
    vals = ["3.9", " 7 ", "1e3", "nan", "inf", "", "abc", None, "1d", "0x10", "-2.5"]
    got = one(spark, "x string", [(v,) for v in vals], numbers.lenient_int(F.col("x"), -9))
    assert got == [3, 7, 1000, -9, -9, -9, -9, -9, -9, -9, -2]
    got = one(spark, "x string", [("1,234 B",), ("",), ("none",)], numbers.digits_int(F.col("x")))
    assert got == [1234, 0, 0]
    got = one(spark, "x string", [("17",), ("1,17",), ("6.0",), (" 6 ",)], numbers.strict_int(F.col("x")))
    assert got == [17, None, None, 6]


@pytest.mark.parametrize(
    "name,want",
    [
        ("capturaAgenteAdmin15m3.pcapng", ("admin", "15m", 15, 3)),
        ("capturaAgenteGamerPro1h12.pcapng", ("gamer", "1h", 60, 12)),
        ("capturaAgenteNormal5m1.pcapng", ("regular", "5m", 5, 1)),
        ("capturaAgenteBackup30m1.pcapng", ("backup", "30m", None, 1)),
        ("capturaAgenteWeb5m1.pcap", (None, None, None, None)),
        ("xcapturaAgenteWeb5m1.pcapng", (None, None, None, None)),
        ("capturaAgenteWeb2h1.pcapng", (None, None, None, None)),
    ],
)
def test_capture_names(spark, name, want):
    r = naming.with_capture_name(spark.createDataFrame([(name,)], "filename string")).first()
    assert (r["profile"], r["duration_label"], r["duration_requested_min"], r["run_idx"]) == want


def test_private_ipv6_addresses(spark):
    ips = [
        "::ffff:8.8.8.8", "::ffff:10.0.0.1", "::ffff:192.0.0.9", "0:0:0:0:0:0:0:1", "::", "fe80:1:2", "fe80:::::", "fe80::1%eth0", "2001:1::1", "2001:1::3",
        "2001:20::5", "2001:4:112::1", "2001:db8::1", "2606:4700::1111", "fd00::1", "febf::1", "fec0::1", "64:ff9b:1::1", "64:ff9b::1", "100::1", "100:0:0:1::1",
        "3fff:fff::1", "3fff:1000::1", "2002::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8:9", "::1.2.3", "::g", "12345::", "1::2::3", ":1:2:3:4:5:6:7:8",
        "::ffff:0a00:0001", "2001:0:1::", "2001:1ff:ffff::1", "2001:200::1",
    ]

    def told(ip):
        try:
            return ipaddress.ip_address(ip).is_private
        except ValueError:
            return False

    got = one(spark, "x string", [(i,) for i in ips], net.is_private_ip(F.col("x")))
    assert dict(zip(ips, got, strict=True)) == {i: told(i) for i in ips}


def test_private_addresses(spark):
    import ipaddress

    ips = [
        "10.0.0.1", "172.15.0.1", "172.16.0.1", "172.31.9.9", "172.32.0.1", "192.168.1.1", "8.8.8.8", "127.0.0.1", "169.254.3.3",
        "192.0.0.8", "192.0.0.9", "192.0.0.10", "192.0.2.5", "198.17.0.1", "198.19.255.1", "198.51.100.7", "203.0.113.9", "239.1.1.1",
        "240.0.0.1", "255.255.255.255", "0.1.2.3", "100.64.0.1", "01.2.3.4", "256.1.1.1", "1.2.3", "", "::1", "::", "fe80::1", "febf::1",
        "fec0::1", "fd00::2", "2001:db8::1", "2001:4860:4860::8888", "2001:1::1", "2001:3::5", "2001:10::1", "2001:20::1", "2002::1", "100::5",
        "64:ff9b::1", "64:ff9b:1::1", "2a00::1", "2001::1", "2001:200::1",
    ]

    def truth(ip):
        try:
            return ipaddress.ip_address(ip).is_private
        except ValueError:
            return False

    got = one(spark, "x string", [(i,) for i in ips], net.is_private_ip(F.col("x")))
    assert dict(zip(ips, got)) == {i: truth(i) for i in ips}
    assert one(spark, "x string", [(None,)], net.is_private_ip(F.col("x"))) == [False]


def test_http_and_quic(spark):
    reqs = [
        b"GET / HTTP/1.1\r\nhost: a.test \r\n\r\n", b"DELETE /x HTTP/1.1\r\n\r\nHost: late", b"PATCH / HTTP/1.1\r\nHost: b", b"\xff\xfePOST / x",
        b"GETX", b"POST", b"PUT /a\r\n" + b"X: y\r\n" * 23 + b"Host: in24", b"PUT /a\r\n" + b"X: y\r\n" * 24 + b"Host: out",
    ]
    t = net.payload_text(F.col("p"))
    rows = spark.createDataFrame([(bytearray(r),) for r in reqs], "p binary").select(net.http_method(t), net.http_host(t)).collect()
    assert [tuple(r) for r in rows] == [
        ("GET", "a.test"), ("DELETE", "late"), (None, "b"), ("POST", None), (None, None), ("POST", None), ("PUT", "in24"), ("PUT", None),
    ]
    raw = [b"\xc0" * 6, b"\xc0" * 5, b"\x40" * 9, b"\x80" * 9, b""]
    assert one(spark, "p binary", [(bytearray(r),) for r in raw], net.quic_form(F.col("p"))) == ["LONG_HDR", None, None, None, None]


def test_text_forms(spark):
    got = one(spark, "x double", [(None,), (0.0,), (1023.0,), (1024.0,), (5e20,)], text.human_bytes(F.col("x")))
    assert got == ["n/a", "0.00 B", "1023.00 B", "1.00 KB", f"{5e20 / 1024**4:.2f} TB"]
    cells = spark.createDataFrame([(None, None), (2.5, 0.0), (3.5, 1.5), (7.0, None)], "m double, i double")
    assert [r[0] for r in cells.select(text.median_iqr_cell(F.col("m"), F.col("i"))).collect()] == ["--", "2", "4 [2]", "7"]
    assert [r[0] for r in cells.select(text.median_iqr_cell(F.col("m"), F.col("i"), 2)).collect()] == ["--", "2.50", "3.50 [1.50]", "7.00"]
    assert one(spark, "x string", [("a/b: c_1 ",)], text.clean_label(F.col("x"))) == ["ab c_1"]


def test_epoch_micros(spark):
    rows = [(5, 7, None, None, None), (None, None, 1, 2, None), (None, None, 1, 2, 1_000_000_000), (None, None, None, 2, None), (None, None, 1, 2, 0)]
    c = net.epoch_micros(*[F.col(x) for x in "abcde"])
    assert one(spark, "a long, b long, c long, d long, e long", rows, c) == [5_000_007, 2**32 + 2, (2**32 + 2) // 1000, 0, 0]
