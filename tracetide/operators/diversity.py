"""Counters, top lists, entropy and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net
from .ordered import every_capture, top_n

CAP = "filename"


def _entropy() -> Column:
    n = F.col("n")
    bits = F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)
    return F.round(F.greatest(bits, F.lit(0.0)), 6)


def value_diversity(rows: DataFrame, keys: list[str], value: Column, prefix: str) -> DataFrame:
    """Distinct values and the Shannon entropy of their counts."""
    counts = rows.select(*keys, value.alias("_value")).where(F.col("_value").isNotNull()).groupBy(*keys, "_value").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(f"unique_{prefix}"), _entropy().alias(f"entropy_{prefix}")
    )


def dst_diversity(packets: DataFrame) -> DataFrame:
    """Destinations of every capture; one without addresses has 0 and 0."""
    both = packets.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    found = value_diversity(both, [CAP], F.col("dst"), "dst_ips")
    return every_capture(packets, found, ["unique_dst_ips", "entropy_dst_ips"])


def domain_diversity(packets: DataFrame) -> DataFrame:
    """The same over base domains; a capture without queries has 0 and 0."""
    some = value_diversity(packets, [CAP], net.dns_base_domain(F.col("dns_qname")), "dns_domains")
    return packets.select(CAP).distinct().join(some, CAP, "left").fillna(0).select(
        CAP, "unique_dns_domains", "entropy_dns_domains"
    )


# columns whose combinations are counted before the dimensions are taken apart
_RAW = ["eth_type", "ip_version", "proto_num", "is_tcp", "is_udp", "src", "dst", "sport", "dport", "tcp_flags", "icmp_type", "dns_qname"]


def packet_kinds(packets: DataFrame) -> DataFrame:
    """Distinct packet descriptions of a capture with their count and first packet number.

    Payloads are read here and dropped: what follows works on descriptions, far
    fewer than packets.
    """
    app = net.app_protocol(F.col("is_udp"), F.col("sport"), F.col("dport"), F.col("payload"))
    known = packets.select(
        CAP, "packet_no", *_RAW, "payload",
        F.when(F.col("src").isNotNull() & F.col("dst").isNotNull(), app).alias("app"),
    )
    read = known.withColumn(
        "text", F.when(F.col("app").startswith("HTTP") & F.col("payload").isNotNull(), net.payload_text(F.col("payload")))
    )
    derived = read.select(
        CAP, "packet_no", *_RAW, "app",
        net.http_method(F.col("text")).alias("http_method"), net.http_host(F.col("text")).alias("http_host"),
        F.when(F.col("app").startswith("QUIC"), net.quic_form(F.col("payload"))).alias("quic_form"),
    )
    return derived.groupBy(CAP, *_RAW, "app", "http_method", "http_host", "quic_form").agg(
        F.count(F.lit(1)).alias("n"), F.min("packet_no").alias("first_no")
    )


def counter_rows(kinds: DataFrame) -> DataFrame:
    """Long form of all counted dimensions: capture, dim, value, n, first_no."""
    ip = F.col("src").isNotNull() & F.col("dst").isNotNull()
    tcp = ip & F.col("is_tcp") & F.col("sport").isNotNull()
    udp = ip & ~F.col("is_tcp") & F.col("is_udp") & F.col("sport").isNotNull()

    def some(text: Column) -> Column:
        return F.nullif(text, F.lit(""))

    dims = {
        "eth_type": F.col("eth_type"),
        "ip_version": F.col("ip_version"),
        "ip_protocol": net.proto_name(F.col("ip_version"), F.col("proto_num")),
        "app_protocol": F.col("app"),
        "http_method": some(F.col("http_method")),
        "http_host": some(F.col("http_host")),
        "quic_form": F.col("quic_form"),
        "src_ip": F.when(ip, F.col("src")),
        "dst_ip": F.when(ip, F.col("dst")),
        "ip_pair": F.when(ip, F.concat("src", F.lit("->"), "dst")),
        "tcp_src_port": F.when(tcp, F.col("sport")),
        "tcp_dst_port": F.when(tcp, F.col("dport")),
        "udp_src_port": F.when(udp, F.col("sport")),
        "udp_dst_port": F.when(udp, F.col("dport")),
        "tcp_flags": F.when(tcp, net.tcp_flag_label(F.col("tcp_flags"))),
        "dns_query": F.when(ip, some(net.dns_name(F.col("dns_qname")))),
        "icmp_type": F.when(ip & F.col("icmp_type").isNotNull(), F.when(F.col("ip_version") == "IPv6", "ICMPv6").otherwise(F.col("icmp_type").cast("string"))),
    }
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), c.cast("string").alias("value")) for d, c in dims.items()])
    long = kinds.select(CAP, "n", "first_no", F.explode(pairs).alias("_p"))
    return long.select(CAP, "_p.dim", "_p.value", "n", "first_no").where(F.col("value").isNotNull())


def top_values(packets: DataFrame, n: int = 15) -> DataFrame:
    """Most frequent values of every dimension; ties go to the value seen first."""
    counts = counter_rows(packet_kinds(packets)).groupBy(CAP, "dim", "value").agg(
        F.sum("n").alias("n"), F.min("first_no").alias("first_no")
    )
    return top_n(counts, [CAP, "dim"], [F.desc("n"), F.asc("first_no")], n).select(CAP, "dim", "rank", "value", "n")


def duplicates(rows: DataFrame, keys: list[str], content: Column) -> DataFrame:
    """Rows whose content was seen before, by content hash. No cap on the hashes held."""
    hashed = rows.select(*keys, F.unhex(F.sha2(content, 256)).alias("_hash")).where(F.col("_hash").isNotNull())
    return hashed.groupBy(*keys, "_hash").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(
        F.sum("n").alias("total"), F.sum(F.col("n") - 1).alias("duplicates")
    )


# what tells packets apart when the export has no hash of their bytes
_CONTENT = (
    "cap_len", "frame_len", "eth_type", "src", "dst", "proto_num", "sport", "dport", "udp_sport", "udp_dport",
    "tcp_seq", "tcp_flags", "payload_len", "icmp_type", "dns_qname", "payload",
)


def content_fingerprint(packets: DataFrame) -> Column:
    """128 bits that stand for a packet's bytes: the export's hash, else a hash of all decoded fields that there are."""
    if "content_hash" in packets.columns:
        return F.unhex(F.md5(F.col("content_hash").cast("binary")))
    told = [F.coalesce(F.hex(c) if c == "payload" else F.col(c).cast("string"), F.lit("-")) for c in _CONTENT if c in packets.columns]
    return F.unhex(F.md5(F.concat_ws("|", *told).cast("binary")))


def duplicate_packets(packets: DataFrame) -> DataFrame:
    """Packets of a capture whose content was seen before, over all its files.

    Counts are formed before the shuffle, so a packet that repeats all the time moves once
    for each task. Packets without a hash are not duplicates; every capture has a row.
    """
    counts = packets.select(CAP, content_fingerprint(packets).alias("_hash")).groupBy(CAP, "_hash").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(CAP).agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("_hash").isNotNull(), F.col("n") - 1)), F.lit(0)).alias("duplicates")
    )
