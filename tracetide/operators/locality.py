"""The capture's own address and what it sends out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.net import is_private_ip
from .ordered import attach_small, numbered, packet_chunk

CAP = "filename"


def local_ip(packets: DataFrame, given: str | None = None, min_packets: int = 200) -> DataFrame:
    """Address of the recording host: columns local_ip, local_ip_source, known_from_no.

    Without a given address it is the most frequent private source, decided at the
    first packet from a private source that is at least packet ``min_packets`` of its
    capture, over all packets up to that one. A capture without such a packet has nulls.
    """
    captures = packets.select(CAP).distinct()
    if given:
        return captures.select(
            CAP, F.lit(given).alias("local_ip"), F.lit("arg").alias("local_ip_source"),
            F.lit(-1).cast("bigint").alias("known_from_no"),
        )
    slim = packets.select(CAP, "packet_no", "src", "dst")
    place = numbered(slim.select(CAP, "packet_no"), [CAP], ["packet_no"], packet_chunk(F.col("packet_no")), min_packets)
    nth = place.where(F.col("pos") == min_packets).select(CAP, F.col("packet_no").alias("_nth"))
    private = slim.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & is_private_ip(F.col("src")))
    cut = (
        attach_small(private, nth, [CAP]).where(F.col("packet_no") >= F.col("_nth"))
        .groupBy(CAP).agg(F.min("packet_no").alias("known_from_no"))
    )
    seen = (
        attach_small(private, cut, [CAP]).where(F.col("packet_no") <= F.col("known_from_no"))
        .groupBy(CAP, "src", "known_from_no").agg(F.count(F.lit(1)).alias("n"), F.min("packet_no").alias("first_no"))
    )
    best = seen.groupBy(CAP).agg(
        F.max_by("src", F.struct("n", -F.col("first_no"))).alias("local_ip"),
        F.lit("inferred").alias("local_ip_source"),
        F.max("known_from_no").alias("known_from_no"),
    )
    return captures.join(best, CAP, "left")


def outbound_port_counts(packets: DataFrame, local: DataFrame) -> DataFrame:
    """Destination ports of packets the local address sends once it is known."""
    known = local.where(F.col("local_ip").isNotNull()).select(CAP, "local_ip", "known_from_no")
    sent = packets.where(F.col("dport").isNotNull() & F.col("dst").isNotNull()).select(
        CAP, "packet_no", "src", "dport", F.when(F.col("is_tcp"), "tcp").when(F.col("is_udp"), "udp").alias("l4")
    )
    out = attach_small(sent, known, [CAP]).where(
        (F.col("src") == F.col("local_ip")) & (F.col("packet_no") >= F.col("known_from_no"))
    )
    return out.groupBy(CAP, "l4", "dport").agg(F.count(F.lit(1)).alias("n"))


def outbound_ports(packets: DataFrame, local: DataFrame) -> DataFrame:
    """Outbound totals and service-port counts; every capture has a row."""
    counts = outbound_port_counts(packets, local)

    def total(l4: str, port: int | None = None):
        hit = F.col("l4") == l4
        if port is not None:
            hit = hit & (F.col("dport") == port)
        return F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0))

    sums = counts.groupBy(CAP).agg(
        total("tcp").alias("tcp_outbound_total_pkts"),
        total("udp").alias("udp_outbound_total_pkts"),
        total("tcp", 443).alias("tcp_outbound_dport_443_pkts"),
        total("udp", 443).alias("udp_outbound_dport_443_pkts"),
        total("udp", 53).alias("udp_outbound_dport_53_pkts"),
    )
    names = [c for c in sums.columns if c != CAP]
    return local.select(CAP, "local_ip", "local_ip_source").join(sums, CAP, "left").fillna(0, names)
