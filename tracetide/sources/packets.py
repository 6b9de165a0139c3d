"""Readers for packet field exports and capture files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ..functions.numbers import lenient_float, strict_int
from ..operators.ordered import attach_small

# Fields of an export row, in order.
EXPORT_FIELDS = (
    "ts_epoch", "ip_src", "ip_dst", "ipv6_src", "ipv6_dst", "tcp_srcport", "tcp_dstport",
    "udp_srcport", "udp_dstport", "ip_proto", "ipv6_nxt", "frame_len",
)
# The names of these fields in a header, and further fields.
HEADER_FIELDS = (
    "frame.time_epoch", "ip.src", "ip.dst", "ipv6.src", "ipv6.dst", "tcp.srcport", "tcp.dstport",
    "udp.srcport", "udp.dstport", "ip.proto", "ipv6.nxt", "frame.len",
)
MORE_FIELDS = {
    "frame.cap_len": "cap_len_text", "eth.type": "eth_type_text", "tcp.seq": "tcp_seq_text", "tcp.len": "tcp_len_text",
    "tcp.flags": "tcp_flags_text", "icmp.type": "icmp_type_text", "dns.qry.name": "dns_name_text", "tcp.payload": "payload_hex",
    "frame.md5_hash": "content_hash_text",
}
EXPORT_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in EXPORT_FIELDS])


def _filled(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def endpoints() -> dict[str, Column]:
    """IPv4 wins over IPv6 for addresses and for the protocol number."""
    return {
        "src": F.coalesce(_filled("ip_src"), _filled("ipv6_src")),
        "dst": F.coalesce(_filled("ip_dst"), _filled("ipv6_dst")),
        "proto_num": F.coalesce(strict_int(F.col("ip_proto")), strict_int(F.col("ipv6_nxt"))).cast("int"),
    }


def decode_export(raw: DataFrame, *more: Column) -> DataFrame:
    """Packets from text fields; ``more`` are further columns to keep.

    Rows without a numeric time or an integer length are skipped, which also covers
    rows with too few fields. A packet may be in several protocol classes: an ICMP
    error that quotes a UDP header has ``1,17`` as protocol and no protocol number,
    so it is counted but belongs to no flow. Both port pairs are kept; ``sport`` and
    ``dport`` are those of TCP where there is a TCP layer.
    """
    ends = endpoints()
    layers = F.split(F.coalesce(_filled("ip_proto"), _filled("ipv6_nxt"), F.lit("")), r"\s*,\s*")
    tcp = F.array_contains(layers, "6") | _filled("tcp_dstport").isNotNull()
    udp = F.array_contains(layers, "17") | _filled("udp_dstport").isNotNull()
    exact = F.floor(F.trim("ts_epoch").try_cast("decimal(28,9)") * 1_000_000).cast("bigint")
    rough = F.floor(lenient_float(F.col("ts_epoch")) * 1e6).try_cast("bigint")
    ts_us = F.coalesce(exact, rough)

    def port(side: str) -> Column:
        return F.when(tcp, strict_int(F.col(f"tcp_{side}port"))).otherwise(strict_int(F.col(f"udp_{side}port"))).cast("int")

    decoded = raw.select(
        "filename", "packet_no",
        ts_us.alias("ts_us"),
        strict_int(F.col("frame_len")).alias("frame_len"),
        ends["proto_num"].alias("proto_num"),
        F.when(_filled("ip_src").isNotNull(), "IPv4").when(_filled("ipv6_src").isNotNull(), "IPv6").alias("ip_version"),
        tcp.alias("is_tcp"), udp.alias("is_udp"), F.array_contains(layers, "1").alias("is_icmp"),
        ends["src"].alias("src"), ends["dst"].alias("dst"),
        port("src").alias("sport"), port("dst").alias("dport"),
        *(strict_int(F.col(f"{p}_{s}port")).cast("int").alias(f"{p}_{s[0]}port") for p in ("tcp", "udp") for s in ("src", "dst")),
        *more,
    )
    return decoded.where(F.col("ts_us").isNotNull() & F.col("frame_len").isNotNull())


def scan_packets(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Read quoted, headerless exports.

    The capture is the ``filename=`` folder of a partitioned layout, else the file
    name without its export suffix.
    """
    raw = spark.read.schema(EXPORT_SCHEMA).option("quote", '"').option("mode", "PERMISSIVE").csv(paths)
    return decode_export(numbered_lines(raw))


def _code(name: str) -> Column:
    """A number written in decimal or, behind 0x, in hexadecimal digits."""
    text = F.lower(_filled(name))
    return F.when(text.rlike("^0x[0-9a-f]{1,15}$"), F.conv(F.substring(text, 3, 15), 16, 10).cast("bigint")).otherwise(strict_int(text))


def scan_packet_fields(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Read exports whose header names their fields, in any order and number.

    Beside the columns of ``scan_packets`` there are the captured length, a hash of the
    content, and the decoded fields that counters, TCP quality and DNS diversity need.
    A field that the export lacks is null; the captured length is then the wire length.
    """
    raw = spark.read.option("header", True).option("quote", '"').option("mode", "PERMISSIVE").csv(paths)
    known = {**dict(zip(HEADER_FIELDS, EXPORT_FIELDS, strict=True)), **MORE_FIELDS}
    lines = numbered_lines(raw)
    told = {new: F.col(f"`{old}`") if old in raw.columns else F.lit(None).cast("string") for old, new in known.items()}
    lines = lines.select("filename", "packet_no", *(c.alias(n) for n, c in told.items()))
    digits = F.replace(_filled("payload_hex"), F.lit(":"), F.lit(""))
    return decode_export(
        lines,
        F.coalesce(strict_int(F.col("cap_len_text")), strict_int(F.col("frame_len"))).alias("cap_len"),
        _code("eth_type_text").cast("int").alias("eth_type"),
        strict_int(F.col("tcp_seq_text")).alias("tcp_seq"),
        strict_int(F.col("tcp_len_text")).alias("payload_len"),
        _code("tcp_flags_text").cast("int").alias("tcp_flags"),
        strict_int(F.col("icmp_type_text")).cast("int").alias("icmp_type"),
        _filled("dns_name_text").alias("dns_qname"),
        F.when(digits.rlike("^([0-9a-fA-F]{2})+$"), F.unhex(digits)).alias("payload"),
        F.lower(_filled("content_hash_text")).alias("content_hash"),
    )


def numbered_lines(raw: DataFrame) -> DataFrame:
    """Rows of export files with ``filename`` and ``packet_no``.

    A capture in several files is read in the order of their paths, a file in the
    order of its splits, a split line by line; ``packet_no`` counts from 0 without
    gaps. The lines of each split are counted first, in a table of one row a split.
    """
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.(csv|txt|tsv)(\.(gz|bz2|zst))?$", "")
    if "filename" not in raw.columns:
        raw = raw.withColumn("filename", name)
    placed = raw.withColumns(
        {
            "_path": F.col("_metadata.file_path"),
            "_block": F.col("_metadata.file_block_start"),
            "_row": F.monotonically_increasing_id(),
        }
    )
    splits = placed.groupBy("filename", "_path", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    ahead = W.partitionBy("filename").orderBy("_path", "_block").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    numbers = F.col("_before") + F.col("_row") - F.col("_first")
    # a row for each split of a file: counted before it is sent around
    joined = attach_small(placed, splits, ["filename", "_path", "_block"])
    return joined.withColumn("packet_no", numbers).drop("_path", "_block", "_row", "_first", "_before")


def scan_captures(spark: SparkSession, folder: str, pattern: str = "capturaAgente*.pcapng", recursive: bool = False) -> DataFrame:
    """Captures below a folder, sorted by name; no file is an error. Contents are not read.

    As in ``scan_packets`` the capture is the ``filename=`` folder when there is one.
    """
    parts = F.split("path", "/")
    folder_name = F.try_element_at(F.filter(parts, lambda p: p.startswith("filename=")), F.lit(1))
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(folder)
        .select(F.coalesce(F.substring(folder_name, 10, 1 << 30), F.element_at(parts, -1)).alias("filename"), "path")
    )
    if files.isEmpty():
        raise FileNotFoundError(f"no files matched {pattern} in {folder}")
    return files.groupBy("filename").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("files")).orderBy("filename")
