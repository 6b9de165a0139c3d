"""Read the given tables as the packet model.

``events`` plays the part of packets: 45 captures, 3 profiles x 3 durations x 5
runs, with packet numbers in time order inside each capture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settled

START_US = 1_704_067_200_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event_micros(df: DataFrame) -> Column:
    """Microseconds since the epoch whatever the session time zone is."""
    if isinstance(df.schema["ts"].dataType, T.TimestampType):
        return F.unix_micros("ts")
    gap = "(ts - TIMESTAMP_NTZ'2024-01-01 00:00:00')"
    return F.expr(
        f"{START_US} + (extract(DAY FROM {gap}) * 86400L + extract(HOUR FROM {gap}) * 3600L"
        f" + extract(MINUTE FROM {gap}) * 60L) * 1000000L"
        f" + CAST(extract(SECOND FROM {gap}) * 1000000 AS BIGINT)"
    )


def packets_from_events(events: DataFrame) -> DataFrame:
    """One packet per event; works on a batch and on a streaming table."""
    # addresses are made of k: a filter on them would repeat the pattern
    ev = settled(events, k=F.regexp_extract("props", "[0-9]+", 0).cast("bigint")).select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        "k",
        (F.col("event_id") % 45).alias("cell"),
        (_event_micros(events) - START_US).alias("off_us"),
    )
    cell, eid, k, user = F.col("cell"), F.col("event_id"), F.col("k"), F.col("user_id")
    kind = F.col("event_type")
    pi = F.floor(cell / 15)
    di = F.floor(cell / 5) % 3
    ev = ev.select(
        "*",
        F.when(kind.isin("click", "purchase"), 6).when(kind.isin("view", "signup"), 17).otherwise(1).alias("proto_num"),
        F.when(kind.isin("click", "view"), 443).when(kind == "purchase", 80).when(kind == "signup", 53).alias("svc"),
        F.concat(F.lit("10.0.0."), (user % 2 + 2).cast("string")).alias("host"),
        F.concat(
            F.when(k % 2 == 0, "93.184.216.").otherwise("192.168.1."), (k % 3 + 1).cast("string")
        ).alias("peer"),
        (user % 2 + 40000).alias("eph"),
        (eid % 2 == 0).alias("out"),
    )
    num, out = F.col("proto_num"), F.col("out")
    request = F.concat(
        F.element_at(F.array(F.lit("GET "), F.lit("POST "), F.lit("DELETE ")), (k % 3 + 1).cast("int")),
        F.lit("/"), k.cast("string"), F.lit(" HTTP/1.1\r\nHost: h"), (user % 5).cast("string"),
        F.lit(".test\r\n\r\n"),
    )
    return ev.select(
        F.concat(
            F.lit("capturaAgente"),
            F.when(pi == 0, "Admin").when(pi == 1, "Gamer").otherwise("Web"),
            F.when(di == 0, "5m").when(di == 1, "15m").otherwise("1h"),
            (cell % 5 + 1).cast("string"),
            F.lit(".pcapng"),
        ).alias("filename"),
        eid.alias("packet_no"),
        (
            F.lit(START_US)
            + F.floor(F.col("off_us") / F.when(di == 0, 8640).when(di == 1, 2880).otherwise(720))
        ).cast("bigint").alias("ts_us"),
        (F.floor("value") + 60).cast("bigint").alias("frame_len"),
        num.cast("int").alias("proto_num"),
        F.lit("IPv4").alias("ip_version"),
        F.lit(0x0800).alias("eth_type"),
        (num == 6).alias("is_tcp"),
        # an ICMP error quotes a UDP header: both classes hold
        ((num == 17) | ((num == 1) & (k % 5 == 0))).alias("is_udp"),
        (num == 1).alias("is_icmp"),
        F.when(out, F.col("host")).otherwise(F.col("peer")).alias("src"),
        F.when(out, F.col("peer")).otherwise(F.col("host")).alias("dst"),
        F.when(num != 1, F.when(out, F.col("eph")).otherwise(F.col("svc"))).cast("int").alias("sport"),
        F.when(num != 1, F.when(out, F.col("svc")).otherwise(F.col("eph"))).cast("int").alias("dport"),
        F.when(num == 6, (k % 4) * 10).cast("bigint").alias("tcp_seq"),
        F.when(num == 6, (k % 3) * 10).cast("bigint").alias("payload_len"),
        F.when(num == 6, user % 4).cast("int").alias("tcp_flags"),
        F.when(num == 1, F.when(out, 8).otherwise(0)).alias("icmp_type"),
        F.when(
            (kind == "signup") & out,
            F.concat(F.lit("h"), (user % 7).cast("string"), F.lit(".site"), (k % 5).cast("string"), F.lit(".test")),
        ).alias("dns_qname"),
        F.when((kind == "purchase") & out, F.encode(request, "UTF-8"))
        .when((kind == "view") & (k % 2 == 0), F.lit(bytes.fromhex("c00000000108")))
        .when(kind == "view", F.lit(bytes.fromhex("400000000108")))
        .alias("payload"),
        k.alias("k"),
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_from_events(table(spark, sf_dir, "events"))


def packets_with_lost_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same packets where some timestamps could not be read and are zero."""
    return packets(spark, sf_dir).withColumn("ts_us", F.when(F.col("k") % 13 == 0, 0).otherwise(F.col("ts_us")))


def packets_with_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same packets with clocks that step back now and then."""
    return packets(spark, sf_dir).withColumn("ts_us", F.col("ts_us") + (F.col("k") % 5) * 1_500_000)
