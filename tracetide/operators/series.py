"""Dense time series of a capture and what is computed from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .captures import ts_trust
from .flows import unidir_flows
from .ordered import attach_small, every_capture, exact_percentiles

CAP = "filename"
WINDOWS = (300, 900, 3600)  # fixed values: 5, 15 and 60 minutes in seconds
_BLOCK = 3600


def _dense_range(rows: DataFrame, lo: str, hi: str, out: str) -> DataFrame:
    """One row per integer from ``lo`` to ``hi``, in blocks so that no array grows with the span."""
    block = F.explode(F.sequence(F.floor(F.col(lo) / _BLOCK), F.floor(F.col(hi) / _BLOCK)))
    start = F.col("_block") * _BLOCK
    inside = F.sequence(F.greatest(F.col(lo), start), F.least(F.col(hi), start + (_BLOCK - 1)))
    return rows.withColumn("_block", block).withColumn(out, F.explode(inside)).drop("_block")


def bucket_series(packets: DataFrame, bucket_s: int = 1) -> DataFrame:
    """Bytes per epoch-aligned bucket, zero-filled from the first to the last usable time.

    Only captures whose timestamps can be trusted have a series.
    """
    width = bucket_s * 1_000_000
    data = packets.where(F.col("ts_us") > 0).groupBy(CAP, F.floor(F.col("ts_us") / width).alias("bucket")).agg(
        F.sum("frame_len").alias("bytes")
    )
    trusted = ts_trust(packets).where(F.col("series_ok") & (F.col("duration_s") > 0)).select(
        CAP, F.floor(F.col("min_us") / width).alias("lo"), F.floor(F.col("max_us") / width).alias("hi")
    )
    zeros = _dense_range(trusted, "lo", "hi", "bucket").select(CAP, "bucket", F.lit(0).cast("bigint").alias("bytes"), "lo")
    filled = (
        data.withColumn("lo", F.lit(None).cast("bigint"))
        .unionByName(zeros)
        .groupBy(CAP, "bucket")
        .agg(F.sum("bytes").alias("bytes"), F.max("lo").alias("lo"))
        .where(F.col("lo").isNotNull())
    )
    return filled.select(
        CAP,
        (F.col("bucket") - F.col("lo")).alias("idx"),
        ((F.col("bucket") - F.col("lo")) * bucket_s).alias("t_s"),
        "bytes",
        (F.col("bytes") * 8 / (bucket_s * 1e6)).alias("mbps"),
        (F.col("bytes") * 8.0 / bucket_s).alias("bps"),
    )


def bucket_summary(series: DataFrame, bucket_s: int = 1, packets: DataFrame | None = None) -> DataFrame:
    """Peak, p95 and p99 of the bucket rates in Mbps.

    With ``packets`` every capture has a row; without usable times it has 0 buckets and nulls.
    """
    rate = 8 / (bucket_s * 1e6)
    pct = exact_percentiles(series, [CAP], "bytes", {"p95": 0.95, "p99": 0.99})
    found = pct.select(
        CAP, F.col("n").alias("buckets"),
        F.round(F.col("max") * rate, 6).alias("peak_mbps"),
        F.round(F.col("p95") * rate, 6).alias("p95_mbps"),
        F.round(F.col("p99") * rate, 6).alias("p99_mbps"),
    )
    return found if packets is None else every_capture(packets, found, ["buckets"])


def window_throughput(series: DataFrame, bucket_s: int = 1, windows=WINDOWS) -> DataFrame:
    """Mean rate per run of buckets; the last, short run is also divided by the full window."""
    sizes = F.array(*[F.struct(F.lit(w).alias("window_s"), F.lit(max(1, round(w / bucket_s))).alias("per")) for w in windows])
    chunked = series.withColumn("_w", F.explode(sizes)).groupBy(
        CAP, F.col("_w.window_s").alias("window_s"), F.floor(F.col("idx") / F.col("_w.per")).alias("k")
    )
    return chunked.agg(F.sum("bytes").alias("bytes")).withColumn("mean_bps", F.col("bytes") * 8.0 / F.col("window_s"))


def window_throughput_summary(windows: DataFrame) -> DataFrame:
    """Mean, p95, p99 and largest window rate in Mbps."""
    keys = [CAP, "window_s"]
    rate = F.lit(8.0) / F.col("window_s") / 1e6
    pct = exact_percentiles(windows, keys, "bytes", {"p95": 0.95, "p99": 0.99})
    return pct.withColumn("mean", F.col("sum") / F.col("n")).select(
        *keys, F.col("n").alias("windows"),
        *[F.round(F.col(c) * rate, 6).alias(f"{c}_mbps") for c in ("mean", "p95", "p99", "max")],
    )


def window_new_flows(packets: DataFrame, windows=WINDOWS, unidir: DataFrame | None = None) -> DataFrame:
    """New one-way flows per minute in windows from the first usable time, up to the last used one."""
    start = packets.groupBy(CAP).agg(
        F.coalesce(F.min(F.when(F.col("ts_us") > 0, F.col("ts_us"))), F.min_by("ts_us", "packet_no")).alias("t0")
    ).where(F.col("t0") > 0)
    born = (unidir_flows(packets) if unidir is None else unidir).where(F.col("seen_us") > 0).select(CAP, "seen_us")
    placed = attach_small(born, start, [CAP]).withColumn("window_s", F.explode(F.array(*map(F.lit, windows))))
    k = F.floor((F.col("seen_us") - F.col("t0")) / (F.col("window_s") * F.lit(1e6)))
    used = placed.groupBy(CAP, "window_s", k.alias("k")).agg(F.count(F.lit(1)).alias("new_flows")).where(F.col("k") >= 0)
    last = used.groupBy(CAP, "window_s").agg(F.max("k").alias("hi")).withColumn("lo", F.lit(0).cast("bigint"))
    zeros = _dense_range(last, "lo", "hi", "k").select(CAP, "window_s", "k", F.lit(0).cast("bigint").alias("new_flows"))
    return used.unionByName(zeros).groupBy(CAP, "window_s", "k").agg(F.sum("new_flows").alias("new_flows")).withColumn(
        "flows_per_min", F.round(F.col("new_flows") / (F.col("window_s") / 60.0), 6)
    )


def autocorr_lag1(series: DataFrame, packets: DataFrame | None = None) -> DataFrame:
    """Lag-1 autocorrelation of the bucket bytes; 0 below three buckets or without variance.

    With ``packets`` every capture has a row.

    Each bucket is sent to its own index and to the next one, so the product of
    neighbours needs a grouping and no sorted window. The sums are exact decimals.
    """
    wide = "decimal(38,0)"
    x = F.col("bytes").cast("decimal(19,0)")
    zero = F.lit(0).cast("decimal(19,0)")
    twice = series.select(
        CAP, F.explode(F.array(
            F.struct(F.col("idx").alias("i"), x.alias("cur"), zero.alias("prev"), F.lit(1).alias("own")),
            F.struct((F.col("idx") + 1).alias("i"), zero.alias("cur"), x.alias("prev"), F.lit(0).alias("own")),
        )).alias("s"),
    ).select(CAP, "s.*")
    met = twice.groupBy(CAP, "i").agg(
        F.sum("cur").cast("decimal(19,0)").alias("cur"), F.sum("prev").cast("decimal(19,0)").alias("prev"),
        F.max("own").alias("own"),
    )
    sums = met.groupBy(CAP).agg(
        F.sum("own").cast(wide).alias("n"),
        F.sum("cur").cast(wide).alias("s"),
        F.sum((F.col("cur") * F.col("cur")).cast(wide)).cast(wide).alias("q"),
        F.sum((F.col("cur") * F.col("prev")).cast(wide)).cast(wide).alias("p"),
        F.max(F.when(F.col("i") == 0, F.col("cur"))).cast(wide).alias("first"),
        F.max(F.struct("i", "prev"))["prev"].cast(wide).alias("last"),
    )
    # numerator and denominator times n * n: all differences are taken between whole numbers;
    # beyond 38 digits the products are doubles
    n, s, q, p = (F.col(c) for c in ("n", "s", "q", "p"))
    ends = F.col("first") + F.col("last")
    real = {c: F.col(c).cast("double") for c in ("n", "s", "q", "p", "first", "last")}
    mul, less = F.try_multiply, F.try_subtract
    square = mul(s, s)
    exact_num = less(mul(n, less(mul(n, p), square)), mul(s, less(s, mul(n, ends))))
    exact_den = mul(n, less(mul(n, q), square))
    rough_den = real["n"] * (real["n"] * real["q"] - real["s"] * real["s"])
    rough_num = real["n"] * (real["n"] * real["p"] - real["s"] * real["s"]) - real["s"] * (
        real["s"] - real["n"] * (real["first"] + real["last"])
    )
    both = exact_num.isNotNull() & exact_den.isNotNull()
    num = F.when(both, exact_num.cast("double")).otherwise(rough_num)
    den = F.when(both, exact_den.cast("double")).otherwise(rough_den)
    usable = (n >= 3) & (den > 0)
    found = sums.select(CAP, F.when(usable, F.round(num / den, 6)).otherwise(0.0).alias("autocorr_lag1"))
    return found if packets is None else every_capture(packets, found, ["autocorr_lag1"])
