"""Distribution tables behind the usual plots, and bounded raw samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pin
from .flows import unidir_flows
from .ordered import attach_small, neighbours, numbered, numbered_in_time, packet_chunk, running_counts
from .timing import newflow_gaps, packet_gaps

CAP = "filename"
KEYS = [CAP, "metric"]
# Bins of the histograms.
BINS = {"bytes": 50, "dur_us": 50, "packets": 60, "pkt_gap_us": 80, "newflow_gap_us": 80}


def metric_values(packets: DataFrame) -> DataFrame:
    """Long table (capture, metric, value, n) of flow sizes and gaps. The flow table is made once."""
    flows = pin(unidir_flows(packets).select(CAP, "bytes", "dur_us", "packets", "seen_us"))
    pairs = F.create_map(*[x for m in ("bytes", "dur_us", "packets") for x in (F.lit(m), F.col(m))])
    of_flows = flows.select(CAP, F.explode(pairs).alias("metric", "value"), F.lit(1).cast("bigint").alias("n"))

    def of_gaps(gaps: DataFrame, name: str) -> DataFrame:
        return gaps.select(CAP, F.lit(name).alias("metric"), F.col("gap_us").alias("value"), "n")

    return of_flows.unionByName(of_gaps(packet_gaps(packets), "pkt_gap_us")).unionByName(
        of_gaps(newflow_gaps(packets, flows), "newflow_gap_us")
    )


def cumulative_tables(values: DataFrame) -> DataFrame:
    """Empirical distribution function and its complement at every distinct value.

    A value held by ``n`` rows covers the ranks ``cum_n - n + 1`` to ``cum_n``.
    """
    share = F.col("cum_n") / F.col("total_n")
    return running_counts(values, KEYS, "value", "n").select(
        *KEYS, "value", "n", "cum_n",
        F.round(share, 6).alias("ecdf"), F.round(1 - share, 6).alias("ccdf"),
    )


def histogram(values: DataFrame, bins: dict[str, int] = BINS) -> DataFrame:
    """Equal-width bins between the smallest and the largest value, empty bins included.

    A group with a single value is centred in a range of width one.
    """
    counts = values.groupBy(*KEYS, "value").agg(F.sum("n").alias("n"))
    many = F.create_map(*[x for k, b in bins.items() for x in (F.lit(k), F.lit(b))])[F.col("metric")]
    ends = pin(counts.groupBy(*KEYS).agg(F.min("value").alias("lo"), F.max("value").alias("hi")).withColumn("bins", many))
    placed = attach_small(counts, ends, KEYS, pinned=True)
    spread = F.col("hi") > F.col("lo")
    step = F.expr("(value - lo) * bins div (CASE WHEN hi > lo THEN hi - lo ELSE 1 END)")
    place = F.when(spread, F.least(step, F.col("bins") - 1)).otherwise(F.floor(F.col("bins") / 2))
    hit = placed.select(*KEYS, place.cast("int").alias("bin"), "n")
    empty = ends.select(*KEYS, F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"), F.lit(0).cast("bigint").alias("n"))
    return hit.unionByName(empty).groupBy(*KEYS, "bin").agg(F.sum("n").alias("n"))


def raw_samples(packets: DataFrame, limit: int | None = None, most: int = 1 << 20, unidir: DataFrame | None = None) -> DataFrame:
    """The raw lists of the report as rows with their position; with ``limit`` only the first entries of each.

    Flow lists are in first-seen order, gap lists in time order. A second with more than
    ``most`` rows is cut into smaller pieces.
    """
    flows = unidir_flows(packets) if unidir is None else unidir
    pairs = F.create_map(*[x for m in ("bytes", "dur_us", "packets") for x in (F.lit(m), F.col(m))])
    by_flow = numbered(flows, [CAP], ["first_no"], packet_chunk(F.col("first_no")), limit).select(
        CAP, F.explode(pairs).alias("metric", "value"), "pos"
    )

    def by_time(rows: DataFrame, name: str, order: str, time: str) -> DataFrame:
        # the first gap needs a second row, so one row more is kept
        head = numbered_in_time(rows.select(CAP, order, time), [CAP], time, order, None if limit is None else limit + 1, most)
        gaps = neighbours(head.withColumn("_pair", F.struct("pos", time)), [CAP], "pos", "_pair", packet_chunk(F.col("pos")))
        return gaps.select(
            CAP, F.lit(name).alias("metric"),
            (F.col("cur")[time] - F.col("prev")[time]).alias("value"), (F.col("cur.pos") - 1).alias("pos"),
        )

    return (
        by_flow.unionByName(by_time(packets.where(F.col("ts_us") > 0), "pkt_gap_us", "packet_no", "ts_us"))
        .unionByName(by_time(flows, "newflow_gap_us", "first_no", "seen_us"))
    )
