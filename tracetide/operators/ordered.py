"""Order, rank and percentile work that never gathers one group in one task.

A capture may hold a third of all packets, so nothing here sorts a whole
capture. Rows are cut into chunks by a monotone function of the order key, the
work is done inside ``(group, chunk)``, and a table of one row per chunk carries
counts or border values from one chunk to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import pin

PACKET_CHUNK_BITS = 18  # at most 262,144 packets of a capture per chunk
_OCTAVE_BITS = 14
_OFFSET = 1 << 26


def packet_chunk(packet_no: Column, bits: int = PACKET_CHUNK_BITS) -> Column:
    return F.shiftright(packet_no, bits)


def second_chunk(ts_us: Column) -> Column:
    """At most a million distinct timestamps share a chunk."""
    return F.floor(ts_us / 1_000_000)


def value_chunk(v: Column) -> Column:
    """A monotone bucket of a number: 16,384 steps per power of two.

    Integers below 2**34 fall at most 2**20 to a bucket, and there are at most
    about a million buckets, so both levels of the rank search stay bounded.
    """
    x = F.abs(v.cast("double"))
    octave = F.floor(F.log2(x))
    step = F.floor(x / F.pow(F.lit(2.0), octave) * (1 << _OCTAVE_BITS))
    place = octave * (1 << (_OCTAVE_BITS + 1)) + step + _OFFSET
    signed = F.when(v > 0, place).when(v < 0, -place).otherwise(F.lit(0)).cast("bigint")
    # never null, so that no null filter makes two copies of a shuffle differ
    return F.coalesce(signed, F.lit(0).cast("bigint"))


def value_counts(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """One row per distinct value of a group with its count ``n``."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("n"))


def _chunk_totals(counts: DataFrame, keys: list[str], value: str | None = None) -> DataFrame:
    """Rows before each chunk and rows in the whole group, one row per chunk.

    With ``value`` also the sum and the largest value of the group.
    """
    if not keys:
        return _whole_totals(counts, value)
    group = W.partitionBy(*keys)
    ahead = group.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    aggs, whole = [F.sum("n").alias("_in_chunk")], {"_total": F.sum("_in_chunk").over(group)}
    if value is not None:
        aggs += [F.sum(F.col(value) * F.col("n")).alias("_part"), F.max(value).alias("_top")]
        whole |= {"_sum": F.sum("_part").over(group), "_max": F.max("_top").over(group)}
    out = counts.groupBy(*keys, "_chunk").agg(*aggs)
    out = out.withColumns({"_before": F.coalesce(F.sum("_in_chunk").over(ahead), F.lit(0)), **whole})
    return out.drop("_part", "_top")


def _whole_totals(counts: DataFrame, value: str | None) -> DataFrame:
    """The same for a table without groups: octaves first, then the chunks inside each octave.

    There are some thousand octaves at most, whatever the number of rows. Their sums make one
    array; chunks are only ordered within their octave.
    """
    worth = F.col(value) if value is not None else F.lit(0)
    per = counts.groupBy("_chunk").agg(F.sum("n").alias("_in_chunk"), F.sum(worth * F.col("n")).alias("_part"), F.max(worth).alias("_top"))
    per = per.withColumn("_octave", F.shiftright("_chunk", _OCTAVE_BITS + 1))
    octaves = per.groupBy("_octave").agg(F.sum("_in_chunk").alias("c"), F.sum("_part").alias("s"), F.max("_top").alias("t"))
    listed = octaves.agg(
        F.array_sort(F.collect_list(F.struct(F.col("_octave").alias("o"), "c"))).alias("l"),
        F.sum("c").alias("_total"), F.sum("s").alias("_sum"), F.max("t").alias("_max"),
    )
    zero = F.lit(0).cast("bigint")
    sums = F.transform("l", lambda x, i: F.struct(
        x["o"].alias("_octave"), F.aggregate(F.slice("l", F.lit(1), i), zero, lambda a, y: a + y["c"]).alias("_octave_before")))
    whole = ["_total", *(["_sum", "_max"] if value is not None else [])]
    placed = listed.select(F.inline(sums), *whole)
    ahead = W.partitionBy("_octave").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    inside = per.withColumn("_inner", F.coalesce(F.sum("_in_chunk").over(ahead), zero))
    return inside.join(placed, "_octave").select("_chunk", "_in_chunk", (F.col("_octave_before") + F.col("_inner")).alias("_before"), *whole)


def running_counts(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Distinct values with ``n``, the cumulated count ``cum_n`` and the group's ``total_n``."""
    counts = value_counts(df, keys, value, weight).withColumn("_chunk", value_chunk(F.col(value)))
    inside = W.partitionBy(*keys, "_chunk").orderBy(value)
    return (
        counts.join(_chunk_totals(counts, keys), [*keys, "_chunk"])
        .withColumn("cum_n", F.col("_before") + F.sum("n").over(inside))
        .select(*keys, value, "n", "cum_n", F.col("_total").alias("total_n"))
    )


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], weight: str | None = None
) -> DataFrame:
    """Exact linear-interpolation percentiles per group.

    Values are counted first (combined before the shuffle). Chunk totals tell in
    which chunk each wanted rank lies, and only those chunks are ranked. The row
    count ``n``, the ``sum`` and the ``max`` of the group come along.
    """
    counts = value_counts(df, keys, value, weight).withColumn("_chunk", value_chunk(F.col(value)))
    totals = _chunk_totals(counts, keys, value)
    ranks = []
    for p in probs.values():
        at = (F.col("_total") - 1) * F.lit(float(p))
        ranks += [F.floor(at), F.ceil(at)]
    wanted = F.exists(
        F.array(*ranks),
        lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_in_chunk")),
    )
    inside = W.partitionBy(*keys, "_chunk").orderBy(value)
    ranked = (
        counts.join(totals.where(wanted).drop("_in_chunk"), [*keys, "_chunk"])
        .withColumn("_end", F.col("_before") + F.sum("n").over(inside))
        .withColumn("_start", F.col("_end") - F.col("n"))
    )
    aggs = [F.max("_total").alias("n"), F.max("_sum").alias("sum"), F.max("_max").alias("max")]
    for name, p in probs.items():
        at = (F.col("_total") - 1) * F.lit(float(p))
        for tag, r in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (r >= F.col("_start")) & (r < F.col("_end"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{tag}_{name}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"_w_{name}"))
    out = ranked.groupBy(*keys).agg(*aggs)
    return out.select(
        *keys,
        "n",
        "sum",
        "max",
        *[
            (F.col(f"_lo_{k}") + (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")) * F.col(f"_w_{k}"))
            .cast("double")
            .alias(k)
            for k in probs
        ],
    )


def neighbours(df: DataFrame, keys: list[str], order: str, value: str, chunk: Column) -> DataFrame:
    """Each value with its predecessor in the group: columns ``cur`` and ``prev``.

    One shuffle on (group, chunk).
    """
    cut = df.select(*keys, F.col(order).alias("_order"), F.col(value).alias("cur"), chunk.alias("_chunk"))
    return stitched(cut.repartition(*keys, "_chunk"), keys)


def stitched(cut: DataFrame, keys: list[str]) -> DataFrame:
    """Neighbour pairs of rows already placed by (group, chunk): columns _order, cur, _chunk.

    Pairs that straddle a chunk border come from the first and last value of the chunks.
    """
    inside = (
        cut.withColumn("prev", F.lag("cur").over(W.partitionBy(*keys, "_chunk").orderBy("_order")))
        .where(F.col("prev").isNotNull())
        .select(*keys, "cur", "prev")
    )
    edges = cut.groupBy(*keys, "_chunk").agg(
        F.min_by("cur", "_order").alias("cur"), F.max_by("cur", "_order").alias("_last")
    )
    borders = (
        edges.withColumn("prev", F.lag("_last").over(W.partitionBy(*keys).orderBy("_chunk")))
        .where(F.col("prev").isNotNull())
        .select(*keys, "cur", "prev")
    )
    return inside.unionByName(borders)


def numbered(df: DataFrame, keys: list[str], order: list[str], chunk: Column, up_to: int | None = None) -> DataFrame:
    """Add the 1-based position ``pos`` in the group; chunks beyond ``up_to`` are not sorted."""
    cut = df.withColumn("_chunk", chunk)
    totals = _chunk_totals(cut.withColumn("n", F.lit(1)), keys).drop("_in_chunk", "_total")
    w = W.partitionBy(*keys, "_chunk").orderBy(*order)
    pos = F.col("_before") + F.row_number().over(w)
    if up_to is None:
        out = cut.join(totals, [*keys, "_chunk"]).withColumn("pos", pos)
    else:
        # few chunks are left per group, so the rows are filtered before any shuffle
        head = attach_small(cut, totals.where(F.col("_before") < up_to), [*keys, "_chunk"])
        out = head.withColumn("pos", pos).where(F.col("pos") <= up_to)
    return out.drop("_chunk", "_before")


def numbered_in_time(
    df: DataFrame, keys: list[str], time: str, order: str, up_to: int | None = None, most: int = 1 << 20, bits: int = PACKET_CHUNK_BITS
) -> DataFrame:
    """Add the 1-based position ``pos`` in the order of (time, order), both whole numbers.

    Rows are cut by seconds. A second with more than ``most`` rows is cut again, by time and by
    ranges of ``order``: it is then ordered by the counts of these cells, and no more than
    ``2**bits`` rows of it meet. With ``up_to`` only the first positions are kept.
    """
    cut = df.withColumn("_chunk", second_chunk(F.col(time)))
    per = cut.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    ahead = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    if up_to is not None:
        per = per.where(F.col("_before") < up_to)
    per = per.withColumn("_hot", F.col("_n") > most).drop("_n")
    seen = attach_small(cut, per, [*keys, "_chunk"])
    hot = lambda c: F.when(F.col("_hot"), c).otherwise(F.lit(0).cast("bigint"))
    seen = seen.withColumns({"_at": hot(F.col(time)), "_range": hot(packet_chunk(F.col(order), bits))})
    cell = [*keys, "_chunk", "_at", "_range"]
    cells = seen.where(F.col("_hot")).groupBy(*cell).agg(F.count(F.lit(1)).alias("_m"))
    inner = W.partitionBy(*keys, "_chunk").orderBy("_at", "_range").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("_inner", F.coalesce(F.sum("_m").over(inner), F.lit(0))).drop("_m")
    place = F.col("_before") + F.coalesce("_inner", F.lit(0)) + F.row_number().over(W.partitionBy(*cell).orderBy(time, order))
    out = seen.join(cells, cell, "left").withColumn("pos", place)
    if up_to is not None:
        out = out.where(F.col("pos") <= up_to)
    return out.drop("_chunk", "_before", "_hot", "_at", "_range", "_inner")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group with their ``rank``.

    Spark limits each partition to ``n`` rows per group before the shuffle.
    """
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def every_capture(packets: DataFrame, found: DataFrame, zeros: list[str], cap: str = "filename") -> DataFrame:
    """``found`` with a row for each capture of ``packets``: 0 in the columns ``zeros``, null in others, where it has none."""
    return packets.select(cap).distinct().join(found, cap, "left").fillna(0, zeros).select(*found.columns)


def attach_small(
    big: DataFrame, small: DataFrame, on: list[str], max_rows: int = 500_000, salts: int = 32, pinned: bool = False,
    how: str = "inner",
) -> DataFrame:
    """Inner or left join with a table that is expected to be small, say one row per capture.

    The small side is written once and counted. Up to ``max_rows`` it is
    broadcast; beyond that both sides are spread over ``salts`` so that a hot key
    does not end in one task.
    """
    if not pinned:
        small = pin(small)
    if small.count() <= max_rows:
        return big.join(F.broadcast(small), on, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int")
    return big.withColumn("_salt", spread).join(salted, [*on, "_salt"], how).drop("_salt")
