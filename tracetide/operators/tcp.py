"""TCP sequence quality of directional flows.

The expected next sequence number of a flow moves only when a segment matches it
exactly, so the packets of a flow depend on each other in order. A flow of at most
``2**bits`` packets is one fold. A longer one is cut into chunks of ``2**bits``
packet numbers:

* each chunk is first turned into a table "expected number on entry -> expected
  number on exit". Chunks that do not hold the number leave it alone, so the
  chunks a flow really passes through form a linked chain, which is followed by
  pointer doubling (a logarithmic number of joins);
* with the number on entry known, every chunk folds on its own.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.net import tcp_segment_length
from ..session import pin
from .ordered import PACKET_CHUNK_BITS, attach_small, packet_chunk

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAP = "filename"
FLOW = [CAP, "src", "dst", "sport", "dport"]
WRAP = 1 << 32
_START = -1  # entry value of a flow's first chunk
_WHOLE = -1  # chunk of a flow that is not cut


def segments(packets: DataFrame, bits: int = PACKET_CHUNK_BITS) -> DataFrame:
    usable = F.col("is_tcp") & F.col("tcp_seq").isNotNull() & F.col("src").isNotNull() & F.col("dst").isNotNull()
    return packets.where(usable).select(
        *FLOW, "packet_no",
        F.col("tcp_seq").cast("bigint").alias("seq"),
        tcp_segment_length(F.col("payload_len"), F.col("tcp_flags")).alias("len"),
        packet_chunk(F.col("packet_no"), bits).alias("chunk"),
    )


def _fold(rows: Column, entry: Column) -> Column:
    """Counts of one chunk, given the expected number on entry (null at the start of a flow)."""
    zero = F.lit(0).cast("bigint")
    start = F.struct(entry.cast("bigint").alias("next"), zero.alias("retrans"), zero.alias("ooo"))

    def step(acc: Column, p: Column) -> Column:
        after = (p["seq"] + p["len"]) % WRAP
        fresh = acc["next"].isNull()
        counted = ~fresh & (p["len"] > 0)
        return F.struct(
            F.when(fresh | (counted & (p["seq"] == acc["next"])), after).otherwise(acc["next"]).alias("next"),
            (acc["retrans"] + F.when(counted & (p["seq"] < acc["next"]), 1).otherwise(0)).alias("retrans"),
            (acc["ooo"] + F.when(counted & (p["seq"] > acc["next"]), 1).otherwise(0)).alias("ooo"),
        )

    return F.aggregate(rows, start, step)


def _chunk_counts(seg: DataFrame, entry: str | None) -> DataFrame:
    """Fold every (flow, chunk): at most ``2**bits`` packets per group."""
    first = F.lit(None).cast("bigint") if entry is None else F.max(entry)
    grouped = seg.groupBy(*FLOW, "chunk").agg(
        F.array_sort(F.collect_list(F.struct("packet_no", "seq", "len"))).alias("rows"), first.alias("entry")
    )
    return grouped.select(*FLOW, _fold(F.col("rows"), F.col("entry")).alias("f"), F.size("rows").alias("packets"))


def _passages(seq: np.ndarray, size: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """The numbers one chunk can be entered with, and the expected number on exit for each."""
    _, entry, out = _passages_of_chunks(seq, size, np.zeros(len(seq), dtype=np.int64), np.array([first]))
    return entry, out


def _passages_of_chunks(seq: np.ndarray, size: np.ndarray, part: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(chunk, entry, exit) of many chunks at once.

    ``part`` is the chunk of each packet, ascending from 0 without a gap, and ``first`` tells of each chunk whether
    its flow begins there.

    Every packet passes the walk on to the next one of its chunk that holds the number it asks for. These
    steps are composed with themselves until none leads further, in a logarithmic number of rounds. The first chunk
    of a flow is entered in one way, and its first packet counts whatever it holds.
    """
    after = (seq + size) % WRAP
    m = len(seq) + 1
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    heads = starts[first]
    counted = size > 0
    counted[heads] = False
    place = np.flatnonzero(counted)
    # numbers and (chunk, number) pairs by rank, so that no key outgrows 64 bits
    numbers = np.unique(np.r_[seq, after])
    pair = part * len(numbers) + np.searchsorted(numbers, seq)
    asked = part * len(numbers) + np.searchsorted(numbers, after)
    held = np.unique(pair[place])
    # the first later packet of a chunk with a given number: packets sorted by pair and place
    keys = np.sort(np.searchsorted(held, pair[place]) * m + place)

    def holder(rows: np.ndarray) -> np.ndarray:
        if not len(held):
            return np.full(len(rows), -1, dtype=np.int64)
        rank = np.minimum(np.searchsorted(held, asked[rows]), len(held) - 1)
        at = np.searchsorted(keys, rank * m + rows + 1)
        found = keys[np.minimum(at, len(keys) - 1)]
        return np.where((held[rank] == asked[rows]) & (at < len(keys)) & (found // m == rank), found % m, -1)

    step = np.arange(len(seq))
    to = holder(place)
    step[place] = np.where(to >= 0, to, place)
    while True:
        further = step[step]
        if (further == step).all():
            break
        step = further
    to = holder(heads)
    begun = after[np.where(to >= 0, step[to], heads)]
    _, at = np.unique(keys // m, return_index=True)
    rows = keys[at] % m
    rows = rows[~first[part[rows]]]
    return (
        np.r_[part[heads], part[rows]],
        np.r_[np.full(len(heads), _START, dtype=np.int64), seq[rows]],
        np.r_[begun, after[step[rows]]],
    )


def _transitions(seg: DataFrame, bits: int) -> DataFrame:
    """(flow, chunk, entry, exit) for every number a chunk can be entered with.

    One call works out all chunks of a range of packet numbers of a capture, at most ``2**PACKET_CHUNK_BITS`` packets:
    small chunks, of which there may be as many as packets, do not cost a call each.
    """
    keys = [*FLOW, "chunk"]

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        part = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        order = np.lexsort((pdf["packet_no"].to_numpy(), part))
        pdf, part = pdf.iloc[order], part[order]
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        heads = pdf.iloc[starts]
        first = (heads["chunk"] == heads["first_chunk"]).to_numpy()
        chunk, entry, out = _passages_of_chunks(pdf["seq"].to_numpy(), pdf["len"].to_numpy(), part, first)
        found = heads[keys].iloc[chunk].reset_index(drop=True)
        return found.assign(entry=entry, exit=out)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in seg.schema if f.name in keys)
    together = F.shiftright("chunk", max(PACKET_CHUNK_BITS - bits, 0))
    return seg.groupBy(CAP, together.alias("range")).applyInPandas(table, f"entry bigint, exit bigint, {fields}")


def _visited(steps: DataFrame) -> DataFrame:
    """States (flow, chunk, exit) on the chain of each flow, from its first chunk on."""
    spots = [*FLOW, "chunk", "exit"]
    seeks = steps.select(*spots).distinct().select(
        *FLOW, F.col("exit").alias("num"), "chunk", F.lit(None).cast("bigint").alias("have"), F.lit(None).cast("bigint").alias("out")
    )
    haves = steps.where(F.col("entry") != _START).select(
        *FLOW, F.col("entry").alias("num"), "chunk", F.col("chunk").alias("have"), F.col("exit").alias("out")
    )
    # the next chunk that holds the number; one group has at most two rows per chunk. Chunks run backwards: a frame
    # that only gains rows is carried on, one that loses them is worked out anew for every row
    later = W.partitionBy(*FLOW, "num").orderBy(F.desc("chunk")).rangeBetween(W.unboundedPreceding, -1)
    found = F.last(F.when(F.col("have").isNotNull(), F.struct("have", "out")), ignorenulls=True).over(later)
    jump = (
        seeks.unionByName(haves).withColumn("to", found)
        .where(F.col("have").isNull() & F.col("to").isNotNull())
        .select(*FLOW, "chunk", F.col("num").alias("exit"), F.col("to.have").alias("chunk2"), F.col("to.out").alias("exit2"))
    )
    jump = pin(jump)
    reached = pin(steps.where(F.col("entry") == _START).select(*spots))
    while True:
        new = pin(reached.join(jump, spots).select(*FLOW, F.col("chunk2").alias("chunk"), F.col("exit2").alias("exit")))
        if new.isEmpty():
            return reached
        reached = reached.unionByName(new)
        second = jump.select(*FLOW, F.col("chunk").alias("chunk2"), F.col("exit").alias("exit2"), F.col("chunk2").alias("c3"), F.col("exit2").alias("e3"))
        jump = pin(jump.join(second, [*FLOW, "chunk2", "exit2"]).select(*FLOW, "chunk", "exit", F.col("c3").alias("chunk2"), F.col("e3").alias("exit2")))


def flow_quality(packets: DataFrame, bits: int = PACKET_CHUNK_BITS, long_from: int | None = None) -> DataFrame:
    """Packets, retransmissions and out-of-order segments of each directional flow.

    Flows of more than ``long_from`` packets (``2**bits`` without it) are cut.
    """
    seg = segments(packets, bits)
    sizes = seg.groupBy(*FLOW).agg(F.min("chunk").alias("first_chunk"), F.count(F.lit(1)).alias("size"))
    long_flows = pin(sizes.where(F.col("size") > (1 << bits if long_from is None else long_from)).drop("size"))
    if long_flows.isEmpty():
        counts = _chunk_counts(seg.withColumn("chunk", F.lit(_WHOLE).cast("bigint")), None)
    else:
        seg = attach_small(seg, long_flows, FLOW, pinned=True, how="left").withColumn(
            "chunk", F.when(F.col("first_chunk").isNotNull(), F.col("chunk")).otherwise(_WHOLE)
        )
        long = seg.where(F.col("first_chunk").isNotNull())
        steps = pin(_transitions(long, bits))
        chunks = long.select(*FLOW, "chunk").distinct()
        known = _visited(steps).groupBy(*FLOW, "chunk").agg(F.max("exit").alias("exit"))
        before = W.partitionBy(*FLOW).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
        entries = chunks.join(known, [*FLOW, "chunk"], "left").select(
            *FLOW, "chunk", F.last("exit", ignorenulls=True).over(before).alias("entry")
        )
        # first chunks and short flows have no entry number and start fresh
        later = pin(entries.where(F.col("entry").isNotNull()))
        counts = _chunk_counts(seg.join(later, [*FLOW, "chunk"], "left"), "entry")
    return counts.groupBy(*FLOW).agg(
        F.sum("packets").alias("packets"), F.sum("f.retrans").alias("retransmissions"), F.sum("f.ooo").alias("out_of_order")
    )


def tcp_seq_quality(packets: DataFrame, bits: int = PACKET_CHUNK_BITS, long_from: int | None = None) -> DataFrame:
    """Retransmitted and out-of-order segments per capture, 0 without TCP."""
    per = flow_quality(packets, bits, long_from).groupBy(CAP).agg(
        F.sum("retransmissions").alias("retransmissions"), F.sum("out_of_order").alias("out_of_order")
    )
    return packets.select(CAP).distinct().join(per, CAP, "left").fillna(0)
