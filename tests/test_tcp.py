"""TCP sequence fold against a packet-by-packet walk, for several chunk sizes."""

import random

import pytest
from pyspark.sql import functions as F

from tracetide.operators import tcp

SCHEMA = (
    "filename string, packet_no long, is_tcp boolean, src string, dst string, sport int, dport int, "
    "tcp_seq long, payload_len long, tcp_flags int"
)


def _rows(seed):
    rnd, nxt, rows = random.Random(seed), {}, []
    for i in range(400):
        f = rnd.choice([0, 0, 0, 0, 1, 2, 3])  # one flow holds most packets
        expected, size = nxt.get(f, 100), rnd.choice([0, 1, 5, 10])
        r = rnd.random()
        seq = expected if r < 0.7 else max(0, expected - rnd.choice([1, 5, 10, 15])) if r < 0.85 else expected + 10
        if rnd.random() < 0.6:
            nxt[f] = (seq + size) % 2**32
        if f == 3:
            seq = (2**32 - 60 + seq) % 2**32
        rows.append((f"c{f % 2}", i * 3, True, f"10.0.0.{f}", "b", 1, 2, seq, size, rnd.choice([0, 0, 2])))
    return rows


def _walk(rows):
    state, out = {}, {}
    for c, _, _, src, *_, seq, size, flags in rows:
        key, used = (c, src), 1 if size == 0 and flags & 3 else size
        n = out.setdefault(key, [0, 0, 0])
        n[0] += 1
        if key not in state:
            state[key] = (seq + used) % 2**32
        elif used > 0:
            if seq == state[key]:
                state[key] = (seq + used) % 2**32
            else:
                n[1 if seq < state[key] else 2] += 1
    return out


@pytest.mark.parametrize("bits", [18, 5, 2])
def test_chunks_give_the_same_counts(spark, bits):
    rows = _rows(bits)
    got = tcp.flow_quality(spark.createDataFrame(rows, SCHEMA), bits).collect()
    assert {(r["filename"], r["src"]): [r["packets"], r["retransmissions"], r["out_of_order"]] for r in got} == _walk(rows)


def test_literal_cases(spark):
    rows = [
        ("a", 1, True, "x", "y", 1, 2, 100, 0, 2),  # SYN uses one number
        ("a", 2, True, "x", "y", 1, 2, 101, 10, 0),  # expected
        ("a", 3, True, "x", "y", 1, 2, 101, 10, 0),  # seen before
        ("a", 4, True, "x", "y", 1, 2, 131, 10, 0),  # ahead: does not move the expected number
        ("a", 5, True, "x", "y", 1, 2, 111, 0, 0),  # pure acknowledgement
        ("a", 6, True, "x", "y", 1, 2, 111, 10, 0),  # expected
        ("b", 7, False, "x", "y", 1, 2, None, None, None),
    ]
    got = {r["filename"]: (r["retransmissions"], r["out_of_order"]) for r in tcp.tcp_seq_quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"a": (1, 1), "b": (0, 0)}


def _passages_by_walk(seq, size, first):
    out = {}
    for entry in [None] if first else sorted({s for s, n in zip(seq, size, strict=True) if n > 0}):
        at = entry
        for i, (s, n) in enumerate(zip(seq, size, strict=True)):
            if (first and i == 0) or (n > 0 and s == at):
                at = (s + n) % 2**32
        out[-1 if entry is None else entry] = at
    return out


def test_composed_steps_equal_a_walk():
    import numpy as np

    rnd = random.Random(3)
    for _ in range(400):
        n = rnd.randint(1, 30)
        seq, size = [rnd.choice([0, 5, 10, 15, 20, 2**32 - 5]) for _ in range(n)], [rnd.choice([0, 5, 5, 10]) for _ in range(n)]
        for first in (True, False):
            entry, out = tcp._passages(np.array(seq), np.array(size), first)
            assert dict(zip(entry.tolist(), out.tolist(), strict=True)) == _passages_by_walk(seq, size, first)


def test_long_path_by_its_own_threshold(spark):
    rows = _rows(7)
    got = tcp.flow_quality(spark.createDataFrame(rows, SCHEMA), bits=6, long_from=3).collect()
    assert {(r["filename"], r["src"]): [r["packets"], r["retransmissions"], r["out_of_order"]] for r in got} == _walk(rows)


def test_chunks_of_one_call_stay_apart():
    import numpy as np

    rnd = random.Random(4)
    for _ in range(300):
        sizes = [rnd.randint(1, 8) for _ in range(rnd.randint(1, 12))]
        first = [rnd.random() < 0.4 for _ in sizes]
        rows = [(part, rnd.choice([0, 5, 10, 15, 2**32 - 5]), rnd.choice([0, 5, 5, 10])) for part, n in enumerate(sizes) for _ in range(n)]
        part, seq, size = (np.array(c) for c in zip(*rows, strict=True))
        got = list(zip(*(c.tolist() for c in tcp._passages_of_chunks(seq, size, part, np.array(first))), strict=True))
        want = [
            (p, entry, out) for p, head in enumerate(first)
            for entry, out in _passages_by_walk([r[1] for r in rows if r[0] == p], [r[2] for r in rows if r[0] == p], head).items()
        ]
        assert sorted(got) == sorted(want)


def test_small_chunks_share_a_call(spark):
    """20,000 packets in chunks of two packet numbers: calls go by ranges of packet numbers, not by chunk."""
    rows = [(f"c{i % 2}", i, True, f"10.0.0.{i % 5}", "b", 1, None if i % 5 == 4 else 2, i % 7 * 10, i % 3 * 10, 0) for i in range(20000)]
    seg = tcp.segments(spark.createDataFrame(rows, SCHEMA), 1).withColumn("first_chunk", F.lit(0).cast("bigint"))
    steps = tcp._transitions(seg, 1)
    calls = steps.select("filename", F.spark_partition_id().alias("p")).distinct().count()
    assert calls == 2 and "range" in steps._jdf.queryExecution().analyzed().toString()
    got = tcp.flow_quality(spark.createDataFrame(rows, SCHEMA), bits=1, long_from=1).collect()
    assert {(r["filename"], r["src"]): [r["packets"], r["retransmissions"], r["out_of_order"]] for r in got} == _walk(rows)
