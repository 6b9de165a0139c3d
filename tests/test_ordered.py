"""Order primitives against brute force, with chunks small enough to need stitching."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracetide.operators import ordered


def test_percentiles_match_numpy(spark):
    rnd = random.Random(1)
    data = {
        "ints": [rnd.randrange(0, 10**9) for _ in range(501)],
        "ties": [rnd.randrange(0, 4) for _ in range(300)],
        "signed": [rnd.randrange(-5000, 5000) for _ in range(200)],
        "wide": [2**rnd.randrange(0, 50) for _ in range(99)],
        "one": [7],
    }
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["k"]: r for r in ordered.exact_percentiles(df, ["k"], "v", probs).collect()}
    assert set(got) == set(data)
    for k, vs in data.items():
        assert got[k]["n"] == len(vs) and got[k]["sum"] == sum(vs) and got[k]["max"] == max(vs)
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.percentile(vs, p * 100), rel=1e-12)


def test_percentiles_of_doubles_and_weights(spark):
    rnd = random.Random(2)
    vs = [rnd.gauss(0, 1) * 10 ** rnd.randrange(-5, 5) for _ in range(400)] + [0.0, 0.0]
    df = spark.createDataFrame([(v, 1 + i % 3) for i, v in enumerate(vs)], "v double, w int")
    row = ordered.exact_percentiles(df, [], "v", {"m": 0.5, "q": 0.9}, "w").first()
    full = [v for i, v in enumerate(vs) for _ in range(1 + i % 3)]
    assert row["m"] == pytest.approx(np.percentile(full, 50)) and row["q"] == pytest.approx(np.percentile(full, 90))


def test_value_chunk_is_monotone(spark):
    vs = sorted({s * (2**e + d) for e in range(0, 50) for d in (-1, 0, 1) for s in (-1, 1)} | {0})
    df = spark.createDataFrame([(v,) for v in vs], "v bigint").select("v", ordered.value_chunk(F.col("v")).alias("c"))
    chunks = [r["c"] for r in sorted(df.collect(), key=lambda r: r["v"])]
    assert chunks == sorted(chunks)


@pytest.mark.parametrize("bits", [0, 1, 3, 20])
def test_neighbours_across_chunks(spark, bits):
    rnd = random.Random(bits)
    rows = [(f"c{i % 3}", i * 2, rnd.randrange(1000)) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, o bigint, v bigint")
    got = sorted((r["g"], r["prev"], r["cur"]) for r in ordered.neighbours(df, ["g"], "o", "v", F.shiftright("o", bits)).collect())
    want = []
    for g in ("c0", "c1", "c2"):
        vs = [v for k, _, v in rows if k == g]
        want += [(g, a, b) for a, b in zip(vs, vs[1:])]
    assert got == sorted(want)


def test_numbered_stops_at_the_limit(spark):
    df = spark.createDataFrame([("a", i * 3) for i in range(50)] + [("b", 1)], "g string, o bigint")
    got = ordered.numbered(df, ["g"], ["o"], F.shiftright("o", 4), 20).collect()
    assert {(r["g"], r["o"]): r["pos"] for r in got} == {**{("a", i * 3): i + 1 for i in range(20)}, ("b", 1): 1}


def test_running_counts(spark):
    df = spark.createDataFrame([("a", v) for v in (5, 1, 1, 9, 5, 5)], "g string, v bigint")
    got = [(r["v"], r["n"], r["cum_n"], r["total_n"]) for r in ordered.running_counts(df, ["g"], "v").orderBy("v").collect()]
    assert got == [(1, 2, 2, 6), (5, 3, 5, 6), (9, 1, 6, 6)]


def test_attach_small_both_ways(spark):
    big = spark.createDataFrame([(i % 5, i) for i in range(200)], "k int, v int")
    small = spark.createDataFrame([(i, i * 10) for i in range(4)], "k int, w int")
    want = sorted((i % 5, i, (i % 5) * 10) for i in range(200) if i % 5 < 4)
    for limit in (100, 0):  # broadcast, then the salted join
        got = ordered.attach_small(big, small, ["k"], max_rows=limit, salts=3)
        assert sorted((r["k"], r["v"], r["w"]) for r in got.collect()) == want


def test_top_n_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    top = ordered.top_n(df, ["g"], [F.desc("id")], 2)
    assert sorted(r["id"] for r in top.collect()) == [994, 995, 996, 997, 998, 999]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_ranks_of_a_whole_table_need_no_single_window(spark):
    rnd = random.Random(11)
    values = [rnd.choice([rnd.randint(-50, 50), rnd.randint(-(10**9), 10**9), rnd.random()]) for _ in range(3000)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    out = ordered.exact_percentiles(df, [], "v", {"a": 0.25, "b": 0.999})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any("Window" in line and "partitionSpec=[]" in line for line in plan.splitlines()) and "Window [" in plan
    row = out.first()
    want = sorted(map(float, values))
    for name, p in (("a", 0.25), ("b", 0.999)):
        at = (len(want) - 1) * p
        lo = int(at)
        assert abs(row[name] - (want[lo] + (want[min(lo + 1, len(want) - 1)] - want[lo]) * (at - lo))) < 1e-6
    assert row["n"] == 3000
    assert ordered.exact_percentiles(df.where("false"), [], "v", {"a": 0.5}).first()["a"] is None


def test_places_in_a_second_that_holds_everything(spark):
    """Equal times, and few times, with cells of four rows: the order is that of (time, number)."""
    rnd = random.Random(5)
    for times in ([7_000_000], [7_000_000, 7_000_001, 7_999_999, 8_000_000, 3]):
        rows = [("c", rnd.choice(times), i) for i in range(200)] + [("d", 1, 5)]
        df = spark.createDataFrame(rows, "g string, t long, i long").repartition(5)
        want = {(g, i): k + 1 for g in "cd" for k, (_, i) in enumerate(sorted((t, i) for h, t, i in rows if h == g))}
        out = ordered.numbered_in_time(df, ["g"], "t", "i", most=10, bits=2)
        assert {(r.g, r.i): r.pos for r in out.collect()} == want and sorted(out.columns) == ["g", "i", "pos", "t"]
        head = ordered.numbered_in_time(df, ["g"], "t", "i", up_to=13, most=10, bits=2)
        assert {(r.g, r.i): r.pos for r in head.collect()} == {k: v for k, v in want.items() if v <= 13}
