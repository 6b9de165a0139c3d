"""Sketches against exact ranks and counts, whole and merged."""

import random

from pyspark.sql import functions as F

from tracetide.operators import sketches

PROBS = {"p10": 0.1, "p50": 0.5, "p99": 0.99}


def test_quantiles_of_merged_parts_are_near_their_ranks(spark):
    rnd = random.Random(1)
    values = [rnd.paretovariate(1.1) for _ in range(30_000)]
    df = spark.createDataFrame([(i % 2, i % 7, v) for i, v in enumerate(values)], "g int, day int, v double")
    parts = sketches.quantile_sketches(df, ["g", "day"], "v", k=256)
    merged = sketches.merged_quantiles(parts, ["g"])
    for r in sketches.approximate_percentiles(merged, ["g"], PROBS).collect():
        own = sorted(values[r.g :: 2])
        assert r.n == len(own)
        for name, p in PROBS.items():
            assert abs(sum(v <= r[name] for v in own) / len(own) - p) <= 2 * sketches.quantile_error(256)


def test_groups_without_values(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0), ("b", None)], "g string, v double")
    found = {r.g: r for r in sketches.approximate_percentiles(sketches.quantile_sketches(df, ["g"], "v"), ["g"], PROBS).collect()}
    assert (found["a"].n, found["a"].p50, found["b"].n, found["b"].p50) == (0, None, 1, 2.0)


def test_distinct_counts_of_merged_parts(spark):
    df = spark.range(40_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 5).alias("day"), (F.col("id") % 9_000).cast("string").alias("v"))
    merged = sketches.merged_distinct(sketches.distinct_sketches(df, ["g", "day"], "v"), ["g"])
    found = {r.g: r.n for r in sketches.approximate_distinct(merged, ["g"], "n").collect()}
    assert all(abs(n - 3_000) <= 4 * sketches.distinct_error() * 3_000 for n in found.values()) and len(found) == 3
