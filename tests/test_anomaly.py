"""Forest behaviour: range, order, determinism, bounds."""

import random

import pytest
from pyspark.sql import functions as F

from tracetide.operators import anomaly

FEATS = ["a", "b"]


def blob(spark, n=300):
    rnd = random.Random(5)
    rows = [(f"r{i}", "m", "in", rnd.gauss(0, 1), rnd.gauss(0, 1)) for i in range(n)] + [("far", "m", "out", 9.0, -9.0)]
    return spark.createDataFrame(rows, "filename string, model string, profile string, a double, b double")


def test_forest_ranks_the_outlier_lowest_on_any_partitioning(spark):
    rows = blob(spark)
    results = []
    for parts, slices in ((1, 1), (7, 5), (3, None)):
        nodes = anomaly.iforest_fit(rows.repartition(parts), FEATS, trees=40, sample=64)
        scored = anomaly.iforest_score(rows.repartition(parts), nodes, FEATS, slices=slices)
        results.append(sorted((round(r["score"], 12), r["filename"]) for r in scored.collect()))
    assert results[0] == results[1] == results[2]
    assert results[0][0][1] == "far" and all(-1 <= s < 0 for s, _ in results[0])


def test_trees_are_bounded_by_the_sample(spark):
    nodes = anomaly.iforest_fit(blob(spark), FEATS, trees=30, sample=16)
    sizes = nodes.groupBy("tree").agg(F.count("*").alias("n"), F.max("path").alias("p")).collect()
    assert len(sizes) == 30 and max(r["n"] for r in sizes) <= 2 * 16 - 1


def test_a_large_pool_gives_each_row_to_one_tree(spark):
    """40 rows, 5 trees of 4: a pool of 20 rows."""
    rows = blob(spark, 39)
    nodes = anomaly.iforest_fit(rows, FEATS, trees=5, sample=4)
    assert {r["tree"] for r in nodes.collect()} == set(range(5))
    leaves = nodes.where("feature < 0").groupBy("tree").agg(F.count("*").alias("n")).collect()
    assert all(2 <= r["n"] <= 4 for r in leaves)


def test_baselines_need_regular_runs(spark):
    row = {f: 1.0 for f in anomaly.FEATURES}
    few = spark.createDataFrame([{"filename": "a", "profile": "gamer", **row}])
    with pytest.raises(ValueError, match="not enough"):
        anomaly.score_baselines(few)


def test_scaling_keeps_a_feature_without_spread(spark):
    df = spark.createDataFrame([("m", 1.0, 5.0), ("m", 3.0, 5.0), ("m", 5.0, 5.0)], "model string, a double, b double")
    out = anomaly.robust_scale(df.unionByName(spark.createDataFrame([("m", 3.0, 7.0)], df.schema)), anomaly.scale_table(df, FEATS), FEATS)
    assert sorted((r["a"], r["b"]) for r in out.collect()) == [(-1.0, 0.0), (0.0, 0.0), (0.0, 2.0), (1.0, 0.0)]


def test_thresholds_and_training_checks(spark):
    s = spark.createDataFrame([("m", -0.5), ("m", -0.4)], "model string, score double")
    assert anomaly.score_threshold(s, ["model"]).first()["threshold"] == -0.5 - 1e-12
    assert anomaly.score_threshold(s, ["model"], mode="quantile", q=0.5).first()["threshold"] == pytest.approx(-0.45)
    with pytest.raises(ValueError):
        anomaly.score_threshold(s, ["model"], mode="other")
    few = spark.createDataFrame([("a", "regular")], "filename string, profile string")
    with pytest.raises(ValueError, match="not enough"):
        anomaly.check_training_rows(few)
    with pytest.raises(ValueError, match="no valid"):
        anomaly.check_training_rows(few.where("false"))


def test_each_duration_trains_its_own_models(spark):
    rnd = random.Random(2)
    rows = [
        {"filename": f"{p}{d}{i}", "profile": p, "duration": d, **{f: rnd.gauss(0 if d == "5m" else 100, 1) for f in anomaly.FEATURES}}
        for p in ("regular", "gamer") for d in ("5m", "60m") for i in range(4)
    ]
    df = spark.createDataFrame(rows)
    out = anomaly.score_baselines(df, trees=20).collect()
    assert {r["model"] for r in out} == {f"{d}/{b}" for d in ("5m", "60m") for b in anomaly.BASELINES}
    assert all(("5m" in r["filename"]) == r["model"].startswith("5m/") for r in out) and len(out) == 32
    with pytest.raises(ValueError, match="not enough"):
        anomaly.score_baselines(df.where("NOT (duration = '60m' AND profile = 'regular')"))


def test_cuts_leave_rows_on_both_sides():
    import numpy as np

    x = np.array([[1.0, 5.0], [np.nextafter(1.0, 2.0), 5.0], [1.0, 5.0]])
    for tree in range(40):
        nodes = anomaly._grow(x, 1, tree)
        assert len(nodes) == 3 and nodes[0][1] == 0 and nodes[0][2] == 1.0
    assert anomaly._grow(x[:1], 1, 0) == [(0, -1, 0.0, -1, -1, 0.0)]


def test_filters_on_parsed_names_stay_above_the_packets(spark, sf_dir):
    """A run is valid by its parsed name: the name is parsed for each capture, the packets are read once for each part."""
    from tracetide.operators.captures import capture_summary
    from tracetide.operators.flows import bidir_flows
    from tracetide.plans.quality_plans import joined_runs
    from tracetide.sources.adapter import packets

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString().splitlines()

    filters = [line for line in plan(joined_runs(spark, sf_dir)) if "Filter" in line]
    assert filters and not any("RLIKE" in line or "regexp_extract" in line for line in filters)
    assert sum("Relation" in line for line in plan(capture_summary(packets(spark, sf_dir)))) == 3
    assert sum(line.count("regexp_extract") for line in plan(bidir_flows(packets(spark, sf_dir)))) == 1


def test_features_read_the_packets_once_behind_the_summary(spark, sf_dir):
    """Counts, spans and ports come from one pinned pass, and the spans of flows from the summary: only the flows still read
    packets. They stand twice in the plan, for totals and for ranks, and share one exchange."""
    from tracetide.operators.captures import capture_summary, summary_pairs
    from tracetide.plans.quality_plans import joined_runs
    from tracetide.session import pin
    from tracetide.sources.adapter import packets

    plan = joined_runs(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("Relation" in line for line in plan) == 2
    p = packets(spark, sf_dir)
    alone, shared = capture_summary(p), capture_summary(p, pairs=pin(summary_pairs(p)))
    assert alone.schema == shared.schema and sorted(map(str, alone.collect())) == sorted(map(str, shared.collect()))
