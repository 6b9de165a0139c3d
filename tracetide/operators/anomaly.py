"""Run features and a distributed isolation forest over them.

The forest is a table of nodes: trees are built in parallel, each from at most
``sample`` rows, and rows are scored in place against a copy of the node table,
whose size is bounded and checked. Rows never pass through the driver.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.naming import PROFILES, duration_group
from ..session import pin
from .conditions import valid_runs
from .ordered import exact_percentiles

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The features of a run, in order.
FEATURES = (
    "log_bytes", "log_pkts", "log_mean_bps", "log_peak_mbps",
    "tcp_pct", "udp_pct", "udp443_pct", "icmp_pct",
    "log_flows_per_min", "log_med_bytes_flow", "log_med_dur", "log_med_pkts_flow",
)
TREES = 500
SAMPLE = 256
EPSILON = 1e-12
TREE_BLOCK = 25  # trees built by one call
SLICE_ROWS = 20_000  # rows scored by one call
MAX_NODES = 2_000_000  # nodes on every executor, about 100 MB

NODE_SCHEMA = (
    "model string, seed int, tree int, node int, feature int, cut double, lo int, hi int, path double"
)


def join_capture_flows(captures: DataFrame, flows: DataFrame, duration: str | None = "15m") -> DataFrame:
    """Valid summaries of one duration, or of all of them, with the flow metrics of the same capture.

    With ``duration`` None the result has a column ``duration``, in which an hour is 60m.
    """
    group = duration_group(F.col("duration_label"))
    metrics = ["flows", "flows_per_min", "median_bytes_per_flow", "median_dur_s", "median_pkts_per_flow"]
    ok_flows = valid_runs(flows).select("filename", *metrics)
    if duration is None:
        return valid_runs(captures).withColumn("duration", group).join(ok_flows, "filename")
    label = "60m" if duration == "1h" else duration
    return valid_runs(captures).where(group == label).join(ok_flows, "filename")


def run_features(joined: DataFrame, digits: int | None = None) -> DataFrame:
    """The 12 features, and the duration where the rows have one; runs with a missing feature are dropped."""
    n = {c: F.col(c).cast("double") for c in ("tcp_pkts", "udp_pkts", "udp443_pkts", "icmp_pkts", "other_pkts")}
    udp_rest = F.when(n["udp_pkts"].isNotNull() & n["udp443_pkts"].isNotNull(), F.greatest(n["udp_pkts"] - n["udp443_pkts"], F.lit(0.0)))
    total = n["tcp_pkts"] + udp_rest + n["udp443_pkts"] + n["icmp_pkts"] + n["other_pkts"]
    total = F.when(total.isNotNull(), F.greatest(total, F.lit(EPSILON)))
    cols = {
        "log_bytes": F.log1p("bytes_total"),
        "log_pkts": F.log1p("packets_total"),
        "log_mean_bps": F.log1p("mean_bps"),
        "log_peak_mbps": F.log1p("peak_mbps_1s"),
        "tcp_pct": n["tcp_pkts"] / total,
        "udp_pct": udp_rest / total,
        "udp443_pct": n["udp443_pkts"] / total,
        "icmp_pct": n["icmp_pkts"] / total,
        "log_flows_per_min": F.log1p("flows_per_min"),
        "log_med_bytes_flow": F.log1p("median_bytes_per_flow"),
        "log_med_dur": F.log1p("median_dur_s"),
        "log_med_pkts_flow": F.log1p("median_pkts_per_flow"),
    }
    if digits is not None:
        cols = {k: F.round(v, digits) for k, v in cols.items()}
    known = [c for c in ("duration",) if c in joined.columns]
    return joined.select("filename", "profile", *known, *[cols[f].alias(f) for f in FEATURES]).dropna(subset=list(FEATURES))


BASELINES = ("regular_only", "mixed")


def model_name(columns: list[str], baseline: str) -> Column:
    """Name of a model: its baseline, behind the duration where runs of several durations are told apart."""
    return F.concat("duration", F.lit(f"/{baseline}")) if "duration" in columns else F.lit(baseline)


def training_sets(features: DataFrame) -> DataFrame:
    """Rows with the baselines they train: regular runs train two models, others one; each duration has its own."""
    regular, mixed = (model_name(features.columns, b) for b in BASELINES)
    models = F.when(F.col("profile") == "regular", F.array(regular, mixed)).otherwise(F.array(mixed))
    return features.withColumn("model", F.explode(models))


def scale_table(train: DataFrame, features=FEATURES) -> DataFrame:
    """Median and IQR of each feature per model; an IQR of zero divides by one.

    Input: one row per run. The generic scaler of the ML library is not used: it
    turns a feature without spread into zeros.
    """
    quart = [F.percentile(f, [0.25, 0.5, 0.75]).alias(f) for f in features]
    q = train.groupBy("model").agg(*quart)

    def spread(f: str) -> Column:
        iqr = F.col(f)[2] - F.col(f)[0]
        return F.when(iqr == 0, 1.0).otherwise(iqr)

    return q.select(
        "model",
        *[F.col(f)[1].alias(f"{f}_med") for f in features],
        *[spread(f).alias(f"{f}_iqr") for f in features],
    )


def robust_scale(rows: DataFrame, scales: DataFrame, features=FEATURES, digits: int | None = None) -> DataFrame:
    """(x - median) / IQR under the row's model. The scale table has one row per model."""
    joined = rows.join(F.broadcast(scales), "model")
    out = {f: (F.col(f) - F.col(f"{f}_med")) / F.col(f"{f}_iqr") for f in features}
    if digits is not None:
        out = {f: F.round(c, digits) for f, c in out.items()}
    return joined.withColumns(out).drop(*[f"{f}_{s}" for f in features for s in ("med", "iqr")])


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a random tree of ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _draw(seed: int, tree: int, code: int) -> tuple[int, float]:
    """Two numbers for a node, from a hash of its place: one to pick a feature, one in [0, 1) for the cut."""
    digits = hashlib.md5(f"{seed}:{tree}:{code}".encode(), usedforsecurity=False).hexdigest()
    return int(digits[:8], 16), int(digits[8:16], 16) / 2.0**32


def _grow(x: np.ndarray, seed: int, tree: int) -> list[tuple]:
    """Nodes of one isolation tree over the rows of ``x`` (at most ``SAMPLE``).

    A node's code is 1 for the root, and 2c and 2c + 1 below c. The feature is drawn from
    those with two values or more, the cut between the smallest and the largest.
    """
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[tuple] = []
    todo = [(0, 1, np.arange(len(x)), 0)]
    free = 1
    while todo:
        node, code, rows, depth = todo.pop()
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= limit or len(open_features) == 0:
            nodes.append((node, -1, 0.0, -1, -1, depth + average_path(len(rows))))
            continue
        pick, share = _draw(seed, tree, code)
        f = int(open_features[pick % len(open_features)])
        cut = float(low[f] + share * (high[f] - low[f]))
        if cut >= high[f]:  # rounded up: both sides must hold a row
            cut = float(low[f])
        left = part[:, f] <= cut
        nodes.append((node, f, cut, free, free + 1, 0.0))
        todo += [(free, 2 * code, rows[left], depth + 1), (free + 1, 2 * code + 1, rows[~left], depth + 1)]
        free += 2
    return nodes


def iforest_fit(
    train: DataFrame, features=FEATURES, key: str = "filename", seeds=(0,), trees: int = TREES, sample: int = SAMPLE
) -> DataFrame:
    """Node table of one forest per model and seed.

    Rows are put in the order of a hash of row and seed, and the first ``trees * sample``
    of them make a pool; each partition keeps no more before the shuffle. Tree t takes
    ``sample`` rows of the pool from place ``t * sample`` on, starting over at its end,
    so a row meets few trees and a tree never sees more than ``sample`` rows.
    """
    feats = list(features)
    keyed = train.select(
        "model", F.col(key).cast("string").alias("_key"), *feats,
        F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias("seed"),
    )
    pool = W.partitionBy("model", "seed")
    placed = (
        keyed.withColumn("_place", F.row_number().over(pool.orderBy(F.md5(F.concat_ws(":", "_key", "seed").cast("binary")), "_key")) - 1)
        .where(F.col("_place") < trees * sample)
        .withColumn("_n", F.count(F.lit(1)).over(pool))
    )
    # a large pool gives every row to one tree
    takes = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.col("_place") - t * sample, F.col("_n")) < sample
    )
    one = F.array(F.floor(F.col("_place") / sample).cast("int"))
    picked = (
        placed.withColumn("tree", F.explode(F.when(F.col("_n") == trees * sample, one).otherwise(takes)))
        .withColumn("_rn", F.col("_place"))
        .drop("_place", "_n")
        .withColumn("_block", F.floor(F.col("tree") / TREE_BLOCK))
    )

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tree", "_rn"])
        model, seed = pdf["model"].iloc[0], int(pdf["seed"].iloc[0])
        x, tree = pdf[feats].to_numpy(float), pdf["tree"].to_numpy()
        starts = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
        out = []
        for lo, hi in zip(starts, np.r_[starts[1:], len(tree)]):
            unit = average_path(hi - lo) or 1.0
            out += [(model, seed, int(tree[lo]), *node[:-1], node[-1] / unit) for node in _grow(x[lo:hi], seed, int(tree[lo]))]
        return pd.DataFrame(out, columns=["model", "seed", "tree", "node", "feature", "cut", "lo", "hi", "path"])

    return picked.groupBy("model", "seed", "_block").applyInPandas(build, NODE_SCHEMA)


def _walk(x: np.ndarray, nodes: pd.DataFrame, batch: int = 2000) -> np.ndarray:
    """Mean normalised path of every row over the trees of one forest."""
    nodes = nodes.sort_values(["tree", "node"])
    tree = nodes["tree"].to_numpy()
    starts = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
    offset = np.repeat(starts, np.diff(np.r_[starts, len(tree)]))
    feature, cut, path = (nodes[c].to_numpy() for c in ("feature", "cut", "path"))
    lo, hi = nodes["lo"].to_numpy() + offset, nodes["hi"].to_numpy() + offset
    means = []
    for first in range(0, len(x), batch):
        part = x[first : first + batch]
        at = np.tile(starts, (len(part), 1))
        rows, trees = np.nonzero(feature[at] >= 0)
        while len(rows):
            here = at[rows, trees]
            below = part[rows, feature[here]] <= cut[here]
            here = np.where(below, lo[here], hi[here])
            at[rows, trees] = here
            more = feature[here] >= 0
            rows, trees = rows[more], trees[more]
        means.append(path[at].mean(axis=1))
    return np.concatenate(means)


def _score_in_place(rows: DataFrame, nodes: DataFrame, feats: list[str], key: str) -> DataFrame:
    """Scores by a copy of the node table on every executor."""
    table = nodes.orderBy("model", "seed", "tree", "node").toPandas()
    forests = {m: [(int(s), f) for s, f in g.groupby("seed", sort=True)] for m, g in table.groupby("model")}
    shared = rows.sparkSession.sparkContext.broadcast(forests)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for model, part in batch.groupby("model"):
                x = part[feats].to_numpy(float)
                for seed, forest in shared.value.get(model, []):
                    out = part[["model", key, "profile"]].copy()
                    out.insert(1, "seed", seed)
                    out["score"] = -np.power(2.0, -_walk(x, forest))
                    yield out

    keyed = rows.select("model", F.col(key).cast("string").alias(key), "profile", *feats)
    return keyed.mapInPandas(score, f"model string, seed int, {key} string, profile string, score double")


def iforest_score(rows: DataFrame, nodes: DataFrame, features=FEATURES, key: str = "filename", slices: int | None = None) -> DataFrame:
    """Score -2^(-mean path) of each row under each model and seed; higher is more normal.

    The node table has at most trees * (2 * sample - 1) rows per model and seed. It is
    counted, and up to ``MAX_NODES`` rows it goes to all executors and no row is moved.
    A larger table meets the rows in slices of about ``SLICE_ROWS`` by hash, as it does
    when ``slices`` is given.
    """
    feats = list(features)
    if slices is None:
        if nodes.count() <= MAX_NODES:
            return _score_in_place(rows, nodes, feats, key)
        slices = 1 + rows.count() // SLICE_ROWS
    keyed = rows.select("model", F.col(key).cast("string").alias(key), "profile", *feats).withColumn(
        "_slice", F.pmod(F.xxhash64(key), F.lit(slices)).cast("int")
    )
    copies = nodes.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    names = ["model", "seed", key, "profile", "score"]
    schema = f"model string, seed int, {key} string, profile string, score double"

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=names)
        parts = []
        x = left[feats].to_numpy(float)
        for seed, forest in right.groupby("seed", sort=True):
            part = left[["model", key, "profile"]].copy()
            part.insert(1, "seed", int(seed))
            part["score"] = -np.power(2.0, -_walk(x, forest))
            parts.append(part)
        return pd.concat(parts)

    return keyed.groupBy("model", "_slice").cogroup(copies.groupBy("model", "_slice")).applyInPandas(score, schema)


def score_threshold(scores: DataFrame, keys: list[str], score: str = "score", mode: str = "min_train", q: float = 0.05) -> DataFrame:
    """Threshold per group from the training scores: just below the smallest, or a quantile.

    """
    if mode == "min_train":
        return scores.groupBy(*keys).agg((F.min(score) - F.lit(EPSILON)).alias("threshold"))
    if mode == "quantile":
        return exact_percentiles(scores, keys, score, {"threshold": q}).select(*keys, "threshold")
    raise ValueError(f"unknown threshold mode: {mode}")


def flagged_rate(scores: DataFrame, thresholds: DataFrame, on: list[str], by: list[str], score: str = "score") -> DataFrame:
    """Share of rows strictly below the threshold."""
    hit = F.avg((F.col(score) < F.col("threshold")).cast("int"))
    return scores.join(thresholds, on).groupBy(*on, *by).agg(hit.alias("flagged_rate"))


def score_baselines(
    features: DataFrame, seeds=(0,), trees: int = TREES, mode: str = "min_train", q: float = 0.05
) -> DataFrame:
    """Every run under both baselines: score, threshold and flag, for each seed.

    Where the features have a duration, runs train and are scored within their own.
    """
    # features, scales, nodes and scores are small and read by several branches
    known = pin(features.where(F.col("profile").isin(*PROFILES)))
    check_training_rows(known)
    train = training_sets(known)
    scales = pin(scale_table(train))
    nodes = pin(iforest_fit(robust_scale(train, scales), seeds=seeds, trees=trees))
    # two fixed models: every run is scored under both
    both = known.withColumn("model", F.explode(F.array(*(model_name(known.columns, b) for b in BASELINES))))
    scored = pin(iforest_score(robust_scale(both, scales), nodes))
    trained = scored.where(F.col("model").endswith("mixed") | (F.col("profile") == "regular"))
    thr = score_threshold(trained, ["model", "seed"], mode=mode, q=q)
    return scored.join(thr, ["model", "seed"]).withColumn("flagged", F.col("score") < F.col("threshold"))


def check_training_rows(features: DataFrame) -> None:
    """Fail early when there is nothing to train on, for any duration that has runs."""
    known = features.where(F.col("profile").isin(*PROFILES))
    groups = ["duration"] if "duration" in features.columns else []
    counts = known.groupBy(*groups).agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("profile") == "regular").alias("regular"))
    row = counts.agg(F.coalesce(F.sum("runs"), F.lit(0)).alias("runs"), F.min("regular").alias("regular")).first()
    if row["runs"] == 0:
        raise ValueError("no valid rows after filtering")
    if row["regular"] < 2:
        raise ValueError("not enough regular runs to train the baseline")


def baseline_rates(scored: DataFrame) -> DataFrame:
    """Flagged share per baseline, seed and profile."""
    return scored.groupBy("model", "seed", "profile").agg(
        F.count(F.lit(1)).alias("runs"), F.avg(F.col("flagged").cast("int")).alias("flagged_rate")
    )


def baseline_compare(scored: DataFrame) -> DataFrame:
    """The comparison table: one row per baseline and seed, gamer and admin rates in percent."""
    def pct(profile: str) -> Column:
        return F.avg(F.when(F.col("profile") == profile, F.col("flagged").cast("int") * 100.0))

    return scored.groupBy("model", "seed").agg(
        pct("gamer").alias("gamer_flagged_pct"), pct("admin").alias("admin_flagged_pct")
    )
