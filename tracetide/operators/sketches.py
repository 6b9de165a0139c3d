"""Approximate forms of percentiles and distinct counts, on request, next to the exact ones.

Sketches are small binary values with a stated error. They are made for each part of the data, say a
capture and a day, can be stored, and are merged over any set of parts without reading the data again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUANTILE_K = 512
DISTINCT_LG_K = 12


def quantile_error(k: int = QUANTILE_K) -> float:
    """Normalised rank error of a quantile sketch, as its library states it for a confidence of 99 %."""
    return 2.296 / k**0.9723


def distinct_error(lg_k: int = DISTINCT_LG_K) -> float:
    """Relative standard error of a distinct-count sketch."""
    return 1.04 / 2 ** (lg_k / 2)


def quantile_sketches(df: DataFrame, keys: list[str], value: str, k: int = QUANTILE_K) -> DataFrame:
    """One sketch of the values of each group; nulls take no part."""
    return df.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))


def merged_quantiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of larger groups from stored ones."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def approximate_percentiles(sketches: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Row count ``n`` and a value near each wanted rank; null for a group without values."""
    n = F.kll_sketch_get_n_double("sketch")
    at = {name: F.when(n > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))) for name, p in probs.items()}
    return sketches.select(*keys, n.alias("n"), *(c.alias(name) for name, c in at.items()))


def distinct_sketches(df: DataFrame, keys: list[str], value: str, lg_k: int = DISTINCT_LG_K) -> DataFrame:
    """One distinct-count sketch of each group; nulls take no part."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(value, lg_k).alias("sketch"))


def merged_distinct(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def approximate_distinct(sketches: DataFrame, keys: list[str], name: str = "approx_distinct") -> DataFrame:
    return sketches.select(*keys, F.hll_sketch_estimate("sketch").alias(name))
