"""Capture names, profiles and requested durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled

# The naming scheme of the recordings and its two vocabularies.
CAPTURE_NAME = r"^capturaAgente([A-Za-z]+)(\d+m|1h)(\d+)\.pcapng$"
CAPTURE_NAME_ANY = r"^capturaAgente([A-Za-z]+)(\d+m|1h)(\d+)\.pcap(?:ng)?$"
PROFILES = ("regular", "gamer", "admin")
DURATIONS = ("5m", "15m", "60m")


def map_profile(agent: Column) -> Column:
    """Profile of an agent name: known prefixes, else the lower-cased name."""
    low = F.lower(agent)
    return (
        F.when(low.startswith("admin"), "admin")
        .when(low.startswith("gamer"), "gamer")
        .when(low.startswith("web") | low.startswith("normal"), "regular")
        .otherwise(low)
    )


def duration_minutes(label: Column) -> Column:
    return (
        F.when(label == "5m", 5).when(label == "15m", 15).when(label.isin("60m", "1h"), 60)
    )


def duration_seconds(label: Column) -> Column:
    return duration_minutes(label) * 60


def duration_group(label: Column) -> Column:
    """Grouping label: one hour is written two ways."""
    return F.when(label == "1h", "60m").otherwise(label)


def with_capture_name(df: DataFrame, allow_pcap: bool = False) -> DataFrame:
    """Add profile, duration_label, duration_requested_min and run_idx.

    They are settled: a filter on them stays at the rows given, often one for each capture.
    """
    rx = CAPTURE_NAME_ANY if allow_pcap else CAPTURE_NAME
    hit = F.col("filename").rlike(rx)

    def part(i: int) -> Column:
        return F.when(hit, F.regexp_extract("filename", rx, i))

    label = part(2)
    parsed = {
        "profile": map_profile(part(1)),
        "duration_label": label,
        "duration_requested_min": duration_minutes(label),
        "run_idx": part(3).try_cast("int"),
    }
    return settled(df.drop(*parsed), **parsed)


def profile_rank(col: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, PROFILES)), col)


def duration_rank(col: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, DURATIONS)), col)
