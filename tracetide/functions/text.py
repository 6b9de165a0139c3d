"""Text forms used in reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import fixed_text, round_even

# Unit ladders of the printed reports.
BYTE_UNITS = ("B", "KB", "MB", "GB", "TB")
RATE_UNITS = ("bps", "Kbps", "Mbps", "Gbps", "Tbps")


def _ladder(value: Column, step: float, units: tuple[str, ...]) -> Column:
    scaled = [value.cast("double")]
    for _ in units[1:]:
        scaled.append(scaled[-1] / F.lit(step))
    shown, unit = scaled[-1], F.lit(units[-1])
    for s, u in reversed(list(zip(scaled[:-1], units[:-1]))):
        shown, unit = F.when(s < step, s).otherwise(shown), F.when(s < step, u).otherwise(unit)
    text = F.concat(fixed_text(shown, 2), F.lit(" "), unit)
    return F.coalesce(F.when(value.isNotNull(), text), F.lit("n/a"))


def human_bytes(n: Column) -> Column:
    return _ladder(n, 1024.0, BYTE_UNITS)


def human_bps(rate: Column) -> Column:
    return _ladder(rate, 1000.0, RATE_UNITS)


def median_iqr_cell(med: Column, iqr: Column, digits: int | None = None) -> Column:
    """``m [i]``, only ``m`` without spread, ``--`` without data."""

    def show(x: Column) -> Column:
        return round_even(x).cast("string") if digits is None else fixed_text(x, digits)

    plain = iqr.isNull() | F.isnan(iqr) | (iqr == 0)
    return (
        F.when(med.isNull() | F.isnan(med), "--")
        .when(plain, show(med))
        .otherwise(F.concat(show(med), F.lit(" ["), show(iqr), F.lit("]")))
    )


def clean_label(text: Column) -> Column:
    """Keep letters, digits, blank, dot, underscore and dash; trim the right end."""
    return F.rtrim(F.regexp_replace(text, r"[^\p{L}\p{N} ._-]", ""))


def clean_session_id(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "")


def snippet(text: Column, limit: int) -> Column:
    """First characters, with an ellipsis when something was left out."""
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


# Size limits of the recorded command output.
OUTPUT_LIMIT = 20_000
STDOUT_FIELD_LIMIT = 10_000


def stdout_field(text: Column) -> Column:
    return F.substring(text, 1, STDOUT_FIELD_LIMIT)


def output_text(text: Column, limit: int = OUTPUT_LIMIT) -> Column:
    """Command output up to the limit, with a marker when something was left out."""
    size = F.char_length(text)
    marker = F.concat(F.lit("\n...TRUNCATED("), size.cast("string"), F.lit(" bytes)..."))
    return F.when(size > limit, F.concat(F.substring(text, 1, limit), marker)).otherwise(text)
