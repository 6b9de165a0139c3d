"""Lenient numbers and exact decimal text, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient_float(text: Column, default: float | None = None) -> Column:
    """Float of a text, or the default. Java suffixes such as ``1d`` are no numbers."""
    java_only = text.rlike(r"(?i)[0-9.][df]\s*$|x")
    value = F.when(~java_only, text.try_cast("double"))
    return F.coalesce(value, F.lit(default).cast("double"))


def lenient_int(text: Column, default: int | None = 0) -> Column:
    """Whole part of a numeric text (``"3.9"`` is 3), or the default."""
    return F.coalesce(lenient_float(text).try_cast("bigint"), F.lit(default).cast("bigint"))


def strict_int(text: Column) -> Column:
    """Plain integer text only: ``"1,17"`` and ``"6.0"`` give null."""
    return F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).try_cast("bigint"))


def digits_int(text: Column) -> Column:
    """All digits of a token read as one number; 0 when there are none."""
    return F.coalesce(F.regexp_replace(text, r"\D", "").try_cast("bigint"), F.lit(0).cast("bigint"))


def fixed_text(x: Column, digits: int) -> Column:
    """Decimal text of a double with exact binary ties going to even.

    The built-in formatter rounds the shortest decimal form half up, so 1.125
    would print as 1.13. It is wrong only where that form ends in a tie or is cut
    short by a large whole part, and those values are rounded here. The lambda
    binds the value once, however large its expression is.
    """
    return F.transform(F.array(x.cast("double")), lambda v: _fixed(v, digits))[0]


def _fixed(v: Column, digits: int) -> Column:
    mag = F.abs(v)
    part = mag - F.floor(mag)
    scale = float(10 ** (digits + 1))
    near = F.rint(part * scale)
    tie = (F.abs(part * scale - near) < 1e-3) & (near % 10 == 5)
    # exact sign of part * scale - near, by splitting the fraction in two halves
    c = part * F.lit(134217729.0)
    high = c - (c - part)
    off = (high * scale - near) + (part - high) * scale
    low_unit = (near - 5) / 10
    up = (off > 0) | ((off == 0) & (low_unit % 2 == 1))
    large = mag >= float(1 << 40)  # few fraction bits are left, so the product is exact
    units = F.when(large, F.rint(part * float(10**digits))).otherwise(low_unit + up.cast("double")).cast("bigint")
    whole = (F.floor(mag) + F.floor(units / 10**digits)).cast("bigint").cast("string")
    sign = F.when(v < 0, "-").otherwise("")
    text = F.concat(sign, whole, F.lit("."), F.lpad((units % 10**digits).cast("string"), digits, "0"))
    return F.when(v.isNotNull(), F.when(large | tie, text).otherwise(F.format_string(f"%.{digits}f", v)))


def round_even(x: Column) -> Column:
    """Nearest integer, ties to even. Doubles hold such ties exactly."""
    return F.rint(x).cast("bigint")
