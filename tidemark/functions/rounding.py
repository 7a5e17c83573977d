"""Rounding doubles to decimal digits by their exact binary value, ties to even."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def half_even(x: Column, digits: int) -> Column:
    """The double next to the decimal of so many digits (0 to 22) that is nearest to the exact value of ``x``.

    2.675 lies a little below its decimal form, so two digits of it are 2.67.
    Null, NaN and infinite values stay, and so do those of 2^52 or more units of
    the last digit.
    """
    if not 0 <= digits <= 22:
        raise ValueError("digits have to be from 0 to 22")
    unit = float(10**digits)
    big = unit * 134217729.0
    unit_high = big - (big - unit)
    unit_low = unit - unit_high
    # the product and its error are exact together: both factors are split into halves of 26 bits
    p, c = x * unit, x * 134217729.0
    high = c - (c - x)
    low = x - high
    error = low * unit_low - (((p - high * unit_high) - low * unit_high) - high * unit_low)
    whole = F.floor(p)
    over = p - whole.cast("double")
    up = (over > 0.5) | ((over == 0.5) & ((error > 0.0) | ((error == 0.0) & (whole % 2 != 0))))
    return F.when(F.abs(p) < 2.0**52, (whole + F.when(up, 1).otherwise(0)).cast("double") / unit).otherwise(x)


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """``df`` with the columns named, or all doubles if none is, rounded."""
    chosen = columns or tuple(c for c, t in df.dtypes if t == "double")
    return df.withColumns({c: half_even(F.col(f"`{c}`"), digits) for c in chosen})
