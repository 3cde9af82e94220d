"""Rounding and safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_half_up(value: Column, digits: int) -> Column:
    """Half-up rounding in plain double arithmetic.

    `round` works on the decimal text of a double in Spark and on its binary value
    elsewhere; this form gives the same double in every engine.
    """
    scale = float(10 ** digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def non_negative(value: Column) -> Column:
    return F.greatest(value, F.lit(0.0))


def saving_pct(current: Column, optimised: Column) -> Column:
    return F.lit(100.0) * (current - optimised) / F.nullif(current, F.lit(0.0))
