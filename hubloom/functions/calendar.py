"""Week arithmetic and seasonal terms."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def week_start(ts: Column) -> Column:
    """Monday of the Monday-to-Sunday week that contains `ts`, as a DATE."""
    day = ts.cast("date")
    return F.date_sub(day, F.weekday(day))


def weeks_since(week: Column, origin: Column) -> Column:
    return F.datediff(week, origin) / F.lit(7.0)


def seasonal_terms(week: Column, orders: tuple[int, ...] = (1, 2), period: int = 52) -> dict[str, Column]:
    """Fourier terms of the ISO week of the year: sin1, cos1, sin2, cos2, ..."""
    iso_week = F.weekofyear(week).cast("double")
    terms: dict[str, Column] = {}
    for k in orders:
        angle = F.lit(2.0 * math.pi * k) * iso_week / F.lit(float(period))
        terms[f"sin{k}"] = F.sin(angle)
        terms[f"cos{k}"] = F.cos(angle)
    return terms
