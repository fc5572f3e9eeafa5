"""Numeric expressions with missing-value rules spelled out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def nan_to_null(col: Column) -> Column:
    return F.nanvl(col, F.lit(None).cast("double"))


def inf_to_null(col: Column) -> Column:
    return F.when(F.abs(col) == F.lit(float("inf")), F.lit(None).cast("double")).otherwise(nan_to_null(col))


def half_even_long(col: Column) -> Column:
    return F.bround(col, 0).cast("long")


def at_least(col: Column, low: float) -> Column:
    """Clip from below; null stays null (greatest() alone would skip it)."""
    return F.when(col.isNotNull(), F.greatest(col, F.lit(low)))


def clip(col: Column, low: float | None, high: float | None) -> Column:
    out = col
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(col.isNotNull(), out)


def log_target(price: Column) -> Column:
    return F.ln(at_least(price.cast("double"), 1.0))


def price_from_log(log_price: Column) -> Column:
    return F.bround(F.exp(log_price), 2)


def price_per_area(price: Column, area: Column) -> Column:
    return F.try_divide(price, area)


def bath_per_room(baths: Column, rooms: Column) -> Column:
    return F.try_divide(baths, rooms)
