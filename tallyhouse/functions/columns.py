"""Column expressions shared by the operators. All are built-in Spark SQL
functions, so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S


def add_days_hours(ts: Column, days: Column, hours: Column) -> Column:
    """ts + days + hours on TIMESTAMP_NTZ (hours may be negative)."""
    return ts + F.make_dt_interval(days.cast("int"), hours.cast("int"))


def line_total(price: Column, quantity: Column) -> Column:
    """price x quantity in exact decimals (quantities to four places)."""
    return (price * quantity.cast("decimal(14,4)")).cast(S.MONEY)


def whole_days(start: Column, end: Column) -> Column:
    """Whole days from start to end, truncated toward zero (a fractional day
    difference cast to int); not a count of midnights."""
    return F.timestamp_diff("DAY", start, end).cast("int")


def per_unit(value: Column, original_quantity: Column, convert_quantity: Column) -> Column:
    """A quantity of a coarse unit expressed in a finer unit: a missing edge or a
    blank quantity counts as factor 1."""
    return value / F.coalesce(original_quantity, F.lit(1.0)) * F.coalesce(convert_quantity, F.lit(1.0))


def tier_discounts(base_quantity: Column) -> list[Column]:
    """(discount1, discount2, discount3) for a base-unit quantity; NULL counts
    as 0 (no discount). Chained CASE over the half-open tiers."""
    q = F.coalesce(base_quantity, F.lit(0.0))
    out = []
    for i in range(3):
        expr = None
        for low, high, *d in S.DISCOUNT_TIERS:
            cond = (q >= low) if high is None else ((q >= low) & (q < high))
            expr = F.when(cond, F.lit(float(d[i]))) if expr is None else expr.when(cond, F.lit(float(d[i])))
        out.append(expr.otherwise(F.lit(0.0)))
    return out


def chained_net(gross: Column, d1: Column, d2: Column, d3: Column, third_tier: str = "repeat") -> Column:
    """Net price after the three discounts, applied one after the other.
    ``third_tier="repeat"`` charges discount 2 a second time (the price the
    original application charges); ``"own"`` applies discount 3."""
    p1 = gross - d1 * gross
    p2 = p1 - d2 * p1
    third = d2 if third_tier == "repeat" else d3
    return p2 - third * p2
