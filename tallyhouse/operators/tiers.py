"""Volume discounts from a dated tier table instead of fixed values.

A tariff is the tiers of one validity period [valid_from, valid_to): half-open
quantity intervals [low, high) with three discounts, ``high`` and ``valid_to``
NULL for no end. A tariff is usable if its tiers, sorted, follow each other
without gap or overlap, and its period overlaps no other usable or unusable one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_TIERS = 256     # of one tariff
MAX_TARIFFS = 4096  # periods of the table: what is broadcast is bounded by both
PERIOD = ["valid_from", "valid_to"]
DISCOUNTS = ["discount1", "discount2", "discount3"]


def _sound(tiers: Column) -> Column:
    """Whether sorted tiers are proper intervals, each starting where the one
    before ends; only the last may have no end."""
    return F.forall(tiers, lambda t: t["low"].isNotNull() & (t["high"].isNull() | (t["low"] < t["high"]))) & F.forall(
        F.zip_with(F.slice(tiers, F.lit(2), F.size(tiers)), F.slice(tiers, F.lit(1), F.greatest(F.size(tiers) - 1, F.lit(0))),
                   lambda after, t: F.struct(after["low"].alias("low"), t["high"].alias("high"))),
        lambda x: F.coalesce(x["low"] == x["high"], F.lit(False)))


def tariffs(table: DataFrame) -> DataFrame:
    """(valid_from, valid_to, tiers, usable): a row for each period of the table.
    Tiers are collected only for periods that a count before found to have
    MAX_TIERS at most; the periods themselves, MAX_TARIFFS at most (else a
    ValueError), are compared in the order of their start."""
    counts = table.groupBy(*PERIOD).agg(F.count(F.lit(1)).alias("_n"))
    if counts.limit(MAX_TARIFFS + 1).count() > MAX_TARIFFS:
        raise ValueError(f"the tier table has more than {MAX_TARIFFS} periods")
    few = counts.where(F.col("_n") <= MAX_TIERS).select(F.struct(*PERIOD).alias("_period"))
    rows = table.withColumn("_period", F.struct(*PERIOD))
    held = rows.join(few, rows["_period"].eqNullSafe(few["_period"]), "left_semi")
    tiers = held.groupBy(*PERIOD).agg(F.sort_array(F.collect_list(F.struct("low", "high", *DISCOUNTS))).alias("tiers"))
    both = counts.alias("c").join(tiers.alias("t"), F.col("c.valid_from").eqNullSafe(F.col("t.valid_from")) & F.col("c.valid_to").eqNullSafe(F.col("t.valid_to")), "left") \
        .select("c.valid_from", "c.valid_to", "t.tiers")
    before = Window.orderBy("valid_from", "valid_to").rowsBetween(Window.unboundedPreceding, -1)  # MAX_TARIFFS rows at most
    after = Window.orderBy("valid_from", "valid_to").rowsBetween(1, Window.unboundedFollowing)
    last = F.lit("9999-12-31").cast("timestamp_ntz")
    end = F.coalesce(F.col("valid_to"), last)
    proper = F.col("valid_from").isNotNull() & (F.col("valid_from") < end)
    free = F.coalesce(F.max(F.when(proper, end)).over(before) <= F.col("valid_from"), F.lit(True)) & F.coalesce(
        F.min(F.when(proper, F.col("valid_from"))).over(after) >= end, F.lit(True))
    return both.withColumn("usable", proper & free & F.coalesce(_sound(F.col("tiers")), F.lit(False)))


def split_tiers(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of usable tariffs, rejects: all rows of the others)."""
    usable = tariffs(table).where("usable").select(F.struct(*PERIOD).alias("_period"))
    rows = table.withColumn("_period", F.struct(*PERIOD))
    same = rows["_period"].eqNullSafe(usable["_period"])
    return rows.join(usable, same, "left_semi").drop("_period"), rows.join(usable, same, "left_anti").drop("_period")


def discounts_of(base: DataFrame, table: DataFrame, date: str = "invoice_date") -> DataFrame:
    """``base`` (with base_quantity and a date) and its three discounts: those of
    the tier that holds the quantity in the tariff valid at the date; 0 where
    there is none. NULL quantities count as 0.

    The usable tariffs are one row, bounded by MAX_TARIFFS and MAX_TIERS, a scalar
    subquery; each row of ``base`` finds its tariff and tier among sorted
    breakpoints: the rows are neither shuffled nor multiplied."""
    one = tariffs(table).where("usable").agg(F.sort_array(F.collect_list(F.struct("valid_from", "valid_to", "tiers"))).alias("_tariffs"))
    quantity = F.coalesce(F.col("base_quantity"), F.lit(0.0))

    def last_from(items: Column, field: str, value: Column) -> Column:
        """The last of sorted items that starts at the value or below."""
        return F.get(items, F.size(F.filter(items, lambda x: x[field] <= value)) - 1)

    tariff = last_from(F.col("_tariffs"), "valid_from", F.col(date))
    tier = last_from(F.col("_tariff.tiers"), "low", quantity)
    found = (base.withColumn("_tariffs", one.scalar()).withColumn("_tariff", tariff).withColumn("_tier", tier)
             .withColumn("_in", F.coalesce((F.col("_tariff.valid_to").isNull() | (F.col(date) < F.col("_tariff.valid_to")))
                                           & (F.col("_tier.high").isNull() | (quantity < F.col("_tier.high"))) & F.col("_tier").isNotNull(), F.lit(False))))
    return found.select(*base.columns, *[F.coalesce(F.when(F.col("_in"), F.col(f"_tier.{d}")), F.lit(0.0)).alias(d) for d in DISCOUNTS])
