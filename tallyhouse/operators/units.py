"""Quantities expressed in one unit: stock or demand summed per product in the
finest unit (the sufficiency gate), and the stock of a product available in
each of its units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.columns import per_unit
from .keys import split_duplicates
from .ladders import KEY, ladders, split_ladder_rows


def unique_edges(conversion: DataFrame, keys: list[str]) -> DataFrame:
    """One row per ``keys`` (the join keys the edges are used on), so that a
    repeated key cannot multiply the rows it is joined to. An edge that stands
    more than once is invalid: ``ambiguous`` is set and no quantity is taken
    from it (its rows are ``edge_rejects``). A hash aggregate grouped on the
    join keys: the join needs no further exchange for this side."""
    one = F.count(F.lit(1)) == 1
    return conversion.groupBy(*keys).agg(F.when(one, F.min("original_quantity")).alias("original_quantity"),
                                         F.when(one, F.min("convert_quantity")).alias("convert_quantity"),
                                         (~one).alias("ambiguous"))


def edge_rejects(conversion: DataFrame) -> DataFrame:
    """Edges whose (product, from unit, to unit) is repeated or incomplete."""
    return split_duplicates(conversion, ["product_id", "original_unit_id", "convert_unit_id"])[1]


def _known_sum(value: Column) -> Column:
    """The sum, NULL as soon as one row needs an ambiguous edge."""
    return F.when(~F.coalesce(F.bool_or("ambiguous"), F.lit(False)), F.sum(value))


def in_unit(quantities: DataFrame, conversion: DataFrame, value: str, alias: str,
            target_unit: int = S.FINEST_UNIT) -> DataFrame:
    """(product_id, alias): sum over a product's (unit, value) rows of value
    converted into ``target_unit`` through the direct edge unit -> target
    (a missing edge or blank quantity counts as factor 1; NULL where a row
    needs an edge that is ambiguous, which the gate takes as insufficient).

    The target unit is applied to the edge table *before* the left join (the
    literal of the original ON clause), so rows without an edge survive.
    """
    edges = unique_edges(conversion.where(F.col("convert_unit_id") == target_unit)
                         .withColumnRenamed("original_unit_id", "unit_id"), ["product_id", "unit_id"])
    joined = quantities.select("product_id", "unit_id", value).join(edges, ["product_id", "unit_id"], "left")
    return joined.groupBy("product_id").agg(
        _known_sum(per_unit(F.col(value), F.col("original_quantity"), F.col("convert_quantity"))).alias(alias))


def stock_in_packs(inventory: DataFrame, conversion: DataFrame) -> DataFrame:
    return in_unit(inventory, conversion, "stock", "stock_pack")


def demand_in_packs(demand: DataFrame, conversion: DataFrame) -> DataFrame:
    return in_unit(demand, conversion, "quantity", "pack_buy")


def available_in_unit(inventory: DataFrame, conversion: DataFrame, unit_size: DataFrame) -> DataFrame:
    """(product_id, unit_id, available): for every unit a product offers, its
    stock in that unit plus every coarser unit's stock converted through the
    direct edge (coarser -> that unit). NULL when no such stock row exists, and
    for the unit rows of ``available_rejects``.

    The units a product offers are one array of bounded length (``ladders``),
    by which each inventory row is spread to the units at or below its own: the
    non-equi condition ``x.unit <= target`` becomes an equi join on (product,
    target), whatever the ids are; no pairs of a product are formed.
    """
    offered = unit_size.where(F.col("product_id").isNotNull() & F.col("unit_id").isNotNull()).select(*KEY).distinct()
    targets = ladders(split_ladder_rows(offered)[0])
    expanded = (inventory.select("product_id", F.col("unit_id").alias("from_unit"), "stock").join(targets, "product_id")
                .select("product_id", "from_unit", "stock", F.explode(F.filter(F.col("ladder.unit_id"), lambda v: v >= F.col("from_unit"))).alias("unit_id")))
    edges = unique_edges(conversion.withColumnRenamed("original_unit_id", "from_unit")
                         .withColumnRenamed("convert_unit_id", "unit_id"), ["product_id", "from_unit", "unit_id"])
    sums = (expanded.join(edges, ["product_id", "from_unit", "unit_id"], "left")
            .groupBy("product_id", "unit_id")
            .agg(_known_sum(per_unit(F.col("stock"), F.col("original_quantity"),
                                     F.col("convert_quantity"))).alias("available")))
    return unit_size.select("product_id", "unit_id").join(sums, ["product_id", "unit_id"], "left")


def available_rejects(unit_size: DataFrame) -> DataFrame:
    """Unit rows whose availability is not to be relied on: the key is repeated
    or incomplete, or the product has too many units (which get NULL)."""
    return split_ladder_rows(unit_size)[1]
