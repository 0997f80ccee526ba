"""Product catalogue: stock and unit listings, conversion edges, id assignment,
product onboarding."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.ids import with_consecutive_ids
from ..session import work_dir
from .keys import split_duplicates
from .ladders import ladders, pairs, split_ladder_rows


def _only(df: DataFrame, product_ids) -> DataFrame:
    return df if product_ids is None else df.where(F.col("product_id").isin(list(product_ids)))


def stock_list(inventory: DataFrame, product_ids=None) -> DataFrame:
    """Stock and unit name per inventory row; ``product_ids`` narrows it to the
    products on screen (the filter reaches the scan)."""
    return _only(inventory, product_ids).select("product_id", "stock", "unit_size")


def size_list(unit_size: DataFrame, product_ids=None) -> DataFrame:
    """The unit choices (id, name) of each product."""
    return _only(unit_size, product_ids).select("product_id", "unit_id", "unit_size")


def conversion_edges(unit_size: DataFrame, product_ids=None, validated: bool = False) -> DataFrame:
    """Every (coarser, finer) unit pair of a product, quantities left blank.

    Instead of a self join on product with ``x.unit < y.unit``, the product's
    units are put into one sorted array of bounded length (``ladders``), whose
    pairs are read off by position: one grouping, no join of unit rows. The
    units may have any ids. Rows that repeat a (product, unit), lack one, or
    belong to a product with too many units get no edge; they are the
    ``edge_unit_rejects`` (``validated=True`` skips that check for a table known
    to be valid).
    """
    us = _only(unit_size, product_ids)
    if not validated:
        us = split_ladder_rows(us)[0]
    edges = ladders(us, "unit_size", "product_name").select("product_id", F.explode(pairs()).alias("e"))
    return edges.select(
        "product_id", F.col("e.coarse.product_name").alias("product_name"),
        F.col("e.coarse.unit_id").alias("original_unit_id"), F.col("e.coarse.unit_size").alias("original_unit_size"),
        F.lit(None).cast("double").alias("original_quantity"),
        F.col("e.fine.unit_id").alias("convert_unit_id"), F.col("e.fine.unit_size").alias("convert_unit_size"),
        F.lit(None).cast("double").alias("convert_quantity"))


def edge_unit_rejects(unit_size: DataFrame, product_ids=None) -> DataFrame:
    """The unit rows that get no conversion edge: see ``conversion_edges``."""
    return split_ladder_rows(_only(unit_size, product_ids))[1]


def next_ids(product: DataFrame, inventory: DataFrame) -> DataFrame:
    """One row: the next free product id and inventory id (max + 1, an empty
    table counts as max 0). One global aggregate over a union of both id
    columns; partial max per task, one row to the final stage."""
    ids = product.select(F.col("product_id").alias("pid"), F.lit(None).cast("long").alias("iid")).unionByName(
        inventory.select(F.lit(None).cast("long").alias("pid"), F.col("inventory_id").alias("iid")))
    return ids.agg(
        (F.coalesce(F.max("pid"), F.lit(0)) + 1).cast("long").alias("next_product_id"),
        (F.coalesce(F.max("iid"), F.lit(0)) + 1).cast("long").alias("next_inventory_id"))


@dataclass
class Onboarding:
    product: DataFrame
    unit_size: DataFrame
    inventory: DataFrame
    size_conversion: DataFrame
    rejects: DataFrame


def onboard_products(new_products: DataFrame, product: DataFrame, inventory: DataFrame,
                     order_by: str = "form_order", reserve: Callable[[str, int, int], int] | None = None) -> Onboarding:
    """Add products from form rows (product_name, ball, half_ball, pack, roll
    flags, ``order_by``): new product ids above the current maximum in form
    order, one unit row per ticked unit, a zero-stock inventory row with its
    own id per unit, and the blank conversion edges between the units.

    A product with both PACK and ROLL ticked has two unit-3 rows: both go to
    ``rejects`` and get no inventory row or edge.

    Ids are dense and ordered but never pass through one task: see
    ``functions.ids.with_consecutive_ids``. Needs a checkpoint folder
    (``session.work_dir``).

    ``reserve`` (column, count, floor) gives the first id of a range that no
    other writer has (``IdRanges.reserve``): two onboardings at once then get
    disjoint ids. Only counts and first ids come to the driver for it. Without
    it the ids follow the tables' maxima as they are read here.
    """
    # Both offsets come from one scan of the product and inventory ids; the
    # offsets and the numbered products are checkpointed (to the shared
    # checkpoint folder), so the later steps reuse them instead of re-running
    # the scans, the range partitioning and the prefix sum.
    work_dir(product.sparkSession)  # the checkpoint folder (the session's, or a local one in tests)
    nxt = next_ids(product, inventory).checkpoint()

    def before(column: str, rows: DataFrame) -> DataFrame:
        """The last id before those of ``rows``."""
        free = nxt.select(F.col(f"next_{column}") - 1)
        if reserve is None:
            return free
        return nxt.select(F.lit(reserve(column, rows.count(), free.first()[0] + 1) - 1))

    prod = with_consecutive_ids(new_products, [order_by], "product_id", before("product_id", new_products)).checkpoint()
    units = F.array(*[
        F.when(F.col(flag), F.struct(F.lit(u).alias("unit_id"), F.lit(name).alias("unit_size")))
        for flag, (u, name) in zip(("ball", "half_ball", "pack", "roll"), (*S.UNIT_LADDER, S.ROLL_UNIT))])
    unit_rows = prod.select("product_id", "product_name",
                            F.explode(F.filter(units, lambda e: e.isNotNull())).alias("u")).select(
        "product_id", "product_name", F.col("u.unit_id").cast("int").alias("unit_id"),
        F.col("u.unit_size").alias("unit_size"))
    valid, rejects = split_duplicates(unit_rows, ["product_id", "unit_id"])
    valid = valid.checkpoint()
    inv = with_consecutive_ids(valid, ["product_id", "unit_id"], "inventory_id", before("inventory_id", valid)).select(
        "inventory_id", "product_id", "product_name", "unit_id", "unit_size", F.lit(0.0).alias("stock"))
    return Onboarding(
        product=prod.select("product_id", "product_name"),
        unit_size=valid.select(*S.UNIT_SIZE.fieldNames()),
        inventory=inv,
        size_conversion=conversion_edges(valid, validated=True),
        rejects=rejects,
    )
