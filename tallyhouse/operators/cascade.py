"""Break-bulk cascade: post OUT demand against stock, opening coarser units
into finer ones when the finer unit runs short.

Rules, per product and inventory row (stock S, demand B, 0 when none), from
the finest unit up:

1. a row is *short* when B > S, for every unit above the base unit;
2. its *edge* is the conversion (unit - 1) -> unit of the product, with
   quantity q (an edge from any other unit does not count);
3. a short row gets S + m*q with m = ceil((B - S) / q); without an edge, or
   with a blank or zero q, its stock becomes NULL;
4. if the edge exists, the next coarser row (unit - 1) of the product gets
   B + m (NULL when m is NULL); a missing coarser row drops m.

The result is S - B for every inventory row, exactly once; demand for a
(product, unit) without an inventory row is dropped.

Plan: inventory rows, demand rows and adjacent edges are unioned and grouped
once by product, folded with ``aggregate`` over the units in descending order,
and exploded back to rows. No UDF. Every product group is bounded by the unit
ladder: inventory rows with a duplicate or missing (product, unit) key or a
unit off the ladder are not folded but pass through unchanged (they are the
rejects of ``keys.split_duplicates``); edges are reduced to one per (product,
unit), blank where ambiguous, and demand is taken per ladder unit before the grouping. A product hot
in the transaction lines arrives already summed (partial aggregate).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from .keys import split_duplicates
from .ladders import KEY, ladders, neighbours, split_ladder_rows

_OUT = T.StructType([
    T.StructField("inventory_id", T.LongType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("unit_id", T.IntegerType()),
    T.StructField("unit_size", T.StringType()),
    T.StructField("stock", T.DoubleType()),
])


_LADDER = [u for u, _ in S.UNIT_LADDER]


def adjacent_edges(conversion: DataFrame) -> DataFrame:
    """(product_id, unit_id, q): the edge (unit - 1) -> unit of each product,
    one per (product, unit). The quantity of an edge that stands more than once
    is taken as blank: no factor is made up, a short row's stock becomes NULL."""
    e = conversion.where((F.col("original_unit_id") == F.col("convert_unit_id") - 1)
                         & F.col("convert_unit_id").isin(_LADDER) & F.col("product_id").isNotNull())
    return e.groupBy("product_id", F.col("convert_unit_id").alias("unit_id")).agg(
        F.when(F.count(F.lit(1)) == 1, F.min("convert_quantity")).alias("q"))


# The fold, as one SQL expression (parsed once on the JVM side; building it
# column by column from Python costs a round trip per node). Per element x
# (finest unit first) with accumulator acc = (out rows, next_unit, m):
#   buy   = demand of x, plus acc.m when x is the unit acc.next_unit points at
#   short = x is above the base unit and buy > stock
#   m     = ceil((buy - stock) / q); stock' = (short ? stock + m*q : stock) - buy
#   next_unit = x.unit_id - 1 when short and the adjacent edge exists
_ELEMS = """sort_array(transform(inv, x -> named_struct(
    'unit_id', x.unit_id, 'inventory_id', x.inventory_id, 'product_name', x.product_name,
    'unit_size', x.unit_size, 'stock', x.stock,
    'buy', coalesce(get(filter(dem, d -> d.unit_id = x.unit_id), 0).buy, 0D),
    'has_edge', exists(edg, e -> e.unit_id = x.unit_id),
    'q', get(filter(edg, e -> e.unit_id = x.unit_id), 0).q)), false)"""
_BUY = "if(acc.next_unit <=> x.unit_id, x.buy + acc.m, x.buy)"
_SHORT = f"(x.unit_id > {S.BASE_UNIT} AND coalesce({_BUY} > x.stock, false))"
_M = f"cast(ceil(try_divide({_BUY} - x.stock, x.q)) AS double)"
_STOCK = f"if({_SHORT}, x.stock + {_M} * x.q, x.stock) - {_BUY}"
_FOLD = f"""aggregate(elems,
    named_struct('out', cast(array() AS array<{_OUT.simpleString()}>),
                 'next_unit', cast(NULL AS int), 'm', cast(NULL AS double)),
    (acc, x) -> named_struct(
        'out', array_append(acc.out, named_struct(
            'inventory_id', x.inventory_id, 'product_name', x.product_name, 'unit_id', x.unit_id,
            'unit_size', x.unit_size, 'stock', {_STOCK})),
        'next_unit', if({_SHORT} AND x.has_edge, x.unit_id - 1, NULL),
        'm', {_M}),
    acc -> acc.out)"""


def cascade_rows(inventory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows the cascade folds, rows it passes through unchanged)."""
    return split_duplicates(inventory, ["product_id", "unit_id"], F.col("unit_id").isin(_LADDER))


def stock_cascade(inventory: DataFrame, conversion: DataFrame, demand: DataFrame,
                  validated: bool = False) -> DataFrame:
    """Inventory after posting ``demand`` (product_id, unit_id, quantity).

    Output: inventory_id, product_id, product_name, unit_id, unit_size, stock;
    every inventory row exactly once. ``validated=True`` states that
    ``inventory`` already holds only the rows ``cascade_rows`` would fold
    (``post_invoices`` checks them itself), which skips the key check.
    """
    passed = None
    if not validated:
        inventory, passed = cascade_rows(inventory)
    p = F.col("product_id")
    demand = demand.where(p.isNotNull() & F.col("unit_id").isin(_LADDER)) \
        .groupBy("product_id", "unit_id").agg(F.sum("quantity").alias("quantity"))
    inv = inventory.select(p, F.struct(
        F.col("unit_id").cast("int").alias("unit_id"), "inventory_id", "product_name", "unit_size",
        F.col("stock").cast("double").alias("stock")).alias("inv"))
    dem = demand.select(p, F.struct(
        F.col("unit_id").cast("int").alias("unit_id"), F.col("quantity").cast("double").alias("buy")).alias("dem"))
    edg = adjacent_edges(conversion).select(p, F.struct(
        F.col("unit_id").cast("int").alias("unit_id"), F.col("q").cast("double").alias("q")).alias("edg"))

    grouped = (inv.unionByName(dem, allowMissingColumns=True)
               .unionByName(edg, allowMissingColumns=True)
               .groupBy("product_id")
               .agg(F.collect_list("inv").alias("inv"), F.collect_list("dem").alias("dem"),
                    F.collect_list("edg").alias("edg"))
               .where(F.size("inv") > 0))

    folded = grouped.select("product_id", F.expr(_ELEMS).alias("elems")) \
        .select("product_id", F.explode(F.expr(_FOLD)).alias("r"))
    out = folded.select(
        F.col("r.inventory_id").alias("inventory_id"), "product_id",
        F.col("r.product_name").alias("product_name"), F.col("r.unit_id").alias("unit_id"),
        F.col("r.unit_size").alias("unit_size"), F.col("r.stock").alias("stock"))
    if passed is not None:
        out = out.unionByName(passed.select(*out.columns))
    return out


# The fold over a product's own ladder: ``coarser`` is the unit next above x in the product's array (NULL for its
# coarsest, which is never short), ``has_edge`` and ``q`` belong to the edge coarser -> x
_OWN_ELEMS = """transform(rungs, (x, i) -> named_struct(
    'unit_id', x.unit_id, 'inventory_id', x.inventory_id, 'product_name', x.product_name,
    'unit_size', x.unit_size, 'stock', x.stock, 'coarser', get(rungs, i + 1).unit_id,
    'buy', coalesce(get(filter(dem, d -> d.unit_id = x.unit_id), 0).buy, 0D),
    'has_edge', exists(edg, e -> e.unit_id = x.unit_id),
    'q', get(filter(edg, e -> e.unit_id = x.unit_id), 0).q))"""
_OWN_SHORT = f"(x.coarser IS NOT NULL AND coalesce({_BUY} > x.stock, false))"
_OWN_FOLD = _FOLD.replace(_SHORT, _OWN_SHORT).replace("x.unit_id - 1", "x.coarser")


def cascade_own_ladders(inventory: DataFrame, conversion: DataFrame, demand: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inventory after the demand, rejects): ``stock_cascade`` where a product's
    ladder is the list of its own units, of any ids and depth; the next coarser
    unit is the one before it in the list, not ``unit - 1``. (A product with the
    units 1 and 3 opens balls into packs here and does not there.)

    Rejects are inventory rows off the ladders (key repeated or incomplete, or
    more than ``MAX_UNITS`` units); they pass through unchanged. Demand
    and edges meet the ladder's keys first, so that what is collected for a
    product is bounded by its ladder, whatever units lines and edges name."""
    valid, rejects = split_ladder_rows(inventory)
    rungs = ladders(valid, "inventory_id", "product_name", "unit_size", F.col("stock").cast("double").alias("stock"))
    need = (demand.where(F.col("product_id").isNotNull()).groupBy(*KEY).agg(F.sum("quantity").cast("double").alias("buy"))
            .join(valid.select(*KEY), KEY, "left_semi"))
    steps = ladders(valid).select("product_id", F.explode(neighbours()).alias("e")).select(
        "product_id", F.col("e.coarse.unit_id").alias("original_unit_id"), F.col("e.fine.unit_id").alias("convert_unit_id"))
    factors = conversion.groupBy("product_id", "original_unit_id", "convert_unit_id").agg(
        F.when(F.count(F.lit(1)) == 1, F.min("convert_quantity")).cast("double").alias("q"))
    edges = factors.join(steps, ["product_id", "original_unit_id", "convert_unit_id"], "left_semi")
    dem = need.groupBy("product_id").agg(F.collect_list(F.struct("unit_id", "buy")).alias("dem"))
    edg = edges.groupBy("product_id").agg(F.collect_list(F.struct(F.col("convert_unit_id").alias("unit_id"), "q")).alias("edg"))
    grouped = (rungs.withColumn("rungs", F.reverse("ladder")).join(dem, "product_id", "left").join(edg, "product_id", "left")
               .withColumns({"dem": F.coalesce("dem", F.array().cast("array<struct<unit_id:int,buy:double>>")),
                             "edg": F.coalesce("edg", F.array().cast("array<struct<unit_id:int,q:double>>"))}))
    folded = grouped.select("product_id", F.expr(_OWN_ELEMS).alias("elems")).select("product_id", F.explode(F.expr(_OWN_FOLD)).alias("r"))
    out = folded.select("r.inventory_id", "product_id", "r.product_name", "r.unit_id", "r.unit_size", "r.stock")
    return out.unionByName(rejects.select(*out.columns)), rejects
