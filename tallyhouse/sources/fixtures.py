"""Domain tables derived from the driver's TPC-H-like parquet tables.

The mapping is the one written down in FIXTURES.md section 2. Every table is a
lazy DataFrame over the parquet scans, so Catalyst prunes unused columns and
pushes filters into the scans. The registered queries do not run on these
views directly: ``sources.ledger`` writes them once into the ledger's table
store and the queries read the stored tables. Two tables also come in a lean
form without name lookups (``txn_lines``, ``invoice_core``), exact column
subsets of ``txn`` / ``invoice`` that spare the lookup joins for direct use.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.catalogue import conversion_edges
from ..functions.columns import add_days_hours, line_total

# Reference moment of the driver data: the day after the last order.
AS_OF = "2001-08-02 00:00:00"


def _ladder_structs() -> Column:
    return F.array(*[F.struct(F.lit(u).alias("unit_id"), F.lit(n).alias("unit_name"))
                     for u, n in S.UNIT_LADDER])


class Ledger:
    """The eight ledger tables (plus input batches) over one driver folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def driver(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ---- catalogue ---------------------------------------------------------
    @cached_property
    def product(self) -> DataFrame:
        return self.driver("part").select(
            F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"))

    @cached_property
    def unit_size(self) -> DataFrame:
        """part x unit ladder; unit 2 is absent when p_size % 10 = 0 and unit 3
        is called 'ROLL BALL' for PROMO parts. Built with explode, no join."""
        p = self.driver("part").select("p_partkey", "p_name", "p_type", "p_size")
        u = p.select("*", F.explode(_ladder_structs()).alias("u"))
        return u.where(~((F.col("u.unit_id") == 2) & (F.col("p_size") % 10 == 0))).select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("u.unit_id").cast("int").alias("unit_id"),
            F.when((F.col("u.unit_id") == S.ROLL_UNIT[0]) & (F.col("p_type") == "PROMO"),
                   F.lit(S.ROLL_UNIT[1])).otherwise(F.col("u.unit_name")).alias("unit_size"),
        )

    @cached_property
    def size_conversion(self) -> DataFrame:
        e = conversion_edges(self.unit_size)
        p = F.col("product_id")
        o, c = F.col("original_unit_id"), F.col("convert_unit_id")
        step = (F.lit(4) + p % 3).cast("double")
        conv = (F.when(p % 97 == 0, F.lit(None).cast("double"))
                .when((o == 1) & (c == 2), F.lit(2.0))
                .when((o == 2) & (c == 3), step)
                .otherwise(F.lit(2.0) * step))
        return e.withColumn(
            "original_quantity", F.when(p % 89 == 0, F.lit(None).cast("double")).otherwise(F.lit(1.0))
        ).withColumn("convert_quantity", conv).select(*S.SIZE_CONVERSION.fieldNames())

    @cached_property
    def inventory(self) -> DataFrame:
        p, u = F.col("product_id"), F.col("unit_id")
        stock = (F.when(u == 1, F.lit(60) + p % 41).when(u == 2, p % 53).otherwise(p % 37)).cast("double")
        return self.unit_size.select(
            (p * 3 + u).cast("long").alias("inventory_id"), "product_id", "product_name",
            "unit_id", "unit_size", stock.alias("stock"))

    # ---- transactions --------------------------------------------------------
    @cached_property
    def txn_lines(self) -> DataFrame:
        """Transaction lines without name or price lookups."""
        li = self.driver("lineitem")
        ttype = F.when(F.col("l_returnflag") == "R", F.lit(S.TXN_IN)).otherwise(F.lit(S.TXN_OUT))
        return li.select(
            F.concat_ws("_", ttype, F.col("l_partkey").cast("string"), F.col("l_orderkey").cast("string"),
                        F.col("l_linenumber").cast("string")).alias("transaction_id"),
            F.col("l_orderkey").alias("invoice_id"),
            F.col("l_partkey").alias("product_id"),
            ttype.alias("txn_type"),
            F.col("l_quantity").alias("quantity"),
            (F.col("l_linenumber") % 3 + 1).cast("int").alias("unit_id"),
        )

    @cached_property
    def txn(self) -> DataFrame:
        """Full transaction table: one lookup join with part gives the product
        name, the price and the unit name (the unit rule of ``unit_size``)."""
        part = self.driver("part").select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
        t = self.txn_lines.join(part, F.col("product_id") == F.col("p_partkey"), "left")
        u = F.col("unit_id")
        usize = (F.when(F.col("p_partkey").isNull(), F.lit(None).cast("string"))
                 .when(u == 1, F.lit(S.UNIT_LADDER[0][1]))
                 .when(u == 2, F.when(F.col("p_size") % 10 != 0, F.lit(S.UNIT_LADDER[1][1])))
                 .when(F.col("p_type") == "PROMO", F.lit(S.ROLL_UNIT[1]))
                 .otherwise(F.lit(S.UNIT_LADDER[2][1])))
        price = F.col("p_retailprice").cast(S.MONEY)
        return t.select(
            "transaction_id", "invoice_id", "product_id", F.col("p_name").alias("product_name"),
            "txn_type", "quantity", "unit_id", usize.alias("unit_size"), price.alias("price"),
            line_total(price, F.col("quantity")).alias("total_price"),
        )

    @cached_property
    def purchase(self) -> DataFrame:
        return self.txn.where(F.col("txn_type") == S.TXN_IN).select(
            F.col("transaction_id").alias("purchase_id"), "product_id", "product_name", "txn_type",
            "quantity", "unit_id", "unit_size", "total_price")

    # ---- invoices ------------------------------------------------------------
    @cached_property
    def _invoice_base(self) -> DataFrame:
        o = self.driver("orders")
        k = F.col("o_orderkey")
        status = (F.when(F.col("o_orderstatus") == "P", F.lit(S.STATUS_PROCESS))
                  .when(F.col("o_orderstatus") == "O", F.lit(S.STATUS_INVOICE))
                  .when(F.col("o_orderstatus") == "F",
                        F.when(k % 3 == 0, F.lit(S.STATUS_CANCELLED)).otherwise(F.lit(S.STATUS_PAID))))
        maturity = F.when(k % 11 == 0, F.lit(None).cast("timestamp_ntz")).otherwise(
            add_days_hours(F.col("o_orderdate"), k % 90, k % 24 - 12))
        return o.select(
            k.alias("invoice_id"),
            add_days_hours(F.col("o_orderdate"), F.lit(0), F.col("o_custkey") % 24).alias("invoice_date"),
            maturity.alias("maturity_date"),
            status.alias("status"),
            F.col("o_totalprice").alias("price"),
            (k % 2).cast("int").alias("is_process"),
            F.lit(0.0).alias("discount1"), F.lit(0.0).alias("discount2"), F.lit(0.0).alias("discount3"),
            F.col("o_totalprice").alias("final_price"),
            F.col("o_custkey"),
        )

    @cached_property
    def invoice_core(self) -> DataFrame:
        """Invoice headers without the vendor lookup."""
        return self._invoice_base.drop("o_custkey")

    @cached_property
    def invoice(self) -> DataFrame:
        c = self.driver("customer").select("c_custkey", "c_name")
        return self._invoice_base.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select(
            *[F.col("c_name").alias("vendor") if f == "vendor" else F.col(f) for f in S.INVOICE.fieldNames()])

    # ---- users -------------------------------------------------------------
    @cached_property
    def users(self) -> DataFrame:
        c = self.driver("customer")
        return c.select(
            F.lower("c_name").alias("email"), F.sha2(F.col("c_name"), 256).alias("password"),
            (F.col("c_nationkey") % 2).cast("int").alias("approved"))

    @cached_property
    def users_incoming(self) -> DataFrame:
        c = self.driver("customer")
        known = F.lower("c_name")
        return c.select(
            F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("new."), known)).otherwise(known).alias("email"), F.sha2(F.col("c_name"), 256).alias("password"),
            F.lit(0).alias("approved"))

    @cached_property
    def login_attempts(self) -> DataFrame:
        c = self.driver("customer")
        plain = F.when(F.col("c_custkey") % 10 == 0, F.col("c_name")).otherwise(F.lit("wrong"))
        return c.select(
            F.lower("c_name").alias("email"), plain.alias("password_plain"))

    # ---- onboarding input (the product form, one row per new product) ------
    @cached_property
    def new_products(self) -> DataFrame:
        s = self.driver("supplier")
        k = F.col("s_suppkey")
        return s.select(
            F.col("s_name").alias("product_name"),
            (k % 2 == 0).alias("ball"), (k % 3 == 0).alias("half_ball"),
            ((F.col("s_nationkey") != 0) | (k % 7 == 0)).alias("pack"),
            ((F.col("s_nationkey") == 0) | (k % 7 == 0)).alias("roll"),
            k.alias("form_order"))

    # ---- drafts (input of invoice building, one row per draft line) ---------
    @cached_property
    def draft_lines(self) -> DataFrame:
        """OUT lines as drafts: (invoice_id, line_no, product_id, txn_type,
        quantity, unit_id, price). The parts are as many as the ledger has
        products: they are merged with the lines and never broadcast."""
        part = self.driver("part").select("p_partkey", "p_retailprice").hint("merge")
        li = self.driver("lineitem").where(F.col("l_returnflag") != "R")
        return li.join(part, F.col("l_partkey") == F.col("p_partkey"), "left").select(
            F.col("l_orderkey").alias("invoice_id"), F.col("l_linenumber").alias("line_no"),
            F.col("l_partkey").alias("product_id"), F.lit(S.TXN_OUT).alias("txn_type"),
            F.col("l_quantity").alias("quantity"), (F.col("l_linenumber") % 3 + 1).cast("int").alias("unit_id"),
            F.col("p_retailprice").alias("price"))

    @cached_property
    def draft_headers(self) -> DataFrame:
        """(invoice_id, vendor, invoice_date, maturity_days) per order; the
        customers, which grow with the orders, are merged with them."""
        c = self.driver("customer").select("c_custkey", "c_name").hint("merge")
        o = self.driver("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select(
            F.col("o_orderkey").alias("invoice_id"), F.col("c_name").alias("vendor"),
            F.col("o_orderdate").alias("invoice_date"), (F.col("o_orderkey") % 90).cast("int").alias("maturity_days"))

    @cached_property
    def purchase_entries(self) -> DataFrame:
        """Purchase form entries: the IN lines with their total price."""
        t = self.txn.where(F.col("txn_type") == S.TXN_IN)
        return t.select(F.col("transaction_id").alias("purchase_id"), "product_id", "quantity", "unit_id",
                        "total_price")
