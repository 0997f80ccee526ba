"""Invoice building: draft lines become transaction rows, draft headers become
invoices with gross price, volume-tier discounts, net price and maturity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.columns import add_days_hours, chained_net, line_total, tier_discounts
from .reports import enrich_lines


def draft_totals(lines: DataFrame) -> DataFrame:
    """(invoice_id, gross, base_quantity) in one grouped pass over the lines:
    gross = sum of line totals (exact decimal sum, then double), base quantity
    = summed quantity of base-unit lines (NULL when there is none)."""
    return lines.groupBy("invoice_id").agg(
        F.sum("total_price").cast("double").alias("gross"),
        F.sum(F.when(F.col("unit_id") == S.BASE_UNIT, F.col("quantity"))).alias("base_quantity"))


def base_unit_quantity(lines: DataFrame) -> DataFrame:
    return lines.groupBy("invoice_id").agg(
        F.sum(F.when(F.col("unit_id") == S.BASE_UNIT, F.col("quantity"))).alias("base_quantity"))


def discount_tier(base: DataFrame) -> DataFrame:
    """(invoice_id, base_quantity, discount1..3) from the base-unit quantity."""
    d1, d2, d3 = tier_discounts(F.col("base_quantity"))
    return base.select("invoice_id", "base_quantity", d1.alias("discount1"), d2.alias("discount2"),
                       d3.alias("discount3"))


def invoice_pricing(lines: DataFrame, third_tier: str = "repeat") -> DataFrame:
    """(invoice_id, gross, discount1..3, final_price) per draft invoice."""
    t = draft_totals(lines)
    d1, d2, d3 = tier_discounts(F.col("base_quantity"))
    t = t.select("invoice_id", "gross", d1.alias("discount1"), d2.alias("discount2"), d3.alias("discount3"))
    return t.withColumn("final_price", chained_net(F.col("gross"), F.col("discount1"), F.col("discount2"),
                                                   F.col("discount3"), third_tier))


def build_invoice_lines(drafts: DataFrame, product: DataFrame, unit_size: DataFrame) -> DataFrame:
    """Transaction rows from draft lines (invoice_id, line_no, product_id,
    txn_type, quantity, unit_id, price): a transaction id from the source keys,
    names looked up by id, total = price x quantity, rounded to cents once."""
    lines = drafts.select(
        F.concat_ws("_", F.col("txn_type"), F.col("product_id").cast("string"), F.col("invoice_id").cast("string"),
                    F.col("line_no").cast("string")).alias("transaction_id"),
        "invoice_id", "product_id", "txn_type", "quantity", "unit_id",
        F.col("price").cast(S.MONEY).alias("price"))
    lines = lines.withColumn("total_price", line_total(F.col("price"), F.col("quantity")))
    return enrich_lines(lines, product, unit_size).select(*S.TXN.fieldNames())


def build_invoices(headers: DataFrame, lines: DataFrame, third_tier: str = "repeat") -> tuple[DataFrame, DataFrame]:
    """(invoices, rejects) from draft headers (invoice_id, vendor,
    invoice_date, maturity_days) and their lines. New invoices have status
    PROCESS and is_process 0; a header with an empty vendor is rejected."""
    ok = F.col("vendor").isNotNull() & (F.trim(F.col("vendor")) != "")
    good, rejects = headers.where(ok), headers.where(~ok | F.col("vendor").isNull())
    priced = invoice_pricing(lines, third_tier)
    j = good.join(priced, "invoice_id", "left")
    gross = F.coalesce(F.col("gross"), F.lit(0.0))
    d = [F.coalesce(F.col(f"discount{i}"), F.lit(0.0)) for i in (1, 2, 3)]
    inv = j.select(
        "invoice_id", "invoice_date",
        add_days_hours(F.col("invoice_date"), F.col("maturity_days"), F.lit(0)).alias("maturity_date"),
        F.lit(S.STATUS_PROCESS).alias("status"), "vendor", gross.alias("price"), F.lit(0).alias("is_process"),
        d[0].alias("discount1"), d[1].alias("discount2"), d[2].alias("discount3"),
        chained_net(gross, d[0], d[1], d[2], third_tier).alias("final_price"))
    return inv, rejects


def build_purchase_rows(entries: DataFrame, product: DataFrame, unit_size: DataFrame) -> DataFrame:
    """Purchase history rows from purchase entries (purchase_id, product_id,
    quantity, unit_id, total_price): direction IN, names looked up by id."""
    rows = entries.withColumn("txn_type", F.lit(S.TXN_IN))
    return enrich_lines(rows, product, unit_size).select(*S.PURCHASE.fieldNames())
