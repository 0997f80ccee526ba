"""Reports: invoice detail lines, invoice terms, histories, name lookups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.columns import whole_days
from .keys import split_duplicates


def invoice_detail(selection: DataFrame, txn: DataFrame) -> DataFrame:
    """All transaction lines of the selected invoices (a DataFrame with an
    ``invoice_id`` column, e.g. rows picked in a grid). Semi join: a selected
    id listed twice does not repeat its lines."""
    return txn.join(selection.select("invoice_id"), "invoice_id", "left_semi").select(*txn.columns)


def invoice_detail_between(selection: DataFrame, txn: DataFrame) -> DataFrame:
    """``invoice_detail`` for a selection of neighbouring ids (a page of a grid,
    a month): the selection's least and greatest id come to the driver and go to
    the scan as a range, so that files of a table in the order of its invoices
    (``TableStore.compact``) stay unread outside it. An empty selection has no
    lines."""
    ends = selection.agg(F.min("invoice_id").alias("least"), F.max("invoice_id").alias("greatest")).first()
    if ends["least"] is None:
        return txn.where(F.lit(False))
    return invoice_detail(selection, txn.where(F.col("invoice_id").between(ends["least"], ends["greatest"])))


def invoice_term_days(invoice: DataFrame, as_of: str | dt.datetime | None = None,
                      status: str = S.STATUS_INVOICE) -> DataFrame:
    """Invoices of ``status`` with ``remaining_days``: whole days from invoice
    date to maturity (the term), or to ``as_of`` when there is no maturity
    (the age), truncated toward zero; sorted by it, NULL last."""
    now = F.current_date().cast("timestamp_ntz") if as_of is None else F.lit(as_of).cast("timestamp_ntz")
    days = F.when(F.col("maturity_date").isNull(), whole_days(F.col("invoice_date"), now)) \
        .otherwise(whole_days(F.col("invoice_date"), F.col("maturity_date")))
    return (invoice.where(F.col("status") == status).withColumn("remaining_days", days)
            .orderBy(F.col("remaining_days").asc_nulls_last(), F.col("invoice_id")))


def history(table: DataFrame) -> DataFrame:
    """The full table (purchase or transaction history listing)."""
    return table.select("*")


def enrich_lines(lines: DataFrame, product: DataFrame, unit_size: DataFrame) -> DataFrame:
    """Lines with product_name and unit_size looked up by id, one row for each
    line. A line without a catalogue entry keeps NULL names, and so does one
    whose catalogue key is repeated (``catalogue_rejects``): it cannot multiply
    the line.

    The catalogue becomes one row per product with a map from unit to name (as
    many entries as the product has units); the lines are scanned once and meet
    it in one left join on product. The join is a merge join: the catalogue grows
    with the ledger, and Spark would broadcast it by the size of its compressed
    files, a small part of what then passes through the driver."""
    one = F.count(F.lit(1)) == 1
    names = product.where(F.col("product_id").isNotNull()).groupBy("product_id").agg(F.when(one, F.min("product_name")).alias("_name"))
    units = (unit_size.where(F.col("product_id").isNotNull() & F.col("unit_id").isNotNull()).groupBy("product_id", "unit_id")
             .agg(F.when(one, F.min("unit_size")).alias("unit_size"))
             .groupBy("product_id").agg(F.map_from_entries(F.collect_list(F.struct("unit_id", "unit_size"))).alias("_units")))
    lookup = names.join(units, "product_id", "full")
    keep = [c for c in lines.columns if c not in ("product_name", "unit_size")]
    return lines.select(*keep).join(lookup.hint("merge"), "product_id", "left").select(
        *keep, F.col("_name").alias("product_name"), F.col("_units")[F.col("unit_id")].alias("unit_size"))


def catalogue_rejects(product: DataFrame, unit_size: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Product and unit rows whose key is repeated or incomplete."""
    return split_duplicates(product, ["product_id"])[1], split_duplicates(unit_size, ["product_id", "unit_id"])[1]
