"""Unprocessed demand and supply: transaction lines of invoices that have a
given status and are not processed yet, summed per (product, unit)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S


def open_invoices(invoice: DataFrame, status: str = S.STATUS_INVOICE) -> DataFrame:
    """Ids of invoices with ``status`` and ``is_process = 0``."""
    return invoice.where((F.col("status") == status) & (F.col("is_process") == 0)).select("invoice_id")


def unprocessed_lines(txn: DataFrame, invoice: DataFrame, txn_type: str = S.TXN_OUT,
                      status: str = S.STATUS_INVOICE) -> DataFrame:
    """Lines of direction ``txn_type`` that belong to open invoices.

    A left-semi join: the invoice side only filters, so a line never
    multiplies. Both filters reach the parquet scans; AQE broadcasts the
    invoice ids when they are small at run time, else sort-merges on
    invoice_id and splits a hot invoice across tasks (skew join).
    """
    lines = txn.where(F.col("txn_type") == txn_type)
    return lines.join(open_invoices(invoice, status), "invoice_id", "left_semi")


def demand(txn: DataFrame, invoice: DataFrame, txn_type: str = S.TXN_OUT,
           status: str = S.STATUS_INVOICE) -> DataFrame:
    """(product_id, unit_id, quantity): summed line quantities. The sum is
    partial per task before the shuffle, so a hot product costs one row per
    task, not its line count."""
    return (unprocessed_lines(txn.select("invoice_id", "product_id", "unit_id", "quantity", "txn_type"),
                              invoice, txn_type, status)
            .groupBy("product_id", "unit_id").agg(F.sum("quantity").alias("quantity")))
