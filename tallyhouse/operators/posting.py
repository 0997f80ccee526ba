"""Posting: the stock sufficiency gate, stock replenishment, the processed
flag, and end-to-end posting of invoices as one versioned commit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..session import work_dir
from ..sources.tables import TableStore
from .cascade import cascade_rows, stock_cascade
from .demand import demand
from .units import demand_in_packs, stock_in_packs


def stock_sufficiency(inventory: DataFrame, conversion: DataFrame, txn: DataFrame, invoice: DataFrame,
                      status: str = S.STATUS_INVOICE, parity: bool = False) -> DataFrame:
    """(product_id, stock_pack, pack_buy, truth_value) per product with open
    demand, both sides in the finest unit.

    Default: every product with demand is checked and missing stock is
    insufficient (left join from demand). ``parity=True`` keeps the original
    inner join, under which a product without stock escapes the check. A NULL
    comparison counts as insufficient either way.
    """
    return sufficiency_of(inventory, conversion, demand(txn, invoice, S.TXN_OUT, status), parity)


def sufficiency_of(inventory: DataFrame, conversion: DataFrame, open_demand: DataFrame,
                   parity: bool = False) -> DataFrame:
    """``stock_sufficiency`` for an already aggregated demand (product_id,
    unit_id, quantity)."""
    sp = stock_in_packs(inventory, conversion)
    dp = demand_in_packs(open_demand, conversion)
    j = sp.join(dp, "product_id", "inner") if parity else dp.join(sp, "product_id", "left")
    return j.select("product_id", "stock_pack", "pack_buy",
                    F.coalesce(F.col("stock_pack") >= F.col("pack_buy"), F.lit(False)).alias("truth_value"))


def sufficiency_gate(sufficiency: DataFrame) -> DataFrame:
    """One row, ``sufficient``: all products pass (true when none is checked)."""
    return sufficiency.agg(F.coalesce(F.bool_and("truth_value"), F.lit(True)).alias("sufficient"))


def is_sufficient(sufficiency: DataFrame) -> bool:
    """The gate's answer as a search for one product that fails: the tasks of
    the last stage start a few at a time (one, then four times as many), and
    none starts once a failing product is found. True without products. The
    demand must be summed before any product can be judged, so what is saved
    are the tasks that compare; ``sufficiency_gate`` is the same as a table."""
    return not sufficiency.where(~F.col("truth_value")).select(F.lit(1)).take(1)


def usable_rows(inventory: DataFrame) -> DataFrame:
    """(product_id, unit_id) of the inventory rows that stock can be posted to:
    the key is complete and held by one row. One grouped count."""
    return (inventory.where(F.col("product_id").isNotNull() & F.col("unit_id").isNotNull()).groupBy("product_id", "unit_id")
            .agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 1).select("product_id", "unit_id"))


def replenish(inventory: DataFrame, additions: DataFrame) -> DataFrame:
    """Inventory with ``additions`` (product_id, unit_id, quantity) added to the
    stock of the matching rows; other rows are unchanged. An addition without
    one usable row changes nothing: see ``unplaced``."""
    add = additions.groupBy("product_id", "unit_id").agg(F.sum("quantity").alias("_add"))
    add = add.join(usable_rows(inventory), ["product_id", "unit_id"], "left_semi")
    j = inventory.join(add, ["product_id", "unit_id"], "left")
    return j.select(*[
        (F.when(F.col("_add").isNotNull(), F.col("stock") + F.col("_add")).otherwise(F.col("stock"))
         .alias("stock") if c == "stock" else F.col(c)) for c in inventory.columns])


def unplaced(inventory: DataFrame, additions: DataFrame) -> DataFrame:
    """The additions that no stock can be posted for: (product, unit) stands in
    no or in several inventory rows, or the quantity is blank."""
    known = additions.join(usable_rows(inventory), ["product_id", "unit_id"], "left_anti").select(*additions.columns)
    blank = additions.where(F.col("quantity").isNull()).join(usable_rows(inventory), ["product_id", "unit_id"], "left_semi")
    return known.unionByName(blank.select(*additions.columns))


def replenish_in(inventory: DataFrame, txn: DataFrame, invoice: DataFrame,
                 status: str = S.STATUS_INVOICE) -> DataFrame:
    """Stock plus the IN lines of open invoices."""
    return replenish(inventory, demand(txn, invoice, S.TXN_IN, status))


def replenish_purchases(inventory: DataFrame, purchases: DataFrame) -> DataFrame:
    """Stock plus a batch of purchases (summed per product and unit first)."""
    return replenish(inventory, purchases.select("product_id", "unit_id", "quantity"))


def mark_processed(invoice: DataFrame, status: str = S.STATUS_INVOICE) -> DataFrame:
    """Set ``is_process = 1`` on every invoice with ``status``."""
    return invoice.withColumn(
        "is_process", F.when(F.col("status") == status, F.lit(1)).otherwise(F.col("is_process")).cast("int"))


def open_lines(txn: DataFrame, invoice: DataFrame, status: str = S.STATUS_INVOICE) -> DataFrame:
    """The OUT lines of open ``status`` invoices."""
    open_ids = invoice.where((F.col("status") == status) & (F.col("is_process") == 0)).select("invoice_id")
    return txn.where(F.col("txn_type") == S.TXN_OUT).join(open_ids, "invoice_id", "left_semi")


def unserved_lines(lines: DataFrame, valid: DataFrame) -> DataFrame:
    """Lines whose (product, unit) is no row of ``valid`` inventory: the unit is
    off the ladder, the row is missing, or its key is repeated. Posting cannot
    take their stock."""
    return lines.join(valid.select("product_id", "unit_id"), ["product_id", "unit_id"], "left_anti")


def with_statuses(invoice: DataFrame, statuses: DataFrame) -> DataFrame:
    """Invoices with the status that ``statuses`` (invoice_id, status; one row
    an invoice) gives them; the others as they are."""
    new = statuses.select("invoice_id", F.col("status").alias("_new_status"))
    return invoice.join(new, "invoice_id", "left").select(*[
        F.coalesce("_new_status", "status").alias("status") if c == "status" else F.col(c) for c in invoice.columns])


@dataclass
class Posting:
    committed: bool
    version: int
    reason: str
    rejects: DataFrame | None = None         # inventory rows that the cascade passes through
    unserved: DataFrame | None = None        # open lines without a usable inventory row


def _flagged(invoice: DataFrame, held: DataFrame | None, status: str) -> DataFrame:
    """``mark_processed``, but for the invoices held back."""
    if held is None:
        return mark_processed(invoice, status)
    flag = F.when(F.col("_held"), F.col("is_process")).when(F.col("status") == status, F.lit(1)).otherwise(F.col("is_process"))
    kept = held.withColumn("_held", F.lit(True))
    return invoice.join(kept, "invoice_id", "left").withColumn("is_process", flag.cast("int")).select(*invoice.columns)


def _in_folders(folders: set[tuple[str | None, ...]]) -> Column:
    """Whether an invoice lies in one of the (status, is_process) folders; a
    condition on folder columns only, so the scan opens no other folder."""
    test = F.lit(False)
    for status, flag in sorted(folders, key=str):
        test = test | (F.col("status").eqNullSafe(status) & F.col("is_process").eqNullSafe(None if flag is None else int(flag)))
    return test


def _rewrite(store: TableStore, changed: set[tuple[str | None, ...]], rows) -> dict[str, tuple[DataFrame, list[str]]]:
    """The rewrite of the invoices in the ``changed`` folders by ``rows``, a
    function of them; empty where no folder changes."""
    kept = [f for f, values in store.folders("invoice").items() if values not in changed]
    return {"invoice": (rows(store.read("invoice").where(_in_folders(changed))), kept)} if changed else {}


def post_invoices(store: TableStore, status: str = S.STATUS_INVOICE, parity: bool = False,
                  invoice: DataFrame | None = None, txn: DataFrame | None = None,
                  conversion: DataFrame | None = None, edits: DataFrame | None = None,
                  append: dict[str, DataFrame] | None = None, tag: str | None = None) -> Posting:
    """Post the open ``status`` invoices of the store: gate, cascade, mark.

    ``invoice`` is an edited invoice table (e.g. statuses changed in a grid)
    to post instead of the stored one; it is written with the posting, so a
    refused posting writes nothing, edits included. ``txn`` and ``conversion``
    are only read; they default to the store's tables. ``edits`` (invoice_id,
    status; one row an invoice) are status edits to the stored invoices that
    hold whether the posting is refused or not: they, the rows to ``append`` to
    other tables and the posting are one commit, under ``tag``.

    1. inventory rows with a duplicate or missing (product, unit) key or a unit
       off the ladder are set aside (they pass through unchanged and are
       returned as ``rejects``);
    2. open lines without a usable inventory row are returned as ``unserved``.
       Their invoices are held back whole: no line of theirs is posted and they
       stay unmarked (``parity`` posts their other lines and marks them, as the
       original does);
    3. the gate: ``parity`` checks ``PAID`` demand with the inner join, the
       default checks ``status`` demand with every product, and the search ends
       at the first product that fails (``is_sufficient``);
    4. new inventory (cascade) and invoices (flag) are staged under one
       version; unless ``parity``, a NULL or negative stock refuses the posting
       and drops what was staged. Of the invoices only the (status, is_process)
       folders with open or edited rows are read and written; the others are
       carried into the version as they are, so the bytes follow the open
       invoices and not the table (an edited table given as ``invoice`` is
       written whole);
    5. the commit marker switches both tables together.
    """
    if edits is not None and invoice is not None:
        raise ValueError("either an edited invoice table or edits to the stored one")
    inventory = store.read("inventory")
    conversion = store.read("size_conversion") if conversion is None else conversion
    txn = store.read("txn") if txn is None else txn
    whole, edited, append = invoice, set(), append or {}
    if invoice is None:
        invoice = store.read("invoice")
        if edits is not None:  # at most one row a folder comes back
            moved = invoice.join(edits.select("invoice_id", F.col("status").alias("_to")), "invoice_id").where(~F.col("status").eqNullSafe(F.col("_to")))
            edited = {(r["status"], None if r["is_process"] is None else str(r["is_process"])) for r in moved.select("status", "is_process").distinct().collect()}
            invoice = with_statuses(invoice, edits)

    def refused(reason: str) -> Posting:
        change = _rewrite(store, edited, lambda rows: with_statuses(rows, edits))
        if change or append or tag is not None:
            store.commit(store.stage(append=append, rewrite=change), tag=tag)
        return Posting(False, store.version(), reason, rejects, unserved)

    valid, rejects = cascade_rows(inventory)
    # The demand (the one aggregate over the transaction lines) is computed once
    # for the gate and the cascade: checkpointed into the shared folder, it is
    # product x unit sized. So are the ids of the invoices held back.
    work_dir(store.spark)
    unserved = unserved_lines(open_lines(txn, invoice, status), valid)
    postable, held = invoice, None
    if not parity:
        held = unserved.select("invoice_id").distinct().checkpoint()
        postable = invoice.join(held, "invoice_id", "left_anti")
    open_demand = demand(txn, postable, S.TXN_OUT, status).checkpoint()
    gate_demand = demand(txn, invoice, S.TXN_OUT, S.STATUS_PAID) if parity else open_demand
    if not is_sufficient(sufficiency_of(valid, conversion, gate_demand, parity)):
        return refused("insufficient stock")

    new_inventory = stock_cascade(valid, conversion, open_demand, validated=True).unionByName(rejects)
    if whole is not None:
        version = store.stage({"inventory": new_inventory, "invoice": _flagged(whole, held, status)}, append)
    else:
        unmarked = {f for f in store.folders("invoice").values() if f[0] == status and f[1] != "1"}
        change = _rewrite(store, edited | unmarked, lambda rows: _flagged(rows if edits is None else with_statuses(rows, edits), held, status))
        version = store.stage({"inventory": new_inventory}, append, change)
    if not parity:
        staged = store.read("inventory", version)
        bad = staged.agg(F.count(F.when(F.col("stock").isNull() | (F.col("stock") < 0), 1)).alias("n")).first()["n"]
        if bad:
            store.abort(version)
            return refused(f"{bad} inventory rows would have NULL or negative stock")
    store.commit(version, tag=tag)
    return Posting(True, version, "posted", rejects, unserved)
