"""The ledger's actions on a ``TableStore``, each one commit: what the forms
and buttons of the original application do to its tables.

* ``submit_invoices``: draft lines and headers -> transaction rows + invoices
  (headers without a vendor or with a known id are refused with their lines);
* ``record_purchases``: stock up + purchase history rows;
* ``add_products``: product, unit, zero-stock inventory and edge rows;
* ``save_edits``: a keyed edit set applied to a whole table;
* ``save_grid``: a whole edited grid merged with what others saved meanwhile;
* ``register_users`` / ``login``: insert-if-absent and hashed-key match;
* posting: ``posting.post_invoices``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import work_dir
from ..sources.claims import IdRanges
from ..sources.tables import CommitConflict, TableStore
from .catalogue import onboard_products
from .edits import apply_edits, insert_if_absent, keyed_match, keyless
from .invoicing import build_invoice_lines, build_invoices, build_purchase_rows
from .keys import with_key_check
from .merge import merge_edits
from .posting import replenish_purchases, unplaced, usable_rows


@dataclass
class Applied:
    version: int
    rejects: DataFrame | None = None
    orphans: DataFrame | None = None


def _table(store: TableStore, name: str, given: DataFrame | None) -> DataFrame:
    """A table that an action only reads: the given one, else the store's."""
    return store.read(name) if given is None else given


def submit_invoices(store: TableStore, headers: DataFrame, drafts: DataFrame, third_tier: str = "repeat",
                    product: DataFrame | None = None, unit_size: DataFrame | None = None, tag: str | None = None) -> Applied:
    """Append the lines and invoices of draft invoices in one commit, once.

    ``rejects`` are the headers that enter no table: without a vendor, with a
    blank or repeated invoice id, or with an id that is stored already - a draft
    submitted again adds nothing. ``orphans`` are the lines without an accepted
    header. ``tag`` marks the commit: a submission under a tag that is committed
    is skipped (version 0). Two writers that submit one draft at once meet in the
    commit marker: the second gets a conflict, and finds the ids when it submits
    again."""
    if tag is not None and store.has_tag(tag):
        return Applied(0)
    work_dir(store.spark)
    checked = with_key_check(headers, ["invoice_id"])
    if store.version("invoice"):
        stored = store.read("invoice").select("invoice_id").distinct().withColumn("_stored", F.lit(True))
        checked = checked.join(stored, "invoice_id", "left").withColumn("_unique", F.col("_unique") & F.col("_stored").isNull()).drop("_stored")
    checked = checked.checkpoint()   # the draft headers as they are judged, before the tables change
    catalogue = _table(store, "product", product), _table(store, "unit_size", unit_size)
    invoices, unsold = build_invoices(checked.where("_unique").drop("_unique"), build_invoice_lines(drafts, *catalogue), third_tier)
    ids = invoices.select("invoice_id")
    # the drafts are parted before they get their names: narrow rows go through the shuffle by invoice
    lines, orphans = (build_invoice_lines(drafts.join(ids, "invoice_id", how), *catalogue) for how in ("left_semi", "left_anti"))
    orphans = orphans.select("invoice_id", *[c for c in orphans.columns if c != "invoice_id"])
    rejects = checked.where("NOT _unique").select(*headers.columns).unionByName(unsold.select(*headers.columns))
    return Applied(store.change(append={"txn": lines, "invoice": invoices}, tag=tag), rejects, orphans)


def record_purchases(store: TableStore, entries: DataFrame, tag: str | None = None, product: DataFrame | None = None,
                     unit_size: DataFrame | None = None, parity: bool = False) -> Applied:
    """Add purchased quantities to stock and the entries to the purchase
    history, together. Entries that no stock can be posted for (no inventory row
    of their product and unit, or several, or a blank quantity) come back as
    ``rejects`` and enter neither table, so that stock and history agree;
    ``parity`` writes them into the history all the same, as the original does.
    ``tag`` marks the commit (a batch recorded under a tag that is already
    committed is skipped: version 0)."""
    if tag is not None and store.has_tag(tag):
        return Applied(0)
    work_dir(store.spark)
    inventory = store.read("inventory")
    rejects = unplaced(inventory, entries).checkpoint()
    good = entries.where(F.col("quantity").isNotNull()).join(usable_rows(inventory), ["product_id", "unit_id"], "left_semi").select(*entries.columns)
    rows = build_purchase_rows(entries if parity else good, _table(store, "product", product), _table(store, "unit_size", unit_size))
    stock = replenish_purchases(inventory, good)
    return Applied(store.change(replace={"inventory": stock}, append={"purchase": rows}, tag=tag), rejects)


def add_products(store: TableStore, form: DataFrame, order_by: str = "form_order") -> Applied:
    """Onboard new products with their units, inventory rows and edges. The ids
    are reserved before anything is written, so of two onboardings at once each
    keeps its own: the one that commits later only stages its rows again. A
    failed one leaves a gap in the ids."""
    ob = onboard_products(form, store.read("product"), store.read("inventory"), order_by, IdRanges(store.spark, store.root).reserve)
    added = {"product": ob.product, "unit_size": ob.unit_size, "inventory": ob.inventory.checkpoint(), "size_conversion": ob.size_conversion}
    while True:
        try:
            return Applied(store.change(append=added), ob.rejects)
        except CommitConflict:  # appends do not depend on what the other writer committed
            continue


def save_edits(store: TableStore, table: str, edits: DataFrame, keys: list[str]) -> Applied:
    """Apply a keyed edit set (updates, inserts, deletes) to a whole table."""
    out, rejects = apply_edits(store.read(table), edits, keys)
    return Applied(store.replace({table: out}), rejects)


def save_grid(store: TableStore, table: str, grid: DataFrame, opened: int, keys: list[str]) -> tuple[Applied, DataFrame]:
    """Save a whole grid that was opened at version ``opened`` of the table:
    what its user changed is merged into the table as it is now, so another
    user's save in between is not undone. Returns the commit (with rows that
    have no usable key as ``rejects``) and the conflicts, whose rows keep the
    other user's values."""
    merged = merge_edits(store.read(table, opened), store.read(table), grid, keys)
    return Applied(store.replace({table: merged.result}), merged.rejects), merged.conflicts


def register_users(store: TableStore, incoming: DataFrame) -> Applied:
    """Append the users whose email is not registered yet; those without an
    email come back as ``rejects``."""
    return Applied(store.append("users", insert_if_absent(store.read("users"), incoming, ["email"])), keyless(incoming, ["email"]))


def login(store: TableStore, attempts: DataFrame) -> DataFrame:
    """The attempts (email, password_plain) that match an approved user."""
    return keyed_match(attempts, store.read("users"))
