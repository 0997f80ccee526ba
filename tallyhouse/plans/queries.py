"""The registered queries: one callable (spark, sf_dir) -> DataFrame per
operator, each over the whole ledger tables, read through the lazy mapping of
``sources.fixtures``: a query scans the columns it needs of the given tables,
and nothing is copied first.

Queries that exercise a sink write into a fresh folder under the session's
shared work folder (``spark.checkpoint.dir``) and return the table read back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import actions, catalogue, edits, invoicing, merge, posting, reports, tiers, units
from ..operators.cascade import cascade_own_ladders, stock_cascade
from ..operators.demand import demand
from ..session import scratch_path
from ..sources.fixtures import AS_OF, Ledger
from ..sources.quarantine import Quarantined, read_csv_quarantined
from ..sources.tables import TableStore, read_csv_table, write_csv_table

Query = Callable[[SparkSession, str], DataFrame]


def _out_lines(L: Ledger) -> DataFrame:
    return L.txn.where(F.col("txn_type") == S.TXN_OUT)


def money_as_double(df: DataFrame) -> DataFrame:
    """Listing output: money columns as double. The tables keep exact
    decimal(18,2) and every sum is taken in decimal before conversion; only
    the listed values are converted (the same conversion as the oracle's)."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if f.dataType == S.MONEY else F.col(f.name)
                       for f in df.schema.fields])


def q_inventory_scan(spark, d):
    return Ledger(spark, d).inventory


def q_sufficiency_search(spark, d):
    """The gate's answer by the search that ends at the first failing product."""
    L = Ledger(spark, d)
    found = posting.is_sufficient(posting.stock_sufficiency(L.inventory, L.size_conversion, L.txn, L.invoice))
    return spark.createDataFrame([(found,)], "sufficient boolean")


def q_inventory_csv(spark, d):
    path = scratch_path(spark, "inventory-csv")
    write_csv_table(Ledger(spark, d).inventory, path)
    return read_csv_table(spark, path, S.INVENTORY)


def q_stock_list(spark, d):
    return catalogue.stock_list(Ledger(spark, d).inventory)


def q_size_list(spark, d):
    return catalogue.size_list(Ledger(spark, d).unit_size)


def q_enrich_lines(spark, d):
    L = Ledger(spark, d)
    lines = L.txn.select("transaction_id", "invoice_id", "product_id", "txn_type", "quantity", "unit_id")
    return reports.enrich_lines(lines, L.product, L.unit_size)


def q_invoice_detail(spark, d):
    L = Ledger(spark, d)
    selection = L.invoice.where(F.col("status") == S.STATUS_INVOICE)
    return money_as_double(reports.invoice_detail(selection, L.txn))


def q_demand_out(spark, d):
    L = Ledger(spark, d)
    return demand(L.txn, L.invoice, S.TXN_OUT, S.STATUS_INVOICE)


def q_demand_paid(spark, d):
    L = Ledger(spark, d)
    return demand(L.txn, L.invoice, S.TXN_OUT, S.STATUS_PAID)


def q_supply_in(spark, d):
    L = Ledger(spark, d)
    return demand(L.txn, L.invoice, S.TXN_IN, S.STATUS_INVOICE)


def q_replenish_in(spark, d):
    L = Ledger(spark, d)
    return posting.replenish_in(L.inventory, L.txn, L.invoice)


def q_replenish_purchases(spark, d):
    L = Ledger(spark, d)
    return posting.replenish_purchases(L.inventory, L.purchase)


def q_purchase_history(spark, d):
    return money_as_double(reports.history(Ledger(spark, d).purchase))


def q_transaction_history(spark, d):
    return money_as_double(reports.history(Ledger(spark, d).txn))


def q_conversion_edges(spark, d):
    return catalogue.conversion_edges(Ledger(spark, d).unit_size)


def q_stock_in_packs(spark, d):
    L = Ledger(spark, d)
    return units.stock_in_packs(L.inventory, L.size_conversion)


def q_demand_in_packs(spark, d):
    L = Ledger(spark, d)
    return units.demand_in_packs(demand(L.txn, L.invoice), L.size_conversion)


def q_demand_in_packs_paid(spark, d):
    L = Ledger(spark, d)
    return units.demand_in_packs(demand(L.txn, L.invoice, S.TXN_OUT, S.STATUS_PAID), L.size_conversion)


def q_stock_sufficiency(spark, d):
    L = Ledger(spark, d)
    return posting.stock_sufficiency(L.inventory, L.size_conversion, L.txn, L.invoice)


def q_stock_sufficiency_paid(spark, d):
    L = Ledger(spark, d)
    return posting.stock_sufficiency(L.inventory, L.size_conversion, L.txn, L.invoice,
                                     S.STATUS_PAID, parity=True)


def q_sufficiency_gate(spark, d):
    return posting.sufficiency_gate(q_stock_sufficiency(spark, d))


def q_sufficiency_gate_paid(spark, d):
    return posting.sufficiency_gate(q_stock_sufficiency_paid(spark, d))


def q_available_in_unit(spark, d):
    L = Ledger(spark, d)
    return units.available_in_unit(L.inventory, L.size_conversion, L.unit_size)


def q_stock_cascade(spark, d):
    L = Ledger(spark, d)
    return stock_cascade(L.inventory, L.size_conversion, demand(L.txn, L.invoice))


def q_mark_processed(spark, d):
    return posting.mark_processed(Ledger(spark, d).invoice)


def q_invoice_term_days(spark, d):
    return reports.invoice_term_days(Ledger(spark, d).invoice, AS_OF)


def q_base_unit_quantity(spark, d):
    L = Ledger(spark, d)
    return invoicing.base_unit_quantity(L.txn.where(F.col("txn_type") == S.TXN_OUT))


def q_discount_tier(spark, d):
    L = Ledger(spark, d)
    return invoicing.discount_tier(invoicing.base_unit_quantity(L.txn.where(F.col("txn_type") == S.TXN_OUT)))


def q_invoice_pricing(spark, d):
    return invoicing.invoice_pricing(_out_lines(Ledger(spark, d)))


def q_build_invoice_lines(spark, d):
    L = Ledger(spark, d)
    return money_as_double(invoicing.build_invoice_lines(L.draft_lines, L.product, L.unit_size))


def q_build_invoices(spark, d):
    L = Ledger(spark, d)
    return invoicing.build_invoices(L.draft_headers, _out_lines(L))[0]


def q_purchase_rows(spark, d):
    L = Ledger(spark, d)
    return money_as_double(invoicing.build_purchase_rows(L.purchase_entries, L.product, L.unit_size))


def q_next_ids(spark, d):
    L = Ledger(spark, d)
    return catalogue.next_ids(L.product, L.inventory)


def q_onboard_products(spark, d):
    L = Ledger(spark, d)
    return catalogue.onboard_products(L.new_products, L.product, L.inventory).inventory


def q_append_rows(spark, d):
    L = Ledger(spark, d)
    store = TableStore(spark)
    store.replace({"txn": L.txn.where(F.col("txn_type") == S.TXN_IN)})
    out = L.txn.where(F.col("txn_type") == S.TXN_OUT)
    store.append("txn", out.select(*reversed(out.columns)))  # by name, not by position
    return money_as_double(store.read("txn"))


def _compacted(spark, d) -> TableStore:
    """The lines written as two segments, then as one in the order of their invoices."""
    L = Ledger(spark, d)
    store = TableStore(spark)
    for kind in (S.TXN_IN, S.TXN_OUT):
        store.append("txn", L.txn.where(F.col("txn_type") == kind))
    store.compact("txn")
    return store


def q_compact_lines(spark, d):
    return money_as_double(_compacted(spark, d).read("txn"))


def q_compact_detail(spark, d):
    """The lines of the open invoices, from a table in the order of its invoices."""
    selection = Ledger(spark, d).invoice.where(F.col("status") == S.STATUS_INVOICE)
    return money_as_double(reports.invoice_detail_between(selection, _compacted(spark, d).read("txn")))


def q_replace_table(spark, d):
    L = Ledger(spark, d)
    store = TableStore(spark)
    store.replace({"inventory": L.inventory})
    # the new version is computed from the version being replaced
    store.replace({"inventory": posting.replenish_purchases(store.read("inventory"), L.purchase)})
    return store.read("inventory")


def inventory_edits(L: Ledger) -> DataFrame:
    """A stock-take edit set over the whole inventory: recounted BALL rows
    (stock doubled), empty rows deleted, and a new zero-stock 1/2 BALL row
    for every product that has none."""
    inv = L.inventory
    recount = inv.where(F.col("unit_id") == 1).withColumn("stock", F.col("stock") * 2) \
        .withColumn("deleted", F.lit(False))
    empty = inv.where(F.col("stock") == 0).withColumn("deleted", F.lit(True))
    missing = L.product.join(L.unit_size.where(F.col("unit_id") == 2), "product_id", "left_anti").select(
        (F.col("product_id") * 3 + 2).cast("long").alias("inventory_id"), "product_id", "product_name",
        F.lit(2).alias("unit_id"), F.lit(S.UNIT_LADDER[1][1]).alias("unit_size"), F.lit(0.0).alias("stock"),
        F.lit(False).alias("deleted"))
    return recount.unionByName(empty).unionByName(missing)


def q_apply_edits(spark, d):
    L = Ledger(spark, d)
    return edits.apply_edits(L.inventory, inventory_edits(L), ["product_id", "unit_id"])[0]


def q_insert_if_absent(spark, d):
    L = Ledger(spark, d)
    return edits.insert_if_absent(L.users, L.users_incoming, ["email"])


def q_keyed_match(spark, d):
    L = Ledger(spark, d)
    return edits.keyed_match(L.login_attempts, L.users)


def q_register_users(spark, d):
    """The users table after a registration batch."""
    L = Ledger(spark, d)
    store = TableStore(spark)
    store.replace({"users": L.users})
    actions.register_users(store, L.users_incoming)
    return store.read("users")


def refused_headers(L: Ledger) -> DataFrame:
    """Draft headers, every thirteenth without a vendor."""
    return L.draft_headers.withColumn("vendor", F.when(F.col("invoice_id") % 13 == 0, F.lit("")).otherwise(F.col("vendor")))


def _submitted(spark, d) -> TableStore:
    L = Ledger(spark, d)
    store = TableStore(spark)
    actions.submit_invoices(store, refused_headers(L), L.draft_lines, product=L.product, unit_size=L.unit_size)
    return store


def q_submit_lines(spark, d):
    return money_as_double(_submitted(spark, d).read("txn"))


def q_submit_invoices(spark, d):
    return _submitted(spark, d).read("invoice")


def q_submit_orphans(spark, d):
    """The lines that a submission refuses with their header."""
    L = Ledger(spark, d)
    store = TableStore(spark)
    done = actions.submit_invoices(store, refused_headers(L), L.draft_lines, product=L.product, unit_size=L.unit_size)
    return money_as_double(done.orphans)


def _purchased(spark, d) -> TableStore:
    L = Ledger(spark, d)
    store = TableStore(spark)
    store.replace({"inventory": L.inventory})
    actions.record_purchases(store, L.purchase_entries, product=L.product, unit_size=L.unit_size)
    return store


def q_purchase_entry_stock(spark, d):
    return _purchased(spark, d).read("inventory")


def q_purchase_entry_history(spark, d):
    return money_as_double(_purchased(spark, d).read("purchase"))


def doubtful_entries(L: Ledger) -> DataFrame:
    """Purchase entries, every seventeenth product unknown to the ledger."""
    p = F.col("product_id")
    return L.purchase_entries.withColumn("product_id", F.when(p % 17 == 0, p + 1_000_000_000).otherwise(p))


def repeated_inventory(L: Ledger) -> DataFrame:
    """Inventory with a second unit-1 row for every nineteenth product."""
    again = L.inventory.where((F.col("product_id") % 19 == 0) & (F.col("unit_id") == 1)).withColumn("inventory_id", -F.col("inventory_id"))
    return L.inventory.unionByName(again)


def _doubtful(spark, d):
    L = Ledger(spark, d)
    store = TableStore(spark)
    store.replace({"inventory": repeated_inventory(L)})
    return store, actions.record_purchases(store, doubtful_entries(L), product=L.product, unit_size=L.unit_size)


def q_purchase_entry_rejects(spark, d):
    """The entries that neither stock nor history takes."""
    return money_as_double(_doubtful(spark, d)[1].rejects)


def q_purchase_doubtful_stock(spark, d):
    """The stock after the other entries of the same batch."""
    return _doubtful(spark, d)[0].read("inventory")


def q_submit_repeated(spark, d):
    """The invoices after a draft is submitted, and submitted again with more
    headers: every fifth order's stands twice, every seventh comes the second
    time only."""
    L = Ledger(spark, d)
    store = TableStore(spark)
    o = F.col("invoice_id")
    every = L.draft_headers
    twice = every.unionByName(every.where(o % 5 == 0))
    for headers in (twice.where(o % 7 != 0), twice):
        actions.submit_invoices(store, headers, L.draft_lines, product=L.product, unit_size=L.unit_size)
    return store.read("invoice")


def deep_units(L: Ledger) -> DataFrame:
    """Unit rows with the ids 1, 4 and 7, every seventh product with a finer
    unit 10; every eleventh product's unit 1 stands twice."""
    p = F.col("product_id")
    rows = L.unit_size.withColumn("unit_id", (F.col("unit_id") * 3 - 2).cast("int"))
    finest = L.product.where(p % 7 == 0).select(p, "product_name", F.lit(10).alias("unit_id"), F.lit("SINGLE").alias("unit_size"))
    again = rows.where((p % 11 == 0) & (F.col("unit_id") == 1)).withColumn("unit_size", F.lit("BALL AGAIN"))
    return rows.unionByName(finest).unionByName(again)


def deep_stock(L: Ledger) -> DataFrame:
    """Inventory over the same units: an id and a stock of its own for each row."""
    p, u = F.col("product_id"), F.col("unit_id")
    return deep_units(L).select((p * 100 + u).cast("long").alias("inventory_id"), p, "product_name", u, "unit_size",
                                F.when(u == 1, 60 + p % 41).otherwise((p + u) % 23).cast("double").alias("stock"))


def deep_edges(L: Ledger) -> DataFrame:
    """Conversions between every two units of a product, blank for every 97th."""
    p, q = F.col("product_id"), F.col("convert_unit_id") - F.col("original_unit_id")
    edges = catalogue.conversion_edges(deep_units(L).where(F.col("unit_size") != "BALL AGAIN"))
    return edges.withColumns({"original_quantity": F.lit(1.0), "convert_quantity": F.when(p % 97 != 0, (q + p % 3).cast("double"))})


def deep_demand(L: Ledger) -> DataFrame:
    return demand(L.txn, L.invoice).withColumn("unit_id", (F.col("unit_id") * 3 - 2).cast("int"))


def q_ladder_edges(spark, d):
    return catalogue.conversion_edges(deep_units(Ledger(spark, d)))


def q_ladder_edge_rejects(spark, d):
    return catalogue.edge_unit_rejects(deep_units(Ledger(spark, d)))


def q_ladder_available(spark, d):
    L = Ledger(spark, d)
    return units.available_in_unit(deep_stock(L), deep_edges(L), deep_units(L))


def q_ladder_cascade(spark, d):
    L = Ledger(spark, d)
    return cascade_own_ladders(deep_stock(L), deep_edges(L), deep_demand(L))[0]


def dirty_inventory(spark, d) -> Quarantined:
    """The inventory as a sheet's CSV export with cells that are no numbers,
    blank ones and blank ids, read back."""
    i = F.col("inventory_id")
    cells = Ledger(spark, d).inventory.select(
        F.when(i % 31 == 0, F.lit("")).otherwise(i.cast("string")).alias("inventory_id"),
        F.when(i % 29 == 0, F.lit(" ")).otherwise(F.col("product_id").cast("string")).alias("product_id"), "product_name",
        F.when(i % 19 == 0, F.lit("two")).when(i % 23 == 0, F.lit("2.5")).otherwise(F.col("unit_id").cast("string")).alias("unit_id"), "unit_size",
        F.when(i % 13 == 0, F.lit("n/a")).when(i % 17 == 0, F.lit("")).otherwise(F.col("stock").cast("string")).alias("stock"))
    path = scratch_path(spark, "dirty-csv")
    write_csv_table(cells, path)
    return read_csv_quarantined(spark, path, S.INVENTORY)


def q_csv_good_rows(spark, d):
    return dirty_inventory(spark, d).good


def q_csv_rejects(spark, d):
    rejects = dirty_inventory(spark, d).rejects
    return rejects.select(F.get_json_object("record", "$.product_name").alias("product_name"), "column", "raw")


def _merged(spark, d) -> merge.Merge:
    """Two users edit the inventory: one adds 5 to every third product's stock
    and deletes every tenth's (remainder 7), the other adds 5 to every sixth's,
    doubles every fifth's, deletes every eleventh's and adds a unit 9 to every
    fourth's balls."""
    inv, p, stock = Ledger(spark, d).inventory, F.col("product_id"), F.col("stock")
    theirs = inv.where(p % 10 != 7).withColumn("stock", F.when(p % 3 == 0, stock + 5).otherwise(stock))
    mine = inv.where(p % 11 != 0).withColumn("stock", F.when(p % 6 == 0, stock + 5).when(p % 5 == 0, stock * 2).otherwise(stock))
    new = inv.where((p % 4 == 0) & (F.col("unit_id") == 1)).withColumns({"inventory_id": -F.col("inventory_id"), "unit_id": F.lit(9), "stock": F.lit(0.0)})
    return merge.merge_edits(inv, theirs, mine.unionByName(new), ["product_id", "unit_id"])


def q_merge_edits(spark, d):
    return _merged(spark, d).result


def q_merge_conflicts(spark, d):
    return _merged(spark, d).conflicts.select("product_id", "unit_id", *[F.col(f"{s}.stock").alias(f"{s}_stock") for s in ("base", "theirs", "mine")])


def tier_table(L: Ledger) -> DataFrame:
    """The fixed tiers as a table, for each year that has orders, with a first
    discount of its own; those of every fifth year overlap."""
    years = L.draft_headers.select(F.year("invoice_date").alias("y")).where("y is not null").distinct()
    fixed = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(lo).alias("low"), F.lit(hi).cast("double").alias("high"), *[F.lit(x).alias(f"discount{k + 1}") for k, x in enumerate(ds)])
                      for i, (lo, hi, *ds) in enumerate(S.DISCOUNT_TIERS)])
    rows = years.select("y", F.explode(fixed).alias("t")).select("y", "t.*")
    low = F.when((F.col("y") % 5 == 0) & (F.col("i") == 1), F.col("low") - 1).otherwise(F.col("low"))

    def first_of(year) -> F.Column:
        return F.concat(year.cast("string"), F.lit("-01-01")).cast("timestamp_ntz")

    return rows.select(first_of(F.col("y")).alias("valid_from"), first_of(F.col("y") + 1).alias("valid_to"), low.alias("low"), "high",
                       (F.col("discount1") + (F.col("y") % 3).cast("double") / 100).alias("discount1"), "discount2", "discount3")


def q_tier_table_discounts(spark, d):
    """Discounts of the draft invoices by the tiers valid at their date."""
    L = Ledger(spark, d)
    base = invoicing.base_unit_quantity(_out_lines(L)).join(L.draft_headers.select("invoice_id", "invoice_date"), "invoice_id")
    return tiers.discounts_of(base, tier_table(L))


def q_tier_table_rejects(spark, d):
    return tiers.split_tiers(tier_table(Ledger(spark, d)))[1]


def _onboarded(spark, d):
    L = Ledger(spark, d)
    return catalogue.onboard_products(L.new_products, L.product, L.inventory)


def q_onboard_product_rows(spark, d):
    return _onboarded(spark, d).product


def q_onboard_unit_rows(spark, d):
    return _onboarded(spark, d).unit_size


def q_onboard_edges(spark, d):
    return _onboarded(spark, d).size_conversion


def q_onboard_rejects(spark, d):
    return _onboarded(spark, d).rejects


def _onboarded_twice(spark, d) -> TableStore:
    """A store after two onboardings: the forms of even orders, then the odd ones."""
    L = Ledger(spark, d)
    store = TableStore(spark)
    store.replace({"product": L.product, "inventory": L.inventory})
    for odd in (0, 1):
        actions.add_products(store, L.new_products.where(F.col("form_order") % 2 == odd))
    return store


def q_onboard_twice_products(spark, d):
    return _onboarded_twice(spark, d).read("product")


def q_onboard_twice_inventory(spark, d):
    return _onboarded_twice(spark, d).read("inventory")


def _post(spark, d, inventory) -> TableStore:
    L = Ledger(spark, d)
    store = TableStore(spark)
    store.replace({"inventory": inventory(L), "invoice": L.invoice})  # the two tables a posting rewrites
    posting.post_invoices(store, txn=L.txn, conversion=L.size_conversion)
    return store


def q_post_invoices(spark, d):
    """A posting that is refused: the inventory stays as it is."""
    return _post(spark, d, lambda L: L.inventory).read("inventory")


def restocked(L: Ledger) -> DataFrame:
    """Inventory after a stock-take that covers the open demand. Products with
    all three units and no blank quantity get the balls for all of it, so that
    the posting opens them; of the others each row gets its own demand."""
    need = demand(L.txn, L.invoice)
    per_product = need.groupBy("product_id").agg(F.sum("quantity").alias("_all"))
    units = L.inventory.groupBy("product_id").agg(F.count(F.lit(1)).alias("_units"))
    p = F.col("product_id")
    folds = (F.col("_units") == 3) & (p % 97 != 0) & (p % 89 != 0)
    add = F.when(folds, F.when(F.col("unit_id") == 1, F.col("_all"))).otherwise(F.col("quantity"))
    j = L.inventory.join(need, ["product_id", "unit_id"], "left").join(per_product, "product_id", "left").join(units, "product_id")
    return j.select(*[(F.col("stock") + F.coalesce(add, F.lit(0.0))).alias("stock") if c == "stock" else F.col(c) for c in L.inventory.columns])


def q_post_restocked_inventory(spark, d):
    """A posting that commits: inventory after the cascade."""
    return _post(spark, d, restocked).read("inventory")


def q_post_restocked_invoices(spark, d):
    """The invoice flags after the same posting; invoices with a line that no
    inventory row serves are held back."""
    return _post(spark, d, restocked).read("invoice").select("invoice_id", "status", "is_process")


QUERIES: dict[str, Query] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
