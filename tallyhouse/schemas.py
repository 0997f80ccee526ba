"""Domain table schemas and the fixed values of the stock ledger.

Every table is a plain DataFrame with snake_case columns. Keys are implied
(the ledger never enforced them); operators that need unique keys say so and
``operators.keys.split_duplicates`` sends offending rows to a reject table.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values (must equal the original application's) -------------------
# Unit ladder, coarse to fine: id -> name. 'ROLL BALL' is an alternative name
# that also carries unit id 3.
UNIT_LADDER = ((1, "BALL"), (2, "1/2 BALL"), (3, "PACK BALL"))
ROLL_UNIT = (3, "ROLL BALL")
BASE_UNIT = 1          # the coarsest unit; volume discounts count it
FINEST_UNIT = 3        # stock is normalised to this unit for the gate

# Status values of an invoice.
STATUS_PROCESS = "PROCESS"
STATUS_INVOICE = "INVOICE"
STATUS_CANCELLED = "CANCELLED"
STATUS_PAID = "PAID"
STATUSES = (STATUS_PROCESS, STATUS_INVOICE, STATUS_CANCELLED, STATUS_PAID)

# Transaction direction.
TXN_IN = "IN"
TXN_OUT = "OUT"

# Volume discount tiers on the base-unit quantity of an invoice, half-open
# [low, high): (low, high, discount1, discount2, discount3). high None = open.
DISCOUNT_TIERS = (
    (5.0, 30.0, 0.02, 0.00, 0.00),
    (30.0, 60.0, 0.02, 0.01, 0.00),
    (60.0, 100.0, 0.02, 0.02, 0.00),
    (100.0, None, 0.02, 0.03, 0.00),
)
# -----------------------------------------------------------------------------

MONEY = T.DecimalType(18, 2)

PRODUCT = T.StructType([
    T.StructField("product_id", T.LongType(), False),
    T.StructField("product_name", T.StringType()),
])

UNIT_SIZE = T.StructType([
    T.StructField("product_id", T.LongType(), False),
    T.StructField("product_name", T.StringType()),
    T.StructField("unit_id", T.IntegerType(), False),
    T.StructField("unit_size", T.StringType()),
])

SIZE_CONVERSION = T.StructType([
    T.StructField("product_id", T.LongType(), False),
    T.StructField("product_name", T.StringType()),
    T.StructField("original_unit_id", T.IntegerType(), False),
    T.StructField("original_unit_size", T.StringType()),
    T.StructField("original_quantity", T.DoubleType()),
    T.StructField("convert_unit_id", T.IntegerType(), False),
    T.StructField("convert_unit_size", T.StringType()),
    T.StructField("convert_quantity", T.DoubleType()),
])

INVENTORY = T.StructType([
    T.StructField("inventory_id", T.LongType(), False),
    T.StructField("product_id", T.LongType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("unit_id", T.IntegerType()),
    T.StructField("unit_size", T.StringType()),
    T.StructField("stock", T.DoubleType()),
])

TXN = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("invoice_id", T.LongType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("txn_type", T.StringType()),
    T.StructField("quantity", T.DoubleType()),
    T.StructField("unit_id", T.IntegerType()),
    T.StructField("unit_size", T.StringType()),
    T.StructField("price", MONEY),
    T.StructField("total_price", MONEY),
])

INVOICE = T.StructType([
    T.StructField("invoice_id", T.LongType(), False),
    T.StructField("invoice_date", T.TimestampNTZType()),
    T.StructField("maturity_date", T.TimestampNTZType()),
    T.StructField("status", T.StringType()),
    T.StructField("vendor", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("is_process", T.IntegerType()),
    T.StructField("discount1", T.DoubleType()),
    T.StructField("discount2", T.DoubleType()),
    T.StructField("discount3", T.DoubleType()),
    T.StructField("final_price", T.DoubleType()),
])

PURCHASE = T.StructType([
    T.StructField("purchase_id", T.StringType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("txn_type", T.StringType()),
    T.StructField("quantity", T.DoubleType()),
    T.StructField("unit_id", T.IntegerType()),
    T.StructField("unit_size", T.StringType()),
    T.StructField("total_price", MONEY),
])

USERS = T.StructType([
    T.StructField("email", T.StringType(), False),
    T.StructField("password", T.StringType()),
    T.StructField("approved", T.IntegerType()),
])

# A status edit, as the posting stream takes them; those it rejects are a table.
EDIT = T.StructType([
    T.StructField("invoice_id", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("edited_at", T.TimestampNTZType()),
])

TABLES = {
    "product": PRODUCT,
    "unit_size": UNIT_SIZE,
    "size_conversion": SIZE_CONVERSION,
    "inventory": INVENTORY,
    "txn": TXN,
    "invoice": INVOICE,
    "purchase": PURCHASE,
    "users": USERS,
}

# Tables that the ledger writes besides: what a stream refused.
LOGS = {"edit_reject": EDIT}

# Implied keys per table (never enforced by the original application).
KEYS = {
    "product": ("product_id",),
    "unit_size": ("product_id", "unit_id"),
    "size_conversion": ("product_id", "original_unit_id", "convert_unit_id"),
    "inventory": ("product_id", "unit_id"),
    "invoice": ("invoice_id",),
    "users": ("email",),
}
