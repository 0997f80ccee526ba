"""Keyed table edits: apply a set of row edits, insert rows whose key is new,
match attempts against a keyed table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import work_dir
from .keys import with_key_check


def apply_edits(base: DataFrame, edits: DataFrame, keys: list[str],
                delete_col: str = "deleted") -> tuple[DataFrame, DataFrame]:
    """(edited table, rejected edits). ``edits`` holds whole rows (the base
    columns) plus a boolean ``delete_col``: a row replaces the base row(s) of
    its key, inserts it when the key is new, or deletes it when flagged. Two
    edits of one key are ambiguous and rejected.

    Base rows without an edit (anti join on the key) plus the kept edits: no
    full outer join, so a hot base key is split by AQE like any left-side
    join skew."""
    work_dir(edits.sparkSession)
    checked = with_key_check(edits, keys).checkpoint()   # the edit set is computed once for all that follows
    good, rejects = checked.where("_unique").drop("_unique"), checked.where("NOT _unique").drop("_unique")
    untouched = base.join(good.select(*keys), keys, "left_anti")
    kept = good.where(~F.coalesce(F.col(delete_col), F.lit(False))).select(*base.columns)
    return untouched.select(*base.columns).unionByName(kept), rejects


def _complete(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def keyless(incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that ``insert_if_absent`` leaves out: a part of the key is NULL."""
    return incoming.where(~_complete(keys))


def insert_if_absent(base: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` whose key is not in ``base``, one per key: of a
    batch's rows with one key the smallest (a deterministic choice). One anti
    join against the keys of ``base``; the de-duplication is an
    aggregate with a partial stage, so a key repeated many times stays cheap.
    Rows with an incomplete key are no row's duplicate and would enter again with
    every call: they are left out (``keyless``)."""
    incoming = incoming.where(_complete(keys))
    others = [c for c in incoming.columns if c not in keys]
    batch = incoming
    if others:
        batch = (incoming.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_row"))
                 .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others]).select(*incoming.columns))
    else:
        batch = incoming.distinct()
    return batch.join(base.select(*keys), keys, "left_anti")


def keyed_match(attempts: DataFrame, users: DataFrame, secret_col: str = "password_plain") -> DataFrame:
    """Attempts (email, plain secret) whose email and sha-256 of the secret
    match an approved user: one hash per row, then a semi join on both
    columns."""
    hashed = attempts.select("email", F.sha2(F.col(secret_col), 256).alias("password"))
    approved = users.where(F.col("approved") == 1).select("email", "password")
    return hashed.join(approved, ["email", "password"], "left_semi").select("email")
