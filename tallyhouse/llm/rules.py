"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger holds the
measurements and one failure bit per rule. A policy is a versioned set of rule
bits: applying it, changing it or finding what each rule alone costs
(ablation) needs the ledger's masks only, never the texts again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import SPACE, map_batches, repeated_words, texts, unused, word_codes

# fixed values: rules by bit; each holds if its expression over the ledger's measurements is true
FAILS = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "4 * n_symbols > n_words",
    "dup_lines": "n_text_lines >= 4 and 2 * n_dup_lines > n_text_lines",
    "long_words": "n_words > 0 and word_chars > 20 * n_words",
    "upper_case": "2 * n_upper > word_chars",
    "exclamations": "2 * n_exclaim > n_words",
}
BIT = {name: 1 << i for i, name in enumerate(FAILS)}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_text_lines", "n_upper", "n_exclaim")
_SYMBOLS, _UPPER, _BANG = b"#*$%&|<>", bytes(range(65, 91)), b"!"


@dataclass(frozen=True)
class Policy:
    """The rules that reject a document, under a version name."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in set(self.rules))


BASE = Policy("base-1", ("few_words", "repeated_words"))
PRODUCTION = Policy("production-1", tuple(FAILS))


def measure(text: bytes) -> tuple[int, ...]:
    """MEASURES of one text."""
    words = text.split()
    ids, distinct = word_codes(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    bare = text.translate(None, SPACE)
    without = lambda chars: len(text) - len(text.translate(None, chars))
    return (len(words), len(bare.decode("utf-8", "replace")), without(_SYMBOLS), len(lines) - len(set(lines)),
            repeated_words(ids, distinct), len(lines), without(_UPPER), without(_BANG))


def with_ledger(docs: DataFrame, name: str = "_ledger") -> DataFrame:
    """``docs`` with a struct column ``name``: MEASURES and ``failed``, the mask
    of failed rules. ``docs`` keeps all its rows and columns; a null text has no
    word. A column of that name in ``docs`` is replaced."""
    docs = docs.drop(name)

    def measured(batch: pa.RecordBatch) -> dict:
        rows = np.array([measure(t) for t in texts(batch)], np.int64).reshape(-1, len(MEASURES))
        columns = dict(zip(batch.schema.names, batch.columns, strict=True))
        return columns | {name: pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(MEASURES))], MEASURES)}

    schema = StructType([*docs.schema.fields, StructField(name, StructType([StructField(m, LongType()) for m in MEASURES]))])
    out = map_batches(docs, measured, schema)
    scope = "named_struct(" + ", ".join(f"'{m}', `{name}`.{m}" for m in MEASURES) + ")"
    failed = " + ".join(f"if({_qualified(rule, name)}, {BIT[key]}L, 0L)" for key, rule in FAILS.items())
    return out.withColumn(name, F.expr(scope).withField("failed", F.expr(failed)))


def _qualified(rule: str, name: str) -> str:
    return " ".join(f"`{name}`.{x}" if x in MEASURES else x for x in rule.split())


def passes(policy: Policy, failed: Column) -> Column:
    """True where no rule of the policy failed."""
    return failed.bitwiseAND(F.lit(policy.mask)) == 0


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements, failed): one row for each row of ``docs``."""
    return with_ledger(docs.select("doc_id", "text")).select("doc_id", "_ledger.*")


def apply_policy(ledger_rows: DataFrame, policy: Policy) -> DataFrame:
    return ledger_rows.withColumns({"policy": F.lit(policy.version), "kept": passes(policy, F.col("failed"))})


def ablations(ledger_rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents it rejects, and documents that
    only it rejects (they would be kept without the rule). Works on the counts
    of distinct masks, at most 2^rules rows whatever the input."""
    masks = ledger_rows.select(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).alias("bit")) for r in policy.rules]))
    return (masks.select("m", "n", rules.alias("r")).where(F.col("m").bitwiseAND(F.col("r.bit")) != 0)
            .groupBy(F.col("r.rule").alias("rule"))
            .agg(F.sum("n").alias("n_failed"), F.sum(F.when(F.bit_count("m") == 1, F.col("n")).otherwise(0)).alias("n_only")))


def kept_documents(docs: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their own columns."""
    name = unused(docs.columns, "_ledger")
    return with_ledger(docs, name).where(passes(policy, F.col(f"{name}.failed"))).drop(name)
