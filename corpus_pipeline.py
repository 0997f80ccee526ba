"""The corpus pipeline: five stages over ``documents``, each one of the
operators of ``tallyhouse.llm`` at work on all that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import line_dedup, lsh_forest, packing, quality, rules
from tallyhouse.llm.common import stored, table, unused
from tallyhouse.llm.queries import tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of the production policy go."""
    return rules.kept_documents(docs, rules.PRODUCTION)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold go; the model is fitted on the
    labelled ones among ``docs`` that are not held out."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller doc_id holds go; n_chars follows the text."""
    name = unused(docs.columns, "_lines")
    out = line_dedup.deduplicated(docs, line_dedup.build(docs), name).drop(name)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each near-duplicate class stays."""
    return lsh_forest.first_of_groups(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, placed in sequences."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("line_dedup", dedup_lines),
    ("ngram_join", ngram_join),
    ("packing", pack),
]

ORACLE_SQL = None  # SQL cannot express the classifier; tests hold run() against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the packed pieces."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
