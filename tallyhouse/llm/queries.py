"""The registered queries of the subpackage: (spark, sf_dir) -> DataFrame, each
its operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fim, fingerprints, licenses, line_dedup, lsh_forest, packing, pieces, pii, quality, rules, toxicity, trie, urls
from .common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_quality_classifier(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op3_sentencepiece(spark, sf_dir):
    model = pieces.load(tokenizer_file("piece_bpe_32k.model"))
    return pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), model), model).drop("decoded")


def op4_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.deduplicated(docs, line_dedup.build(docs)).select("doc_id", "_lines.*")


def op6_ngram_join(spark, sf_dir):
    return lsh_forest.join(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark, sf_dir):
    rows = rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents")), rules.PRODUCTION)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~rules.passes(rules.BASE, F.col("failed"))).alias("base_failed"), "kept", "failed")


def op8_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents")).drop("blocks")


def op9_url_filter(spark, sf_dir):
    return urls.filter_urls(table(spark, sf_dir, "pages"), urls.rule_table(spark))


def op10_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_personal_data(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark, sf_dir):
    out = fim.transform(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fim.restored(), 256).alias("restored_sha256"))


def op13_conversation_trie(spark, sf_dir):
    return trie.nodes(table(spark, sf_dir, "conversations"))


QUERIES = {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}
