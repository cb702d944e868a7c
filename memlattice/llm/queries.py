"""The registered queries of this subpackage: one a numbered operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice.llm import bpe, decontam, huffman, licenses, line_dedup, negatives, pii, prefix_trie, quality, secrets, sharding, simhash, url_filter
from memlattice.llm.common import arrow_rows, scratch, table

RANK_FILE = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
SHARDS = 24


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(bpe.encode(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN))


def op2_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


def op3_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(simhash.classify(table(spark, sf_dir, "documents")))


def op5_url_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.digests(url_filter.judge(pages))


def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan_all(table(spark, sf_dir, "documents")))


def op7_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.tree(SHARDS)
    return sharding.digests(sharding.place(table(spark, sf_dir, "documents"), shards, sharding.grown(shards)))


def op8_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.digests(decontam.flag(docs, table(spark, sf_dir, "benchmark")))


def op9_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    folder = scratch(spark, "token-files")
    huffman.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER))
    return huffman.digests(huffman.read(spark, folder))


def op10_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digests(quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op11_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digests(licenses.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.tries(table(spark, sf_dir, "conversations"))


def op13_pq_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_byte_bpe, op2_pii_boosting, op3_line_chunks, op4_simhash, op5_url_models, op6_secret_ledger, op7_hash_tree, op8_minhash_containment, op9_huffman, op10_rule_ledger, op11_license_index, op12_prefix_trie, op13_pq_negatives)
}
