"""A training-data pipeline over ``documents``: five stages, each a corpus operator.

Every stage takes all that the one before kept, written as Parquet and read again.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from memlattice.llm import bpe, decontam, line_dedup, near_copies, quality
from memlattice.llm.common import arrow_rows, guarded, materialized, named, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy of the rule ledger accepts."""
    return quality.accept(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that occurred before; n_chars follows the text."""
    return line_dedup.dedup(docs).select(*map(named, docs.columns))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the document with the smallest doc_id."""
    return near_copies.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    arrow_rows(spark)
    docs, back, _ = guarded(docs)
    return back(decontam.flag(docs, table(spark, sf_dir, "benchmark")).where("size(_items) = 0").drop("_items"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and the digests of the ids and of what they decode to."""
    arrow_rows(spark)
    return bpe.digests(bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", tokenize),
]

#: Hashes, links and merges have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialized(docs, f"stage{k}")
    return docs
