"""Benchmark items inside documents, by size-partitioned MinHash containment search.

An item is contained in a document if the document holds at least ``CONTAINED`` of
the item's distinct five-word shingles.  Items are partitioned by the number of
their shingles (powers of two), and each partition has one sketch depth: the
smallest hash values of an item that, at that size, cannot all fall into the part
that may be missing.  A document that contains the item thus meets its sketch, and
a count of how many values it must meet prunes the rest.  Exact shingles, not
hashes, decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlattice.llm.common import guarded, materialized, named
from memlattice.llm.shingles import hashes_by_text, shingle_hashes, shingles
from memlattice.llm.word_ids import grouped

WORDS = 5
CONTAINED = 0.8
#: Bytes of benchmark text up to which its sketches are sent to the executors.
BLOCK_BYTES = 4 << 20


def sketch(found: set[bytes], contained: float, words: int) -> tuple[np.ndarray, int, int]:
    """The hashes of an item's shingles, ascending, how many of them are its sketch, and how many a document must meet."""
    hashes = np.unique(shingle_hashes(list(found), words)[0])
    upper = 1 << (len(found) - 1).bit_length()  # the partition's largest size
    depth = min(upper - math.ceil(contained * upper - 1e-9) + 1, len(hashes))
    return hashes, depth, max(1, depth - (len(found) - math.ceil(contained * len(found) - 1e-9)))


class Sketches:
    """MinHash sketches of benchmark items, partitioned by size."""

    def __init__(self, items: list[tuple[int, str | None]], contained: float = CONTAINED, words: int = WORDS):
        self.words = words
        sets = [(item, set(shingles((text or "").encode(), words))) for item, text in items]
        sets = [(item, found) for item, found in sets if found]
        self.items = [item for item, _ in sets]
        self.shingles = [found for _, found in sets]
        self.least = [math.ceil(contained * len(found) - 1e-9) for found in self.shingles]
        self.hits = []
        values, owners, every = [], [], [np.zeros(0, dtype=np.uint64)]
        for k, found in enumerate(self.shingles):
            hashes, depth, hits = sketch(found, contained, words)
            self.hits.append(hits)
            values.append(hashes[:depth])
            owners.append(np.full(depth, k))
            every.append(hashes)
        values, owners = np.concatenate([np.zeros(0, np.uint64), *values]), np.concatenate([np.zeros(0, np.int64), *owners])
        order = np.argsort(values, kind="stable")
        self.owners = owners[order]
        self.values, self.first, self.count = np.unique(values[order], return_index=True, return_counts=True)
        self.every = np.unique(np.concatenate(every))
        self.gate = np.zeros(1 << 16, dtype=bool)
        self.gate[(self.every >> np.uint64(48)).astype(np.int64)] = True

    def contained(self, texts: list[bytes]) -> list[list[int]]:
        """Items in each text, by ascending number."""
        out: list[list[int]] = [[] for _ in texts]
        if not len(self.values):
            return out
        hashes, owner, at = shingle_hashes(texts, self.words)
        open_ = np.flatnonzero(self.gate[(hashes >> np.uint64(48)).astype(np.int64)])
        hashes, owner, at = hashes[open_], owner[open_], at[open_]
        where = np.minimum(np.searchsorted(self.every, hashes), len(self.every) - 1)
        known = np.flatnonzero(self.every[where] == hashes)
        hashes, owner, at = hashes[known], owner[known], at[known]
        where = np.minimum(np.searchsorted(self.values, hashes), len(self.values) - 1)
        met = np.flatnonzero(self.values[where] == hashes)
        if not len(met):
            return out
        pairs = np.unique(np.stack([owner[met], where[met]]), axis=1)
        reps = self.count[pairs[1]]
        item = self.owners[np.repeat(self.first[pairs[1]], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)]
        candidates, seen = np.unique(np.stack([np.repeat(pairs[0], reps), item]), axis=1, return_counts=True)
        hits = np.array(self.hits)
        candidates = candidates[:, seen >= hits[candidates[1]]]
        order = np.argsort(owner, kind="stable")
        begin = np.searchsorted(owner[order], np.arange(len(texts) + 1))
        for text in np.unique(candidates[0]).tolist():
            words = texts[text].lower().split()
            held = {b" ".join(words[p : p + self.words]) for p in np.unique(at[order[begin[text] : begin[text + 1]]]).tolist()}
            for k in candidates[1][candidates[0] == text].tolist():
                if len(held & self.shingles[k]) >= self.least[k]:
                    out[text].append(self.items[k])
        return [sorted(x) for x in out]


def flag(docs: DataFrame, items: DataFrame, text_col: str = "text", contained: float = CONTAINED, words: int = WORDS) -> DataFrame:
    """``docs`` with ``_items``, the ids of the benchmark items each document contains.

    ``items`` has ``item_id`` and ``text``; items without words are in no document,
    items and documents of fewer than ``words`` words are one shingle.  Repeated
    items with one id count once.  Null texts contain nothing, repeated rows are all
    kept and an empty table stays empty.  A column called ``_items`` is replaced.

    Items are the query set.  Up to BLOCK_BYTES of text their sketches go to the
    executors and documents are never shuffled; a larger set is joined with the
    documents' shingle hashes, with the same result.
    """
    spark = docs.sparkSession
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > BLOCK_BYTES:
        return _joined(docs, items, text_col, contained, words)
    kept = [c for c in docs.columns if c != "_items"]
    out = docs.select(*map(named, kept))
    rows = sorted({(r.item_id, r.text) for r in items.select("item_id", "text").collect() if r.text is not None and r.item_id is not None})
    sketches = spark.sparkContext.broadcast(Sketches(rows, contained, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in grouped(iter([whole]), whole.schema.get_field_index(text_col), 2 << 20):
                texts = [t.as_py() or b"" for t in batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sketches.value.contained(texts), pa.list_(pa.int64()))], names=[*batch.schema.names, "_items"])

    return out.mapInArrow(run, T.StructType([*out.schema.fields, T.StructField("_items", T.ArrayType(T.LongType()))]))


def _joined(docs: DataFrame, items: DataFrame, text_col: str, contained: float, words: int) -> DataFrame:
    """``flag`` for a benchmark of any size: sketches meet shingle hashes in a join, and texts of candidates only are looked at again."""
    docs, back, of = guarded(docs.drop("_items"))
    both = [F.xxhash64(of[text_col]).alias("_h"), F.hash(of[text_col]).alias("_g")]
    texts = docs.where(F.col(of[text_col]).isNotNull()).select(*both, F.col(of[text_col]).cast("binary").alias("_text"))

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, 2, 1 << 20):
            found = hashes_by_text([t.as_py() for t in batch.column(2)], words)
            n = [len(x) for x in found]
            values = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
            keys = [pa.array(np.repeat(batch.column(k).to_numpy(zero_copy_only=False), n)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(values)], names=["_h", "_g", "s"])

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = set(shingles(text, words))
                if found:
                    hashes, depth, hits = sketch(found, contained, words)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(depth, item)), pa.array(hashes[:depth].view(np.int64)), pa.array(np.full(depth, hits))], names=["item_id", "s", "hits"])

    wanted = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("binary").alias("_item")).distinct()
    sketched = wanted.mapInArrow(of_items, "item_id long, s long, hits long")
    met = texts.mapInArrow(of_texts, "_h long, _g int, s long").join(sketched, "s").groupBy("_h", "_g", "item_id").agg(F.countDistinct("s").alias("n"), F.min("hits").alias("hits"))
    pairs = materialized(met.where("n >= hits").select("_h", "_g", "item_id"), "candidates")
    asked = texts.join(pairs.select("_h", "_g").distinct(), ["_h", "_g"], "left_semi").groupBy("_h", "_g").agg(F.first("_text").alias("_text"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for text, item in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                theirs = set(shingles(item, words))
                good.append(len(theirs & set(shingles(text, words))) >= math.ceil(contained * len(theirs) - 1e-9))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in batch.columns[:3]], names=["_h", "_g", "item_id"])

    known = pairs.join(asked, ["_h", "_g"]).join(wanted, "item_id").select("_h", "_g", "item_id", "_text", "_item").mapInArrow(exact, "_h long, _g int, item_id long")
    known = known.groupBy("_h", "_g").agg(F.array_sort(F.collect_set("item_id")).alias("_items"))
    out = docs.select("*", *both).join(known, ["_h", "_g"], "left").select(*docs.columns, F.coalesce("_items", F.expr("cast(array() as array<bigint>)")).alias("_items"))
    return back(out)


def digests(flagged: DataFrame) -> DataFrame:
    """The query's columns."""
    return flagged.select("doc_id", (F.size("_items") > 0).alias("contaminated"), F.size("_items").cast("long").alias("n_items"), F.array_join(F.col("_items").cast("array<string>"), ",").alias("item_ids"))
