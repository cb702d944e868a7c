"""Token ids in files of canonical, length-limited Huffman code.

Layout of a dataset below one folder:

* ``code``: ``token_id``, ``length`` — the code lengths, from counts over the
  whole corpus.  Codes are canonical: by length, then id.
* ``parts``: ``part``, ``n_ids`` — ids in each ordered part of the corpus.
* ``blocks``: one row a block of whole documents: ``part``, ``start`` (ids of the
  part before it), ``n_ids``, ``doc_ids``, ``lengths`` (ids of each document),
  ``bits`` and ``checkpoints``, the bits between every ``STEP`` ids as unsigned
  16-bit integers.

Blocks decode independently, and within a block all checkpoints decode side by
side through one table of ``2 ** limit`` entries.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlattice.llm.common import remove, scratch
from memlattice.llm.word_ids import KnownWords, WordEncoder, binaries, grouped

STEP = 64
BLOCK_IDS = 1 << 16
LIMIT = 20
#: Bytes of ids that are counted at a time.
COUNTED_BYTES = 8 << 20
#: Chunks that are one pre-token: letters, digits or marks, after a space or none.
ONE_PIECE = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[!-/:-@\[-`{-~]+)").fullmatch
BLOCK = "part int, start long, n_ids long, doc_ids array<long>, lengths array<int>, bits binary, checkpoints binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal lengths of at most ``limit`` bits for symbols by count, by package-merge.

    Symbols that never occur get length 0; a single symbol gets one bit.
    """
    lengths = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    levels, row, leaf = [], leaves, np.ones(len(leaves), dtype=bool)
    for _ in range(limit):
        levels.append(np.cumsum(leaf))
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        rank = np.argsort(both, kind="stable")
        row, leaf = both[rank], rank < len(leaves)
    take = 2 * len(leaves) - 2
    for upto in reversed(levels):
        if take == 0:
            break
        own = int(upto[take - 1])
        lengths[order[:own]] += 1
        take = 2 * (take - own)
    return lengths


class Code:
    """Canonical codes of given lengths, with the decoding table."""

    def __init__(self, lengths: np.ndarray, limit: int = LIMIT):
        self.limit, self.lengths = limit, lengths.astype(np.int64)
        used = np.flatnonzero(lengths)
        order = used[np.argsort(lengths[used], kind="stable")]
        self.codes = np.zeros(len(lengths), dtype=np.uint64)
        table = np.zeros(1 << limit, dtype=np.int32)
        widths = np.zeros(1 << limit, dtype=np.int64)
        spans = np.int64(1) << (limit - self.lengths[order])
        starts = np.cumsum(spans) - spans
        self.codes[order] = (starts >> (limit - self.lengths[order])).astype(np.uint64)
        total = int(spans.sum())
        table[:total] = np.repeat(order, spans)
        widths[:total] = np.repeat(self.lengths[order], spans)
        self.table, self.widths = table, widths

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Bits of the ids, most significant first, and the checkpoint distances."""
        if not len(ids):
            return b"", b""
        width = self.lengths[ids]
        ends = np.cumsum(width)
        offset = ends - width
        word = offset >> 5
        shifted = self.codes[ids] << (64 - (offset & 31) - width).astype(np.uint64)
        n_words = int(ends[-1] >> 5) + 2
        words = np.bincount(word, weights=(shifted >> np.uint64(32)).astype(np.float64), minlength=n_words)
        words[1:] += np.bincount(word, weights=(shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n_words)[:-1]
        marks = np.diff(offset[::STEP], append=ends[-1])
        return words.astype(np.uint64).astype(">u4").tobytes(), marks.astype("<u2").tobytes()

    def decode(self, bits: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        """The ``n`` ids of a block."""
        out = np.zeros((-(-n // STEP), STEP), dtype=np.int32)
        if not n:
            return out.reshape(-1)
        words = np.frombuffer(bits, dtype=">u4").astype(np.uint64)
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        marks = np.frombuffer(checkpoints, dtype="<u2").astype(np.int64)
        at, stop = np.cumsum(marks) - marks, 64 - self.limit
        mask, last = np.uint64((1 << self.limit) - 1), len(pairs) - 1
        for k in range(STEP):
            seen = pairs[np.minimum(at >> 5, last)] >> (stop - (at & 31)).astype(np.uint64) & mask
            out[:, k] = self.table[seen]
            at = at + self.widths[seen]
        return out.reshape(-1)[:n]


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Visible Latin-1 characters stand for their own byte, and the characters from
    U+0100 on for the other bytes in order.
    """
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def library(path: str) -> WordEncoder:
    """The tokenizers library's ids (``add_special_tokens=False``), whole texts by their distinct words."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def wholes(texts: list[str]) -> list[np.ndarray]:
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.uint32) for e in found]

    (line_feed,) = wholes(["\n"])[0].tolist()
    # The model takes bytes as the visible characters that the byte-level pre-tokenizer writes for them.
    shown = {byte: char for char, byte in byte_characters().items()}
    merges = tokenizer.model.tokenize

    def words(chunks: list[str]) -> list[bytes]:
        """A chunk of one pre-token goes to the model itself, any other through the whole tokenizer."""
        single = [c for c in chunks if ONE_PIECE(c)]
        ids, ends = [], [0]
        for piece in "\n".join(single).encode().decode("latin-1").translate(shown).split(shown[10]) if single else ():
            ids += [t.id for t in merges(piece)]
            ends.append(len(ids))
        packed = np.array(ids, dtype="<u4").tobytes()
        out = {c: packed[4 * a : 4 * b] for c, a, b in zip(single, ends, ends[1:], strict=False)}
        rest = [c for c in chunks if c not in out]
        out.update((c, found.astype("<u4").tobytes()) for c, found in zip(rest, wholes(rest), strict=True))
        return [out[c] for c in chunks]

    return WordEncoder(KnownWords(words), wholes, line_feed, tuple(t.content for t in tokenizer.get_added_tokens_decoder().values()))


def _tokenized(tokenizer: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library(tokenizer)
        for batch in grouped(batches, 1):
            flat, ends = encoder(batch.column(1))
            flat = np.insert(flat, ends[1:], end_id)
            ends = ends + np.arange(len(ends))
            width = _narrowest(flat)
            packed = binaries(flat.astype(width), ends)
            sizes = pa.array(np.diff(ends), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), sizes, packed], names=["doc_id", "tie", "n", "ids"])

    return run


def _narrowest(ids: np.ndarray) -> str:
    return "<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4"


def _widened(packed: pa.Array, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Each value's ids; its length and their number tell their width."""
    for held, n in zip(packed.to_pylist(), sizes.tolist(), strict=True):
        yield np.frombuffer(held, dtype="<u2" if len(held) == 2 * n else "<u4")


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, limit: int = LIMIT, block_ids: int = BLOCK_IDS) -> None:
    """Tokenize ``doc_id``, ``text`` and write the ids below ``folder`` in ascending order of doc_id.

    ``end_id`` follows each document; null and empty texts have that id alone.
    Rows with equal doc_id are all written, ordered by the hash of their text;
    null doc_ids come first.  An empty table gives a dataset without blocks.
    Texts are tokenized where they lie, into a table in the shared folder that goes
    when the files are written, and ids, not texts, are shuffled into order; only
    the counts (a row for each id of the vocabulary) and the totals of the parts (a
    row for each task) come to the driver.
    """
    spark = docs.sparkSession
    stage = scratch(spark, "ids")
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("tie"))
    raw = "doc_id long, tie long, n int, ids binary"
    source.mapInArrow(_tokenized(tokenizer, end_id), raw).write.option("compression", "zstd").parquet(stage)
    held = spark.read.schema(raw).parquet(stage)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in grouped(batches, 1, COUNTED_BYTES):
            found = np.bincount(np.concatenate(list(_widened(batch.column(1), batch.column(0).to_numpy()))), minlength=len(total))
            found[: len(total)] += total
            total = found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["token_id", "n"])

    counted = held.select("n", "ids").mapInArrow(count, "token_id int, n long").groupBy("token_id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(counted["token_id"].max()) + 1 if len(counted) else 1, dtype=np.int64)
    counts[counted["token_id"]] = counted["n"]
    lengths = code_lengths(counts, limit)
    used = np.flatnonzero(lengths)
    code = spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "token_id int, length int")
    code.coalesce(1).write.parquet(f"{folder}/code")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        huffman, part = Code(lengths, limit), TaskContext.get().partitionId()
        start, size, docs_held, sizes, ids = 0, 0, [], [], []

        def block() -> pa.RecordBatch:
            bits, marks = huffman.encode(np.concatenate(ids).astype(np.int64))
            columns = [pa.array([part], pa.int32()), pa.array([start], pa.int64()), pa.array([size], pa.int64()), pa.array([docs_held], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([bits], pa.binary()), pa.array([marks], pa.binary())], names=[f.split()[0] for f in BLOCK.split(", ")])

        for batch in batches:
            for doc_id, n, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _widened(batch.column(2), batch.column(1).to_numpy()), strict=True):
                docs_held.append(doc_id)
                sizes.append(n)
                ids.append(found)
                size += n
                if size >= block_ids:
                    yield block()
                    start, size, docs_held, sizes, ids = start + size, 0, [], [], []
        if docs_held:
            yield block()

    ordered = held.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "n", "ids")
    ordered.mapInArrow(coded, BLOCK).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    blocks = spark.read.schema(BLOCK).parquet(f"{folder}/blocks")
    blocks.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).coalesce(1).write.parquet(f"{folder}/parts")
    remove(spark, stage)


def read(spark: SparkSession, folder: str, limit: int = LIMIT) -> DataFrame:
    """Documents of a dataset: ``doc_id``, ``start`` (ids before it), ``token_ids`` packed in 4 bytes each."""
    code = spark.read.schema("token_id int, length int").parquet(f"{folder}/code").toPandas()
    lengths = np.zeros(int(code["token_id"].max()) + 1 if len(code) else 1, dtype=np.uint8)
    lengths[code["token_id"]] = code["length"]
    parts = sorted((r.part, r.n_ids) for r in spark.read.schema("part int, n_ids long").parquet(f"{folder}/parts").collect())
    before = dict(zip([p for p, _ in parts], np.cumsum([0, *(n for _, n in parts)]).tolist(), strict=False))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        huffman = Code(lengths, limit)
        for batch in batches:
            for part, start, doc_ids, sizes, bits, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cuts = np.cumsum([0, *sizes])
                packed = huffman.decode(bits, marks, int(cuts[-1])).astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array(before[part] + start + cuts[:-1], pa.int64()),
                        pa.array([packed[4 * a : 4 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "start", "token_ids"],
                )

    blocks = spark.read.schema(BLOCK).parquet(f"{folder}/blocks").drop("n_ids")
    return blocks.mapInArrow(decoded, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("token_ids", T.BinaryType())]))


def digests(decoded: DataFrame) -> DataFrame:
    """The query's columns, from what ``read`` gives."""
    return decoded.select("doc_id", "start", F.expr("octet_length(token_ids) div 4").cast("long").alias("n_tokens"), F.crc32("token_ids").alias("ids_crc32"))


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
