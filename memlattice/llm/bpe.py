"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The queue has one bucket per merge rank, holding positions of a linked list over
the bytes of a pre-token.  Three levels of 64-bit words mark the ranks whose
bucket is not empty, so the next rank is three find-first-set steps away however
long the pre-token is.  Entries are not removed when a neighbour's merge outdates
them; they are skipped when they surface.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlattice.llm.word_ids import KnownWords, TwoGenerations, WordEncoder, binaries, grouped


#: Rows of ids and bytes that go back to Spark at a time.
ROWS_A_BATCH = 256


class RankQueue:
    """Lists of positions by merge rank; ``pop`` gives the lowest rank and its list."""

    def __init__(self, n_ranks: int):
        words = (n_ranks >> 6) + 1
        self.leaf = [0] * words
        self.middle = [0] * ((words >> 6) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def open(self, rank: int, positions: list[int]) -> list[int]:
        """Start the bucket of a rank that has none."""
        self.buckets[rank] = positions
        word = rank >> 6
        if not self.leaf[word]:
            block = word >> 6
            self.middle[block] |= 1 << (word & 63)
            self.top |= 1 << block
        self.leaf[word] |= 1 << (rank & 63)
        return positions

    def pop(self) -> tuple[int, list[int]]:
        top = self.top
        block = (top & -top).bit_length() - 1
        bits = self.middle[block]
        word = (block << 6) | ((bits & -bits).bit_length() - 1)
        bits = self.leaf[word]
        low = bits & -bits
        self.leaf[word] = rest = bits ^ low
        if not rest:
            self.middle[block] ^= 1 << (word & 63)
            if not self.middle[block]:
                self.top ^= 1 << block
        rank = (word << 6) | (low.bit_length() - 1)
        return rank, self.buckets.pop(rank)


class ByteBPE:
    """A rank vocabulary: ``encode`` gives the ids of a group of texts, ``decode`` the bytes of ids.

    A pre-token that is itself a token becomes that token; otherwise its lowest
    ranked adjacent pair, leftmost first, is merged until no pair has a rank.
    Ranks are the ids, and every single byte has one.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.n_ranks = max(ranks.values(), default=0) + 1
        self.tokens = [b""] * self.n_ranks
        for token, rank in ranks.items():
            self.tokens[rank] = token
        #: Rank of a pair by left id << 32 | right id, for every split of a token into two tokens.
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.byte_pair = np.full((256, 256), -1, dtype=np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.byte_pair[token[0], token[1]] = rank
        self.split = regex.compile(pattern).findall
        self.pieces = TwoGenerations()
        line_feed = ranks[b"\n"]
        self.encode = WordEncoder(KnownWords(self._texts), lambda texts: [np.frombuffer(ids, dtype="<u4") for ids in self._texts(texts)], line_feed)
        self.flat = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.ends = np.cumsum([0, *map(len, self.tokens)], dtype=np.int64)

    def _texts(self, texts: list[str]) -> list[bytes]:
        split = [self.split(text) for text in texts]
        absent = self.pieces.missing({piece for found in split for piece in found})
        now, merged = self.pieces.now, []
        for piece in absent:
            raw = piece.encode("utf-8", "surrogatepass")
            rank = self.ranks.get(raw)
            if rank is None:
                merged.append((piece, raw))
            else:
                now[piece] = rank.to_bytes(4, "little")
        for (piece, _), ids in zip(merged, self.merge([raw for _, raw in merged]), strict=True):
            now[piece] = ids
        return [b"".join(map(now.__getitem__, found)) for found in split]

    def merge(self, raws: list[bytes]) -> list[bytes]:
        """Packed ids of pre-tokens of one byte or more, all through one queue.

        The linked list runs over the bytes of all of them, without pairs across
        their borders.
        """
        if not raws:
            return []
        data = np.frombuffer(b"".join(raws), dtype=np.uint8)
        ends = np.cumsum([len(raw) for raw in raws])
        n = len(data)
        first_pairs = np.full(n, -1, dtype=np.int64)
        first_pairs[:-1] = self.byte_pair[data[:-1], data[1:]]
        first_pairs[ends - 1] = -1
        at = np.flatnonzero(first_pairs >= 0)
        at = at[np.argsort(first_pairs[at], kind="stable")]
        queue = RankQueue(self.n_ranks)
        if len(at):
            ordered = first_pairs[at]
            cuts = np.flatnonzero(np.diff(ordered)) + 1
            for rank, positions in zip(ordered[np.r_[0, cuts]].tolist(), np.split(at, cuts), strict=True):
                queue.open(rank, positions.tolist())
        pair = first_pairs.tolist() + [-1]
        token = self.byte_id[data].tolist() + [-1]
        after = list(range(1, n + 2))
        before = list(range(-1, n + 1))
        border = bytearray(n + 1)  # 1 where a pre-token starts
        border[0] = border[n] = 1
        for end in ends.tolist():
            border[end] = 1
        rank_of, buckets, pop, start = self.pairs.get, queue.buckets, queue.pop, queue.open
        while queue.top:
            rank, positions = pop()
            positions.sort()
            for done, left in enumerate(positions, 1):
                if pair[left] != rank:
                    continue  # outdated by a neighbour's merge
                right = after[left]
                end = after[right]
                after[left] = end
                before[end] = left
                pair[right] = -1
                token[right] = -1
                token[left] = rank
                lower = False
                made = -1 if border[end] else rank_of(rank << 32 | token[end], -1)
                pair[left] = made
                if made >= 0:
                    bucket = buckets.get(made)
                    if bucket is None:
                        start(made, [left])
                        lower = made < rank
                    else:
                        bucket.append(left)
                if not border[left]:
                    ahead = before[left]
                    made = rank_of(token[ahead] << 32 | rank, -1)
                    pair[ahead] = made
                    if made >= 0:
                        bucket = buckets.get(made)
                        if bucket is None:
                            start(made, [ahead])
                            lower = lower or made < rank
                        else:
                            bucket.append(ahead)
                if lower and done < len(positions):  # that pair goes first
                    rest = positions[done:]
                    if rank in buckets:
                        buckets[rank].extend(rest)
                    else:
                        start(rank, rest)
                    break
        tokens = np.array(token[:-1], dtype=np.int64)
        kept = tokens >= 0
        upto = np.cumsum(kept)[ends - 1] * 4
        packed = tokens[kept].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *upto[:-1].tolist()], upto.tolist(), strict=True)]

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        """The number of bytes of each id."""
        return self.ends[ids + np.int64(1)] - self.ends[ids]

    def decode(self, ids: np.ndarray, step: int = 1 << 18) -> np.ndarray:
        """The bytes of ids, as an array; ``step`` ids at a time."""
        found = [np.zeros(0, np.uint8)]
        for start in range(0, len(ids), step):
            some = ids[start : start + step]
            sizes = self.sizes(some)
            place = np.repeat(self.ends[some] - (np.cumsum(sizes) - sizes), sizes)
            found.append(self.flat[place + np.arange(len(place))])
        return np.concatenate(found)


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> ByteBPE:
    """The vocabulary of a rank file (base64 token and rank a line), once a process."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return ByteBPE(ranks, pattern)


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, ``token_ids`` and ``decoded``, the bytes of those ids.

    ``rank_file`` is a path that every worker can open (an installed data package).
    Null and empty texts give no ids and no bytes; repeated rows each give a row;
    other columns, whatever their names, are not read.  Rows stay in their
    partition: there is no shuffle, and a lost executor repeats only its own tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(rank_file, pattern)
        for batch in grouped(batches, 1):
            flat, ends = codec.encode(batch.column(1))
            for start in range(0, batch.num_rows, ROWS_A_BATCH):
                rows = batch.column(0).slice(start, ROWS_A_BATCH)
                cuts = ends[start : start + len(rows) + 1]
                ids = flat[cuts[0] : cuts[-1]]
                sizes = np.r_[0, np.cumsum(codec.sizes(ids))]
                cuts = cuts - cuts[0]
                listed = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([rows, listed, binaries(codec.decode(ids), sizes[cuts])], names=["id", "token_ids", "decoded"])

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The query's columns, derived from ``encode``'s ids and bytes."""
    return encoded.select(
        id_col,
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
