"""Near copies: SimHash rings of five-word shingles find them, exact similarity decides.

Two texts are near copies if their sets of ``WORDS``-word shingles have a Jaccard
similarity of ``SIMILAR`` or more.  At that similarity a fingerprint's bits differ with
a chance of 15 %, too far for the budgets of a few bits of ``simhash``, so the search
is in three steps:

1. Pigeonring: a 128-bit fingerprint is a ring of 16 segments.  If two differ in at most
   t bits, some segment starts a chain round the ring in which the first l segments
   together differ in at most floor(l * t / 16), for every l.  At t = 10 that is
   0, 1, 1: from that start one segment is equal and so is one of the next two, which are
   the two index keys of each start.  What meets under a key joins a candidate group if
   the chain from there is within the budgets of t = ``MOST`` at every length.  Pairs of
   more than 10 differing bits meet by chance, so several rings hold the bits in orders
   of their own.
2. In each group, texts are compared by their shingles; a tree of links connects what
   is similar, so that a group of copies has as many links as texts and not all pairs.
3. The connected texts are a class.

Keys get longer, and rings more, with the number of texts (``rings``), which keeps what
meets under one key small; the longer keys take the two parts from more segments of the
chain and are sure up to fewer bits.  Recall is a matter of chance in step 1 only and
about the same at all sizes (``expected_recall``, README).  No key or group
is cut short: large ones are dealt into tiles, and every two tiles meet in a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.llm.common import arrow_rows, guarded, materialized, remove, scratch, text_or_empty
from memlattice.llm.components import connected
from memlattice.llm.shingles import hashes_by_text, mix
from memlattice.llm.tiles import dealt, hot_keys
from memlattice.llm.word_ids import grouped

WORDS, SIMILAR = 5, 0.8
BITS, SEGMENTS = 128, 16
WIDTH = BITS // SEGMENTS
#: Parts of the segments behind the first of a chain, of which one is equal.
PARTS = 2
#: Bits in which fingerprints of similar texts differ at most: three standard deviations over the mean at SIMILAR.
MOST = 33
#: Bits in which the first l segments of a chain may differ.
BUDGET = np.array([length * MOST // SEGMENTS for length in range(1, SEGMENTS + 1)])
#: Texts under one key that meet by chance, at most, and the members and shingles of a tile.
BY_CHANCE, TILE, TILE_SHINGLES = 16, 4096, 4_000_000
#: Rings whose keys are on disk at a time.
ROUND = 4

Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


def rings(texts: int) -> tuple[int, list[np.ndarray]]:
    """The bits of a key and the orders of bits of all rings, for a number of texts.

    A key has 16 bits or more, so many that at most BY_CHANCE unrelated texts share one;
    rings are as many as keep the recall of similar pairs while keys get longer.
    """
    width = 16
    while texts >> width > BY_CHANCE and width < 64:
        width += 4
    draw = np.random.default_rng(11)
    return width, [draw.permutation(BITS) for _ in range(math.ceil(3 * 2.8 ** ((width - 16) / 4)))]


def turns(ring: np.ndarray) -> Iterator[np.ndarray]:
    """The bits of a ring from each of its segments on: the order in which a chain meets them."""
    for start in range(SEGMENTS):
        yield np.roll(ring, -start * WIDTH)


def parts(width: int) -> list[np.ndarray]:
    """The places in a turn of the ring that make up each of its keys: the first segment and one of the parts that follow."""
    size = width - WIDTH
    return [np.r_[0:WIDTH, WIDTH + k * size : WIDTH + (k + 1) * size] for k in range(PARTS)]


def layout(texts: int) -> list[list[int]]:
    """The bits of each key, for a number of texts."""
    width, orders = rings(texts)
    return [turn[part].tolist() for ring in orders for turn in turns(ring) for part in parts(width)]


def tree(n: int, near: Near, side: np.ndarray | None = None, step: int = 64, walks: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is near among ``n`` members, at most one a member; with ``side``, only links across sides.

    ``near`` tells for some members which of others they are near to.  Large trees are
    walked, which asks of every member reached for those still waiting only; after
    ``walks`` trees the rest, parted into many, is compared block by block.
    """
    waiting, left, right = np.arange(n), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def asked(some: np.ndarray, others: np.ndarray) -> np.ndarray:
        good = near(some, others)
        return good if side is None else good & (side[some][:, None] != side[others][None, :])

    for _ in range(walks):
        front, waiting = waiting[:1], waiting[1:]
        while len(front) and len(waiting):
            some, front = front[:step], front[step:]
            good = asked(some, waiting)
            hit = good.any(axis=0)
            if hit.any():
                left.append(some[good[:, hit].argmax(axis=0)])
                right.append(waiting[hit])
                front, waiting = np.concatenate([front, waiting[hit]]), waiting[~hit]
    label = np.arange(len(waiting))
    for start in range(0, len(waiting) - 1, step):
        good = asked(waiting[start : start + step], waiting[start:])
        for k in range(len(good)):
            found = np.flatnonzero(good[k, k + 1 :]) + start + k + 1
            for group, first in zip(*np.unique(label[found], return_index=True), strict=True) if len(found) else ():
                if group != label[start + k]:
                    left.append(waiting[start + k : start + k + 1])
                    right.append(waiting[found[first] : found[first] + 1])
                    label[label == group] = label[start + k]
    return np.concatenate(left), np.concatenate(right)


class Sets:
    """How many shingles any members share, by products over frequent ones and lists of members of the others."""

    def __init__(self, sets: list[np.ndarray], dense: int = 2048):
        self.size = np.array([len(s) for s in sets])
        _, ids, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), self.size)
        kept = times[ids] > 1  # what one member has nobody shares
        ids, owner = ids[kept], owner[kept]
        order = np.argsort(-times, kind="stable")[:dense]
        order = order[times[order] >= max(2, len(sets) / 64)]
        column = np.full(len(times), -1)
        column[order] = np.arange(len(order))
        often = column[ids] >= 0
        self.matrix = np.zeros((len(sets), len(order)), dtype=np.float32)
        self.matrix[owner[often], column[ids[often]]] = 1
        self.rare = None
        if not often.all():
            ids, owner = ids[~often], owner[~often]
            by_id, by_owner = np.argsort(ids, kind="stable"), np.argsort(owner, kind="stable")
            self.rare = ids[by_owner], np.searchsorted(owner[by_owner], np.arange(len(sets) + 1)), owner[by_id], np.searchsorted(ids[by_id], np.arange(len(times) + 1))

    def shared(self, some: np.ndarray, asked: np.ndarray) -> np.ndarray:
        found = np.rint(self.matrix[some] @ self.matrix[asked].T).astype(np.int64)
        if self.rare:
            ids, upto, owners, first = self.rare
            for k, member in enumerate(some.tolist()):
                mine = ids[upto[member] : upto[member + 1]]
                n = first[mine + 1] - first[mine]
                if len(mine):
                    place = np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    found[k] += np.bincount(owners[place], minlength=len(self.size))[asked]
        return found

    def similar(self, some: np.ndarray, asked: np.ndarray) -> np.ndarray:
        shared = self.shared(some, asked)
        return shared >= SIMILAR * (self.size[some][:, None] + self.size[asked][None, :] - shared) - 1e-9


def prints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``node`` (hash of the text), ``n`` (distinct shingles) and the fingerprint ``lo``, ``hi`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, 1, 1 << 20):
            rows = np.zeros((batch.num_rows, 3), dtype=np.int64)
            for k, found in enumerate(hashes_by_text([t.as_py() for t in batch.column(1)], WORDS)):
                rows[k, 0] = len(found)
                rows[k, 1:] = majority(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(rows[:, k]) for k in range(3))], names=["doc_id", "node", "n", "lo", "hi"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", text_or_empty().cast("binary").alias("text"), F.xxhash64(text_or_empty()).alias("node"))
    return source.mapInArrow(run, f"doc_id {kind}, node long, n long, lo long, hi long")


def majority(shingles: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """The fingerprint of distinct shingle hashes as two signed integers: a bit is set if it is in over half of them."""
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(shingles), step):
        some = shingles[start : start + step]
        both = np.stack([mix(some), mix(some ^ np.uint64(0x9E3779B97F4A7C15))], axis=1)
        ones += np.unpackbits(both.view(np.uint8).reshape(len(some), -1), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(shingles)).view(np.int64)


def _keyed(width: int, orders: list[np.ndarray], first: int):
    """The keys of each fingerprint in rings numbered from ``first``, with its bits in the order of the chain that begins there."""
    weights = np.uint64(1) << np.arange(width, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, lo, hi = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            bits = np.unpackbits(np.stack([lo, hi], axis=1).view(np.uint8).reshape(len(node), -1), axis=1)
            number = first * SEGMENTS * PARTS
            for ring in orders:
                found = []
                for turn in turns(ring):
                    chain = bits[:, turn]
                    whole = np.ascontiguousarray(np.packbits(chain, axis=1)).view(np.int64)
                    for part in parts(width):
                        seed = np.uint64(number * 0xD6E8FEB86659FD93 % 2**64)
                        key = mix((chain[:, part].astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64) ^ seed).view(np.int64)
                        found.append((key, node, whole[:, 0], whole[:, 1]))
                        number += 1
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["key", "node", "lo", "hi"])

    return run


def _by_key(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The rows of each key (the first ``n_keys`` columns) of batches sorted by it."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            this = tuple(int(c[start]) for c in columns)
            if this != key and held:
                yield key, pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            key = this
            held.append(batch.slice(start, end - start))
    if held:
        yield key, pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _edges(node: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node[left]), pa.array(node[right])], names=["a", "b"])


def _within(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether chains are within budget at every length, the last of which is the whole ring; ``lo``, ``hi``: differing bits in the order of the chain."""
    held = np.bitwise_count(lo.view(np.uint64)) <= BUDGET[SEGMENTS // 2 - 1]  # half the ring, which most unrelated pairs fail
    some = np.stack([lo[held], hi[held]], axis=-1).view(np.uint8)
    held[held] = np.all(np.cumsum(np.bitwise_count(some), axis=-1, dtype=np.int64) <= BUDGET, axis=-1)
    return held


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of fingerprints that share a key, from rows sorted by key, two tiles and side."""
    whole = np.zeros((0, 7), dtype=np.int64)

    def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.any(rows[1:, :3] != rows[:-1, :3], axis=1)) + 1
        starts = np.r_[0, cuts]
        sizes = np.diff(np.r_[starts, len(rows)])
        few = np.repeat(sizes <= 8, sizes)
        for lag in range(1, min(8, int(sizes.max()))):
            pair = np.flatnonzero(few[lag:] & np.all(rows[lag:, :3] == rows[:-lag, :3], axis=1) & ((rows[lag:, 2] == rows[:-lag, 1]) | (rows[lag:, 3] != rows[:-lag, 3])))
            pair = pair[_within(rows[pair, 5] ^ rows[pair + lag, 5], rows[pair, 6] ^ rows[pair + lag, 6])]
            if len(pair):
                yield _edges(rows[:, 4], pair, pair + lag)
        for start, size in zip(starts[sizes > 8].tolist(), sizes[sizes > 8].tolist(), strict=True):
            some = rows[start : start + size]
            lo, hi = some[:, 5].copy(), some[:, 6].copy()
            side = None if some[0, 1] == some[0, 2] else some[:, 3]
            yield _edges(some[:, 4], *tree(size, lambda few, asked: _within(lo[few, None] ^ lo[asked], hi[few, None] ^ hi[asked]), side))  # noqa: B023

    for batch in batches:
        whole = np.concatenate([whole, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)])
        same = np.flatnonzero(np.any(whole[:, :3] != whole[-1, :3], axis=1))
        upto = int(same[-1]) + 1 if len(same) else 0  # the last key may go on
        if upto:
            yield from links(whole[:upto])
            whole = whole[upto:]
    if len(whole):
        yield from links(whole)


def candidates(distinct: DataFrame, texts: int, tile: int = TILE) -> DataFrame:
    """``node``, ``root``: groups in which texts may be similar, for distinct ``node``, ``lo``, ``hi``; lone texts are left out."""
    spark = distinct.sparkSession
    width, orders = rings(texts)
    links = None
    for k in range(0, len(orders), ROUND):
        arrow_rows(spark, 4096)
        path, columns = scratch(spark, "keys"), "key long, node long, lo long, hi long"
        distinct.select("node", "lo", "hi").mapInArrow(_keyed(width, orders[k : k + ROUND], k), columns).write.parquet(path)
        found = spark.read.schema(columns).parquet(path)
        arrow_rows(spark, 20_000)
        rows = dealt(found, "key", hot_keys(found, "key", F.ceil(F.count("*") / tile))).select("key", "x", "y", "side", "node", "lo", "hi")
        rows = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "side", "node").mapInArrow(_meetings, "a long, b long")
        if len(orders) > ROUND:  # the keys go before the next ones are written
            rows = materialized(rows, "links")
            remove(spark, path)
        links = rows if links is None else links.union(rows)
    roots = connected(links)
    return roots.union(roots.select("root", "root").distinct())


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of similar texts among the rows of a group's two tiles, sorted by these and side; a node may come in several rows."""
    for (_, x, y), rows in _by_key(batches, 3):
        side, nodes = rows.column(3).to_numpy(zero_copy_only=False), rows.column(4).to_numpy(zero_copy_only=False)
        _, first = np.unique(nodes, return_index=True)
        rows, side, nodes = rows.take(pa.array(first)), side[first], nodes[first]
        held = Sets(hashes_by_text([t.as_py() for t in rows.column(5)], WORDS))
        yield _edges(nodes, *tree(len(nodes), held.similar, None if x == y else side))


def _roots(docs: DataFrame, tile: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The prints of all rows, the distinct texts with their first doc_id (nulls come first), and the roots of texts that have another."""
    spark = docs.sparkSession
    arrow_rows(spark)
    printed = materialized(prints(docs), "prints")
    distinct = printed.groupBy("node").agg(F.min("n").alias("n"), F.min("lo").alias("lo"), F.min("hi").alias("hi"), F.min(F.struct("doc_id"))["doc_id"].alias("doc_id"))
    distinct = materialized(distinct, "distinct")
    members = candidates(distinct, distinct.count(), tile).join(distinct.select("node", "n", "doc_id"), "node")
    members = materialized(members, "members")
    large = hot_keys(members, "root", F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("n") / TILE_SHINGLES)))
    groups = dealt(members, "root", large).select("root", "x", "y", "side", "node", F.col("doc_id").alias("first"))
    texts = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("_node"), text_or_empty().cast("binary").alias("text"))
    # The id is a key of the join as well, so that the copies of a text do not meet in one task.
    asked = texts.join(groups, (texts._node == groups.node) & texts.doc_id.eqNullSafe(groups["first"]))
    asked = asked.select("root", "x", "y", "side", "node", "text").repartition("root", "x", "y").sortWithinPartitions("root", "x", "y")
    arrow_rows(spark)
    roots = connected(asked.mapInArrow(_similar, "a long, b long"))
    arrow_rows(spark)
    return printed, distinct, roots


def classes(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """``doc_id``, ``node`` and ``root`` of every row of ``docs``; rows of one root are copies or near copies, by links.

    Null texts count as empty, and texts without words are alike.
    """
    printed, _, roots = _roots(docs, tile)
    return printed.select("doc_id", "node").join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))


def dedup(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """The documents that stay: of each class the row first by doc_id, then by hash of the text.

    All columns are kept, whatever their names; of rows equal in doc_id and text one
    stays; null doc_ids come first.  An empty table stays empty.
    """
    docs, named, _ = guarded(docs)
    _, distinct, roots = _roots(docs, tile)
    each = distinct.select("doc_id", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = each.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("k")).select("k.*")
    kept = materialized(kept.withColumnsRenamed({"doc_id": "_id", "node": "_hash"}), "kept")
    marked = docs.withColumn("_node", F.xxhash64(text_or_empty()))
    stay = marked.join(kept, marked.doc_id.eqNullSafe(kept._id) & (marked._node == kept._hash), "left_semi")
    return named(stay.dropDuplicates(["doc_id", "_node"]).drop("_node"))


def expected_recall(similarity: float, texts: int, pairs: int = 4096) -> float:
    """The share of pairs of that similarity that meet, their bits drawn independently, through the keys and the chains."""
    width, orders = rings(texts)
    differ = np.random.default_rng(3).random((pairs, BITS)) < math.acos(2 * similarity / (1 + similarity)) / math.pi
    met = np.zeros(pairs, dtype=bool)
    for turn in (turn for ring in orders for turn in turns(ring)):
        left = np.flatnonzero(~met)
        left = left[~differ[np.ix_(left, turn[:WIDTH])].any(axis=1)]
        chain = differ[np.ix_(left, turn)]
        keyed = np.any([~chain[:, part].any(axis=1) for part in parts(width)], axis=0)
        met[left[keyed]] = _within(*np.ascontiguousarray(np.packbits(chain[keyed], axis=1)).view(np.int64).T.copy())
    return float(met.mean())
