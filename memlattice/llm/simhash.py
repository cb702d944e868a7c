"""SimHash near-duplicates found by pigeonring filtering.

A 64-bit fingerprint is a ring of eight 8-bit segments.  If two fingerprints
differ in at most ``BITS`` = 3 bits, some segment starts a chain round the ring in
which the first ``l`` segments together differ in at most ``floor(l * 3 / 8)``
bits, for every ``l``: 0, 0, 1, 1, 1, 2, 2, 3.  So from that start two segments are
equal, and of the next three, taken as two halves of 12 bits, one half is.  Those
28 bits are the index key; the longer chains prune what the key brings together
before the whole distance counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlattice.llm.common import arrow_rows, materialized, text_or_empty
from memlattice.llm.components import connected
from memlattice.llm.tiles import dealt, hot_keys

BITS = 3
SEGMENTS = 8
WIDTH = 64 // SEGMENTS
#: Bits in which the first l segments of a chain may differ.
BUDGET = [length * BITS // SEGMENTS for length in range(1, SEGMENTS + 1)]
#: Fingerprints under one key that one task compares; more are dealt out as pairs of tiles.
TILE = 8192
_PLACES = (np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1


def fingerprint(text: bytes, words: int = 3) -> int:
    """Majority bits of the shingles' XXH64 (seed 42); 0 without words."""
    found = text.lower().split()  # A-Z, and white space x20, x09-x0D
    if not found:
        return 0
    runs = zip(*(found[k:] for k in range(words)), strict=False) if len(found) >= words else [found]
    hashed = xxhash.xxh64_intdigest
    h = np.array([hashed(b" ".join(run), 42) for run in runs], dtype="<u8")
    columns = h.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _PLACES for k in range(8)])
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``docs`` without its text, with ``_fingerprint`` as a signed long.

    Null texts count as empty.  Every row is kept; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found)], names=["doc_id", "_text", "_fingerprint"])

    source = docs.select("doc_id", text_or_empty().cast("binary").alias("text"), F.xxhash64("text").alias("_text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, _text long, _fingerprint long")


def _keys(fp: Column) -> Column:
    found = []
    for start in range(SEGMENTS):
        turn = start * WIDTH
        ring = fp if not turn else F.shiftleft(fp, turn).bitwiseOR(F.shiftrightunsigned(fp, 64 - turn))
        equal = F.shiftleft(F.shiftrightunsigned(ring, 48), 12)
        for half in (0, 1):
            part = F.shiftrightunsigned(ring, 36 - 12 * half).bitwiseAND(0xFFF)
            found.append(equal.bitwiseOR(part).bitwiseOR(F.lit((start * 2 + half) << 28).cast("long")))
    return F.array(*found)


def _near(start: np.ndarray, difference: np.ndarray) -> np.ndarray:
    """Chains within budget, which end in the whole distance."""
    turn = start.astype(np.uint64) * np.uint64(WIDTH)
    ring = (difference << turn) | (difference >> ((np.uint64(64) - turn) & np.uint64(63)))
    ring = np.where(turn == 0, difference, ring)
    held = np.ones(len(ring), dtype=bool)
    for length in (4, 5, 7, 8):  # the chains that end before a budget grows bind the shorter ones
        held &= np.bitwise_count(ring >> np.uint64(64 - WIDTH * length)) <= BUDGET[length - 1]
    return held


def _tree(start: int, members: np.ndarray, others: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is near among members (or between them and others), at most one a fingerprint."""
    left, right = [], []
    waiting = members if others is None else np.unique(np.concatenate([members, others]))
    inside = None if others is None else members
    while len(waiting):
        front, waiting = [waiting[0]], waiting[1:]
        while front and len(waiting):
            at = front.pop()
            near = _near(np.full(len(waiting), start), waiting ^ at)
            if inside is not None and near.any():
                near &= np.isin(waiting, inside) != np.isin(at, inside)
            if near.any():
                found = waiting[near]
                waiting = waiting[~near]
                left.append(np.full(len(found), at))
                right.append(found)
                front.extend(found)
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of fingerprints that share a key, from rows sorted by key, two tiles and side."""
    whole = np.zeros((0, 5), dtype=np.int64)

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, prints = rows[:, 0], rows[:, 4].copy().view(np.uint64)
        starts = np.r_[0, np.flatnonzero(np.any(rows[1:, :3] != rows[:-1, :3], axis=1)) + 1]
        sizes = np.diff(np.r_[starts, len(rows)])
        few = np.repeat((sizes <= 8) & (rows[starts, 1] == rows[starts, 2]), sizes)
        for lag in range(1, min(8, int(sizes.max()))):
            pair = np.flatnonzero(few[lag:] & (keys[lag:] == keys[:-lag]) & np.all(rows[lag:, 1:3] == rows[:-lag, 1:3], axis=1))
            if len(pair):
                a, b = prints[pair], prints[pair + lag]
                held = _near(keys[pair] >> 29, a ^ b)
                yield out(a[held], b[held])
        for at, size in zip(starts.tolist(), sizes.tolist(), strict=True):
            if size > 1 and not few[at]:
                some, side = prints[at : at + size], rows[at : at + size, 3]
                yield out(*_tree(int(keys[at] >> 29), some[side == 0], some[side == 1] if rows[at, 1] != rows[at, 2] else None))

    for batch in batches:
        if not batch.num_rows:
            continue
        whole = np.concatenate([whole, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)])
        same = np.flatnonzero(np.any(whole[:, :3] != whole[-1, :3], axis=1))
        upto = int(same[-1]) + 1 if len(same) else 0  # the last key may go on
        if upto:
            yield from links(whole[:upto])
            whole = whole[upto:]
    if len(whole):
        yield from links(whole)


def links(distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """Edges ``a``, ``b`` that connect every two fingerprints (column ``fp``, distinct) within BITS bits.

    A key's fingerprints are joined by a tree of links and not by all pairs, so the
    edges are linear in the fingerprints; none that is linked to another is lost.
    Keys are counted first: those of more than ``tile`` fingerprints are dealt into
    tiles by hash and every two tiles are compared in a task of their own.
    """
    keyed = materialized(distinct.select(F.explode(_keys(F.col("fp"))).alias("key"), F.col("fp").alias("node")), "keys")
    rows = dealt(keyed, "key", hot_keys(keyed, "key", F.ceil(F.count("*") / tile))).select("key", "x", "y", "side", "node")
    rows = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "side", "node")
    arrow_rows(distinct.sparkSession, 20_000)
    return rows.mapInArrow(_search, "a long, b long")


def classify(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id``, ``_text`` (hash of the text), ``_fingerprint``, ``component_id`` for every row of ``docs``.

    Fingerprints are those of ``words``-word shingles, linked at BITS bits or fewer;
    documents without words have fingerprint 0 and are linked like any others.
    ``component_id`` is the smallest doc_id reachable.  Copies are one fingerprint in
    the search.  Repeated rows share their component; a null doc_id never names one
    unless its component has no other.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    printed = materialized(fingerprints(docs, words), "fingerprints")
    first = printed.groupBy(F.col("_fingerprint").alias("fp")).agg(F.min("doc_id").alias("first"))
    roots = connected(links(first.select("fp")))
    arrow_rows(spark)
    first = first.join(roots, first.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = first.groupBy("root").agg(F.min("first").alias("component_id"))
    named = first.join(named, "root").select(F.col("fp").alias("_fingerprint"), "component_id")
    return printed.join(named, "_fingerprint").select("doc_id", "_text", "_fingerprint", "component_id")


def digests(classes: DataFrame) -> DataFrame:
    """The query's columns."""
    return classes.select("doc_id", F.lpad(F.lower(F.hex("_fingerprint")), 16, "0").alias("fingerprint"), "component_id")
