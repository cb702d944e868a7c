"""Tries of conversation prefixes: who shares which first turns, and what sharing saves.

Turns stand in range partitions by conversation and place, so that a long conversation
is spread over tasks; a prefix is named by the exclusive-or of two 64-bit hashes of its
turns and places, which running aggregates give without holding a conversation.
Prefixes with the same members form a chain, and chains are the nodes of the tries.

Subtrees of few members are prefix shards: in each, numpy builds a level-order trie as
a LOUDS bit vector with label arrays, and sums run up it level by level from the last.
Chains of many members, the upper levels, take the shards' sums and are rolled up in a
trie of their own; they are about the square root of the conversations.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.llm.common import arrow_rows, materialized

#: A prefix of more members is an upper one, from the square root of the conversations on.
HEAVY = 256
#: The first turns of another conversation that ``spliced`` takes, at most.
MOST_HEAD = 5
#: Bytes of comma-joined ids that one row holds on the way to a digest.
ID_BYTES = 1 << 20


class Louds:
    """A forest in level order: ``1`` for each child and a closing ``0``, first of a root above all, then of each node.

    ``ids`` and ``parents`` are two integers a node; a parent that is no node makes a tree's top.
    """

    def __init__(self, ids: np.ndarray, parents: np.ndarray):
        n = len(ids)
        _, name = np.unique(np.concatenate([ids, parents]), axis=0, return_inverse=True)
        name = name.reshape(-1)
        place = np.full(2 * n, -1)
        place[name[:n]] = np.arange(n)
        up = place[name[n:]]
        level, jump = (up >= 0).astype(np.int64), up.copy()
        while (jump >= 0).any():  # twice as far up each time
            level = level + np.where(jump >= 0, level[jump], 0)
            jump = np.where(jump >= 0, jump[jump], -1)
        by_level = np.argsort(level, kind="stable")
        self.first = np.searchsorted(level[by_level], np.arange(int(level.max(initial=-1)) + 2))
        rank = np.zeros(n, dtype=np.int64)
        self.order = by_level.copy()
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            some = by_level[a:b]
            some = some[np.lexsort((ids[some, 1], ids[some, 0], np.where(up[some] >= 0, rank[up[some]], -1)))]
            rank[some] = np.arange(a, b)
            self.order[a:b] = some
        self.labels = ids[self.order]
        degree = np.bincount(np.where(up >= 0, rank[up], -1) + 1, minlength=n + 1)
        bits = np.ones(2 * n + 1, dtype=bool)
        bits[np.cumsum(degree + 1) - 1] = False
        self.n, self.bits = n, np.packbits(bits)

    def parents(self) -> np.ndarray:
        """Of each node in level order the parent's number, -1 above the tops: the zeros in front of its one, less the first."""
        bits = np.unpackbits(self.bits, count=2 * self.n + 1).astype(np.int64)
        return (np.arange(len(bits)) - np.cumsum(bits) + 1)[bits == 1] - 1

    def degrees(self) -> np.ndarray:
        zeros = np.flatnonzero(np.unpackbits(self.bits, count=2 * self.n + 1) == 0)
        return np.diff(zeros) - 1

    def rolled_up(self, *own: np.ndarray) -> list[np.ndarray]:
        """Sums over each node's subtree, itself included, of values in the order of ``ids``; so are the sums."""
        parent, out = self.parents(), []
        for values in own:
            total = values[self.order]
            for a, b in zip(self.first[1:-1].tolist()[::-1], self.first[2:].tolist()[::-1], strict=True):
                np.add.at(total, parent[a:b], total[a:b])
            back = np.empty_like(total)
            back[self.order] = total
            out.append(back)
        return out


def spliced(head: int = 6, group: int = 100) -> tuple[Column, Column]:
    """How many first turns a conversation takes, and from which: the contract's rule."""
    return F.crc32(F.col("conv_id").cast("string")) % head, F.col("conv_id") - F.col("conv_id") % group


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, two hashes of role and text, code points of the text; nulls count as empty, rows without a conv_id are left out."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(17), text, role).alias("h2"), F.length(text).cast("long").alias("chars")
    )


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a partition with the partition's number and their place in it among their conversation's."""
    from pyspark import TaskContext

    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy()
        starts = np.r_[0, np.flatnonzero(np.diff(ids)) + 1]
        place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.r_[starts, len(ids)]))
        if ids[0] == last:
            place[: starts[1] if len(starts) > 1 else len(ids)] += seen
        last, seen = ids[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(np.full(len(ids), part)), pa.array(place)], names=["conv_id", "h1", "h2", "chars", "part", "i"])


def _carried(rows: DataFrame, parts: list, sums: dict[str, Column], merge) -> DataFrame:
    """``rows`` with what the earlier partitions hold of the conversation that a partition goes on with; a row a partition reaches the driver."""
    spark, held, last, table = rows.sparkSession, None, None, []
    ends = {p.part: p.last for p in parts}
    last_of = F.create_map(*(F.lit(x) for p in parts for x in (p.part, p.last))) if parts else F.create_map().cast("map<bigint,bigint>")
    mine = rows.where(F.col("conv_id") == F.element_at(last_of, F.col("part"))).groupBy("part").agg(*(v.alias(k) for k, v in sums.items())).collect()
    mine = {r.part: tuple(r)[1:] for r in mine}
    none = (0,) * len(sums)
    for p in parts:
        before = held if last == p.first and held is not None else none
        table.append((p.part, p.first, *before))
        own = mine.get(p.part, none)
        held = merge(before, own) if p.first == ends[p.part] else own
        last = ends[p.part]
    carry = spark.createDataFrame(table, "part long, conv_id long, " + ", ".join(f"before_{k} long" for k in sums))
    return rows.join(F.broadcast(carry), ["part", "conv_id"], "left").withColumns({f"before_{k}": F.coalesce(f"before_{k}", F.lit(0)) for k in sums})


def _signed(x: int) -> int:
    return (x + 2**63) % 2**64 - 2**63


def paths(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefixes of each rebuilt conversation, and its last one.

    A row a conversation and ``depth`` (0: no turn): ``k1``, ``k2`` name the prefix and
    ``p1``, ``p2`` the one before; ``chars`` of its last turn and ``sum`` of all its
    turns.  Turns stand by ``turn``, nulls first, equal ones by hash of role and text.
    """
    spark = conversations.sparkSession
    arrow_rows(spark, 16_384)
    order = ["conv_id", F.col("turn").asc_nulls_first(), "h1", "h2"]
    dealt = turns(conversations).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialized(dealt.mapInArrow(_numbered, "conv_id long, h1 long, h2 long, chars long, part long, i long"), "turns")
    parts = rows.groupBy("part").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last")).orderBy("part").collect()
    rows = _carried(rows, parts, {"n": F.count("*")}, lambda a, b: (a[0] + b[0],))
    n_head, source = spliced()
    rows = rows.withColumns({"i": F.col("i") + F.col("before_n"), "h": n_head, "base": source}).drop("before_n")

    # The first turns of the conversations that others begin with, as prefixes of 0, 1, 2, ... turns.
    mark = lambda h1, h2, pos: (F.xxhash64(h1, h2, pos), F.xxhash64(pos, h2, F.lit(29), h1))
    step = lambda s, t: F.struct(s["pos"] + 1, s["k1"].bitwiseXOR(mark(t["h1"], t["h2"], s["pos"])[0]), s["k2"].bitwiseXOR(mark(t["h1"], t["h2"], s["pos"])[1]), t["chars"], s["sum"] + t["chars"])
    kind = "struct<pos:bigint,k1:bigint,k2:bigint,chars:bigint,sum:bigint>"
    nothing = F.struct(*(F.lit(0).cast("long").alias(c) for c in ("pos", "k1", "k2", "chars", "sum")))
    firsts = rows.where((F.col("conv_id") == F.col("base")) & (F.col("i") < MOST_HEAD)).groupBy("base").agg(F.array_sort(F.collect_list(F.struct("i", "h1", "h2", "chars"))).alias("t"))
    grown = F.aggregate("t", F.array(nothing), lambda a, t: F.concat(a, F.array(step(F.element_at(a, -1), t).cast(kind))))
    heads = materialized(firsts.select("base", grown.alias("head")), "heads")
    alone = F.array(nothing)
    convs = rows.groupBy("conv_id").agg(F.first("base").alias("base"), F.first("h").alias("h"))
    convs = convs.join(heads, "base", "left").select("conv_id", F.slice(F.coalesce("head", alone), 1, (F.col("h") + 1).cast("int")).alias("head"))
    head = convs.select("conv_id", F.posexplode("head").alias("depth", "x"), F.col("head")).withColumn("up", F.get("head", F.col("depth") - 1))
    columns = lambda depth, k1, k2, p1, p2, chars, total: [F.col("conv_id"), depth.cast("long").alias("depth"), k1.alias("k1"), k2.alias("k2"), p1.alias("p1"), p2.alias("p2"), chars.alias("chars"), total.alias("sum")]
    c = F.col
    head = head.select(*columns(c("depth"), c("x.k1"), c("x.k2"), c("up.k1"), c("up.k2"), c("x.chars"), c("x.sum")))

    own = rows.where("i >= h").join(heads, "base", "left").withColumn("at", F.get(F.coalesce("head", alone), F.least(c("h"), F.size(F.coalesce("head", alone)) - 1).cast("int")))
    own = own.withColumn("pos", c("i") - c("h") + c("at.pos"))
    own = own.select("part", "conv_id", "i", "chars", "pos", "at", mark(c("h1"), c("h2"), c("pos"))[0].alias("g1"), mark(c("h1"), c("h2"), c("pos"))[1].alias("g2"))
    own = materialized(own, "marked")
    own = _carried(own, parts, {"g1": F.bit_xor("g1"), "g2": F.bit_xor("g2"), "chars": F.sum("chars")}, lambda a, b: (_signed(a[0] ^ b[0]), _signed(a[1] ^ b[1]), a[2] + b[2]))
    upto = Window.partitionBy("part", "conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = {k: c(f"at.k{k[1]}").bitwiseXOR(c(f"before_{k}")).bitwiseXOR(F.bit_xor(k).over(upto)) for k in ("g1", "g2")}
    total = c("at.sum") + c("before_chars") + F.sum("chars").over(upto)
    own = own.select("conv_id", "pos", "chars", "g1", "g2", run["g1"].alias("k1"), run["g2"].alias("k2"), total.alias("sum"))
    own = own.select(*columns(c("pos") + 1, c("k1"), c("k2"), c("k1").bitwiseXOR(c("g1")), c("k2").bitwiseXOR(c("g2")), c("chars"), c("sum")))
    every = materialized(head.unionByName(own), "paths")
    ends = every.groupBy("conv_id").agg(F.max_by(F.struct("k1", "k2"), "depth").alias("k")).select("conv_id", "k.*")
    return every, ends


_CHAIN = "conv_id long, n long, k1 long, k2 long, p1 long, p2 long, own long, leaves long, saved long, n_children long"
_ROLLED = "conv_id long, n long, up_id long, p1 long, p2 long, is_top boolean, n_children long, leaves long, saved long, own long"


def _rolled(rows: pa.Table) -> pa.RecordBatch:
    """The sums of chains that lie whole in ``rows``, with what others have added to their own."""
    conv_id, n, k1, k2, p1, p2, own, leaves, saved, children = (c.to_numpy() for c in rows.columns)
    louds = Louds(np.stack([k1, k2], axis=1), np.stack([p1, p2], axis=1))
    parent, degree = louds.parents(), np.empty(len(n), dtype=np.int64)
    degree[louds.order] = louds.degrees()
    up = np.empty(len(n), dtype=np.int64)
    up[louds.order] = np.where(parent >= 0, louds.order[parent], -1)
    children = children + degree
    total_leaves, total_saved = louds.rolled_up(leaves + (children == 0), saved + own)
    values = [conv_id, n, np.where(up >= 0, conv_id[up], -1), p1, p2, up < 0, children, total_leaves, total_saved, own]
    return pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=[c.split()[0] for c in _ROLLED.split(", ")])


def _shards(batches: Iterator[pa.RecordBatch], least: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Whole subtrees, sorted by their tops; of some subtrees together a trie."""
    held, rows = [], 0
    for batch in batches:
        tops = np.stack([batch.column(k).to_numpy() for k in (0, 1)], axis=1)
        held.append(batch)
        rows += batch.num_rows
        changes = np.flatnonzero(np.any(np.diff(tops, axis=0) != 0, axis=1)) + 1
        if rows >= least and len(changes):
            cut = int(changes[-1])  # the last subtree may go on
            held[-1] = batch.slice(0, cut)
            yield _rolled(pa.Table.from_batches(held).combine_chunks().select(range(2, 12)))
            held, rows = [batch.slice(cut)], batch.num_rows - cut
    if rows:
        yield _rolled(pa.Table.from_batches(held).combine_chunks().select(range(2, 12)))


def _upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        yield _rolled(pa.Table.from_batches(held).combine_chunks())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids, comma-joined into rows of bounded size: prefix, first id, bytes."""
    names, key, first, ids, size = ["k1", "k2", "first", "ids"], None, 0, [], 0

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([o[k] for o in out], pa.int64()) for k in range(3)), pa.array([o[3] for o in out], pa.binary())], names=names)

    for batch in batches:
        k1, k2, conv = (batch.column(k).to_pylist() for k in range(3))
        out: list[tuple] = []
        for x, y, i in zip(k1, k2, conv, strict=True):
            if key != (x, y) or size >= ID_BYTES:
                if ids:
                    out.append((*key, first, ",".join(ids).encode()))
                key, first, ids, size = (x, y), i, [], 0
            ids.append(str(i))
            size += len(ids[-1]) + 1
        if out:
            yield rows(out)
    if ids:
        yield rows([(*key, first, ",".join(ids).encode())])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a prefix, of its rows in order, fed as they come."""
    key, digest = None, None

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out])], names=["k1", "k2", "ends"])

    for batch in batches:
        out = []
        for x, y, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
            if key == (x, y):
                digest.update(b",")
            else:
                if key:
                    out.append((*key, digest.hexdigest()))
                key, digest = (x, y), hashlib.sha256()
            digest.update(ids.as_buffer())
        if out:
            yield batch_of(out)
    if key:
        yield batch_of([(*key, digest.hexdigest())])


def ends_digests(ends: DataFrame) -> DataFrame:
    """``k1``, ``k2``, ``ends``: SHA-256 of the ids that end at a prefix, ascending.

    Ids are sorted in ranges, which split a prefix with many; each range joins its ids
    into rows of ID_BYTES, and only these rows of a prefix meet, one after the other.
    """
    order = ["k1", "k2", "conv_id"]
    joined = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_joined, "k1 long, k2 long, first long, ids binary")
    return joined.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_hashed, "k1 long, k2 long, ends string")


def tries(conversations: DataFrame, heavy: int | None = None) -> DataFrame:
    """A row a prefix: ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    Conversations are rebuilt by ``spliced``; repeated rows are turns like others.  A
    conversation may have no turn left and then ends at the root.  An empty table has
    not even a root.  Columns other than conv_id, turn, role and text are not read.
    ``heavy`` sets from how many members on a prefix belongs to the upper levels; it
    changes the work, not the result.
    """
    spark = conversations.sparkSession
    every, ends = paths(conversations)
    found = every.groupBy("k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), *(F.min(x).alias(x) for x in ("depth", "p1", "p2", "chars", "sum")))
    found = materialized(found, "prefixes")
    n = found.where("depth = 0").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    limit = min(max(HEAVY, math.isqrt(n)) if heavy is None else heavy, n - 1)

    # Chains: prefixes with the same members, which are those of one smallest member and one number.
    deepest, highest = F.max_by(F.struct("k1", "k2", "sum"), "depth").alias("b"), F.min_by(F.struct("p1", "p2", (F.col("sum") - F.col("chars")).alias("before")), "depth").alias("t")
    chains = found.groupBy("conv_id", "n").agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"), deepest, highest)
    none = F.lit(0).cast("long")
    own = (F.col("n") - 1) * (F.col("b.sum") - F.col("t.before"))
    chains = chains.select("conv_id", "n", "b.k1", "b.k2", F.coalesce("t.p1", F.lit(-1)).alias("p1"), F.coalesce("t.p2", F.lit(-1)).alias("p2"), own.alias("own"), "top", "bottom", F.col("b.sum").alias("sum"))
    chains = materialized(chains, "chains")
    node = chains.select("conv_id", "n", "k1", "k2", "p1", "p2", "own", none.alias("leaves"), none.alias("saved"), none.alias("n_children"))

    upper = found.where(F.col("n") > limit).select("k1", "k2")
    tops = every.join(upper, ["k1", "k2"], "left_anti").groupBy("conv_id").agg(F.min_by(F.struct(F.col("k1").alias("t1"), F.col("k2").alias("t2")), "depth").alias("t")).select("conv_id", "t.*")
    light = node.where(F.col("n") <= limit).join(tops, "conv_id").select("t1", "t2", *node.columns)
    arrow_rows(spark, 16_384)
    light = materialized(light.repartition("t1", "t2").sortWithinPartitions("t1", "t2").mapInArrow(_shards, _ROLLED), "shards")
    added = light.where("is_top").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count("*").alias("n_children"))
    over = node.where(F.col("n") > limit).drop("leaves", "saved", "n_children").join(added, ["k1", "k2"], "left")
    over = over.select(*(F.coalesce(c, none).alias(c) if c in ("leaves", "saved", "n_children") else F.col(c) for c in node.columns))
    over = materialized(over.repartition(1).mapInArrow(_upper, _ROLLED), "upper")

    # A shard's top hangs on the upper chain that ends where it begins.
    above = node.where(F.col("n") > limit).select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above"))
    parent = F.when(~F.col("is_top"), F.col("up_id")).otherwise(F.col("above"))
    rolled = light.join(above, ["p1", "p2"], "left").unionByName(over.withColumn("above", F.lit(None).cast("long"))).select("conv_id", "n", parent.alias("parent"), "n_children", "leaves", (F.col("saved") - F.col("own")).alias("below"))
    rolled = rolled.join(chains.select("conv_id", "n", "top", "bottom", F.col("sum").alias("whole")), ["conv_id", "n"])
    digests = ends_digests(ends)
    c = F.col
    return (
        found.join(rolled, ["conv_id", "n"])
        .join(digests, ["k1", "k2"], "left")
        .select(
            "conv_id", "depth", F.when(c("depth") > c("top"), c("conv_id")).otherwise(c("parent")).alias("parent_conv_id"), c("n").alias("n_convs"),
            F.when(c("depth") < c("bottom"), 1).otherwise(c("n_children")).cast("long").alias("n_children"), c("leaves").alias("n_leaves"),
            (c("below") + (c("n") - 1) * (c("whole") - c("sum") + c("chars"))).alias("saved_tokens"), F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )
