"""Shards drawn down a weighted hash tree of regions, racks and shards.

At each level every child draws ``-ln(u) / weight`` with ``u`` hashed from the
child's name and the document, and the smallest draw wins, so a child gets
documents in proportion to its weight.  A child's draw does not depend on its
siblings: where one weight grows, documents move only into that child.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.llm.common import text_or_empty

SHARDS_A_RACK, RACKS_A_REGION = 4, 3
#: Rows that one task numbers.
ROWS_A_TASK = 250_000


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    number: int
    weight: float = 1.0


def tree(shards: int) -> tuple[Shard, ...]:
    """Regions of three racks of four shards, all of weight one."""
    racks = [n // SHARDS_A_RACK for n in range(shards)]
    return tuple(Shard(f"region{k // RACKS_A_REGION}", f"rack{k % RACKS_A_REGION}", n) for n, k in enumerate(racks))


def grown(shards: tuple[Shard, ...], weight: float = 1.0) -> tuple[Shard, ...]:
    """One more shard, in a region of its own, so that no other subtree's weight changes."""
    number = max((s.number for s in shards), default=-1) + 1
    return (*shards, Shard(f"region+{number}", "rack0", number, weight))


def _draw(key: Column, children: list[tuple[str, float]]) -> Column:
    """The index of the child with the smallest draw."""
    if len(children) == 1:
        return F.lit(0)
    draws = []
    for k, (name, weight) in enumerate(children):
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 11).cast("double") + 0.5) / float(1 << 53)
        draws.append(F.struct((-F.log(u) / weight).alias("draw"), F.lit(k).alias("child")))
    return F.array_min(F.array(*draws))["child"]


def _pick(index: Column, values: list[Column]) -> Column:
    return reduce(lambda other, kv: F.when(index == kv[0], kv[1]).otherwise(other), list(enumerate(values))[1:], values[0])


def shard_of(key: Column, shards: tuple[Shard, ...]) -> Column:
    """The shard number of a key; nulls are one key."""

    def level(name: str, members: list[Shard], fields: tuple[str, ...]) -> Column:
        if not fields:
            numbers = [(f"{name}/{s.number}", s.weight) for s in members]
            return _pick(_draw(key, numbers), [F.lit(s.number) for s in members])
        groups: dict[str, list[Shard]] = {}
        for s in members:
            groups.setdefault(getattr(s, fields[0]), []).append(s)
        draws = _draw(key, [(f"{name}/{g}", sum(s.weight for s in inside)) for g, inside in groups.items()])
        return _pick(draws, [level(f"{name}/{g}", inside, fields[1:]) for g, inside in groups.items()])

    return level("", list(shards), ("region", "rack")).cast("int")


def place(docs: DataFrame, shards: tuple[Shard, ...], more: tuple[Shard, ...] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``shard``, ``slot`` and ``grown_shard`` (under ``more``) for every row, with its size and checksum.

    ``size`` is the text's UTF-8 bytes plus 8, ``text_crc32`` its CRC; null texts
    count as empty.  Slots number each shard's rows from 0 without gaps, ordered by
    a hash bucket, then id, checksum and size; rows equal in all of these take any
    order.  A shard is numbered bucket by bucket, so none is one task's work.  Null
    ids are one key and go to one shard.  Other columns are not read, and an empty
    table gives no rows.
    """
    buckets = max(1, -(-docs.count() // (len(shards) * ROWS_A_TASK)))
    binary = text_or_empty(text_col).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(binary) + 8).cast("long").alias("size"), F.crc32(binary).alias("text_crc32"))
    rows = rows.select(
        "*",
        shard_of(F.col("doc_id"), shards).alias("shard"),
        (shard_of(F.col("doc_id"), more) if more else F.lit(None).cast("int")).alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit("slot"), "doc_id", "text_crc32"), F.lit(buckets)).cast("int").alias("_bucket"),
    )
    inside = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("_row", F.row_number().over(inside) - 1)
    if buckets > 1:
        # One row for each shard and ROWS_A_TASK rows: the buckets before each bucket.
        sizes = rows.groupBy("shard", "_bucket").count()
        before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.select("shard", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
        numbered = numbered.join(sizes, ["shard", "_bucket"])
    else:
        numbered = numbered.withColumn("_before", F.lit(0))
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("_row") + F.col("_before")).cast("long").alias("slot"), "grown_shard")


def digests(placed: DataFrame) -> DataFrame:
    """The query's columns."""
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
