"""Greedy packing into token budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _packed(items: Column, most: int, floor_of_one: bool) -> Column:
    """Ranks taken from an array of (rank, size): what fits is taken, what does not is skipped.

    Ranks gather in blocks of about the root of the length, so that a long group does
    not copy all ranks taken for each item.
    """
    n = F.size(items)
    width = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / width).cast("int"), F.lit(0))), lambda b: F.slice(items, b * width + 1, width))
    none = F.array().cast("array<bigint>")

    def state(used: Column, taken: Column, any_: Column, cut: Column) -> Column:
        return F.struct(used.alias("used"), taken.alias("taken"), any_.alias("any"), cut.alias("cut"))

    def step(s: Column, x: Column) -> Column:
        fits = s["used"] + x["size"] <= most
        if floor_of_one:
            fits = fits | ~s["any"]
        return F.when(fits, state(s["used"] + x["size"], F.concat(s["taken"], F.array(x["rank"])), F.lit(True), s["cut"])).otherwise(state(s["used"], s["taken"], s["any"], F.lit(True)))

    def block(s: Column, some: Column) -> Column:
        return F.aggregate(some, state(s["used"], none, s["any"], s["cut"]), step, lambda e: state(e["used"], F.concat(s["taken"], F.array(e["taken"])), e["any"], e["cut"]))

    start = state(F.lit(0).cast("long"), F.array().cast("array<array<bigint>>"), F.lit(False), F.lit(False))
    return F.aggregate(blocks, start, block, lambda e: F.struct(e["used"].alias("used"), F.flatten(e["taken"]).alias("taken"), e["cut"].alias("cut")))


def pack(df: DataFrame, keys: Sequence[str], rank: str, size: Column, most: int, floor_of_one: bool = True) -> DataFrame:
    """For each group, the ranks that fit a budget in rank order: ``used``, ``n``, ``ranks``, ``truncated``.

    An item that does not fit is skipped and later ones are still tried; with
    ``floor_of_one`` the first is taken whatever its size.  A group's ranks and sizes
    are one array, as its ranked list is.
    """
    item = F.struct(F.col(rank).cast("long").alias("rank"), size.cast("long").alias("size"))
    listed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    done = listed.withColumn("p", _packed(F.col("items"), most, floor_of_one))
    return done.select(*keys, F.col("p.used").alias("used"), F.size("p.taken").cast("long").alias("n"), F.array_join(F.col("p.taken").cast("array<string>"), ",").alias("ranks"), F.col("p.cut").alias("truncated"))


def pack_sources(df: DataFrame, keys: Sequence[str], observation: str, rank: str, size: Column, most_total: int, most_each: int) -> DataFrame:
    """A budget for each observation inside one for the group: an item must fit both, and is skipped otherwise."""
    item = F.struct(F.col(rank).cast("long").alias("rank"), F.col(observation).alias("o"), size.cast("long").alias("size"))
    listed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    spent = F.map_from_arrays(F.array().cast("array<bigint>"), F.array().cast("array<bigint>"))
    start = F.struct(F.lit(0).cast("long").alias("used"), spent.alias("each"), F.lit(0).cast("long").alias("n"))

    def step(s: Column, x: Column) -> Column:
        o = x["o"].cast("long")
        own = F.coalesce(F.try_element_at(s["each"], o), F.lit(0).cast("long"))
        fits = (s["used"] + x["size"] <= most_total) & (own + x["size"] <= most_each)
        others = F.map_filter(s["each"], lambda k, v: k != o)
        return F.when(fits, F.struct((s["used"] + x["size"]).alias("used"), F.map_concat(others, F.create_map(o, own + x["size"])).alias("each"), (s["n"] + 1).alias("n"))).otherwise(s)

    done = listed.withColumn("p", F.aggregate("items", start, step))
    return done.select(*keys, F.col("p.used").alias("used"), F.col("p.n").alias("n"))
