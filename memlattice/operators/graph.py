"""Links between units: temporal, semantic, causal; pairs, pruning, components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.config import DEFAULT
from memlattice.functions.scoring import link_weight, norm
from memlattice.functions.times import micros
from memlattice.operators.retrieval import nearest
from memlattice.storage import settled

HOUR = 3_600_000_000


def nearest_in_time(units: DataFrame, keys: Sequence[str], at: str, k: int, block_hours: int = 24) -> DataFrame:
    """Each unit's ``k`` nearest in time among units of its keys, both ways, itself left out.

    One sort gives both directions: the rows around a unit in (time, id) order hold
    its ``k`` before and its ``k`` after, so no row is joined with another.  A key's
    time is cut into blocks that are sorted apart; each block gets the ``k`` rows
    before and after it, found among the ends of all blocks, which are few.  Columns:
    ``unit_id``, ``other_id``, ``hours``, ``rank``.
    """
    keys = list(keys)
    rows = units.select(*keys, "unit_id", micros(F.col(at)).alias("t")).withColumn("block", F.floor(F.col("t") / (block_hours * HOUR)))
    block = Window.partitionBy(*keys, "block")
    up, down = block.orderBy("t", "unit_id"), block.orderBy(F.desc("t"), F.desc("unit_id"))
    ends = rows.withColumn("first", F.row_number().over(up)).withColumn("last", F.row_number().over(down)).where((F.col("first") <= k) | (F.col("last") <= k))
    key = Window.partitionBy(*keys).orderBy("t", "unit_id")
    own = F.struct("t", "unit_id")
    none = F.array().cast("array<struct<t:bigint,unit_id:" + units.schema["unit_id"].dataType.simpleString() + ">>")
    before = F.when(F.col("first") == 1, F.collect_list(own).over(key.rowsBetween(-k, -1))).otherwise(none)
    after = F.when(F.col("last") == 1, F.collect_list(own).over(key.rowsBetween(1, k))).otherwise(none)
    halo = ends.select(*keys, "block", F.concat(before, after).alias("o")).select(*keys, "block", F.explode("o").alias("o"))
    placed = rows.select(*keys, "block", "unit_id", "t", F.lit(True).alias("asks")).unionByName(halo.select(*keys, "block", "o.unit_id", "o.t", F.lit(False).alias("asks")))
    other = F.struct(F.col("t"), F.col("unit_id").alias("u"))
    sides = F.concat(F.collect_list(other).over(up.rowsBetween(-k, -1)), F.collect_list(other).over(up.rowsBetween(1, k)))
    near = placed.withColumn("o", sides).where("asks").select("unit_id", "t", "o").withColumn("o", F.explode("o"))
    near = near.select("unit_id", F.col("o.u").alias("other_id"), F.abs(F.col("o.t") - F.col("t")).alias("d"))
    rank = F.row_number().over(Window.partitionBy("unit_id").orderBy("d", "other_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("unit_id", "other_id", (F.col("d") / HOUR).alias("hours"), "rank")


def temporal_links(units: DataFrame, keys: Sequence[str], at: str, k: int = DEFAULT.temporal_links, cut_hours: float | None = None) -> DataFrame:
    """Links to the nearest units in time; ``cut_hours`` leaves out what is further away."""
    near = nearest_in_time(units, keys, at, k)
    if cut_hours is not None:
        near = near.where(F.col("hours") <= cut_hours)
    return near.select(F.col("unit_id").alias("from_unit"), F.col("other_id").alias("to_unit"), F.lit("temporal").alias("link_type"), F.round(link_weight(F.col("hours")), 6).alias("weight"))


def batch_links(units: DataFrame, keys: Sequence[str], at: str, hours: int = 24) -> DataFrame:
    """Links both ways between units of the same keys at most ``hours`` apart.

    Time is cut into blocks of that length and each unit meets its own block and the
    next, which turns the range into an equality.
    """
    block = F.floor(micros(F.col(at)) / (hours * HOUR))
    a = units.select(*keys, F.col("unit_id").alias("a"), micros(F.col(at)).alias("ta"), F.explode(F.array(block, block + 1)).alias("block"), block.alias("home"))
    b = units.select(*keys, F.col("unit_id").alias("b"), micros(F.col(at)).alias("tb"), block.alias("block"))
    apart = F.abs(F.col("tb") - F.col("ta"))
    near = a.join(b, [*keys, "block"]).where((apart <= hours * HOUR) & ((F.col("block") > F.col("home")) | ((F.col("block") == F.col("home")) & (F.col("a") < F.col("b")))))
    weight = F.round(link_weight(apart / HOUR), 6)
    one = near.select(F.col("a").alias("from_unit"), F.col("b").alias("to_unit"), weight.alias("weight"))
    return one.union(one.select("to_unit", "from_unit", "weight"))


def links_to_stored(new: DataFrame, stored: DataFrame, keys: Sequence[str], at: str, hours: int = 24, most: int = DEFAULT.temporal_links) -> DataFrame:
    """Temporal links of new units to each other and to stored ones within ``hours``, the strongest ``most`` of each new unit.

    Both sides meet on blocks of ``hours``; stored units that are new as well count once.
    """
    block = F.floor(micros(F.col(at)) / (hours * HOUR))
    a = new.select(*keys, F.col("unit_id").alias("from_unit"), micros(F.col(at)).alias("ta"), F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    both = new.select(*keys, "unit_id", at).unionByName(stored.select(*keys, "unit_id", at)).dropDuplicates(["unit_id"])
    b = both.select(*keys, F.col("unit_id").alias("to_unit"), micros(F.col(at)).alias("tb"), block.alias("block"))
    apart = F.abs(F.col("tb") - F.col("ta"))
    near = a.join(b, [*keys, "block"]).where((F.col("from_unit") != F.col("to_unit")) & (apart <= hours * HOUR))
    weighted = near.select("from_unit", "to_unit", F.round(link_weight(apart / HOUR), 6).alias("weight"))
    return cap_links(weighted, most).withColumn("link_type", F.lit("temporal"))


def similar_stored(new: DataFrame, stored: DataFrame, keys: Sequence[str], k: int = DEFAULT.semantic_links, floor: float = DEFAULT.semantic_link_floor) -> DataFrame:
    """Semantic links of new units to each other and to stored ones of their keys, the nearest ``k`` of each."""
    usable = lambda df: df.where(norm(F.col("embedding")) > 0).select(*keys, "unit_id", "embedding")
    both = usable(new).unionByName(usable(stored)).dropDuplicates(["unit_id"])
    asked = usable(new).withColumnsRenamed({"unit_id": "query_id", "embedding": "vector"})
    found = nearest(asked, both, k + 1, floor, partition=keys, digits=6).where("query_id <> unit_id")
    links = found.select(F.col("query_id").alias("from_unit"), F.col("unit_id").alias("to_unit"), F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("weight"))
    return cap_links(links, k).withColumn("link_type", F.lit("semantic"))


def cap_links(links: DataFrame, most: int = DEFAULT.temporal_links, source: str = "from_unit") -> DataFrame:
    """The strongest links of each unit."""
    rank = F.row_number().over(Window.partitionBy(source).orderBy(F.desc("weight"), F.asc("to_unit")))
    return links.withColumn("r", rank).where(F.col("r") <= most).drop("r")


def semantic_links(units: DataFrame, keys: Sequence[str], k: int | None = DEFAULT.semantic_links, floor: float = DEFAULT.semantic_link_floor) -> DataFrame:
    """Each unit's nearest units of its keys by cosine, at least ``floor``; zero vectors have none.

    Exact, over blocks: every two blocks of a key meet in one product, of which only
    the best ``k`` of a unit leave (all of them where ``k`` is None).  The work grows
    with the square of a key's units; ``vectors.search`` is the way for large ones.
    """
    usable = units.where(norm(F.col("embedding")) > 0)
    asked = usable.select(*keys, F.col("unit_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = nearest(asked, usable, None if k is None else k + 1, floor, partition=keys, digits=6).where("query_id <> unit_id")
    links = found.select(F.col("query_id").alias("from_unit"), F.col("unit_id").alias("to_unit"), F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("weight"))
    return (links if k is None else cap_links(links, k)).withColumn("link_type", F.lit("semantic"))


def pairs(postings: DataFrame, unit: str, entity: str) -> DataFrame:
    """Every two entities of a unit, the smaller first."""
    each = postings.select(F.col(unit).alias("u"), F.col(entity).alias("e")).distinct()
    return each.withColumnRenamed("e", "e1").join(each.withColumnRenamed("e", "e2"), "u").where("e1 < e2").select("u", "e1", "e2")


def stale_pairs(stored: DataFrame, postings: DataFrame, unit: str, entity: str) -> DataFrame:
    """Stored pairs that no unit has any more."""
    return stored.join(pairs(postings, unit, entity).select("e1", "e2"), ["e1", "e2"], "left_anti")


def orphans(entities: DataFrame, postings: DataFrame, key: str) -> DataFrame:
    return entities.join(postings.select(key), key, "left_anti")


def inherited_entities(units: DataFrame, postings: DataFrame) -> DataFrame:
    """A unit's own entities, or its sources' (``sources`` array) if it has none."""
    own = units.select("unit_id").join(postings, "unit_id").select("unit_id", "entity_id")
    sources = units.select("unit_id", F.explode("sources").alias("source"))
    theirs = sources.join(postings.withColumnRenamed("unit_id", "source"), "source").select("unit_id", "entity_id")
    return own.union(theirs.join(own.select("unit_id").distinct(), "unit_id", "left_anti")).distinct()


def victims(links: DataFrame, deleted: DataFrame) -> DataFrame:
    """Units that lose a temporal or semantic link when others are deleted."""
    gone = deleted.select(F.col("unit_id").alias("to_unit"))
    lost = links.where(F.col("link_type").isin("temporal", "semantic")).join(gone, "to_unit", "left_semi").select(F.col("from_unit").alias("unit_id")).distinct()
    return lost.join(deleted.select("unit_id"), "unit_id", "left_anti")


def underlinked(units: DataFrame, links: DataFrame, kind: str, least: int) -> DataFrame:
    """Units with fewer than ``least`` links of a kind, and how many they lack."""
    held = links.where(F.col("link_type") == kind).groupBy(F.col("from_unit").alias("unit_id")).agg(F.count("*").alias("n"))
    out = units.select("unit_id").join(held, "unit_id", "left").select("unit_id", (least - F.coalesce("n", F.lit(0))).alias("missing"))
    return out.where("missing > 0")


def causal_links(facts: DataFrame) -> DataFrame:
    """(unit, batch, index, causes: array of indexes) to links, without loops or unknown indexes."""
    each = facts.select("batch", F.col("unit_id").alias("from_unit"), F.explode("causes").alias("index"))
    to = facts.select("batch", "index", F.col("unit_id").alias("to_unit"))
    return each.join(to, ["batch", "index"]).where("from_unit <> to_unit").select("from_unit", "to_unit", F.lit("caused_by").alias("link_type"), F.lit(1.0).alias("weight")).distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``node`` and its ``root``, the smallest node it is connected to, for edges (``a``, ``b``).

    Every round takes the smallest label among neighbours and then the label's own
    label; rounds are checkpointed.  Labels that have not settled after ``rounds``
    rounds are an error.
    """
    both = settled(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = settled(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root")))
    for _ in range(rounds):
        near = both.join(labels.withColumnsRenamed({"node": "b", "root": "m"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("m").alias("m"))
        better = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        theirs = better.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        new = settled(better.join(theirs, F.col("root") == F.col("n2"), "left").select("node", F.least("root", F.coalesce("r2", "root")).alias("root"), "old"))
        labels = new.drop("old")
        if new.where("root <> old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def bidirectional_max(links: DataFrame) -> DataFrame:
    """The strongest weight between two units, whichever way the link goes."""
    low, high = F.least("from_unit", "to_unit"), F.greatest("from_unit", "to_unit")
    return links.groupBy(low.alias("a"), high.alias("b")).agg(F.max("weight").alias("weight"))


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row for each key, the first in an order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
