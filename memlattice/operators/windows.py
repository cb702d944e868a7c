"""Points and intervals in many time windows at once, by dyadic blocks.

Time is cut into blocks of a power of two microseconds, at each level twice as long.
A window of any length is at most two blocks a level, none overlapping, and a point is
in one block a level: a window holds a point exactly if they share one block, and they
share no more than one.  So the join is an equality join whose keys grow with the
logarithm of a window's length; the ends of the first and last block are checked.

What is wanted of each window as a whole (counts, sums, its best points) needs no pairs
of windows and points: points are summed up by block, and a window by its blocks.  The
ends of the windows cut the cells in which they fall into segments, which have dyadic
blocks of their own, so no point is compared with a window.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.functions import times
from memlattice.operators.retrieval import ranked
from memlattice.storage import settled

#: Shortest block as a power of two (19 hours), and the one that holds all time from 7132 BC to 11071 AD.
LEAF, WHOLE = 36, 59
_ZERO = 1 << (WHOLE - 1)
#: Cells that the ends of windows cut, as a power of two (18 minutes), and the levels of whole cells that are rolled up at once.
CELL, ROLLED = 30, 8
_BLOCKS = "array<struct<level:int,block:bigint>>"
_KEYS = ["_cell", "_level", "_block"]


def blocks(low: Column, high: Column) -> Column:
    """The blocks (``level``, ``block``) that cover a window in microseconds, both ends included; a null end is open, an empty window has none."""
    first = F.shiftright(F.coalesce(low, F.lit(-_ZERO)) + _ZERO, LEAF)
    after = F.shiftright(F.coalesce(high, F.lit(_ZERO - 1)) + _ZERO, LEAF) + 1
    return F.when(F.coalesce(low > high, F.lit(False)), F.array().cast(_BLOCKS)).otherwise(_cover(first, after, F.lit(WHOLE - LEAF)))


def _cover(first: Column, after: Column, top: Column) -> Column:
    """The blocks of the levels up to ``top`` that cover the places from ``first`` to before ``after``."""

    def at(k: Column) -> Column:
        # What is left of the window when the levels below have taken the odd blocks at its ends.
        size = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        a, b = F.floor((first + size - 1) / size).cast("long"), F.floor(after / size).cast("long") - 1
        left, right = F.struct(k.alias("level"), a.alias("block")), F.struct(k.alias("level"), b.alias("block"))
        return F.when(a > b, F.array().cast(_BLOCKS)).otherwise(F.concat(F.when(a % 2 == 1, F.array(left)).otherwise(F.array().cast(_BLOCKS)), F.when(b % 2 == 0, F.array(right)).otherwise(F.array().cast(_BLOCKS))))

    return F.when(first < after, F.flatten(F.transform(F.sequence(F.lit(0), top), at))).otherwise(F.array().cast(_BLOCKS))


def holding(windows: DataFrame, points: DataFrame, low: str = "low", high: str = "high", at: str = "at") -> DataFrame:
    """Each window with each point inside it, ends included: all columns of both, whose names must differ.

    Times are timestamps; a null ``low`` or ``high`` leaves that side open, a point
    without a time is in no window.  Points are spread only over the levels at which some
    window has a block, of which there are two dozen.
    """
    clash = {c.lower() for c in windows.columns} & {c.lower() for c in points.columns}
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    cut = windows.select("*", F.explode(blocks(times.micros(F.col(low)), times.micros(F.col(high)))).alias("_b")).select("*", F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block")).drop("_b")
    levels = cut.select("_level").distinct()
    place = F.shiftright(times.micros(F.col(at)) + _ZERO, LEAF)
    spread = points.where(F.col(at).isNotNull()).crossJoin(F.broadcast(levels.withColumnRenamed("_level", "_l")))  # a row a level
    spread = spread.withColumn("_k", F.floor(place / F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_l"))).cast("long"))
    both = cut.join(spread, (F.col("_level") == F.col("_l")) & (F.col("_block") == F.col("_k")))
    inside = (F.col(low).isNull() | (F.col(at) >= F.col(low))) & (F.col(high).isNull() | (F.col(at) <= F.col(high)))
    return both.where(inside).drop("_level", "_block", "_l", "_k")


def overlapping(windows: DataFrame, intervals: DataFrame, low: str = "low", high: str = "high", start: str = "start", end: str = "end") -> DataFrame:
    """Each window with each interval that shares a moment with it, once; ends are included, null ones open on both sides.

    Two intervals meet if one begins inside the other: the interval in the window, or
    the window in the interval after its first moment.  Rows of either side that end
    before they begin meet nothing.
    """
    least = F.timestamp_micros(F.lit(-_ZERO // 4)).cast("timestamp_ntz")
    fits = lambda a, b: F.coalesce(F.col(a) <= F.col(b), F.lit(True))
    windows, intervals = windows.where(fits(low, high)), intervals.where(fits(start, end))
    begun = intervals.withColumn("_start", F.coalesce(F.col(start).cast("timestamp_ntz"), least))
    one = holding(windows.withColumns({"_low": F.col(low).cast("timestamp_ntz"), "_high": F.col(high).cast("timestamp_ntz")}), begun, "_low", "_high", "_start")
    opened = windows.withColumn("_low", F.coalesce(F.col(low).cast("timestamp_ntz"), least))
    later = intervals.withColumns({"_start": F.coalesce(F.col(start).cast("timestamp_ntz"), least) + F.expr("INTERVAL 0.000001 SECOND"), "_end": F.col(end).cast("timestamp_ntz")})
    other = holding(later, opened, "_start", "_end", "_low")
    columns = [*windows.columns, *intervals.columns]
    return one.select(*columns).unionByName(other.select(*columns))


def _ends(windows: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """Windows that are not empty with ``_a``, ``_b``: their first microsecond and the first after them, null where open."""
    shown = windows.select(F.col(key), (times.micros(F.col(low)) + _ZERO).alias("_a"), (times.micros(F.col(high)) + _ZERO + 1).alias("_b"))
    return shown.where(F.coalesce(F.col("_a") < F.col("_b"), F.lit(True)))


def _cuts(ends: DataFrame) -> DataFrame:
    """``_cell``, ``_p``: where windows begin, and where they are over."""
    return ends.select(F.explode(F.array("_a", "_b")).alias("_p")).where("_p IS NOT NULL").select(F.shiftright("_p", CELL).alias("_cell"), "_p")


def _segmented(rows: DataFrame) -> DataFrame:
    """Rows of ``_cell``, ``_p``, ``_cut`` with ``_seg``, how many cuts of the cell are not after them, and ``_deep``, the highest level of the cell's segments, null without cuts."""
    cell = Window.partitionBy("_cell")
    cuts = F.sum("_cut").over(cell)
    deep = F.when(cuts > 0, F.length(F.bin(cuts)))  # so many binary digits: all segments are one block of that level
    return rows.withColumn("_seg", F.sum("_cut").over(cell.orderBy("_p"))).withColumn("_deep", deep)


def _parts(windows: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """``key``, ``_cell``, ``_level``, ``_block``: the blocks a window is made of; those of whole cells have the cell -1."""
    ends = _ends(windows, key, low, high)
    places = _segmented(_cuts(ends).withColumn("_cut", F.lit(1))).distinct()
    at = lambda side: places.select(F.col("_p").alias(side), F.col("_seg").alias(f"{side}_seg"), F.col("_deep").alias(f"{side}_deep"))
    each = ends.join(at("_a"), "_a", "left").join(at("_b"), "_b", "left")
    a, b = F.shiftright("_a", CELL), F.shiftright("_b", CELL)
    end = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_a_deep"))
    none = F.array().cast("array<struct<cell:bigint,level:int,block:bigint>>")
    inside = lambda cell, blocks: F.transform(blocks, lambda x: F.struct(cell.cast("long").alias("cell"), x["level"].alias("level"), x["block"].alias("block")))
    one = F.coalesce(a == b, F.lit(False))
    from_first = F.when(F.col("_a").isNull(), none).otherwise(inside(a, _cover(F.col("_a_seg"), F.when(one, F.col("_b_seg")).otherwise(end), F.col("_a_deep"))))
    to_last = F.when(F.col("_b").isNull() | one, none).otherwise(inside(b, _cover(F.lit(0).cast("long"), F.col("_b_seg"), F.col("_b_deep"))))
    whole = F.when(one, none).otherwise(inside(F.lit(-1), _cover(F.coalesce(a + 1, F.lit(0).cast("long")), F.coalesce(b, F.lit(1 << (WHOLE - CELL)).cast("long")), F.lit(WHOLE - CELL))))
    return each.select(key, F.explode(F.concat(from_first, to_last, whole)).alias("_x")).select(key, F.col("_x.cell").alias("_cell"), F.col("_x.level").alias("_level"), F.col("_x.block").alias("_block"))


def _placed(points: DataFrame, windows: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """Points (``_cell``, ``_p`` and other columns) with ``_seg`` and ``_deep``."""
    cuts = _cuts(_ends(windows, key, low, high)).withColumn("_cut", F.lit(1))
    return _segmented(points.withColumn("_cut", F.lit(0)).unionByName(cuts, allowMissingColumns=True)).where("_cut = 0").drop("_cut", "_p")


def _local() -> Column:
    """The blocks of a segment in its cell; none in a cell without cuts."""
    return F.transform(F.when(F.col("_deep").isNotNull(), F.sequence(F.lit(0), F.col("_deep"))).otherwise(F.array().cast("array<int>")), lambda k: F.struct(F.col("_cell").alias("cell"), k.alias("level"), F.call_function("shiftright", F.col("_seg"), k).alias("block")))


def _raised(first: int, last: int) -> Column:
    """The blocks of whole cells that hold the cell ``_cell``, of the levels from ``first`` to ``last``."""
    return F.transform(F.sequence(F.lit(first), F.lit(last)), lambda k: F.struct(F.lit(-1).cast("long").alias("cell"), k.alias("level"), F.call_function("shiftright", F.col("_cell"), k).alias("block")))


def tallied(windows: DataFrame, points: DataFrame, key: str, measures: Mapping[str, tuple[str, Column]], low: str = "low", high: str = "high", at: str = "at") -> DataFrame:
    """``key`` and ``measures`` of the points inside each window that holds any, ends included.

    ``key`` names windows.  A measure is ``sum``, ``min`` or ``max`` and a column of the
    points; a count is the sum of ones.  Same rules as ``holding``, whose pairs are not
    made: a window is summed up from its blocks, so work grows with points and windows
    and the logarithm of their cuts.
    """
    merged = [getattr(F, kind)(name).alias(name) for name, (kind, _) in measures.items()]
    place = times.micros(F.col(at)) + _ZERO
    each = points.where(F.col(at).isNotNull()).select(F.shiftright(place, CELL).alias("_cell"), place.alias("_p"), *(c.alias(n) for n, (_, c) in measures.items()))
    moments = each.groupBy("_cell", "_p").agg(*merged)  # of points at one moment one row
    segments = _placed(moments, windows, key, low, high).groupBy("_cell", "_seg", "_deep").agg(*merged)
    spread = segments.select(F.explode(F.concat(_local(), _raised(0, WHOLE - CELL))).alias("_x"), *measures).select(*(F.col(f"_x.{c[1:]}").alias(c) for c in _KEYS), *measures)
    blocks_ = spread.groupBy(*_KEYS).agg(*merged)
    return _parts(windows, key, low, high).join(blocks_, _KEYS).groupBy(key).agg(*merged)


def overlap_sums(windows: DataFrame, intervals: DataFrame, key: str, measures: Mapping[str, Column], low: str = "low", high: str = "high", start: str = "start", end: str = "end") -> DataFrame:
    """``key``, ``n`` and the sums of ``measures`` over the intervals that share a moment with each window, where there are any.

    Same rules as ``overlapping``, whose pairs are not made: what has begun by a window's
    end less what was over before it began.
    """
    fits = lambda a, b: F.coalesce(F.col(a) <= F.col(b), F.lit(True))
    least = F.timestamp_micros(F.lit(-_ZERO // 4)).cast("timestamp_ntz")
    windows, intervals = windows.where(fits(low, high)), intervals.where(fits(start, end))
    columns = {"n": F.lit(1).cast("long"), **measures}
    begun = intervals.withColumn("_at", F.coalesce(F.col(start).cast("timestamp_ntz"), least))
    over = intervals.where(F.col(end).isNotNull()).withColumn("_at", F.col(end).cast("timestamp_ntz"))
    none = F.lit(None).cast("timestamp_ntz")
    upto = windows.select(F.col(key), none.alias("_low"), F.col(high).cast("timestamp_ntz").alias("_high"))
    before = windows.where(F.col(low).isNotNull()).select(F.col(key), none.alias("_low"), (F.col(low).cast("timestamp_ntz") - F.expr("INTERVAL 0.000001 SECOND")).alias("_high"))
    plus = tallied(upto, begun, key, {n: ("sum", c) for n, c in columns.items()}, "_low", "_high", "_at")
    minus = tallied(before, over, key, {n: ("sum", -c) for n, c in columns.items()}, "_low", "_high", "_at")
    return plus.unionByName(minus).groupBy(key).agg(*(F.sum(n).alias(n) for n in columns)).where("n > 0")


def best(windows: DataFrame, points: DataFrame, key: str, by: str, score: str, unit: str, most: int, low: str = "low", high: str = "high", at: str = "at", name: str = "k") -> DataFrame:
    """``key``, ``by``, ``unit`` and ``name``, the place from 1: the ``most`` points of highest ``score`` inside each window and value of ``by``; ties go to the smaller ``unit``.

    ``key`` names windows.  The best of each block are found first, those of many whole
    cells from those of fewer.  A window reads them from its blocks, and of these only
    what is not below the last of ``most`` in any of its blocks of whole cells.
    """
    order = (F.desc(score), F.asc(unit))
    top = lambda df, keys: ranked(df, [*keys, by], *order, most=most, name=name)
    opened = lambda df, blocks_: df.select(F.explode(blocks_).alias("_x"), by, score, unit).select(*(F.col(f"_x.{c[1:]}").alias(c) for c in _KEYS), by, score, unit)
    place = times.micros(F.col(at)) + _ZERO
    each = points.where(F.col(at).isNotNull()).select(F.shiftright(place, CELL).alias("_cell"), place.alias("_p"), by, score, unit)
    held = top(opened(_placed(each, windows, key, low, high), _local()), _KEYS)
    marks = [*range(0, WHOLE - CELL, ROLLED), WHOLE - CELL]
    whole, lower = None, top(each.select("_cell", by, score, unit), ["_cell"])
    for first, last in pairwise(marks):
        rolled = settled(top(opened(lower, _raised(1 if first else 0, last - first)), _KEYS).withColumn("_level", F.col("_level") + first))
        whole = rolled if whole is None else whole.unionByName(rolled)
        lower = rolled.where(F.col("_level") == last).select(F.col("_block").alias("_cell"), by, score, unit)
    parts = settled(_parts(windows, key, low, high))
    last = whole.where(F.col(name) == most).select(*_KEYS, F.col(by).alias("_by"), F.col(score).alias("_floor"))
    floors = parts.join(last, _KEYS).groupBy(key, "_by").agg(F.max("_floor").alias("_floor")).groupBy(key).agg(F.collect_list(F.struct("_by", "_floor")).alias("_floors"))
    asked = parts.join(floors, key, "left")
    floor = F.get(F.filter("_floors", lambda x: x["_by"].eqNullSafe(F.col(by))), F.lit(0))["_floor"]
    found = asked.join(held.unionByName(whole).drop(name), _KEYS).where(F.coalesce(F.col(score) >= floor, floor.isNull()))
    return ranked(found.select(key, by, score, unit), [key, by], *order, most=most, name=name).select(key, by, unit, name)
