"""Windows by dyadic blocks against brute force."""

import random
from datetime import datetime, timedelta

import pytest

from memlattice.operators import windows

START = datetime(1999, 12, 31, 23, 59)


def moments(draw, n):
    spans = [timedelta(0), timedelta(microseconds=1), timedelta(hours=19), timedelta(days=1), timedelta(days=400), timedelta(days=3650), timedelta(days=30_000)]
    return [START + draw.choice([-1, 1]) * draw.random() * draw.choice(spans) for _ in range(n)]


def both(spark, rows, names):
    return spark.createDataFrame(rows, f"{names[0]} int, {names[1]} timestamp_ntz, {names[2]} timestamp_ntz")


def windows_of(draw, n):
    out = []
    for k in range(n):
        a, b = sorted(moments(draw, 2))
        out.append((k, draw.choice([a, a, a, None, b]), draw.choice([b, b, b, None, a])))
    return out


def test_points(spark):
    draw = random.Random(8)
    held = windows_of(draw, 150)
    points = [(k, m) for k, m in enumerate(moments(draw, 150))] + [(900, None)] + [(1000 + k, w[1]) for k, w in enumerate(held[:30])] + [(2000 + k, w[2]) for k, w in enumerate(held[:30])]
    frame = spark.createDataFrame(points, "point int, at timestamp_ntz")
    rows = [(r.w, r.point) for r in windows.holding(both(spark, held, ("w", "low", "high")), frame).collect()]
    expected = {(w, p) for w, low, high in held for p, at in points if at and (low is None or at >= low) and (high is None or at <= high)}
    assert len(rows) == len(set(rows)) and set(rows) == expected


def test_overlaps(spark):
    draw = random.Random(9)
    left, right = windows_of(draw, 120), windows_of(draw, 120)
    rows = [(r.w, r.i) for r in windows.overlapping(both(spark, left, ("w", "low", "high")), both(spark, right, ("i", "start", "end"))).collect()]
    ordered = lambda a, b: a is None or b is None or a <= b
    expected = {(w, i) for w, a, b in left for i, c, d in right if ordered(a, b) and ordered(c, d) and ordered(a, d) and ordered(c, b)}
    assert len(rows) == len(set(rows)) and set(rows) == expected


def test_a_window_of_any_length_has_few_blocks(spark):
    frame = spark.sql("SELECT -5 * pow(10, id) AS low, 7 * pow(10, id) AS high FROM range(17)").selectExpr("cast(low as long) low", "cast(high as long) high")
    sizes = [len(r[0]) for r in frame.select(windows.blocks(windows.F.col("low"), windows.F.col("high"))).collect()]
    assert max(sizes) <= 2 * (windows.WHOLE - windows.LEAF)
    none = spark.range(1).select(windows.blocks(windows.F.lit(None).cast("long"), windows.F.lit(None).cast("long")).alias("b")).first().b
    assert [(b.level, b.block) for b in none] == [(windows.WHOLE - windows.LEAF, 0)]


def test_no_rows_and_clashing_names(spark):
    held, points = both(spark, [], ("w", "low", "high")), spark.createDataFrame([(1, START)], "point int, at timestamp_ntz")
    assert windows.holding(held, points).count() == 0
    with pytest.raises(ValueError, match="low"):
        windows.holding(held, points.withColumnRenamed("point", "LOW"))
