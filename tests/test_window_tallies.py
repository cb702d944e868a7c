"""What windows hold as a whole, summed up by blocks: against brute force, and without pairs of windows and points."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from test_queries import compare
from test_windows import START, both, moments, windows_of

from memlattice.operators import windows
from memlattice.operators.retrieval import ranked
from memlattice.plans.registry import ORACLE, QUERIES

def crowded(draw, n):
    """Windows and points that share a few cells and often a moment."""
    at = [START + timedelta(microseconds=draw.choice([0, 1, 5, 1000, 2**30, 2**30 + 1, 2**31]) * draw.randint(0, 3)) for _ in range(n)]
    held = [(k, *draw.choice([(a, b), (a, None), (None, b), (min(a, b), max(a, b))])) for k, (a, b) in enumerate((draw.choice(at), draw.choice(at)) for _ in range(n))]
    return held, at


def test_counts_sums_and_extremes(spark):
    draw = random.Random(4)
    for held, at in ((windows_of(draw, 150), moments(draw, 200)), crowded(draw, 120)):
        points = [(k, m) for k, m in enumerate(at)] + [(900, None)] + [(1000 + k, w[1]) for k, w in enumerate(held[:30])] + [(2000 + k, w[2]) for k, w in enumerate(held[:30])]
        frame = spark.createDataFrame(points, "point int, at timestamp_ntz")
        measures = {"n": ("sum", F.lit(1)), "least": ("min", F.col("point")), "most": ("max", F.col("point")), "ids": ("sum", F.col("point"))}
        rows = {tuple(r) for r in windows.tallied(both(spark, held, ("w", "low", "high")), frame, "w", measures).collect()}
        expected = set()
        for w, low, high in held:
            inside = [p for p, m in points if m and (low is None or m >= low) and (high is None or m <= high)]
            if inside:
                expected.add((w, len(inside), min(inside), max(inside), sum(inside)))
        assert rows == expected


def test_overlaps_summed(spark):
    draw = random.Random(5)
    crowd = crowded(draw, 100)[0]
    for left, right in ((windows_of(draw, 120), windows_of(draw, 120)), (crowd, [(k, b, a) for k, a, b in crowd])):
        w, i = both(spark, left, ("w", "low", "high")), both(spark, right, ("i", "start", "end"))
        rows = {tuple(r) for r in windows.overlap_sums(w, i, "w", {"ids": F.col("i")}).collect()}
        pairs = windows.overlapping(w, i).groupBy("w").agg(F.count("*"), F.sum("i"))
        assert rows == {tuple(r) for r in pairs.collect()}


def test_no_rows(spark):
    held, points = both(spark, [(1, None, None)], ("w", "low", "high")), spark.createDataFrame([], "point int, at timestamp_ntz")
    assert windows.tallied(held, points, "w", {"n": ("sum", F.lit(1))}).count() == 0
    assert windows.tallied(held.where("w = 2"), spark.createDataFrame([(1, datetime(2024, 1, 1))], "point int, at timestamp_ntz"), "w", {"n": ("sum", F.lit(1))}).count() == 0


def _without_pairs(name, spark, sf_dir, duck, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("every window meets every point in it")

    monkeypatch.setattr(windows, "holding", refuse)
    compare(QUERIES[name](spark, sf_dir), duck, ORACLE[name])


def test_overlaps_make_no_pairs(spark, sf_dir, duck, monkeypatch):
    _without_pairs("f9_many_overlaps", spark, sf_dir, duck, monkeypatch)


def test_window_counts_make_no_pairs(spark, sf_dir, duck, monkeypatch):
    _without_pairs("j11_many_windows", spark, sf_dir, duck, monkeypatch)


def test_best_of_windows(spark):
    draw = random.Random(6)
    for held, at in ((windows_of(draw, 100), moments(draw, 300)), crowded(draw, 100)):
        points = [(k, m, draw.choice(["a", "b", None]), draw.choice([None, float("nan"), 1.0, *(draw.random() for _ in range(9))])) for k, m in enumerate([*at, None])]
        frame = spark.createDataFrame(points, "point int, at timestamp_ntz, kind string, score double")
        pairs = windows.holding(both(spark, held, ("w", "low", "high")), frame)
        for most in (1, 4, 60):
            rows = [tuple(r) for r in windows.best(both(spark, held, ("w", "low", "high")), frame, "w", "kind", "score", "point", most).collect()]
            expected = [tuple(r) for r in ranked(pairs, ["w", "kind"], F.desc("score"), F.asc("point"), most=most, name="k").select("w", "kind", "point", "k").collect()]
            assert len(rows) == len(set(rows)) and set(rows) == set(expected)


def test_pools_make_no_pairs(spark, sf_dir, duck, monkeypatch):
    _without_pairs("r12_window_pools", spark, sf_dir, duck, monkeypatch)
