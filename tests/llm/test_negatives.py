"""Hard negatives against all pairs."""

import math
import random

import numpy as np
import pytest

from memlattice.llm import negatives, oracle, queries


def brute(rows, is_anchor, relabel=lambda i, x: x, most=5, share=(80, 100), scale=256):
    kept = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        new = (relabel(i, label), [math.floor(scale * float(np.float32(x))) for x in v])
        kept[i] = min(kept.get(i, new), new)
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = set()
    for a, (label, q) in kept.items():
        if is_anchor(a):
            ranked = sorted((-score(q, v), i, x) for i, (x, v) in kept.items() if i != a)
            for s, p, _ in [r for r in ranked if r[2] == label][:most]:
                held = [r for r in ranked if r[2] != label and share[0] * -s <= 100 * -r[0] <= share[1] * -s][:most]
                out |= {(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(held)}
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")


def test_table_equals_sql_and_all_pairs(spark, sf_dir, duck):
    found = queries.op13_pq_negatives(spark, sf_dir)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    rows = set(map(tuple, found.collect()))
    assert rows == set(duck.execute(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({oracle.ORACLE['op13_pq_negatives']})").fetchall())
    table = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    assert rows == brute(table, lambda i: i % 100 == 0, lambda i, x: (x + 1) % 10 if i % 7 == 0 else x) and rows


@pytest.mark.parametrize("tile", [negatives.TILE, 40])
def test_ties_copies_nulls_and_short_vectors(spark, monkeypatch, tile):
    monkeypatch.setattr(negatives, "TILE", tile)
    monkeypatch.setattr(negatives, "SMALL_TILE", tile)
    draw = random.Random(3)
    rows = [(i, draw.randrange(3), [draw.choice([-1.5, 0.0, 0.25, 1.0]) for _ in range(draw.choice([5, 5, 5, 3, 0]))]) for i in range(150)]
    rows += [(i, 1, rows[7][2]) for i in range(150, 260)] + rows[:20]
    rows += [(None, 1, [1.0]), (300, None, [1.0]), (310, 1, None), (320, 1, [None]), (330, 1, [math.nan]), (340, 1, [math.inf]), (0, 2, [9.0])]
    wider = frame(spark, rows).selectExpr("*", "1 as tile", "2 as `positives`")
    found = set(map(tuple, negatives.mine(wider, negatives.F.expr("vec_id % 10 = 0"), sample_rows=50).collect()))
    assert found == brute(rows, lambda i: i % 10 == 0) and found


def test_empty_and_alone(spark):
    every = negatives.F.lit(True)
    assert negatives.mine(frame(spark, []), every).count() == 0
    assert negatives.mine(frame(spark, [(1, 1, [1.0])]), every).count() == 0
    assert negatives.mine(frame(spark, [(1, 1, []), (2, 1, []), (3, 2, [])]), every).count() == 2
    with pytest.raises(ValueError, match="long"):
        negatives.mine(frame(spark, [(1, 1, [3e38])]), every)


def test_large_components(spark):
    draw = random.Random(4)
    rows = [(i, i % 2, [draw.uniform(-4e6, 4e6) for _ in range(4)]) for i in range(40)]
    assert set(map(tuple, negatives.mine(frame(spark, rows), negatives.F.expr("vec_id % 5 = 0")).collect())) == brute(rows, lambda i: i % 5 == 0)


def test_bounds_hold_and_filter():
    draw = np.random.default_rng(1)
    q = np.floor(draw.normal(size=(3000, 16)) * 64).astype(np.int32)
    books = negatives.fit(q[:500])
    codes, left = negatives.encode(q, books)
    import pyarrow as pa

    tile = negatives.Tile(pa.table({"vec_id": np.arange(3000), "label": np.arange(3000) % 2, "residual": left, "codes": pa.array([c.tobytes() for c in codes], pa.binary()), "whole": pa.array([v.tobytes() for v in q], pa.binary())}), books)
    low, high = tile.bounds(q[5])
    true = q.astype(np.int64) @ q[5].astype(np.int64)
    assert (low <= true).all() and (true <= high).all()
    tile.positives(5, 1, q[5], 5)
    assert tile.scored < 300
