"""The temporal arm in blocks of vectors: against brute force, and without a row for each query and unit in its window."""

import contextlib
import io
import random
from datetime import datetime, timedelta

import numpy as np

from memlattice.operators import retrieval
from memlattice.plans import recall

START = datetime(2024, 1, 1)


def tables(spark, draw):
    moment = lambda: START + timedelta(days=draw.randint(0, 9))
    units = [(k, draw.choice(["a", "b"]), [draw.random() - 0.3, draw.random() - 0.3, draw.random()], draw.choice([None, *(moment() for _ in range(9))])) for k in range(80)]
    queries = [(k, [draw.random(), draw.random() - 0.5, draw.random()], draw.choice([None, moment(), moment()]), draw.choice([None, moment(), moment()])) for k in range(25)]
    return queries, units, spark.createDataFrame(queries, "query_id int, vector array<double>, low timestamp_ntz, high timestamp_ntz"), spark.createDataFrame(units, "unit_id int, kind string, embedding array<double>, at timestamp_ntz")


def test_nearest_within_times(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 6)
    monkeypatch.setattr(retrieval, "UNIT_BLOCK", 9)
    queries, units, q, u = tables(spark, random.Random(1))
    found = {(r.query_id, r.unit_id): r.score for r in retrieval.nearest(q, u, None, 0.1, digits=6, timed=True).collect()}
    expected = {}
    for k, v, low, high in queries:
        for i, _, w, at in units:
            score = round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 6)
            if None not in (low, high, at) and low <= at <= high and score >= 0.1:
                expected[k, i] = score
    assert found.keys() == expected.keys() and all(abs(found[p] - s) < 2e-6 for p, s in expected.items())


def test_temporal_arm_makes_no_pairs(spark):
    _, _, q, u = tables(spark, random.Random(2))
    with contextlib.redirect_stdout(io.StringIO()) as out:
        recall.temporal(q, u, None, 10).explain()
    joins = [line for line in out.getvalue().splitlines() if "Join" in line]
    assert "FlatMapCoGroupsInPandas" in out.getvalue() and not any("_block" in line for line in joins)
