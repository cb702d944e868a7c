"""Best units of many queries by terms, in blocks and chunks: against brute force, and without pairs of queries and units."""

import contextlib
import io
import random
from collections import Counter

import pytest
from test_queries import compare

from memlattice.operators import matching, processes, retrieval, term_scores
from memlattice.plans.registry import ORACLE, QUERIES

WORDS = ["ab", "b", "abc", "cab", "bc", "ca", "xx", "x", "ä"]


@pytest.fixture(params=[(500_000, 256, 1000), (7, 3, 4)])
def sizes(request, monkeypatch):
    for name, value in zip(("ASKED", "QUERIES", "UNITS"), request.param, strict=True):
        monkeypatch.setattr(term_scores, name, value)


def some(draw, n, most):
    return [(k, draw.choice([None, "", " "]) if draw.random() < 0.1 else " ".join(draw.choice(WORDS) for _ in range(draw.randint(1, most)))) for k in range(n)]


def first(scores, most):
    return {(q, u, s) for q in {q for q, _ in scores} for u, s in sorted(((u, s) for (p, u), s in scores.items() if p == q), key=lambda x: (-x[1], x[0]))[:most]}


def test_weighted_selection(spark, sizes):
    draw = random.Random(1)
    queries, units = some(draw, 20, 5), [(k, t, draw.choice([None, [], ["AB", ""], ["x", "ca", None], ["nowhere"]])) for k, t in some(draw, 60, 6)]
    scores = {}
    for q, text in queries:
        low = (text or "").lower()
        for u, body, conditions in units:
            whole = " ".join([body or "", *(c for c in conditions or [] if c is not None)]).lower()
            s = sum(3.0 if len(w) > 1 else 1.0 for w in set(low.split()) if w in whole) + 6.0 * any(c and c.lower() in low for c in conditions or [])
            if s > 0:
                scores[q, u] = s
    found = matching.select_weighted(spark.createDataFrame(queries, "query_id int, text string"), spark.createDataFrame(units, "unit_id int, text string, conditions array<string>"), 5).collect()
    assert {(r.query_id, r.unit_id, r.score) for r in found} == first(scores, 5)


def test_keywords(spark, sizes):
    draw = random.Random(2)
    queries, units = some(draw, 20, 5), [(k, t or "") for k, t in some(draw, 60, 9)]
    asked = spark.createDataFrame([(q, t) for q, text in queries for t in set((text or "").split())], "query_id int, term string")
    frame = spark.createDataFrame([(u, t, draw.choice(["a", "b", None])) for u, t in units], "unit_id int, text string, kind string")
    words = {u: Counter(t.split()) for u, t in units}
    average, df = sum(w.total() for w in words.values()) / len(words), Counter(t for w in words.values() for t in w)
    import math

    idf = {t: math.log(1 + (len(units) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    weight = lambda w, t: idf[t] * w[t] * 2.2 / (w[t] + 1.2 * (0.25 + 0.75 * w.total() / average))
    scores = {(q, u): s for q, text in queries for u, w in words.items() if (s := round(sum(weight(w, t) for t in set((text or "").split()) if t in w), 6)) > 0}
    rows = retrieval.keyword(asked, frame, 5).collect()
    assert {(r.query_id, r.unit_id, r.score) for r in rows} == first(scores, 5)
    kinds = {r.unit_id: r.kind for r in frame.collect()}
    rows = retrieval.keyword(asked, frame, 3, ["kind"]).collect()
    expected = set().union(*(first({p: s for p, s in scores.items() if kinds[p[1]] == kind}, 3) for kind in ("a", "b", None)))
    assert {(r.query_id, r.unit_id, r.score) for r in rows} == expected
    assert retrieval.keyword(asked.where("false"), frame, 3).count() == 0


def test_process_search(spark, sizes):
    draw = random.Random(3)
    queries = [(q, t, draw.choice([None, "en", "de"]), draw.choice([None, "c1"]), draw.choice([None, "x0"])) for q, t in some(draw, 30, 3)]
    records = [
        (k, t, draw.choice([None, "active", "canary", "shadow"]), draw.choice([None, "stable", "deprecated"]), "verified", draw.choice([None, "x0", "x1"]), draw.choice([None, ["en"], ["de", "en"], []]), draw.choice([None, "c1", "c2"]), draw.choice([None, 5, 6, 7]))
        for k, t in some(draw, 60, 6)
    ]
    frame = spark.createDataFrame(records, "record_id int, text string, rollout_state string, drift_status string, maturity string, experiment_id string, traits array<string>, context string, at long").selectExpr("*", "timestamp_micros(at) AS updated_at")
    expected = set()
    for q, text, archetype, context, experiment in queries:
        words, held = set((text or "").split()), []
        for k, body, state, drift, _, trial, traits, place, at in records:
            fit = state != "shadow" and drift != "deprecated" and (state != "canary" or (trial is not None and trial == experiment)) and (archetype is None or archetype in (traits or [])) and (context is None or context == place)
            score = sum(w in (body or "") for w in words)
            if fit and (score or not words):
                held.append((-score, -1 if at is None else at, k))
        expected |= {(q, k, -s, rank) for rank, (s, _, k) in enumerate(sorted(held)[:4], 1)}
    found = processes.search(frame, spark.createDataFrame(queries, "query_id int, text string, archetype string, context string, experiment_id string"), 4).collect()
    assert {tuple(r) for r in found} == expected


def plan(frame):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        frame.explain()
    return out.getvalue()


def no_pairs(shown):
    """Nothing is summed by query and unit: that is done where units are read."""
    assert "MapInPandas" in shown
    for of in ("query_id", "unit_id"), ("query_id", "record_id"):
        assert not any("Aggregate(keys=" in line and all(f"{c}#" in line.split("functions=")[0] for c in of) for line in shown.splitlines())


def test_keyword_topk_makes_no_pairs(spark, sf_dir, duck):
    compare(QUERIES["r3_keyword_topk"](spark, sf_dir), duck, ORACLE["r3_keyword_topk"])
    no_pairs(plan(QUERIES["r3_keyword_topk"](spark, sf_dir)))


def test_weighted_selection_makes_no_pairs(spark, sf_dir, duck):
    compare(QUERIES["r31_weighted_selection"](spark, sf_dir), duck, ORACLE["r31_weighted_selection"])
    no_pairs(plan(QUERIES["r31_weighted_selection"](spark, sf_dir)))


def test_process_search_makes_no_pairs(spark, sf_dir, duck):
    compare(QUERIES["x4_process_search"](spark, sf_dir), duck, ORACLE["x4_process_search"])
    no_pairs(plan(QUERIES["x4_process_search"](spark, sf_dir)))


def test_preference_rank_makes_no_pairs(spark, sf_dir, duck, monkeypatch):
    compare(QUERIES["r30_preference_rank"](spark, sf_dir), duck, ORACLE["r30_preference_rank"])
    monkeypatch.setattr(retrieval, "COMMON", 50)  # with rarer terms, which are joined
    frame = QUERIES["r30_preference_rank"](spark, sf_dir)
    compare(frame, duck, ORACLE["r30_preference_rank"])
    no_pairs(plan(frame))
