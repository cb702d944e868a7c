"""Process records, statistics, topics and coverage on small tables."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from memlattice.operators import aggregates, lifecycle, processes, retrieval

SHAPE = "record_id string, kind string, maturity string, outcome string, sources array<string>, verified boolean, traits array<string>, context string, rollout_state string, drift_status string, experiment_id string, text string, updated_at timestamp"
DAY = datetime(2024, 1, 1)


def record(name, kind="episode", maturity="verified", outcome="correct", sources=None, verified=True, traits=("a", "b"), context="c1", rollout=None, drift="stable", experiment=None, text="", day=1):
    return (name, kind, maturity, outcome, sources, verified, list(traits) if traits is not None else None, context, rollout, drift, experiment, text, DAY.replace(day=day))


def test_patterns_inherit_and_are_made_once(spark):
    rows = [record("e1"), record("e2", traits=("b", "a"), context="c2"), record("e3", traits=None), record("e4", traits=None, context=None), record("e5", traits=("z",)), record("e6", traits=("z",)), record("e7", maturity="observed", context="c9"), record("e8", maturity=None)]
    frame = spark.createDataFrame(rows, SHAPE)
    found = {tuple(r.members): r for r in processes.promotable_patterns(frame, ["outcome", "context"]).collect()}
    assert set(found) == {("e1", "e2"), ("e3", "e4")}
    assert (found["e1", "e2"].outcome, found["e1", "e2"].context, found["e1", "e2"].traits) == ("correct", None, ["a", "b"])
    assert found["e3", "e4"].traits == ["other"] and found["e3", "e4"].context is None
    made = spark.createDataFrame([*rows, record("p", kind="pattern", sources=["e2", "e1"]), record("q", kind="pattern", sources=None)], SHAPE)
    assert {tuple(r.members) for r in processes.promotable_patterns(made).collect()} == {("e3", "e4")}
    assert processes.promotable_patterns(frame.where("false")).count() == 0


def test_traces_need_a_verifier_and_are_taken_once(spark):
    rows = [record("t1", kind="trace"), record("t2", kind="trace", verified=None), record("t3", kind="trace", outcome="failed"), record("t4", kind="trace", outcome=None), record("t5", kind="trace"), record("e", sources=["t5", None])]
    assert [r.record_id for r in processes.promotable_traces(spark.createDataFrame(rows, SHAPE)).collect()] == ["t1"]


def test_states_follow_the_last_allowed_change(spark):
    records = spark.createDataFrame([record("a"), record("b", drift="watch", verified=False), record("c", maturity="observed")], SHAPE)
    changes = spark.createDataFrame([("a", 1, "watch", None, DAY), ("a", 2, "unheard", True, DAY), ("b", 1, "stable", False, DAY), ("x", 1, "watch", True, DAY)], "record_id string, seq int, status string, verified boolean, at timestamp")
    found = {r.record_id: (r.drift_status, r.verified) for r in processes.with_drift(records, changes).collect()}
    assert found == {"a": ("watch", True), "b": ("watch", False), "c": ("stable", True)}
    actions = [("a", 1, "canary", "x", None, DAY), ("a", 2, "canary", None, None, DAY), ("b", 1, "publish", None, True, DAY), ("c", 1, "publish", None, True, DAY), ("c", 2, None, None, None, DAY)]
    found = {r.record_id: (r.rollout_state, r.experiment_id) for r in processes.with_rollout(records, spark.createDataFrame(actions, "record_id string, seq int, action string, experiment_id string, passed boolean, at timestamp")).collect()}
    assert found == {"a": ("canary", "x"), "b": ("active", None), "c": (None, None)}


def test_search_gates(spark):
    rows = [record("ok", text="Retry the Build", day=2), record("old", text="retry only", day=1), record("both", text="build and retry", day=1), record("shadow", text="retry", rollout="shadow"), record("back", text="retry", rollout="rolled_back"), record("mine", text="retry", rollout="canary", experiment="x", day=3), record("theirs", text="retry", rollout="canary", experiment="y"), record("dead", text="retry", drift="deprecated"), record("raw", text="retry", maturity=None), record("none", text=None), record("other", text="retry", traits=None, day=4)]
    records = spark.createDataFrame(rows, SHAPE)
    queries = spark.createDataFrame([("q", "RETRY build retry", None, None, "x"), ("a", "retry", "a", "c1", None), ("e", "", "a", None, None), ("z", "absent", None, None, None)], "query_id string, text string, archetype string, context string, experiment_id string")
    found = processes.search(records, queries, 10).orderBy("query_id", "rank").collect()
    by = {q: [(r.record_id, r.score) for r in found if r.query_id == q] for q in "qaez"}
    assert by["q"] == [("both", 2), ("ok", 2), ("old", 1), ("mine", 1), ("other", 1)]
    assert by["a"] == [("both", 1), ("old", 1), ("ok", 1)] and by["z"] == []
    assert [r for r, _ in by["e"]] == ["both", "none", "old", "ok"] and {s for _, s in by["e"]} == {0}
    assert processes.search(records, queries.where("false")).count() == 0


def plain_preference(order, sources, most):
    upto = min(most, len(order))
    while True:
        gone = {u for o in order[:upto] for u in sources.get(o, ())}
        wider = min(len(order), most + sum(u in gone for u in order[:upto]))
        if wider == upto:
            return [u for u in order[:upto] if u not in gone][:most]
        upto = wider


def test_observations_stand_for_their_sources(spark):
    rng = random.Random(4)
    orders = {q: rng.sample(range(60), rng.choice([0, 1, 5, 30, 60])) for q in range(12)}
    sources = {o: rng.sample(range(60), 9) for o in rng.sample(range(60), 12)}
    found = spark.createDataFrame([(q, u, n) for q, held in orders.items() for n, u in enumerate(held, 1)], "query_id int, unit_id int, rank int")
    pairs = spark.createDataFrame([(o, u) for o, held in sources.items() for u in held], "obs_id int, unit_id int")
    ours = {q: [] for q in orders}
    for r in retrieval.prefer_observations(found, pairs, 8).orderBy("query_id", "rank").collect():
        ours[r.query_id].append(r.unit_id)
        assert r.backfilled == (orders[r.query_id].index(r.unit_id) >= 8)
    assert ours == {q: plain_preference(held, sources, 8) for q, held in orders.items()}
    assert [r.unit_id for r in retrieval.prefer_observations(found.where("query_id = 0"), pairs.where("false"), 8).orderBy("rank").collect()] == orders[0][:8]


def test_statistics_of_empty_and_partial_banks(spark):
    units = spark.createDataFrame([(1, "b", "world", "d", DAY, None, None), (2, "b", None, None, DAY, DAY, None), (3, "b", "observation", "d", DAY, None, None)], "unit_id int, bank_id string, kind string, document_id string, created_at timestamp, consolidated_at timestamp, failed_at timestamp")
    links = spark.createDataFrame([(1, "causes"), (9, "causes")], "from_unit int, link_type string")
    postings = spark.createDataFrame([(1, 5), (2, 5), (9, 5)], "unit_id int, entity_id int")
    operations = spark.createDataFrame([("b", "pending"), ("only", None)], "bank_id string, status string")
    found = {r.bank_id: r for r in aggregates.bank_stats(units, links, postings, operations).collect()}
    b, only = found["b"], found["only"]
    assert (b.nodes, b.documents, b.observations, b.pending_consolidation, b.entity_edges) == (3, 1, 1, 1, 1)
    assert b.nodes_by_kind == {"": 1, "observation": 1, "world": 1} and b.links_by_kind_and_type == {"world/causes": 1}
    assert only.nodes == 0 and only.operations_by_status == {"": 1} and only.nodes_by_kind is None
    with pytest.raises(ValueError):
        aggregates.request_stats(units, "created_at", F.lit(DAY), "2d")


def test_coverage_of_unknown_dimensions(spark):
    plan = spark.createDataFrame([("q", "big"), ("q", "strange"), ("r", None), ("s", "big")], "query_id string, dimension string")
    results = spark.createDataFrame([("q", 5), ("q", None)], "query_id string, n int")
    found = {r.query_id: (r.covered, r.missing, r.complete) for r in aggregates.coverage(results, plan, {"big": F.max("n") > 3}).collect()}
    assert found == {"q": (["big"], ["strange"], False), "r": ([], [], True), "s": ([], ["big"], False)}


def test_scopes_named_and_bounded(spark):
    rows = spark.createDataFrame([(1, ["b", None, "a"], [["y", "x"], ["x", "y"], None]), (2, ["b", "a"], None), (3, None, None), (4, ["a"], [])], "id int, tags array<string>, scopes array<array<string>>")
    found = sorted((r.id, tuple(r.scope)) for r in lifecycle.scopes(rows, "explicit").collect())
    assert found == [(1, ()), (1, ("x", "y")), (2, ("a", "b")), (3, ())]
    wide = spark.createDataFrame([([f"t{n}" for n in range(17)],)], "tags array<string>")
    assert lifecycle.scopes(wide.select(F.slice("tags", 1, 16).alias("tags")), "all_combinations").count() == 65535
    with pytest.raises(Exception, match="more than 16 tags"):
        lifecycle.scopes(wide, "all_combinations").collect()
    with pytest.raises(ValueError):
        lifecycle.scopes(rows, "every")
