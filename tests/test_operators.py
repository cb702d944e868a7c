"""Closed-form cases of columns and operators."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from memlattice.functions import scoring, tags, texts, times
from memlattice.operators import aggregates, budget, entities, graph, lifecycle, retrieval


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_recency(spark):
    for days, expected in ((0, 1.0), (365, 0.1), (400, 0.1), (-5, 1.0)):
        assert value(spark, times.recency(F.lit(days))) == pytest.approx(expected)
    assert value(spark, times.recency(F.lit(90), "exponential")) == pytest.approx(0.5)
    assert value(spark, times.recency(F.lit(90), "none")) == 1.0


def test_scores(spark):
    none = F.lit(None).cast("double")
    assert value(spark, scoring.combined(F.lit(0.6), none, none, none)) == pytest.approx(0.6)
    assert value(spark, scoring.combined(F.lit(0.5), F.lit(0), none, none)) == pytest.approx(0.55)
    for count, expected in ((1, 1.0), (None, 1.0), (150, 1.05)):
        assert value(spark, scoring.proof_factor(F.lit(count).cast("int"))) == pytest.approx(expected)
    for n, expected in ((1, 0.46), (2, 0.76), (3, 0.91), (4, 0.96)):
        assert value(spark, scoring.graph_score(F.lit(n), F.lit(0.0), F.lit(0.0))) == pytest.approx(expected, abs=0.005)
    for hours, expected in ((0, 1.0), (12, 0.5), (24, 0.3), (48, 0.3)):
        assert value(spark, scoring.link_weight(F.lit(hours))) == pytest.approx(expected)
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert value(spark, scoring.cosine(zero, F.array(F.lit(1.0), F.lit(2.0)))) == 0.0


def test_proximity(spark):
    at = lambda day: F.lit(datetime(2024, 1, day))
    assert value(spark, times.proximity(at(6), at(1), at(11))) == pytest.approx(1.0)
    assert value(spark, times.proximity(at(1), at(1), at(11))) == pytest.approx(0.0)
    assert value(spark, times.proximity(at(5), at(5), at(5))) == 1.0
    assert value(spark, times.proximity(F.lit(None).cast("timestamp"), at(1), at(11))) == 0.5


def test_tags(spark):
    rows = spark.createDataFrame([(1, []), (2, None), (3, ["a"]), (4, ["a", "b"]), (5, ["c"])], "id int, tags array<string>")
    keep = lambda test: {r.id for r in rows.where(test).collect()}
    t = F.col("tags")
    assert keep(tags.match(t, [], "exact")) == {1, 2}
    assert keep(tags.match(t, [], "any")) == {1, 2, 3, 4, 5}
    assert keep(tags.match(t, ["a", "b"], "any")) == {1, 2, 3, 4}
    assert keep(tags.match(t, ["a", "b"], "all")) == {1, 2, 4}
    assert keep(tags.match(t, ["a", "b"], "any_strict")) == {3, 4}
    assert keep(tags.match(t, ["a", "b"], "all_strict")) == {4}
    assert keep(tags.match(t, ["b", "a", "a"], "exact")) == {4}
    assert keep(tags.groups(t, [{"not": {"tags": ["a"]}}])) == {1, 2, 5}
    assert keep(tags.group(t, {"or": [{"tags": ["c"]}, {"and": [{"tags": ["a"]}, {"tags": ["b"]}]}]})) == {4, 5}


def test_trigrams(spark):
    a, b = texts.trigrams(F.lit("GPT-4")), texts.trigrams(F.lit("GPT 4"))
    assert value(spark, texts.trigram_similarity(a, b)) == 1.0
    assert value(spark, texts.trigrams(F.lit(""))) == []


def hits(spark, lists):
    rows = [(0, arm, no, rank, unit) for no, (arm, units) in enumerate(lists.items()) for rank, unit in enumerate(units, 1)]
    return spark.createDataFrame(rows, "query_id int, arm string, arm_no int, rank int, unit_id string")


def test_fusion(spark):
    h = hits(spark, {"semantic": ["s1", "s2", "s3"], "bm25": ["b1", "b2"], "graph": ["g1"]})
    assert [r.unit_id for r in retrieval.interleave(h).orderBy("rank").collect()] == ["s1", "b1", "g1", "s2", "b2", "s3"]
    one = hits(spark, {"semantic": ["x"], "bm25": ["x"]})
    assert retrieval.rrf(one, digits=9).first().score == pytest.approx(2 / 61)
    assert retrieval.cap_per_source(h, 1).count() == 3 and retrieval.cap_per_source(h, 0).count() == 6
    assert retrieval.boosted(one, {"bm25": "high"}, digits=9).first().score == pytest.approx(7 / 61)


def test_budgets(spark):
    sizes = lambda *s: spark.createDataFrame([(0, k, v) for k, v in enumerate(s)], "q int, rank int, size int")
    row = budget.pack(sizes(50, 500, 30), ["q"], "rank", F.col("size"), 100).first()
    assert (row.ranks, row.truncated, row.used) == ("0,2", True, 80)
    assert budget.pack(sizes(500, 600), ["q"], "rank", F.col("size"), 100).first().ranks == "0"
    rows = spark.createDataFrame([(0, 1, 0, 60), (0, 1, 1, 50), (0, 2, 2, 50), (0, 2, 3, 10)], "q int, o int, rank int, size int")
    row = budget.pack_sources(rows, ["q"], "o", "rank", F.col("size"), 130, 100).first()
    assert (row.used, row.n) == (120, 3)


def test_chunks_and_diffs(spark):
    old = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c")], "doc_id int, chunk_index int, content_hash string")
    new = spark.createDataFrame([(1, 0, "a"), (1, 1, "x"), (1, 3, "d")], "doc_id int, chunk_index int, content_hash string")
    assert {r.chunk_index: r.state for r in lifecycle.chunk_diff(old, new).collect()} == {0: "same", 1: "changed", 2: "removed", 3: "new"}
    chunks = lifecycle.fixed_chunks(spark.createDataFrame([(1, "abcdefg"), (2, "")], "doc_id int, text string"), 3)
    assert [(r.doc_id, r.chunk_text) for r in chunks.orderBy("doc_id", "chunk_index").collect()] == [(1, "abc"), (1, "def"), (1, "g"), (2, "")]


def test_p95(spark):
    rows = spark.createDataFrame([(0, float(v)) for v in range(1, 21)] + [(0, None), (1, 7.0)], "k int, v double")
    assert {r.k: r.p95 for r in aggregates.p95(rows, ["k"], "v").collect()} == {0: 19.0, 1: 7.0}


def test_nearest_in_time(spark):
    rows = spark.createDataFrame([(i, 0, datetime(2024, 1, 1, h)) for i, h in enumerate((0, 1, 3, 7, 7, 15))], "unit_id int, k int, ts timestamp")
    for hours in (1, 2, 5, 24):
        near = {}
        for r in graph.nearest_in_time(rows, ["k"], "ts", 2, hours).orderBy("unit_id", "rank").collect():
            near.setdefault(r.unit_id, []).append(r.other_id)
        assert near == {0: [1, 2], 1: [0, 2], 2: [1, 0], 3: [4, 2], 4: [3, 2], 5: [3, 4]}


def test_batch_links_cross_blocks(spark):
    rows = spark.createDataFrame([(1, datetime(2024, 1, 1, 23)), (2, datetime(2024, 1, 2, 1)), (3, datetime(2024, 1, 3, 2))], "unit_id int, ts timestamp")
    found = {(r.from_unit, r.to_unit) for r in graph.batch_links(rows.withColumn("k", F.lit(0)), ["k"], "ts").collect()}
    assert found == {(1, 2), (2, 1)}


def test_components_and_clusters(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (3, 4)], "a long, b long")
    assert {r.node: r.root for r in graph.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10}
    names = spark.createDataFrame([("Jon Smith", 1), ("jon smith", 2), ("John Smith", 5), ("Acme", 1)], "name string, mentions int")
    found = {r.lower: r.canonical for r in entities.cluster_names(names, 0.5).collect()}
    assert found == {"jon smith": "john smith", "john smith": "john smith", "acme": "acme"}


def test_semantic_links_meet_across_blocks(spark, monkeypatch):
    rows = [(i, 0, [math.cos(i / 10), math.sin(i / 10)]) for i in range(40)] + [(99, 0, [0.0, 0.0])]
    units = spark.createDataFrame(rows, "unit_id long, kind int, embedding array<float>")
    one = {(r.from_unit, r.to_unit, r.weight) for r in graph.semantic_links(units, ["kind"], 5, 0.9).collect()}
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "UNIT_BLOCK", 11)
    many = {(r.from_unit, r.to_unit, r.weight) for r in graph.semantic_links(units, ["kind"], 5, 0.9).collect()}
    assert one == many and all(a != b for a, b, _ in one)


def test_coverage_of_a_small_pool(spark):
    pool = spark.createDataFrame([(0, i, 1.0 - i / 10, i % 2) for i in range(3)], "k int, unit_id int, similarity double, b int")
    assert [r.unit_id for r in retrieval.coverage(pool, ["k"], F.col("b"), 5).orderBy("rank").collect()] == [0, 1, 2]


def test_spreading_reaches_each_unit_once(spark):
    entries = spark.createDataFrame([(0, 1, 1.0), (0, 2, 0.9)], "query_id int, unit_id int, score double")
    links = spark.createDataFrame([(1, 3, 1.0), (2, 3, 1.0), (3, 4, 0.5), (4, 1, 1.0)], "from_unit int, to_unit int, weight double")
    found = {r.unit_id: (round(r.score, 3), r.round) for r in retrieval.spread(entries, links).collect()}
    assert found == {1: (1.0, 0), 2: (0.9, 0), 3: (0.7, 1), 4: (0.245, 2)}


def test_resolution(spark):
    rows = spark.createDataFrame([(1, 10, 0.9, False, 1.0, 0.0), (1, 11, 0.2, True, None, None), (2, 12, 0.4, False, None, None)], "mention_id int, entity_id int, ratio double, same boolean, together double, days double")
    assert {r.mention_id: r.entity_id for r in entities.resolve(rows).collect()} == {1: 10}


def test_episodes_and_scopes(spark):
    rows = spark.createDataFrame([(0, 1, "user"), (0, 2, "assistant"), (0, 3, "user")], "c int, turn int, role string")
    assert [r.episode for r in lifecycle.episodes(rows, ["c"], "turn", F.col("role") == "user").orderBy("turn").collect()] == [1, 1, 2]
    tagged = spark.createDataFrame([(1, ["b", "a"]), (2, None)], "id int, tags array<string>")
    found = {(r.id, tuple(r.scope)) for r in lifecycle.scopes(tagged, "all_combinations").collect()}
    assert found == {(1, ("a",)), (1, ("b",)), (1, ("a", "b")), (2, ())}


def test_new_units_link_to_stored_ones(spark):
    from memlattice.plans.engine import Engine

    at = lambda day, hour: datetime(2024, 1, day, hour)
    shape = "unit_id int, bank_id string, kind string, created_at timestamp_ntz, embedding array<float>"
    stored = spark.createDataFrame([(1, "b", "w", at(1, 0), [1.0, 0.0]), (2, "b", "w", at(9, 0), [0.0, 1.0]), (3, "c", "w", at(1, 1), [1.0, 0.0])], shape)
    new = spark.createDataFrame([(1, "b", "w", at(1, 0), [1.0, 0.0], 0, 0, []), (10, "b", "w", at(1, 12), [0.9, 0.1], 0, 1, [2, 7]), (11, "b", "w", at(2, 6), [0.0, 0.0], 0, 2, [2])], shape + ", batch int, index int, causes array<int>")
    engine = Engine({"units": stored})
    engine.clock = lambda: now[0]
    now = [0.0]
    assert engine.cached_stats("b") == {"w": 2}
    added, links = engine.retain(new)
    assert sorted(r.unit_id for r in added.collect()) == [10, 11]
    found = {(r.from_unit, r.to_unit, r.link_type): r.weight for r in links.collect()}
    assert found.keys() == {(10, 1, "temporal"), (10, 11, "temporal"), (11, 10, "temporal"), (10, 1, "semantic"), (10, 11, "caused_by")}
    assert found[10, 1, "temporal"] == pytest.approx(0.5) and found[10, 11, "temporal"] == pytest.approx(0.3)
    assert not engine.cached and engine.cached_stats("b") == {"w": 2}
    engine.tables["units"] = stored.where("unit_id = 1")
    now[0] = 59.0
    assert engine.cached_stats("b") == {"w": 2}
    now[0] = 60.0
    assert engine.cached_stats("b") == {"w": 1}
    engine.forget("b")
    assert not engine.cached


def test_claims_merge_by_beginning(spark):
    from memlattice.operators import evidence

    lead = "x" * 48
    rows = [("s", lead + t, n, a) for t, n, a in (("", 9, 1), (" more", 5, 2), (" more words", 7, 9), ("y", 8, 3))] + [("t", lead + " more", 4, 4), ("s", "short", 1, 1), ("s", "Short", 2, 2), ("s", "short one", 3, 3)]
    found = {(r.slot, r.claim): (r.tokens, r.authority, r.n) for r in evidence.claims(spark.createDataFrame(rows, "slot string, claim string, tokens int, authority int")).collect()}
    assert found == {("s", lead): (5, 9, 4), ("t", lead + " more"): (4, 4, 1), ("s", "short"): (1, 2, 2), ("s", "short one"): (3, 3, 1)}


def test_components_that_do_not_settle_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    with pytest.raises(RuntimeError):
        graph.components(edges, rounds=1)
    assert {r.root for r in graph.components(edges).collect()} == {0}


def test_names_beyond_the_first_most_are_not_lost(spark):
    entities_ = spark.createDataFrame([(i, "same name") for i in range(30)] + [(99, "same names")], "entity_id int, canonical_name string")
    mentions = spark.createDataFrame([(0, "Same Name"), (1, None), (2, "--")], "mention_id int, name string")
    assert [r.entity_id for r in entities.trigram_matches(mentions, entities_, 0.3, 5).orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    assert entities.trigram_matches(mentions, entities_, 0.3, None).count() == 31


def test_a_long_group_is_packed_in_time(spark):
    n = 20_000
    items = spark.range(n).selectExpr("0 as k", "id as r", "id % 7 as size")
    row = budget.pack(items, ["k"], "r", F.col("size"), 30_000).first()
    used, taken = 0, []
    for r in range(n):
        if used + r % 7 <= 30_000:
            used += r % 7
            taken.append(r)
    assert row.used == used and row.n == len(taken) and row.ranks == ",".join(map(str, taken))


def test_markers_in_a_text_switch_no_rule_off(spark):
    key = "AKIA" + "A1B2C3D4E5F6G7H8"
    rows = [(1, f"see [REDACTED:aws_access_key] and {key}"), (2, "see [REDACTED:aws_access_key] and sk- nothing"), (3, None), (4, ""), (5, f"{key} {key}, 123-45-6789")]
    frame = spark.createDataFrame(rows, "id int, text string")
    found = {r.id: r for r in texts.screened(frame, "text").collect()}
    label = next(k for k, v in texts.REDACTIONS.items() if "AKIA" in v)
    assert found[1].matched == [label] and found[1].outcome == "redact" and key not in found[1].redacted
    assert (found[2].matched, found[2].outcome, found[2].redacted) == ([], "allow", rows[1][1])
    assert (found[3].matched, found[3].outcome, found[3].redacted) == ([], "allow", None)
    assert found[5].matched == [label, "ssn_us"] and found[5].redacted == f"[REDACTED:{label}] [REDACTED:{label}], [REDACTED:ssn_us]"
    blocked = {r.id: r for r in texts.screened(frame, "text", "block").collect()}
    assert [blocked[k].outcome for k in (1, 2, 3, 5)] == ["block", "allow", "allow", "block"]
    assert blocked[1].matched == [label] and blocked[2].redacted == rows[1][1]
