"""Queries without SQL against plain Python over the same tables."""

import collections
import math
import re
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import numpy as np
import pytest

from memlattice.config import DEFAULT
from memlattice.functions import texts
from memlattice.operators import evidence, retrieval, vectors
from memlattice.plans import catalog_analytics, catalog_more, catalog_predicates  # noqa: F401
from memlattice.plans.catalog_retrieval import vector_queries, vector_units
from memlattice.plans.registry import QUERIES, Tables


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return Tables(spark, sf_dir)


def rows(frame):
    return [r.asDict() for r in frame.collect()]


def grams(name):
    out = set()
    for word in re.split(r"[^\w]+|_", name.lower()):
        if word:
            padded = f"  {word} "
            out |= {padded[i : i + 3] for i in range(len(padded) - 2)}
    return out


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def test_redaction_against_the_patterns(spark):
    token = "sk-ant-" + "a1B2" * 6
    samples = ["nothing here", f"key {token}.", f"{token}x_", "ghp_" + "a" * 36 + " ghp_" + "b" * 36, "ssn 123-45-6789, card 4111 1111 1111 1111", "postgres://u:p@host/db next", "é" + token, "AKIA" + "A" * 16 + "," + "ASIA" + "B" * 16, None, "-----BEGIN RSA PRIVATE KEY-----", "aws secret access key: " + "a" * 40]
    found = {r.i: r for r in texts.screened(spark.createDataFrame(list(enumerate(samples)), "i int, text string"), "text").collect()}
    for i, text in enumerate(samples):
        expected, matched = text or "", []
        for label, pattern in texts.REDACTIONS.items():
            expected, n = re.subn(pattern, f"[REDACTED:{label}]", expected)
            matched += [label] * bool(n)
        assert (found[i].redacted or "") == expected and found[i].matched == matched and found[i].outcome == ("redact" if matched else "allow")
    blocked = texts.screened(spark.createDataFrame([(token,)], "text string"), "text", "block").first()
    assert (blocked.outcome, blocked.redacted) == ("block", token)


def test_entity_resolution(spark, sf_dir, tables):
    found = {r["mention_id"]: (r["entity_id"], r["score"]) for r in rows(QUERIES["g13_entity_resolution"](spark, sf_dir))}
    names = {r.p_partkey: r.p_name for r in tables.part.collect()}
    seen, with_ = {}, collections.defaultdict(set)
    dates = {r.o_orderkey: r.o_orderdate for r in tables.orders.collect()}
    for r in tables.lineitem.collect():
        with_[r.l_partkey].add(r.l_suppkey)
        if r.l_orderkey in dates:
            seen[r.l_partkey] = max(seen.get(r.l_partkey, dates[r.l_orderkey]), dates[r.l_orderkey])
    sets = {k: grams(n) for k, n in names.items()}
    expected = {}
    for m, name in names.items():
        written = name.upper() if m % 3 == 0 else re.sub("([a-z])([a-z])", r"\2\1", name) if m % 3 == 1 else name
        own = grams(written)
        near = sorted(((-round(alike(own, sets[e]), 6), e) for e in names), key=lambda x: x)[:20]
        best = None
        for negative, e in near:
            if -negative < 0.3:
                continue
            ratio = 1.0 if -negative == 1 else SequenceMatcher(None, written.lower(), names[e].lower()).ratio()
            if ratio < 0.3:
                continue
            together = len(with_[m] & with_[e]) / len(with_[m]) if with_[m] else 0.0
            days = abs((datetime(1998, 1, 1) - seen[e]).days) if e in seen else None
            recent = 0.0 if days is None else max(0.0, 1 - days / 7)
            score = round(0.5 * ratio + 0.3 * together + 0.2 * recent, 6)
            if best is None or (-score, e) < (-best[1], best[0]):
                best = (e, score)
        if best and best[1] >= 0.5:
            expected[m] = best
    assert len(expected) > 20 and found.keys() == expected.keys()
    for m, (entity, score) in expected.items():
        assert found[m][1] == pytest.approx(score, abs=2e-6) and (found[m][0] == entity or abs(found[m][1] - score) < 2e-6)


def test_name_clusters(spark, sf_dir, tables):
    found = {r["lower"]: r["canonical"] for r in rows(QUERIES["g15_name_clusters"](spark, sf_dir))}
    count = collections.Counter(r.p_name.lower() for r in tables.part.collect())
    names = sorted(count)
    group = {n: n for n in names}
    for a in names:
        for b in names:
            if group[a] != group[b] and round(alike(grams(a), grams(b)), 6) >= 0.8:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {n: new if g == old else g for n, g in group.items()}
    for n in names:
        members = [m for m in names if group[m] == group[n]]
        assert found[n] == min(members, key=lambda m: (-count[m], len(m), m))


def test_token_compatibility(spark, sf_dir, tables):
    found = {(r["a"], r["b"]) for r in rows(QUERIES["g12_token_compatibility"](spark, sf_dir))}
    names = {r.p_name for r in tables.part.collect()}
    near = lambda u, v: u == v or u.startswith(v) or v.startswith(u) or SequenceMatcher(None, u, v).ratio() >= 0.6
    expected = set()
    for a in names:
        for other in names:
            if set(a.split()) & set(other.split()):
                b = re.sub("([a-z]{2})[a-z]", r"\1", other)
                short, long = sorted((a.lower().split(), b.lower().split()), key=len)
                if short and all(any(near(u, v) for v in long) for u in short):
                    expected.add((a, b))
    assert found == expected and found


def test_diverse_samples(spark, sf_dir, tables):
    found = collections.defaultdict(dict)
    for r in rows(QUERIES["x7_samples"](spark, sf_dir)):
        found[r["topic"]][r["place"]] = r["unit_id"]
    groups = collections.defaultdict(list)
    for r in sorted(tables.embeddings.collect(), key=lambda r: r.vec_id):
        groups[r.label].append((r.vec_id, np.array(r.embedding, dtype=float)))
    for topic, members in groups.items():
        ids, v = [m[0] for m in members], np.stack([m[1] / np.linalg.norm(m[1]) for m in members])
        chosen = list(dict.fromkeys([0, len(v) - 1, int((v @ v.mean(axis=0)).argmax())]))[:6]
        while len(chosen) < min(6, len(v)):
            near = (v @ v[chosen].T).max(axis=1)
            near[chosen] = np.inf
            chosen.append(int(near.argmin()))
        assert [found[topic][k] for k in sorted(found[topic])] == [ids[k] for k in chosen]


def test_document_operations(spark):
    steps = [("add_section", "s", None, None, "Heading"), ("append_block", "s", None, None, "one"), ("insert_block", "s", None, None, "zero"), ("insert_block", "s", None, "b1", "half"), ("replace_block", "s", "b1", None, "ONE"), ("remove_block", "s", "b2", None, None), ("add_section", "s", None, None, "Again"), ("add_section", "t", None, "s", "Between"), ("rename_section", "t", None, None, "Renamed"), ("replace_section_blocks", "t", None, None, "p\n\nq"), ("remove_section", "s-2", None, None, None), ("append_block", "gone", None, None, "x"), ("insert_block", "s", None, "b99", "x"), ("replace_block", "s", "b99", None, "x"), ("unknown", "s", None, None, "x")]
    frame = spark.createDataFrame([(7, k, *step) for k, step in enumerate(steps)] + [(8, 0, "remove_section", "s", None, None, None)], "doc_id long, seq int, op string, section string, block string, after string, text string")
    found = {(r.doc_id, r.place): (r.section, r.heading, list(r.blocks), r.applied, r.skipped) for r in evidence.apply_operations(frame).collect()}
    assert found == {(7, 0): ("s", "Heading", ["ONE", "half"], 11, 4), (7, 1): ("t", "Renamed", ["p", "q"], 11, 4), (8, 0): (None, None, [], 0, 1)}


def test_document_operations_of_the_query(spark, sf_dir, tables):
    from memlattice.plans.catalog_more import _operations

    documents = collections.defaultdict(evidence.Document)
    for r in sorted(_operations(tables).collect(), key=lambda r: (r.doc_id, r.seq)):
        documents[r.doc_id].apply(r.op, r.section, r.block, r.after, r.text)
    found = {r["doc_id"]: r for r in rows(QUERIES["x12_structured_operations"](spark, sf_dir))}
    assert found.keys() == documents.keys() and sum(r["applied"] for r in found.values()) > len(found) * 2
    for doc_id, d in documents.items():
        assert (found[doc_id]["sections"], found[doc_id]["applied"], found[doc_id]["skipped"]) == (len(d.sections), d.applied, d.skipped)
        assert found[doc_id]["blocks"] == sum(len(s["blocks"]) for s in d.sections)


def test_memory_packets(spark, sf_dir, tables):
    found = {r["packet"]: (r["used"], r["ranks"]) for r in rows(QUERIES["x6_memory_packet"](spark, sf_dir))}
    packets = collections.defaultdict(dict)
    for r in sorted(tables.conversations.collect(), key=lambda r: (r.conv_id, r.turn)):
        first = packets[r.conv_id].get(r.role, (r.turn, 0))[0]
        packets[r.conv_id][r.role] = (first, -(-len(r.text) // 4) * 4)  # the last text of a claim, at its first place
    for packet, items in packets.items():
        used, taken = 0, []
        for turn, size in sorted(items.values()):
            if used + size <= 400 or not taken:
                used, taken = used + size, [*taken, turn]
        assert found[packet] == (used, ",".join(map(str, taken)))


def spread(entries, links, config=DEFAULT):
    """Plain rounds: ``entries`` {unit: score}, ``links`` {unit: [(weight, to)]} strongest first."""
    reached, front = dict(entries), sorted(entries.items(), key=lambda x: (-x[1], x[0]))
    for _ in range(config.spread_rounds):
        best = {}
        for place, (unit, score) in enumerate(front[: config.spread_batch]):
            if score > 0.2:
                for weight, to in links.get(unit, [])[: config.spread_neighbours]:
                    if to not in reached:
                        best.setdefault(to, []).append((place, -weight, unit, score * weight * 0.7))
        new = {to: min(ways)[3] for to, ways in best.items()}
        reached |= new
        front = sorted(new.items(), key=lambda x: (-x[1], x[0]))
    return reached


def strongest(pairs):
    out = collections.defaultdict(list)
    for a, b, weight in pairs:
        if weight >= 0.1:
            out[a].append((weight, b))
    return {a: sorted(found, key=lambda x: (-x[0], x[1])) for a, found in out.items()}


def test_temporal_spreading(spark, sf_dir, tables):
    from memlattice.plans import views

    found = collections.defaultdict(dict)
    for r in rows(QUERIES["r15_temporal_spreading"](spark, sf_dir)):
        found[r["query_id"]][r["unit_id"]] = r["score"]
    links = strongest((r.from_unit, r.to_unit, r.weight) for r in views.links(tables).collect())
    seeds = collections.defaultdict(dict)
    for r in views.seeds(tables).collect():
        seeds[r.query_id][r.unit_id] = 1.0
    assert found.keys() == seeds.keys()
    for query, entries in seeds.items():
        expected = spread(entries, links)
        assert expected.keys() == found[query].keys() and all(found[query][u] == pytest.approx(s) for u, s in expected.items())


def test_inverted_file_recall(tables):
    units, asked = vector_units(tables), vector_queries(tables)
    held = vectors.centroids(units, 32)
    indexed = vectors.index(units, held, 2)
    assert indexed.select("unit_id").distinct().count() == units.count()
    found = {(r.query_id, r.unit_id) for r in vectors.search(asked, indexed, held, 10, 12).collect()}
    exact = {(r.query_id, r.unit_id) for r in retrieval.semantic(asked, units, 10, -1.0, keys=()).collect()}
    assert len(found & exact) >= 0.9 * len(exact)


def words(text):
    return [w for w in re.split(r"[^\w]+", (text or "").lower()) if w]


def test_hybrid_recall(spark, sf_dir, tables):
    """All four arms, their fusion, boosts and packing, by plain loops."""
    found = collections.defaultdict(dict)
    for r in rows(QUERIES["hybrid_recall"](spark, sf_dir)):
        found[r["query_id"]][r["unit_id"]] = (r["score"], r["packed"])
    vectors_ = {r.vec_id: np.array(r.embedding, dtype=float) for r in tables.embeddings.collect()}
    docs = {r.doc_id: r for r in tables.documents.collect() if r.doc_id in vectors_}
    asked = {r.conv_id: r.text for r in tables.conversations.where("turn = 0 AND conv_id % 20 = 0").collect() if r.conv_id in vectors_ and r.conv_id % 20 == 0}
    at = {d: datetime(2023, 1, 1) + timedelta(days=d % 400) for d in docs}
    low, high, now = datetime(2023, 3, 1), datetime(2023, 6, 1), datetime(2024, 3, 1)
    cosine = lambda a, b: round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), 6)
    top = lambda scores, most: sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:most]
    labels = {r.vec_id: r.label for r in tables.embeddings.collect()}
    similar = []
    for a, va in vectors_.items():
        near = {b: cosine(va, vb) for b, vb in vectors_.items() if b != a and labels[a] == labels[b]}
        similar += [(a, b, w) for b, w in top({b: w for b, w in near.items() if w >= 0.3}, 5)]
    causal = [(d, d + 1, 0.8) for d in docs]
    entity = {r.doc_id: f"{r.source}/{r.lang}" for r in tables.documents.collect()}
    of_entity = collections.defaultdict(list)
    for d in sorted(entity, reverse=True):
        if entity[d] is not None and len(of_entity[entity[d]]) < 200:
            of_entity[entity[d]].append(d)
    tokens = {d: words(r.text) for d, r in docs.items()}
    df = collections.Counter(w for t in tokens.values() for w in set(t))
    average = sum(map(len, tokens.values())) / len(tokens)
    ranks = lambda ordered: {u: k for k, (u, _) in enumerate(ordered, 1)}
    assert found.keys() == asked.keys() and asked
    for query, text in asked.items():
        v = vectors_[query]
        semantic = top({d: s for d in docs if (s := cosine(v, vectors_[d])) >= 0.3}, 100)
        first = {}
        for k, w in enumerate(words(text)):
            first.setdefault(w, k)
        terms = sorted(first, key=lambda w: (df[w], first[w]))[:16]
        scores = {}
        for d, t in tokens.items():
            counts = collections.Counter(t)
            s = sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * counts[w] * 2.2 / (counts[w] + 1.2 * (0.25 + 0.75 * len(t) / average)) for w in terms if counts[w])
            if round(s, 6) > 0:
                scores[d] = round(s, 6)
        keyword = top(scores, 100)
        seeds = {u for u, _ in semantic[:20]}
        parts = collections.defaultdict(lambda: [0, 0.0, 0.0])
        for e in {entity[s] for s in seeds}:
            for d in of_entity[e]:
                if d not in seeds:
                    parts[d][0] += 1
        for a, b, w in [*similar, *((b, a, w) for a, b, w in similar)]:
            if a in seeds and b not in seeds:
                parts[b][1] = max(parts[b][1], w)
        for a, b, w in causal:
            if a in seeds:
                parts[b][2] = max(parts[b][2], w)
        graph = top({u: round(math.tanh(0.5 * e) + s + c, 6) for u, (e, s, c) in parts.items()}, 100)
        pool = collections.defaultdict(dict)
        nearness = lambda d: 1 - min(abs((at[d] - low - (high - low) / 2).total_seconds() / 86400) / ((high - low).total_seconds() / 86400 / 2), 1.0)
        for d in docs:
            if low <= at[d] <= high and cosine(v, vectors_[d]) >= 0.1:
                pool[docs[d].lang][d] = cosine(v, vectors_[d])
        entries = {}
        for members in pool.values():
            best = top(members, 60)
            tier, buckets = {}, collections.Counter()
            for d, _ in best:
                bucket = min(math.floor((at[d] - low) / (high - low) * 8), 7)
                buckets[bucket] += 1
                tier[d] = 0 if len(best) <= 10 else buckets[bucket]
            for d, _ in sorted(best, key=lambda x: (tier[x[0]], -x[1], x[0]))[:10]:
                entries[d] = round(nearness(d), 6)
        temporal = top({u: round(s, 6) for u, s in spread(entries, strongest([*similar, *causal])).items()}, 100)
        fused = collections.defaultdict(float)
        for arm in (semantic, keyword, graph, temporal):
            for u, rank in ranks(arm).items():
                fused[u] += 1 / (60 + rank)
        order = top({u: round(s, 6) for u, s in fused.items()}, 300)
        scored = {}
        for k, (u, _) in enumerate(order, 1):
            if u in docs:
                ce = 1.0 if len(order) <= 1 else 1 - 0.9 * (k - 1) / (len(order) - 1)
                proof = docs[u].n_chars
                proof = 0.5 if proof is None or proof < 1 else min(max(0.5 + math.log(proof) / 10, 0), 1)
                fresh = max(1 - max((now.date() - at[u].date()).days, 0) / 365, 0.1)
                scored[u] = round(ce * (1 + 0.2 * (fresh - 0.5)) * (1 + 0.2 * (nearness(u) - 0.5)) * (1 + 0.1 * (proof - 0.5)), 6)
        used, packed = 0, set()
        for u, _ in top(scored, len(scored)):
            size = -(-len(docs[u].text or "") // 4)
            if used + size <= 2000 or not packed:
                used += size
                packed.add(u)
        assert found[query].keys() == scored.keys()
        assert all(found[query][u][0] == pytest.approx(s, abs=2e-6) for u, s in scored.items())
        assert {u for u, (_, p) in found[query].items() if p} == packed
