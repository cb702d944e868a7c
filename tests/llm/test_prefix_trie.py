"""Prefix tries against tries of Python dictionaries."""

import hashlib
import random
import zlib

import numpy as np

from memlattice.llm import oracle, prefix_trie, queries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [t[1:] for t in sorted(t, key=lambda t: t[0])] for c, t in turns.items()}
    members = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(turns.get(c - c % 100, [])[:h] + own[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], ([], []))[0].append(c)
        members[whole][1].append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p][0]) - 1) * (len(p[-1][1]) if p else 0)
        below = [sums[k] for k in kids.get(p, [])]
        sums[p] = (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below))
    return {
        (min(m), len(p), min(members[p[:-1]][0]) if p else None, len(m), len(kids.get(p, [])), *sums[p], hashlib.sha256(",".join(map(str, sorted(e))).encode()).hexdigest())
        for p, (m, e) in members.items()
    }


def found(frame, **options):
    rows = list(map(tuple, prefix_trie.tries(frame, **options).select(*COLUMNS).collect()))
    assert len(rows) == len(set(rows))
    return set(rows)


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_table_equals_sql_and_brute_force(spark, sf_dir, duck):
    rows = set(map(tuple, queries.op12_prefix_trie(spark, sf_dir).select(*COLUMNS).collect()))
    table = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows == brute(table)
    assert rows == set(duck.execute(f"SELECT {', '.join(COLUMNS)} FROM ({oracle.ORACLE['op12_prefix_trie']})").fetchall())


def test_shared_prefixes_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_BYTES", 8)
    draw = random.Random(3)
    rows = []
    for c in draw.sample(range(900), 160):
        start = [("user", f"hello {k}" * (k + 1)) for k in range(6)]
        n = draw.choice([1, 2, 3, 7, 12])
        said = [*start, *(("assistant", draw.choice("abé")) for _ in range(n))][: n if draw.random() < 0.5 else None]
        rows += [(c, 2 * k if k else None, role if draw.random() > 0.02 else None, text if draw.random() > 0.02 else None) for k, (role, text) in enumerate(said)]
    rows += [(1000 + c, k, "u", "same") for c in range(1, 70) for k in range(9)]  # copies, their first conversation absent
    rows += [(None, 0, "u", "x"), (5000, None, None, None)]
    draw.shuffle(rows)
    wide = frame(spark, rows).selectExpr("*", "1 as depth", "2 as `n`", "3 as k1").repartition(5)
    assert found(wide, heavy=2) == brute(rows)


def test_one_long_conversation_and_turnless_ones(spark):
    rows = [(5, k, "u", str(k % 3)) for k in range(4000)] + [(c, 0, "u", "x") for c in range(100, 130)]
    assert found(frame(spark, rows).repartition(3)) == brute(rows)
    assert found(frame(spark, [])) == set() and found(frame(spark, [(7, 1, "u", None)])) == brute([(7, 1, "u", None)])


def test_louds():
    draw = np.random.default_rng(2)
    for n in (1, 2, 50, 400):
        up = np.array([draw.integers(-1, k) if k else -1 for k in range(n)])
        ids = np.stack([draw.permutation(n), np.zeros(n, int)], axis=1)
        parents = np.where(up[:, None] >= 0, ids[up], [[-9, -9]])
        louds = prefix_trie.Louds(ids, parents)
        assert len(louds.bits) == (2 * n + 1 + 7) // 8
        back = louds.parents()
        for j, k in enumerate(louds.order):
            assert (louds.order[back[j]] if back[j] >= 0 else -1) == up[k] and (louds.labels[j] == ids[k]).all()
        assert (np.diff(back) >= 0).all() and (louds.degrees() == np.bincount(back + 1, minlength=n + 1)[1:]).all()
        total = np.ones(n, dtype=np.int64)
        for k in range(n - 1, 0, -1):
            if up[k] >= 0:
                total[up[k]] += total[k]
        assert (louds.rolled_up(np.ones(n, dtype=np.int64))[0] == total).all()
