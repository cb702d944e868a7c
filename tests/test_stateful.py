"""Stateful streams against their batch counterparts and against plain Python, over files that arrive one after another."""

import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from memlattice.operators import lifecycle
from memlattice.streaming import stateful

START = datetime(2024, 1, 1)
LEDGER = "key string, id long, at timestamp, digest string"
QUEUE = "key string, id long, at timestamp, what string, tokens long, shape string"


def arriving(spark, folder, batches, schema):
    """A stream of one file a batch, in this order."""
    for number, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(folder))
        if number < len(batches) - 1:
            time.sleep(1.1)  # files are taken by time of modification
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def plain_ledger(rows, keep):
    found, out = {}, set()
    for key, row_id, at, digest in sorted((r for r in rows if r[0] is not None and r[2] is not None), key=lambda r: (r[2], r[1])):
        held = found.get(key)
        if held is None or at - held[2] > timedelta(seconds=keep):
            held, state = (digest, row_id, at), "stored"
        else:
            state = "replayed" if held[0] == digest else "conflict"
            held = (held[0], held[1], at)
        found[key] = held
        out.add((key, row_id, state, held[1]))
    return out


def test_ledger_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.3 else rng.choice("abcde"), n, START + timedelta(minutes=5 * n), rng.choice(["x", "y", None])) for n in range(120)]
    rows += [(None, 900, START, "x"), ("a", 901, None, "x")]
    batches = [[r for r in rows if r[2] is None or r[2] < START + timedelta(minutes=300)], [r for r in rows if r[2] and r[2] >= START + timedelta(minutes=300)]]
    stream = stateful.ledger_outcomes(arriving(spark, tmp_path / "in", batches, LEDGER), "1 hour", 1200)
    streamed = sorted(map(tuple, stateful.settled_stream(stream, str(tmp_path / "out")).collect()))
    batch = sorted(map(tuple, lifecycle.ledger_outcomes(spark.createDataFrame(rows, LEDGER), 1200).collect()))
    expected = sorted(plain_ledger(rows, 1200))
    assert batch == expected
    assert streamed == expected
    assert {r[2] for r in expected} == {"stored", "replayed", "conflict"}


def test_conflict_keeps_what_was_stored(spark):
    rows = [("k", 1, START, "x"), ("k", 2, START, "y"), ("k", 3, START + timedelta(seconds=9), "x"), ("k", 4, START + timedelta(seconds=20), "y")]
    found = lifecycle.ledger_outcomes(spark.createDataFrame(rows, LEDGER), 10).orderBy("id").collect()
    assert [(r.state, r.stored_id) for r in found] == [("stored", 1), ("conflict", 1), ("replayed", 1), ("stored", 4)]
    assert lifecycle.ledger_outcomes(spark.createDataFrame([], LEDGER), 10).count() == 0
    old = [("k", 1, datetime(1960, 1, 1), None), ("k", 2, datetime(1960, 1, 1, 0, 0, 1), None)]
    assert {r.state for r in lifecycle.ledger_outcomes(spark.createDataFrame(old, LEDGER), 0).collect()} == {"stored"}


def plain_runs(rows, peers, budget):
    queue, tries, out = {}, {}, set()
    for key, row_id, _, what, tokens, shape in sorted(rows, key=lambda r: (r[2], r[1])):
        held = queue.setdefault(key, [])
        if what == "append":
            held.append((row_id, tokens or 0, shape))
            continue
        if not held:
            continue
        run, used = [held[0]], held[0][1]
        for one in held[1:]:
            if held[0][2] is None or one[2] != held[0][2] or len(run) > peers // 2 ** tries.get(key, 0) or used + one[1] > budget:
                break
            run.append(one)
            used += one[1]
        out.add((key, row_id, what, tries.get(key, 0), ",".join(str(x[0]) for x in run)))
        if what == "done":
            queue[key], tries[key] = held[len(run):], 0
        else:
            tries[key] = tries.get(key, 0) + 1
    return out, queue, tries


def test_folds_halve_and_agree_with_batch(spark, tmp_path):
    rng = random.Random(7)
    rows = []
    for n in range(150):
        what = rng.choices(["append", "failed", "done"], [6, 2, 1])[0]
        rows.append((rng.choice("ab"), n, START + timedelta(minutes=n), what, rng.choice([None, 1, 30, 90]) if what == "append" else None, rng.choices(["s", "t", None], [8, 1, 1])[0] if what == "append" else None))
    stream = stateful.folds(arriving(spark, tmp_path / "in", [rows[:70], rows[70:]], QUEUE), "1 day", 86_400, 8, 200)
    streamed = set(map(tuple, stateful.settled_stream(stream, str(tmp_path / "out")).collect()))
    expected, queue, tries = plain_runs(rows, 8, 200)
    assert streamed == expected
    assert max(r[3] for r in expected) >= 2
    left = [(key, row_id, START, tokens, shape, tries.get(key, 0)) for key, held in queue.items() for row_id, tokens, shape in held]
    batch = lifecycle.fold_runs(spark.createDataFrame(left, "key string, id long, at timestamp, tokens long, shape string, tries int"), ["key"], ["at", "id"], "tokens", "shape", "tries", 8, 200)
    asked = [(key, 10_000, START + timedelta(days=1), "failed", None, None) for key in queue]
    runs = {r[0]: r[4] for r in plain_runs(rows + asked, 8, 200)[0] if r[1] == 10_000}
    ours = {r.key: r.m for r in batch.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"].cast("string")), ",").alias("m")).collect()}
    assert ours == runs


def test_silent_state_expires(spark, tmp_path):
    append = lambda key, n, day: (key, n, START + timedelta(days=day), "append", 1, "s")
    batches = [[append("a", 1, 0), append("a", 2, 0)], [append("b", 3, 20)], [append("b", 4, 21)], [append("b", 5, 22)]]
    stream = stateful.folds(arriving(spark, tmp_path / "in", batches, QUEUE), "1 day", 86_400)
    found = sorted(map(tuple, stateful.settled_stream(stream, str(tmp_path / "out")).collect()))
    assert ("a", -1, "expired", 0, "1,2") in found
    assert not any(r[0] == "a" and r[2] != "expired" for r in found)


TASKS = "operation_id long, bank string, document string, type string, priority int, status string, next_retry_at timestamp, created_at timestamp"


def plain_claim(tasks, now, shared, reserved):
    busy = [{t[k] for t in tasks if t[5] == "processing" and t[k] is not None} for k in (1, 2)]
    left, out = dict(reserved), {}
    for t in sorted((t for t in tasks if t[5] == "pending" and (t[6] is None or t[6] <= now)), key=lambda t: (t[4], t[7], t[0])):
        if any(t[k] is not None and t[k] in busy[k - 1] for k in (1, 2)):
            continue
        if left.get(t[3], 0):
            left[t[3]] -= 1
            out[t[0]] = t[3]
        elif shared:
            shared -= 1
            out[t[0]] = "shared"
        else:
            continue
        for k in (1, 2):
            busy[k - 1].add(t[k])
    return out


def claim(spark, tasks, shared, reserved):
    found = lifecycle.claimable(spark.createDataFrame(tasks, TASKS), F.lit(START), ["bank", "document"], shared, reserved)
    return {r.operation_id: r.slot for r in found.collect()}


def test_a_passed_over_task_blocks_no_other(spark):
    at = lambda n: START - timedelta(hours=9 - n)
    tasks = [(1, "b2", "d1", "x", 1, "pending", None, at(1)), (2, "b1", "d1", "x", 1, "pending", None, at(2)), (3, "b1", "d2", "x", 1, "pending", None, at(3))]
    assert claim(spark, tasks, 10, {}) == {1: "shared", 3: "shared"}
    full = [(1, "b1", None, "x", 1, "pending", None, at(1)), (2, "b2", None, "x", 1, "pending", None, at(2)), (3, "b2", None, "y", 1, "pending", None, at(3))]
    assert claim(spark, full, 1, {"y": 1}) == {1: "shared", 3: "y"}
    assert claim(spark, full, 0, {}) == {}
    assert claim(spark, [], 3, {}) == {}


def test_claims_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(lifecycle, "LOOK_AHEAD", 1)
    rng = random.Random(3)
    tasks = []
    for n in range(80):
        status = rng.choices(["pending", "processing", "completed"], [12, 1, 1])[0]
        tasks.append((n, rng.choice(["b1", "b2", "b3", "b4", "b5", "b6", None]), rng.choice([None, "d1", "d2", "d3", "d4", "d5"]), rng.choice("xyz"), rng.randint(0, 2), status, rng.choice([None, START, START + timedelta(days=1)]), START - timedelta(hours=rng.randint(0, 9))))
    assert claim(spark, tasks, 3, {"x": 2, "z": 1}) == plain_claim(tasks, START, 3, {"x": 2, "z": 1})
