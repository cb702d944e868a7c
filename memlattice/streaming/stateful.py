"""Streams with a state of their own for each key: idempotent ledgers and folds of queued appends.

Decisions follow the rows' own times and not the clock, so a stream and its batch
counterpart in ``operators.lifecycle`` agree; timers only free the state of keys that
have fallen silent.  Of a key's rows in one micro-batch only the columns named here
are held, to bring them into order: the size of a micro-batch bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from memlattice.operators.lifecycle import fold_width

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = pd.Timestamp("1970-01-01")


def use_rocksdb(spark: SparkSession) -> None:
    """State in RocksDB, which these operators need: state beyond the executors' memory and timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _ordered(frames: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    held = [frame for frame in frames if len(frame)]
    return pd.concat(held, ignore_index=True).sort_values(order, kind="stable", ignore_index=True) if held else pd.DataFrame()


def _micros(at: pd.Timestamp) -> int:
    return (at.tz_localize(None) - EPOCH) // pd.Timedelta(microseconds=1)


class _Ledger(StatefulProcessor):
    """Per key the digest it was stored with, the row that stored it and when it was last met."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "digest string, stored_id long, seen long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        entry = self.entry.get() if self.entry.exists() else None
        out = []
        each = _ordered(rows, ["at", "id"])
        for row_id, at, digest in zip(each["id"], each["at"], each["digest"]):
            digest, at = None if pd.isna(digest) else digest, _micros(at)
            if entry is None or at - entry[2] > self.keep:
                entry, state = (digest, int(row_id), at), "stored"
            else:
                state = "replayed" if digest == entry[0] else "conflict"
                entry = (entry[0], entry[1], max(entry[2], at))
            out.append((key[0], int(row_id), state, entry[1]))
        if entry is not None:
            self.entry.update(entry)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((entry[2] + self.keep) // 1000 + 1)
        yield pd.DataFrame(out, columns=["key", "id", "state", "stored_id"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.entry.clear()
        yield pd.DataFrame({"key": pd.Series(dtype="str"), "id": pd.Series(dtype="int64"), "state": pd.Series(dtype="str"), "stored_id": pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


def ledger_outcomes(events: DataFrame, late: str, keep_seconds: int) -> DataFrame:
    """Every row of a stream (``key``, ``id`` long, ``at``, ``digest``) with ``state`` and ``stored_id``, the row its key was stored by.

    ``stored``: the key is new, or was not met for longer than ``keep_seconds``.
    ``replayed``: stored before with the same digest.  ``conflict``: with another one;
    what was stored stays.  Rows of a micro-batch count by time, then id; rows without a
    key or time take no part.  Only ``stored`` rows belong into an outbox.
    """
    use_rocksdb(events.sparkSession)
    rows = events.where("key IS NOT NULL AND at IS NOT NULL").select("key", "id", "at", "digest").withWatermark("at", late)
    shape = "key string, id long, state string, stored_id long"
    return rows.groupBy("key").transformWithStateInPandas(_Ledger(keep_seconds * 1_000_000), outputStructType=shape, outputMode="append", timeMode="eventTime")


class _Folds(StatefulProcessor):
    """Per document what is queued, how often its first has failed, and the last time of a row."""

    def __init__(self, peers: int, budget: int, keep: int):
        self.peers, self.budget, self.keep = peers, budget, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getListState("queue", "id long, tokens long, shape string")
        self.tries = handle.getValueState("tries", "n int")

    def _run(self, queue: list[tuple], tries: int) -> int:
        """How many of the queue one run takes."""
        if not queue:
            return 0
        first, used, n = queue[0], queue[0][1], 1
        width = fold_width(tries, self.peers)
        while first[2] is not None and n < len(queue) and n <= width and queue[n][2] == first[2] and used + queue[n][1] <= self.budget:
            used, n = used + queue[n][1], n + 1
        return n

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        queue = [tuple(x) for x in self.queue.get()] if self.queue.exists() else []
        tries = self.tries.get()[0] if self.tries.exists() else 0
        out = []
        each = _ordered(rows, ["at", "id"])
        for row_id, what, tokens, shape in zip(each["id"], each["what"], each["tokens"], each["shape"]):
            if what == "append":
                queue.append((int(row_id), 0 if pd.isna(tokens) else int(tokens), None if pd.isna(shape) else shape))
                continue
            n = self._run(queue, tries)
            if not n:
                continue
            out.append((key[0], int(row_id), what, tries, ",".join(str(x[0]) for x in queue[:n])))
            queue, tries = (queue[n:], 0) if what == "done" else (queue, tries + 1)
        self.queue.put(queue) if queue else self.queue.clear()
        self.tries.update((tries,)) if queue else self.tries.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if queue:
            self.handle.registerTimer((_micros(each["at"].max()) + self.keep) // 1000 + 1)
        yield pd.DataFrame(out, columns=["key", "run_id", "outcome", "tries", "members"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """What waited for longer than it may is given out as ``expired``, so that no append is lost."""
        queue = [tuple(x) for x in self.queue.get()] if self.queue.exists() else []
        tries = self.tries.get()[0] if self.tries.exists() else 0
        self.queue.clear()
        self.tries.clear()
        out = [(key[0], -1, "expired", tries, ",".join(str(x[0]) for x in queue))] if queue else []
        yield pd.DataFrame(out, columns=["key", "run_id", "outcome", "tries", "members"])

    def close(self) -> None:
        pass


def folds(rows: DataFrame, late: str, keep_seconds: int, peers: int = 16, budget: int = 8000) -> DataFrame:
    """What each run takes from a document's queue: ``key``, ``run_id``, ``outcome``, ``tries`` and the ids of its ``members``.

    ``rows``: key, id, at, ``what`` (``append``, ``done`` or ``failed``), tokens, shape.
    A run takes the first in the queue and, if it has a shape, what directly follows
    with the same shape: at most ``peers`` more, within ``budget`` tokens.  ``done``
    takes the run off the queue; after ``failed`` it is tried again at half the width,
    in the end alone.  A run of an empty queue gives nothing.  A queue without a row for
    ``keep_seconds`` is given out as ``expired``.
    """
    use_rocksdb(rows.sparkSession)
    each = rows.where("key IS NOT NULL AND at IS NOT NULL AND what IN ('append', 'done', 'failed')")
    each = each.select("key", "id", "at", "what", "tokens", "shape").withWatermark("at", late)
    shape = "key string, run_id long, outcome string, tries int, members string"
    return each.groupBy("key").transformWithStateInPandas(_Folds(peers, budget, keep_seconds * 1_000_000), outputStructType=shape, outputMode="append", timeMode="eventTime")


def settled_stream(stream: DataFrame, path: str) -> DataFrame:
    """All rows there are, written below ``path`` in micro-batches, and read back."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
