"""Approximate nearest vectors through an inverted file of centroids.

Centroids are fitted on a bounded sample (``SAMPLE`` rows by hash of the id); every row
is then put into the lists of its nearest centroids.  A search looks at the lists whose
centroids are nearest to a query.  Recall is measured against ``retrieval.nearest``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.operators.retrieval import nearest, ranked, usable

#: Rows the centroids are fitted on, at most, and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 8


def unit(v: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(length > 0, length, 1)


def centroids(units: DataFrame, lists: int, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means on at most ``sample`` rows, the first by hash of the id; the same rows give the same centroids, no rows none."""
    rows = units.where(usable("embedding")).select("unit_id", "embedding").orderBy(F.xxhash64("unit_id"), "unit_id").limit(sample).toPandas()
    if not len(rows):
        return np.zeros((0, 0))
    width = rows["embedding"].map(len).mode()[0]  # vectors of another length cannot be held against these
    v = unit(np.stack(rows.loc[rows["embedding"].map(len) == width, "embedding"].to_numpy()).astype(float))
    held = v[np.linspace(0, len(v) - 1, min(lists, len(v))).astype(int)]
    for _ in range(rounds):
        near = (v @ held.T).argmax(axis=1)
        sums = np.zeros_like(held)
        np.add.at(sums, near, v)
        empty = ~np.bincount(near, minlength=len(held)).astype(bool)
        sums[empty] = held[empty]
        held = unit(sums)
    return held


def placed(rows: DataFrame, vector: str, held: np.ndarray, most: int) -> DataFrame:
    """``rows`` with ``list``, once for each of the ``most`` nearest centroids; the centroids go to the tasks.

    Rows whose vector is null, holds what is no number or is of another length than the centroids are in no list.
    """
    from pyspark.sql import types as T

    sent = rows.sparkSession.sparkContext.broadcast(held)  # lists x width numbers, both parameters of the index

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                near = np.argsort(-(unit(np.stack(frame[vector].to_numpy()).astype(float)) @ sent.value.T), axis=1, kind="stable")[:, :most]
                yield frame.loc[frame.index.repeat(near.shape[1])].assign(list=near.reshape(-1))

    rows = rows.where(usable(vector) & (F.size(vector) == held.shape[1]) & F.lit(len(held) > 0))
    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType())]))


def index(units: DataFrame, held: np.ndarray, copies: int = 1) -> DataFrame:
    """Every row of ``unit_id``, ``embedding`` in the ``copies`` lists it is nearest to."""
    return placed(units.select("unit_id", "embedding"), "embedding", held, copies)


def search(queries: DataFrame, indexed: DataFrame, held: np.ndarray, most: int, probes: int, floor: float = -1.0, digits: int | None = None) -> DataFrame:
    """The ``most`` nearest units found in the ``probes`` lists nearest to each query: ``query_id``, ``unit_id``, ``score``, ``rank``.

    A list of many units or queries is dealt into blocks, so none is one task's work.
    """
    asked = placed(queries.select("query_id", "vector"), "vector", held, probes)
    found = nearest(asked, indexed, most, floor, digits=digits, partition=("list",)).distinct()
    return ranked(found, ["query_id"], F.desc("score"), F.asc("unit_id"), most=most)
