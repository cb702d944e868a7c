"""Columns that score and rank retrieved facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlattice.config import DEFAULT, Config
from memlattice.functions.times import recency

RRF_BOOST = {"low": 1.0, "medium": 3.0, "high": 6.0}
ADDITIVE_BOOST = {"low": 0.05, "medium": 0.2, "high": 0.5}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def reciprocal_rank(rank: Column, k: int = DEFAULT.rrf_k) -> Column:
    return 1.0 / (F.lit(float(k)) + rank)


def proof_factor(count: Column, alpha: float = DEFAULT.proof_alpha) -> Column:
    """1 plus alpha times how far the log of the count lies from neutral, both sides bounded."""
    norm_ = F.when(count.isNull() | (count < 1), 0.5).otherwise(F.least(F.greatest(0.5 + F.log(count.cast("double")) / 10, F.lit(0.0)), F.lit(1.0)))
    return 1.0 + alpha * (norm_ - 0.5)


def combined(ce: Column, days: Column, nearness: Column, proofs: Column, config: Config = DEFAULT) -> Column:
    """Reranker score times the recency, temporal and proof boosts; an unknown one is neutral."""
    fresh = F.coalesce(recency(days, window=config.linear_window_days), F.lit(0.5))
    near = F.coalesce(nearness, F.lit(0.5))
    return ce * (1.0 + config.recency_alpha * (F.when(days.isNull(), 0.5).otherwise(fresh) - 0.5)) * (1.0 + config.temporal_alpha * (near - 0.5)) * proof_factor(proofs, config.proof_alpha)


def graph_score(shared_entities: Column, semantic: Column, causal: Column) -> Column:
    return F.tanh(0.5 * F.coalesce(shared_entities, F.lit(0))) + F.coalesce(semantic, F.lit(0.0)) + F.coalesce(causal, F.lit(0.0))


def link_weight(hours: Column) -> Column:
    return F.greatest(F.lit(0.3), 1.0 - hours / 24.0)


def passthrough(rank: Column, n: Column) -> Column:
    """1.0 down to 0.1 by rank; 1.0 for a single row."""
    return F.when(n <= 1, 1.0).otherwise(1.0 - 0.9 * (rank - 1) / (n - 1))
