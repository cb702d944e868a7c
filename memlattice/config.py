"""Work sizes and weights of the engine, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    rrf_k: int = 60
    semantic_floor: float = 0.3
    temporal_floor: float = 0.1
    seed_floor: float = 0.3
    seeds: int = 20
    keyword_terms: int = 16
    entity_fanout: int = 200
    rerank_candidates: int = 300
    recency_alpha: float = 0.2
    temporal_alpha: float = 0.2
    proof_alpha: float = 0.1
    linear_window_days: float = 365.0
    temporal_pool: int = 60
    temporal_picks: int = 10
    temporal_buckets: int = 8
    spread_rounds: int = 5
    spread_batch: int = 20
    spread_neighbours: int = 10
    temporal_links: int = 20
    semantic_links: int = 50
    semantic_link_floor: float = 0.7
    trigram_floor: float = 0.15
    name_pair_floor: float = 0.5
    entity_threshold: float = 0.6
    bm25_k1: float = 1.2
    bm25_b: float = 0.75


DEFAULT = Config()
