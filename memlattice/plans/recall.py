"""Hybrid recall for a batch of queries, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.config import DEFAULT, Config
from memlattice.functions import time_words, times
from memlattice.functions.scoring import combined
from memlattice.functions.texts import token_estimate
from memlattice.operators import retrieval
from memlattice.operators.budget import pack
from memlattice.storage import settled

#: Arms in the order in which ties are settled.
ARMS = ("semantic", "keyword", "graph", "temporal")


def hybrid(queries: DataFrame, units: DataFrame, links: DataFrame | None = None, postings: DataFrame | None = None, budget: int = 2000, depth: int = 100, boosts: dict[str, str] | None = None, config: Config = DEFAULT) -> DataFrame:
    """Up to four arms, fused, capped, scored and packed into a token budget.

    ``queries``: query_id, text, vector, and if they ask for a time: low, high, now.
    ``units``: unit_id, kind, embedding, text, proof_count, and ``at`` if they have one.
    The graph arm needs ``links`` (from_unit, to_unit, weight, link_type) and
    ``postings`` (unit_id, entity_id); the temporal arm needs low, high and at, and
    spreads along links if there are any.  Result: query_id, unit_id, score, rank, and
    ``packed``, whether the unit is within the budget in rank order (the first is).
    Queries that have ``now`` but no window get the one their text names, if it names one.
    """
    if {"now", "text"} <= set(queries.columns) and not {"low", "high"} & set(queries.columns):
        queries = settled(time_words.windows(queries))  # read by every arm
    timed = {"low", "high"} <= set(queries.columns) and "at" in units.columns
    similar = settled(retrieval.semantic(queries, units, depth, config.semantic_floor, keys=(), digits=6))
    arms = {"semantic": similar}
    frequencies = retrieval.document_frequencies(units, wanted=retrieval.query_terms(queries))
    arms["keyword"] = retrieval.keyword(retrieval.selective_terms(queries, frequencies, config.keyword_terms), units, depth, config=config, counted=True)
    if links is not None and postings is not None:
        seeds = similar.where((F.col("score") >= config.seed_floor) & (F.col("rank") <= config.seeds)).select("query_id", "unit_id")
        of = lambda kind: links.where(F.col("link_type") == kind).select("from_unit", "to_unit", "weight")
        arms["graph"] = retrieval.graph_arm(seeds, postings, of("semantic"), of("caused_by"), depth, fanout=config.entity_fanout)
    if timed:
        arms["temporal"] = temporal(queries, units, links, depth, config)
    hits = None
    for number, (arm, found) in enumerate(arms.items()):
        one = found.select("query_id", "unit_id", F.lit(arm).alias("arm"), F.lit(number).alias("arm_no"), "rank")
        hits = one if hits is None else hits.unionByName(one)
    fused = retrieval.rescale(retrieval.boosted(hits, boosts or {}, config.rrf_k, config.rerank_candidates))
    kept = ["unit_id", "proof_count", *(["at"] if "at" in units.columns else []), token_estimate(F.col("text")).alias("size")]
    scored = fused.join(units.select(*kept), "unit_id")
    none = F.lit(None).cast("double")
    days = near = none
    asked = [c for c in ("low", "high", "now") if c in queries.columns]
    if asked and "at" in units.columns:
        scored = scored.join(queries.select("query_id", *asked), "query_id")
        days = F.datediff("now", "at") if "now" in asked else none
        near = times.proximity(F.col("at"), F.col("low"), F.col("high")) if timed else none
    scored = scored.withColumn("score", F.round(combined(F.col("ce"), days, near, F.col("proof_count"), config), 6))
    final = retrieval.ranked(scored, ["query_id"], F.desc("score"), F.asc("unit_id"))
    taken = pack(final, ["query_id"], "rank", F.col("size"), budget)
    taken = taken.select("query_id", F.explode(F.split("ranks", ",").cast("array<int>")).alias("rank"), F.lit(True).alias("packed"))
    return final.select("query_id", "unit_id", "score", "rank").join(taken, ["query_id", "rank"], "left").select("query_id", "unit_id", "score", "rank", F.coalesce("packed", F.lit(False)).alias("packed"))


def temporal(queries: DataFrame, units: DataFrame, links: DataFrame | None, depth: int, config: Config = DEFAULT) -> DataFrame:
    """Units of a query's time window: of the most similar a pick spread over the window, then what links lead to from there.

    Entry points score by their nearness to the middle of the window.
    """
    window = queries.where("low IS NOT NULL AND high IS NOT NULL").select("query_id", "vector", "low", "high")
    # Vectors meet in blocks, and only the best of a query, a kind and a block leave them.
    near = retrieval.nearest(window, units, config.temporal_pool, config.temporal_floor, keys=("kind",), digits=6, timed=True).withColumnRenamed("score", "similarity")
    pool = retrieval.ranked(near, ["query_id", "kind"], F.desc("similarity"), F.asc("unit_id"), most=config.temporal_pool, name="k")
    pool = pool.join(units.select("unit_id", "at"), "unit_id").join(window.select("query_id", "low", "high"), "query_id")
    share = (times.micros(F.col("at")) - times.micros(F.col("low"))) / F.greatest(times.micros(F.col("high")) - times.micros(F.col("low")), F.lit(1))
    bucket = F.least(F.floor(share * config.temporal_buckets), F.lit(config.temporal_buckets - 1))
    picks = retrieval.coverage(pool, ["query_id", "kind"], bucket, config.temporal_picks)
    entries = picks.select("query_id", "unit_id", F.round(times.proximity(F.col("at"), F.col("low"), F.col("high")), 6).alias("score"))
    if links is not None:
        entries = retrieval.spread(entries, links, config).select("query_id", "unit_id", F.round("score", 6).alias("score"))
    return retrieval.ranked(entries, ["query_id"], F.desc("score"), F.asc("unit_id"), most=depth)
