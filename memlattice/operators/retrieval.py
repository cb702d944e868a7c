"""Retrieval arms, their fusion and their ranking, for many queries at once.

An arm is a DataFrame ``(query_id, unit_id, arm, rank, score)``; every ranking ends
in the unit's id, so that equal scores have one order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.config import DEFAULT, Config
from memlattice.functions import times
from memlattice.functions.scoring import ADDITIVE_BOOST, RRF_BOOST, graph_score, passthrough, reciprocal_rank
from memlattice.functions.texts import tokens
from memlattice.operators import term_scores
from memlattice.storage import settled

#: Rows of queries and of units that meet in one task.
QUERY_BLOCK, UNIT_BLOCK = 1000, 20_000
#: The terms of most units, which go to the tasks; only the rows of others are shuffled.
COMMON = 50_000


def ranked(df: DataFrame, keys: Sequence[str], *order: Column, most: int | None = None, name: str = "rank") -> DataFrame:
    """Rows numbered from 1 within their keys, and no more than ``most`` of them."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out.where(F.col(name) <= most) if most else out


def semantic(queries: DataFrame, units: DataFrame, most: int, floor: float = DEFAULT.semantic_floor, keys: Sequence[str] = ("kind",), digits: int | None = None) -> DataFrame:
    """Units by cosine similarity to each query (``query_id``, ``vector``), the best of each kind; zero vectors score 0.

    An exact scan in blocks: each block of queries meets each block of units in a
    matrix product, and only the best ``most`` of a query and kind leave it, so what is
    shuffled is bounded by the blocks and not by queries times units.
    """
    return ranked(nearest(queries, units, most, floor, keys, digits), ["query_id", *keys], F.desc("score"), F.asc("unit_id"), most=most).withColumn("arm", F.lit("semantic"))


def nearest(queries: DataFrame, units: DataFrame, most: int | None, floor: float, keys: Sequence[str] = (), digits: int | None = None, partition: Sequence[str] = (), timed: bool = False) -> DataFrame:
    """``query_id``, ``unit_id``, ``score`` (and ``keys``) of what is at least ``floor``, from each pair of blocks at most ``most`` a query and key.

    Both sides are dealt by hash into blocks of QUERY_BLOCK and UNIT_BLOCK rows; with
    ``partition`` only rows equal in these columns meet.  Null vectors and vectors with a
    component that is null or not a number take no part; only vectors of one length
    meet.  Without queries or units there are no rows.
    """
    from pyspark.sql import types as T

    by = list(partition)
    count = lambda df, rows: df.groupBy(*by).agg(F.greatest(F.ceil(F.count("*") / rows), F.lit(1)).cast("int").alias("blocks"))
    ends, moment = (["_low", "_high"], ["_at"]) if timed else ([], [])
    if timed:
        queries = queries.withColumns({"_low": times.micros(F.col("low")), "_high": times.micros(F.col("high"))}).where("_low <= _high")
        units = units.withColumn("_at", times.micros(F.col("at"))).where("_at IS NOT NULL")
    q = queries.select(*by, "query_id", *ends, F.col("vector").cast("array<double>").alias("v")).where(usable("v"))
    u = units.select(*by, *(k for k in keys if k not in by), "unit_id", *moment, F.col("embedding").cast("array<double>").alias("v")).where(usable("v"))
    nq, nu = count(q, QUERY_BLOCK).withColumnRenamed("blocks", "nq"), count(u, UNIT_BLOCK).withColumnRenamed("blocks", "nu")
    sizes = nq.join(nu, by) if by else nq.crossJoin(nu)  # a row for each value of partition
    meet = lambda df: df.join(sizes, by) if by else df.crossJoin(F.broadcast(sizes))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    home = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    again = [F.col(c).alias(c) for c in by]  # columns of their own where both sides come from one table
    q = meet(q).select(*again, home("query_id", "nq").alias("x"), every("nu").alias("y"), "query_id", *ends, "v")
    u = meet(u).select(*by, every("nq").alias("x"), home("unit_id", "nu").alias("y"), *(k for k in keys if k not in by), "unit_id", *moment, "v")
    kinds = {f.name: f.dataType for f in (*queries.schema, *units.schema)}
    names = ["query_id", *keys, "unit_id", "score"]
    schema = T.StructType([T.StructField(n, kinds.get(n, T.DoubleType())) for n in names[:-1]] + [T.StructField("score", T.DoubleType())])

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        sizes = [set(f["v"].map(len)) for f in (left, right)]
        found = [_best(*(f[f["v"].map(len) == n] for f in (left, right)), list(keys), most, floor, digits) for n in sorted(sizes[0] & sizes[1])]
        if found:
            return pd.concat(found)[names]
        none = {"query_id": left["query_id"].iloc[:0], **{k: right[k].iloc[:0] for k in (*keys, "unit_id")}}
        return pd.DataFrame({n: v.reset_index(drop=True) for n, v in none.items()} | {"score": np.zeros(0)})[names]

    return q.groupBy(*by, "x", "y").cogroup(u.groupBy(*by, "x", "y")).applyInPandas(best, schema)


def usable(vector: str) -> Column:
    """Whether a vector is there, and all its components are numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))


def _best(left: pd.DataFrame, right: pd.DataFrame, keys: list[str], most: int | None, floor: float, digits: int | None) -> pd.DataFrame:
    """Of each row of ``left`` and key of ``right`` the best by cosine; all vectors have one length."""
    a, b = (np.stack(f["v"].to_numpy()) for f in (left, right))
    a, b = (v / np.where(n > 0, n, 1)[:, None] for v, n in ((v, np.linalg.norm(v, axis=1)) for v in (a, b)))
    order = right["unit_id"].argsort(kind="stable").to_numpy()
    right, b = right.iloc[order], b[order]
    groups = right.groupby(keys, dropna=False).indices.values() if keys else [np.arange(len(right))]
    found = []
    for start in range(0, len(a), 256):
        score = a[start : start + 256] @ b.T
        score = np.round(score, digits) if digits else score
        if "_at" in right:
            at, low, high = right["_at"].to_numpy(), *(left[c].to_numpy()[start : start + 256, None] for c in ("_low", "_high"))
            score = np.where((at >= low) & (at <= high), score, -np.inf)
        for rows in groups:
            for k, line in enumerate(score[:, rows]):
                good = np.flatnonzero(line >= floor)
                if most is not None and len(good) > most:
                    good = good[np.argsort(-line[good], kind="stable")[:most]]
                found.append((np.full(len(good), start + k), rows[good], line[good]))
    at, to, score = (np.concatenate(x) for x in zip(*found, strict=True))
    columns = {"query_id": left["query_id"].to_numpy()[at], **{k: right[k].to_numpy()[to] for k in keys}, "unit_id": right["unit_id"].to_numpy()[to], "score": score + 0.0}
    return pd.DataFrame(columns)


def document_frequencies(units: DataFrame, text: str = "text", wanted: DataFrame | None = None) -> DataFrame:
    """Units that hold each term; with ``wanted`` (column ``term``) only those terms."""
    each = units.select("unit_id", F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    counted = each.groupBy("term").agg(F.count("*").alias("df"))  # a task gives out each of its terms once
    return counted if wanted is None else counted.join(wanted.select("term").distinct(), "term", "left_semi")


def query_terms(queries: DataFrame) -> DataFrame:
    """The distinct terms of all queries."""
    return queries.select(F.explode(tokens(F.col("text"))).alias("term")).distinct()


def selective_terms(queries: DataFrame, frequencies: DataFrame, most: int = DEFAULT.keyword_terms, stop: Sequence[str] = ()) -> DataFrame:
    """Each query's rarest terms, in their own order; without any but stop words, its first ones."""
    each = queries.select("query_id", F.posexplode(tokens(F.col("text"))).alias("pos", "term"))
    each = each.groupBy("query_id", "term").agg(F.min("pos").alias("pos"))
    each = each.withColumn("stop", F.col("term").isin(*stop) if stop else F.lit(False))
    each = each.join(frequencies, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    query = Window.partitionBy("query_id")
    each = each.withColumn("only_stops", F.min(F.col("stop").cast("int")).over(query) == 1).where(~F.col("stop") | F.col("only_stops"))
    order = F.when(F.col("only_stops"), F.lit(0)).otherwise(F.col("df"))
    return ranked(each, ["query_id"], order.asc(), F.asc("pos"), most=most, name="choice").select("query_id", "term", "pos", "df")


def keyword(terms: DataFrame, units: DataFrame, most: int, keys: Sequence[str] = (), text: str = "text", config: Config = DEFAULT, digits: int = 6, counted: bool = False) -> DataFrame:
    """Units that hold any of the queries' terms, by BM25.

    Only tokens that some query asks for are counted; lengths and the number of
    units are taken over all units.  Units are scored where their texts are read, and
    only the best of each task are shuffled.  With ``counted`` the terms bring ``df``, in
    how many of these units they are.
    """
    words = units.select("unit_id", *keys, tokens(F.col(text)).alias("w")).withColumn("len", F.size("w"))
    n_units, average = words.agg(F.count("*"), F.avg("len")).first()
    names = ["query_id", *keys, "unit_id", "score"]
    schema = term_scores.schema(terms, units, names)

    def found(block: pd.DataFrame) -> DataFrame:
        asked = term_scores.Asked(block.assign(weight=1.0))
        known = F.broadcast(units.sparkSession.createDataFrame([(t, k) for k, t in enumerate(asked.terms)], "term string, number int"))  # a bounded number of terms
        df = np.zeros(len(asked.terms))
        if counted:
            df[asked.terms.get_indexer(block["term"])] = block["df"]
        else:
            for number, n in words.select(F.explode(F.array_distinct("w")).alias("term")).join(known, "term").groupBy("number").count().collect():
                df[number] = n
        idf = np.log(1 + (n_units - df + 0.5) / (df + 0.5))
        hits = words.select("unit_id", *keys, "len", F.explode("w").alias("term")).join(known, "term").select("unit_id", *keys, "len", "number")

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = term_scores.Best(asked, most, keys, ["unit_id"], digits)
            for chunk, unit, number in term_scores.by_unit(frames):
                pair, tf = np.unique(unit * len(idf) + number, return_counts=True)
                unit, number = pair // len(idf), pair % len(idf)
                length = chunk["len"].to_numpy()[unit]
                value = idf[number] * tf * (config.bm25_k1 + 1) / (tf + config.bm25_k1 * (1 - config.bm25_b + config.bm25_b * length / average))
                best.add(chunk, (unit, number, value))
            yield from best.frame(names)

        return hits.mapInPandas(run, schema)

    scored = term_scores.by_block(terms.select("query_id", "term", *(["df"] if counted else [])).distinct(), found)
    scored = units.sparkSession.createDataFrame([], schema) if scored is None else scored
    return ranked(scored, ["query_id", *keys], F.desc("score"), F.asc("unit_id"), most=most).withColumn("arm", F.lit("keyword"))


def squares(each: DataFrame, idf: DataFrame) -> DataFrame:
    """``unit_id``, ``square``: the sum of the squared ``idf`` of the terms of each unit.

    ``each``: unit_id, term, those of a unit together.  ``idf``: term, df, idf, and is
    read more than once.  The COMMON terms are looked up where units are read and summed
    there; only rows of rarer terms are shuffled for a join.
    """
    square = F.sum(F.col("idf") * F.col("idf")).alias("square")
    common = settled(idf.orderBy(F.desc("df"), F.asc("term")).limit(COMMON).select("term", "idf"))
    out = each.join(F.broadcast(common), "term").groupBy("unit_id").agg(square)
    if idf.count() > COMMON:
        others = idf.join(F.broadcast(common.select("term")), "term", "left_anti").select("term", "idf")
        rare = each.join(F.broadcast(common.select("term")), "term", "left_anti").join(others, "term").groupBy("unit_id").agg(square)
        out = out.unionByName(rare).groupBy("unit_id").agg(F.sum("square").alias("square"))
    return out


def idf_cosine(terms: DataFrame, units: DataFrame, frequencies: DataFrame, most: int, text: str = "text", digits: int = 4) -> DataFrame:
    """The ``most`` units of each query by the squared idf of the terms both hold over the length of the unit's vector: ``query_id``, ``unit_id``, ``score``.

    ``terms``: query_id, term.  ``frequencies``: the term and df of every term of these
    units; it is read more than once.  Of the units only the asked terms are shuffled,
    and of the pairs only the best of each task.
    """
    spark = units.sparkSession
    each = units.select("unit_id", F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    idf = frequencies.withColumn("idf", F.log(1 + F.lit(units.count()) / F.col("df")))
    norms = settled(squares(each, idf))
    names = ["query_id", "unit_id", "score"]
    schema = term_scores.schema(terms, units, names)

    def found(block: pd.DataFrame) -> DataFrame:
        asked = term_scores.Asked(block.assign(weight=1.0))
        known = F.broadcast(spark.createDataFrame([(t, k) for k, t in enumerate(asked.terms)], "term string, number int"))  # a bounded number of terms
        weight = np.zeros(len(asked.terms))
        for number, value in idf.join(known, "term").select("number", "idf").collect():
            weight[number] = value * value
        hits = each.join(known, "term").groupBy("unit_id").agg(F.collect_list("number").alias("numbers")).join(norms, "unit_id")

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = term_scores.Best(asked, most, (), ["unit_id"], digits)
            for chunk in term_scores.chunks(frames):
                sizes = chunk["numbers"].map(len).to_numpy()
                number = np.concatenate(chunk["numbers"].to_numpy()).astype("int64")
                best.add(chunk[["unit_id"]], (np.repeat(np.arange(len(chunk)), sizes), number, weight[number] / np.repeat(np.sqrt(chunk["square"].to_numpy()), sizes)))
            yield from best.frame(names)

        return hits.mapInPandas(run, schema)

    scored = term_scores.by_block(terms.select("query_id", "term").distinct(), found)
    scored = spark.createDataFrame([], schema) if scored is None else scored
    return ranked(scored, ["query_id"], F.desc("score"), F.asc("unit_id"), most=most).select(*names)


def entity_expansion(seeds: DataFrame, postings: DataFrame, fanout: int = DEFAULT.entity_fanout) -> DataFrame:
    """Units that share entities with a query's seeds, by the number of distinct entities shared.

    Of each entity the ``fanout`` last units count, which bounds the join.
    """
    entities = seeds.join(postings, "unit_id").select("query_id", "entity_id").distinct()
    capped = ranked(postings, ["entity_id"], F.desc("unit_id"), most=fanout, name="r").drop("r")
    found = entities.join(capped, "entity_id").groupBy("query_id", "unit_id").agg(F.countDistinct("entity_id").alias("shared"))
    return found.join(seeds.select("query_id", "unit_id"), ["query_id", "unit_id"], "left_anti")


def link_expansion(seeds: DataFrame, links: DataFrame, both: bool = True, keep_seeds: bool = False) -> DataFrame:
    """Units linked to a query's seeds with their strongest link; outgoing links only unless ``both``."""
    ways = links.select(F.col("from_unit").alias("seed"), F.col("to_unit").alias("unit_id"), "weight")
    if both:
        ways = ways.union(links.select("to_unit", "from_unit", "weight"))
    found = seeds.select("query_id", F.col("unit_id").alias("seed")).join(ways, "seed").groupBy("query_id", "unit_id").agg(F.max("weight").alias("weight"))
    return found if keep_seeds else found.join(seeds.select("query_id", "unit_id"), ["query_id", "unit_id"], "left_anti")


def graph_merge(entities: DataFrame, semantic_links: DataFrame, causal_links: DataFrame, most: int, digits: int = 6) -> DataFrame:
    """One score a unit from what the three expansions found."""
    none = F.lit(None).cast("double")
    parts = (
        entities.select("query_id", "unit_id", F.col("shared").cast("double").alias("e"), none.alias("s"), none.alias("c"))
        .union(semantic_links.select("query_id", "unit_id", none, "weight", none))
        .union(causal_links.select("query_id", "unit_id", none, none, "weight"))
    )
    merged = parts.groupBy("query_id", "unit_id").agg(F.max("e").alias("e"), F.max("s").alias("s"), F.max("c").alias("c"))
    merged = merged.select("query_id", "unit_id", F.round(graph_score(F.col("e"), F.col("s"), F.col("c")), digits).alias("score"))
    return ranked(merged, ["query_id"], F.desc("score"), F.asc("unit_id"), most=most).withColumn("arm", F.lit("graph"))


def graph_arm(seeds: DataFrame, postings: DataFrame, semantic_links: DataFrame, causal_links: DataFrame, most: int, expand_entities: bool = True, fanout: int = DEFAULT.entity_fanout) -> DataFrame:
    """The graph arm from its seeds; without ``expand_entities``, its costly part, links alone decide."""
    shared = entity_expansion(seeds, postings, fanout) if expand_entities else seeds.select("query_id", "unit_id", F.lit(0).alias("shared")).where("false")
    return graph_merge(shared, link_expansion(seeds, semantic_links), link_expansion(seeds, causal_links, both=False, keep_seeds=True), most)


def coverage(pool: DataFrame, keys: Sequence[str], bucket: Column, limit: int, similarity: str = "similarity") -> DataFrame:
    """Picks spread over buckets: the best of each, then the second of each, until ``limit``.

    A pool of no more than ``limit`` rows is returned in its own order.
    """
    placed = pool.withColumn("bucket", bucket)
    best = Window.partitionBy(*keys, "bucket").orderBy(F.desc(similarity), F.asc("unit_id"))
    placed = placed.withColumn("tier", F.row_number().over(best)).withColumn("pool_n", F.count("*").over(Window.partitionBy(*keys)))
    tier = F.when(F.col("pool_n") <= limit, 0).otherwise(F.col("tier"))
    return ranked(placed, keys, tier.asc(), F.desc(similarity), F.asc("unit_id"), most=limit).drop("pool_n")


def rrf(hits: DataFrame, k: int = DEFAULT.rrf_k, digits: int = 6) -> DataFrame:
    """Units by the sum of reciprocal ranks; ties by first arm, rank in it, then id.

    ``hits`` has ``arm_no`` for the order of arms.
    """
    place = F.struct("arm_no", "rank")
    fused = hits.groupBy("query_id", "unit_id").agg(F.round(F.sum(reciprocal_rank(F.col("rank"), k)), digits).alias("score"), F.min(place).alias("place"))
    return ranked(fused, ["query_id"], F.desc("score"), F.asc("place"), F.asc("unit_id")).drop("place")


def interleave(hits: DataFrame) -> DataFrame:
    """Units in round-robin order of the arms' ranks, each where it first comes; the score is how many follow, and one."""
    first = hits.groupBy("query_id", "unit_id").agg(F.min(F.struct("rank", "arm_no")).alias("place"))
    out = ranked(first, ["query_id"], F.asc("place"), F.asc("unit_id")).drop("place")
    return out.withColumn("score", F.count("*").over(Window.partitionBy("query_id")) - F.col("rank") + 1)


def cap_per_source(hits: DataFrame, cap: int) -> DataFrame:
    return hits.where(F.col("rank") <= cap) if cap else hits


def boosted(hits: DataFrame, boosts: dict[str, str], k: int = DEFAULT.rrf_k, most: int | None = None, digits: int = 6) -> DataFrame:
    """Reciprocal ranks weighted by arm; ``boosts`` gives some arms a level low, medium or high."""
    level, extra = F.lit(1.0), F.lit(0.0)
    for arm, name in boosts.items():
        level = F.when(F.col("arm") == arm, RRF_BOOST[name]).otherwise(level)
        extra = F.when(F.col("arm") == arm, ADDITIVE_BOOST[name]).otherwise(extra)
    fused = hits.groupBy("query_id", "unit_id").agg(F.round(F.sum(level * reciprocal_rank(F.col("rank"), k)), digits).alias("score"), F.round(F.sum(extra / F.col("rank")), digits).alias("additive"))
    return ranked(fused, ["query_id"], F.desc("score"), F.asc("unit_id"), most=most)


def rescale(fused: DataFrame) -> DataFrame:
    """Scores by rank alone, for a reranker that passes its input through."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    return fused.withColumn("ce", passthrough(F.col("rank"), n))


def normalized_reranker(scored: DataFrame, raw: str = "raw") -> DataFrame:
    """Reranker outputs of a query as they are if all lie in [0, 1], else through the logistic function; NaN is 0."""
    value = F.nanvl(F.col(raw), F.lit(0.0))
    query = Window.partitionBy("query_id")
    plain = (F.min(value).over(query) >= 0) & (F.max(value).over(query) <= 1)
    return scored.withColumn("ce", F.when(plain, value).otherwise(1 / (1 + F.exp(-value))))


def margin_head(df: DataFrame, keys: Sequence[str], score: str, least: float, margin: float = 0.035, most: int = 12) -> DataFrame:
    """What lies within a margin of the best score, at least ``least``, and no more than ``most`` rows."""
    top = F.max(score).over(Window.partitionBy(*keys))
    near = df.withColumn("_top", top).where(F.col(score) >= F.greatest(F.lit(least), F.col("_top") - margin)).drop("_top")
    return ranked(near, keys, F.desc(score), F.asc("unit_id"), most=most)


def reserved_slots(df: DataFrame, keys: Sequence[str], recent: str, popular: str, limit: int, share: int = 5) -> DataFrame:
    """One slot in ``share`` for the most recent, the rest by popularity, without repeats."""
    by_time = Window.partitionBy(*keys).orderBy(F.desc(recent), F.asc("unit_id"))
    marked = df.withColumn("is_recent", F.row_number().over(by_time) <= max(1, limit // share))
    return ranked(marked, keys, F.desc("is_recent"), F.desc(popular), F.asc("unit_id"), most=limit)


def spread(entries: DataFrame, links: DataFrame, config: Config = DEFAULT, decay: float = 0.7, stop: float = 0.2) -> DataFrame:
    """Scores carried along links from entry points, in rounds, each unit reached once.

    A unit takes the score of the first parent that reaches it: the earliest round,
    then the parent's place in it, the heaviest link and the smallest id.  Each round
    expands at most ``spread_batch`` units of a query, so rounds stay small.
    """
    place = lambda df: ranked(df, ["query_id"], F.desc("score"), F.asc("unit_id"), name="place")
    front = settled(place(entries.select("query_id", "unit_id", "score")))
    reached = front.select("query_id", "unit_id", "score", F.lit(0).alias("round"))
    links = links.where("weight >= 0.1").select("from_unit", "to_unit", "weight")
    for turn in range(1, config.spread_rounds + 1):
        batch = front.where((F.col("place") <= config.spread_batch) & (F.col("score") > stop))
        # Only links of the units in hand are ranked; each round is computed once and read from the shared folder.
        near = links.join(batch.select(F.col("unit_id").alias("from_unit")).distinct(), "from_unit", "left_semi")
        strongest = ranked(near, ["from_unit"], F.desc("weight"), F.asc("to_unit"), most=config.spread_neighbours, name="r")
        steps = batch.join(strongest, batch.unit_id == strongest.from_unit).select("query_id", F.col("to_unit").alias("unit_id"), (F.col("score") * F.col("weight") * decay).alias("score"), "place", "weight", "from_unit")
        first = ranked(steps, ["query_id", "unit_id"], F.asc("place"), F.desc("weight"), F.asc("from_unit"), most=1, name="k")
        front = settled(place(first.join(reached, ["query_id", "unit_id"], "left_anti").select("query_id", "unit_id", "score")))
        reached = settled(reached.unionByName(front.select("query_id", "unit_id", "score", F.lit(turn).alias("round"))))
    return reached


def prefer_observations(found: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """The ``most`` best of a ranking (``query_id``, ``unit_id``, ``rank``) in which observations stand for what they were made from.

    ``sources``: obs_id, unit_id.  A unit is left out if an observation among the query's
    results has it as a source, and the next results take its place.  Only observations
    that are returned themselves count: those among the ``most``, and those that move up
    because of them.  Result: query_id, unit_id, ``rank`` from 1, and ``backfilled``,
    whether the unit came from beyond ``most``.

    An observation drops a unit when it ends up returned, that is when fewer than
    ``most`` of the units before it stay; as this depends only on ranks before it, the
    ranking is read once in order, query by query, and a query's ranking is as long as
    its arms are deep.
    """
    units = sources.groupBy(F.col("obs_id").alias("unit_id")).agg(F.collect_set("unit_id").alias("_sources"))
    each = found.join(units, "unit_id", "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "unit_id", "_sources"))).alias("_all"))
    none = F.array().cast(found.select(F.array("unit_id")).schema[0].dataType)
    # Of the first places, as many as are needed for ``most`` that stay: longer prefixes only drop more.
    held = F.aggregate(
        F.sequence(F.lit(0), F.size("_all")), F.struct(F.least(F.lit(most), F.size("_all")).alias("upto"), none.alias("gone"), F.lit(False).alias("done")),
        lambda s, _: F.when(s["done"], s).otherwise(_widened(s, most, none)),  # mostly done in two or three steps
    )
    each = each.withColumn("_held", held)
    stays = F.filter(F.slice("_all", 1, F.greatest(F.col("_held.upto"), F.lit(1))), lambda r: ~F.array_contains(F.col("_held.gone"), r["unit_id"]))
    out = each.select("query_id", F.posexplode(F.slice(stays, 1, most)))
    return out.select("query_id", F.col("col.unit_id").alias("unit_id"), (F.col("pos") + 1).alias("rank"), (F.col("col.rank") > most).alias("backfilled"))


def _widened(state: Column, most: int, none: Column) -> Column:
    """A prefix of the ranking grown by as many places as its observations drop from it."""
    head = F.slice("_all", 1, state["upto"])
    gone = F.array_distinct(F.flatten(F.transform(head, lambda r: F.coalesce(r["_sources"], none))))
    dropped = F.size(F.filter(head, lambda r: F.array_contains(gone, r["unit_id"])))
    upto = F.least(F.size("_all"), dropped + most)
    return F.struct(upto.alias("upto"), gone.alias("gone"), (upto == state["upto"]).alias("done"))
