"""Records of how work was done: traces become episodes, episodes patterns; states, gates and search.

Records: ``record_id``, ``kind`` (trace, episode, pattern), ``maturity``, ``outcome``,
``sources`` (ids a record was derived from), ``verified`` (it has an independent
verifier), ``traits`` (archetype, dimensions and signatures), ``context``,
``rollout_state``, ``drift_status``, ``experiment_id``, ``text``, ``updated_at``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlattice.functions import times
from memlattice.operators import matching, term_scores
from memlattice.operators.retrieval import ranked

#: States of records and what they allow.
SETTLED = ("verified", "replicated", "generalized")
GOOD_OUTCOMES = ("correct", "recovered", "partially_correct")
DRIFT_STATES = ("stable", "watch", "revalidation_required", "deprecated")
ROLLOUT_STATES = {"shadow": "shadow", "canary": "canary", "publish": "active", "rollback": "rolled_back"}


def is_one_of(column: str, values: Sequence[str]) -> Column:
    """Null is none of them."""
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


def promotable_traces(records: DataFrame) -> DataFrame:
    """Traces that become episodes: verified, of a good outcome, and no episode's source yet."""
    used = records.where("kind = 'episode'").select(F.explode("sources").alias("record_id")).distinct()
    fit = (F.col("kind") == "trace") & F.coalesce(F.col("verified"), F.lit(False)) & is_one_of("outcome", GOOD_OUTCOMES)
    return records.where(fit).join(used, "record_id", "left_anti")


def shared(column: str) -> Column:
    """A field that all records of a group agree on, null counting as a value; else null."""
    return F.when(F.count(column) == F.count(F.lit(1)), F.when(F.min(column) == F.max(column), F.min(column)))


def promotable_patterns(records: DataFrame, inherited: Sequence[str] = ("context",)) -> DataFrame:
    """Groups of settled episodes of the same traits that become patterns: ``traits``, ``members``, ``n_contexts`` and what they share.

    A group has two episodes or more in two contexts or more (no context is one), and no
    pattern was derived from exactly these episodes before.  Fields all agree on go to
    the pattern, others are null in it.  Groups are told apart and counted by
    aggregates; only the ids of a group's episodes, which the pattern names as its
    sources, are collected, and only where it qualifies.
    """
    traits = F.array_sort(F.coalesce(F.col("traits"), F.array(F.lit("other"))))
    episodes = records.where((F.col("kind") == "episode") & is_one_of("maturity", SETTLED)).withColumn("_traits", traits)
    counted = episodes.groupBy("_traits").agg(F.count(F.lit(1)).alias("n_members"), F.countDistinct(F.coalesce("context", F.lit(""))).alias("n_contexts"), *[shared(c).alias(f"_shared_{c}") for c in inherited])
    large = counted.where("n_members >= 2 AND n_contexts >= 2")
    ids = episodes.join(large.select("_traits"), "_traits", "left_semi").groupBy("_traits").agg(F.array_sort(F.collect_list("record_id")).alias("members"))
    derived = records.where("kind = 'pattern'").select(F.array_sort("sources").alias("members")).where("members IS NOT NULL").distinct()
    new = large.join(ids, "_traits").join(derived, "members", "left_anti")
    return new.select(F.col("_traits").alias("traits"), "members", "n_members", "n_contexts", *[F.col(f"_shared_{c}").alias(c) for c in inherited])


def with_drift(records: DataFrame, changes: DataFrame) -> DataFrame:
    """Records after the latest allowed change of drift of each (``record_id``, ``seq``, ``status``, ``verified``, ``at``).

    Unknown states are not taken, and ``stable`` only with a verifier's evidence.  Other
    records, and those without a change, stay as they are.
    """
    allowed = changes.where(is_one_of("status", DRIFT_STATES) & ((F.col("status") != "stable") | F.coalesce(F.col("verified"), F.lit(False))))
    last = allowed.groupBy("record_id").agg(F.max_by(F.struct("status", "at"), "seq").alias("_change"), F.bool_or("verified").alias("_proved"))
    each = records.join(last, "record_id", "left")
    return each.withColumns({"drift_status": F.coalesce("_change.status", "drift_status"), "updated_at": F.coalesce("_change.at", "updated_at"), "verified": F.col("verified") | F.coalesce(F.col("_proved"), F.lit(False))}).drop("_change", "_proved")


def with_rollout(records: DataFrame, actions: DataFrame) -> DataFrame:
    """Records after the latest allowed rollout action of each (``record_id``, ``seq``, ``action``, ``experiment_id``, ``passed``, ``at``).

    ``shadow`` and ``canary`` need an experiment; ``publish`` a comparison that was
    ``passed`` and a settled record.  An action takes its experiment with it, also none.
    """
    known = actions.where(is_one_of("action", list(ROLLOUT_STATES))).join(records.select("record_id", F.col("maturity").alias("_maturity")), "record_id")
    trial = F.col("action").isin("shadow", "canary")
    fit = F.when(trial, F.coalesce(F.col("experiment_id") != "", F.lit(False))).when(F.col("action") == "publish", F.coalesce(F.col("passed"), F.lit(False)) & is_one_of("_maturity", SETTLED)).otherwise(F.lit(True))
    last = known.where(fit).groupBy("record_id").agg(F.max_by(F.struct("action", "experiment_id", "at"), "seq").alias("_last"))
    state = F.element_at(F.create_map(*[F.lit(x) for pair in ROLLOUT_STATES.items() for x in pair]), F.col("_last.action"))
    changed = F.col("_last").isNotNull()
    each = records.join(last, "record_id", "left")
    return each.withColumns({"rollout_state": F.when(changed, state).otherwise(F.col("rollout_state")), "experiment_id": F.when(changed, F.col("_last.experiment_id")).otherwise(F.col("experiment_id")), "updated_at": F.when(changed, F.col("_last.at")).otherwise(F.col("updated_at"))}).drop("_last")


def search(records: DataFrame, queries: DataFrame, most: int = 8, unverified: bool = False) -> DataFrame:
    """The ``most`` records of each query (``query_id``, ``text``, ``archetype``, ``context``, ``experiment_id``): ``score``, ``rank``.

    Open to search are records that are not shadowed, rolled back, deprecated or to be
    validated again, whose canary is the query's experiment, which are settled, and which
    have the archetype and context that a query asks for (null asks for none).  The score
    is how many of the query's words stand in the record's text, any case; more score and
    then older come first.  A record without any of the words is left out; a query
    without words gets all, with 0.

    All patterns of all queries are found in one pass over each text by an automaton, and
    only the best records of each task are shuffled.
    """
    state = F.coalesce("rollout_state", F.lit("active"))
    open_ = records.where(~state.isin("shadow", "rolled_back") & ~is_one_of("drift_status", ["deprecated", "revalidation_required"]))
    if not unverified:
        open_ = open_.where(is_one_of("maturity", SETTLED))
    open_ = open_.withColumn("_state", F.coalesce("rollout_state", F.lit("active")))
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != ""))
    asked = queries.select("query_id", "archetype", F.col("context").alias("_context"), F.col("experiment_id").alias("_experiment"), words.alias("_words"))
    # The empty word, which no text holds, names the queries without words.
    terms = asked.select("query_id", "archetype", "_context", "_experiment", (F.size("_words") == 0).alias("_any"), F.explode(F.when(F.size("_words") == 0, F.array(F.lit(""))).otherwise(F.col("_words"))).alias("term"))
    # Null times come first, as in an ascending order.
    shown = open_.select("record_id", "text", "_state", "experiment_id", "context", "traits", F.coalesce(times.micros(F.col("updated_at")), F.lit(-(1 << 63))).alias("_at"))
    names = ["query_id", "record_id", "score", "_at"]
    schema = term_scores.schema(queries, shown, names)

    def found(block: pd.DataFrame) -> DataFrame:
        asked = term_scores.Asked(block.assign(weight=1.0))
        gates = ["archetype", "_context", "_experiment", "_any"]
        of = block.drop_duplicates("query_id").set_index("query_id").loc[asked.queries, gates].astype(object)
        code, ways = pd.factorize(pd.Series(list(of.where(of.notna(), None).itertuples(index=False, name=None)), dtype=object))

        def fits(chunk: pd.DataFrame, way: tuple) -> np.ndarray:
            archetype, context, experiment, _ = way
            fit = (chunk["_state"] != "canary") | (chunk["experiment_id"].eq(experiment) if experiment is not None else False)
            if archetype is not None:
                fit &= np.array([t is not None and archetype in t for t in chunk["traits"]], dtype=bool)
            return (fit & chunk["context"].eq(context) if context is not None else fit).to_numpy(dtype=bool)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            machine, best = matching.Automaton(list(asked.terms)), term_scores.Best(asked, most, (), ["_at", "record_id"], 1)
            for chunk in term_scores.chunks(frames):
                unit, term = machine.held(chunk["text"])
                fit = np.stack([fits(chunk, way) for way in ways], axis=1)
                free = np.array([way[3] for way in ways], dtype=bool)

                def changed(first: int, score: np.ndarray, fit: np.ndarray = fit, free: np.ndarray = free) -> np.ndarray:
                    of = code[first : first + score.shape[1]]
                    return np.where(fit[:, of], score + np.where(free[of], 0.5, 0.0), -1.0)  # half a word: a query without words gets all

                best.add(chunk[["_at", "record_id"]], (unit, term, np.ones(len(term))), changed)
            yield from best.frame(names)

        return shown.mapInPandas(run, schema)

    each = term_scores.by_block(terms, found)
    each = records.sparkSession.createDataFrame([], schema) if each is None else each
    each = each.withColumn("score", F.floor("score").cast("long"))
    return ranked(each, ["query_id"], F.desc("score"), F.asc("_at"), F.asc("record_id"), most=most).select("query_id", "record_id", "score", "rank")
