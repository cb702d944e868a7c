"""Incremental maintenance: chunk diffs, folds, queues, consolidation, retention."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.storage import settled


def fixed_chunks(docs: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts as chunks of ``size`` characters with their hashes; an empty text has one."""
    n = F.greatest(F.ceil(F.length(text) / size), F.lit(1)).cast("int")
    each = docs.select(key, text, F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"))
    cut = F.substring(F.col(text), F.col("chunk_index") * size + 1, F.lit(size))
    return each.select(key, "chunk_index", cut.alias("chunk_text"), F.sha2(cut.cast("binary"), 256).alias("content_hash"))


def chunk_diff(stored: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """``same``, ``changed``, ``new`` or ``removed`` for every chunk of either side."""
    on = [key, "chunk_index"]
    both = stored.select(*on, F.col("content_hash").alias("a")).join(new.select(*on, F.col("content_hash").alias("b")), on, "full")
    state = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return both.select(*on, state.alias("state"))


def is_append(stored: Column, new: Column) -> Column:
    """The stored text is a proper prefix of the new."""
    return (F.length(new) > F.length(stored)) & F.startswith(new, stored)


def fold(queue: DataFrame, keys: Sequence[str], order: str, tokens: str, peers: int, budget: int) -> DataFrame:
    """Queued appends that one run takes: the longest prefix of at most ``peers`` whose tokens fit; always the first."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    each = queue.withColumn("place", F.count("*").over(upto)).withColumn("used", F.sum(tokens).over(upto))
    return each.where((F.col("place") == 1) | ((F.col("place") <= peers) & (F.col("used") <= budget)))


def fold_width(tries: int, peers: int = 16) -> int:
    """How many a run takes besides its first: half as many after each failure, in the end none."""
    return peers if tries <= 0 else peers >> min(tries, 31)


def fold_runs(queue: DataFrame, keys: Sequence[str], order: Sequence[str], tokens: str, shape: str, tries: str, peers: int = 16, budget: int = 8000) -> DataFrame:
    """The rows of the next run of each key's queue, with ``place`` from 1.

    A run takes the first row and, if that has a ``shape``, the rows directly after it
    that have the same: at most ``fold_width`` of the first's ``tries``, and together
    within ``budget`` tokens.  It ends at the first row that does not fit.  The first is
    always taken.  Null tokens count as none, null tries as no failure.
    """
    by = Window.partitionBy(*keys).orderBy(*order)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    width = F.when(F.first(tries).over(upto) > 0, F.lit(peers) / F.pow(F.lit(2.0), F.least(F.first(tries).over(upto), F.lit(31)))).otherwise(F.lit(peers))
    each = queue.withColumns({"place": F.row_number().over(by), "_used": F.sum(F.coalesce(F.col(tokens), F.lit(0))).over(upto), "_width": F.floor(width)})
    each = each.withColumn("_other", F.coalesce(F.col(shape) != F.first(shape).over(upto), F.lit(True)) & (F.col("place") > 1))
    fits = ~F.max("_other").over(upto) & (F.col("place") <= F.col("_width") + 1) & (F.max("_used").over(upto) <= budget)
    return each.withColumn("_fits", fits).where((F.col("place") == 1) | F.col("_fits")).drop("_used", "_width", "_other", "_fits")


def ledger_outcomes(events: DataFrame, keep_seconds: int) -> DataFrame:
    """Every row (``key``, ``id``, ``at``, ``digest``) with ``state`` and ``stored_id``, the row its key was stored by.

    ``stored``: the key is new, or was not met for longer than ``keep_seconds``.
    ``replayed``: stored before with the same digest.  ``conflict``: with another one;
    what was stored stays.  Rows count by time, then id, which is theirs alone; those
    without a key or time take no part.  Null digests are equal.

    Within a block of ``keep_seconds`` no key is forgotten, so only the first row of a
    block can be stored: blocks are aggregated first, a window runs over a key's blocks
    alone, and the rows, also those of a key with most of them, are only joined to theirs.
    """
    width = max(keep_seconds, 0) * 1_000_000
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    rows = events.where("key IS NOT NULL AND at IS NOT NULL").select("key", "id", micros.alias("_at"), "digest")
    rows = rows.withColumn("_block", F.floor((F.col("_at") - F.pmod("_at", F.lit(max(width, 1)))) / F.lit(max(width, 1))))
    first = F.min(F.struct("_at", "id", "digest")).alias("_first")
    blocks = rows.groupBy("key", "_block").agg(first, F.max("_at").alias("_last"))
    by = Window.partitionBy("key").orderBy("_block")
    fresh = F.coalesce(F.col("_first._at") - F.lag("_last").over(by) > width, F.lit(True))
    blocks = blocks.withColumn("_start", F.when(fresh, F.col("_first")))
    blocks = blocks.withColumn("_start", F.last("_start", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    each = rows.join(blocks.select("key", "_block", "_start"), ["key", "_block"])
    is_first = (F.col("_at") == F.col("_start._at")) & (F.col("id") == F.col("_start.id"))
    state = F.when(is_first, "stored").when(F.col("digest").eqNullSafe(F.col("_start.digest")), "replayed").otherwise("conflict")
    return each.select("key", "id", state.alias("state"), F.col("_start.id").alias("stored_id"))


#: Tasks that are looked at in one pass, for each slot that is to be filled.
LOOK_AHEAD = 16


def claimable(tasks: DataFrame, now: Column, keys: Sequence[str] = ("serialization_key",), shared: int = 10, reserved: Mapping[str, int] | None = None) -> DataFrame:
    """Tasks that a worker takes: pending and due, with ``slot``, the type a slot is reserved for or ``shared``.

    Tasks are taken in one order, ``priority`` (lower first), time and id.  Of all tasks
    equal in a key (bank, document, ...) one may run: a task is passed over if another
    with one of its keys is processing or was taken before it.  A null key serializes
    nothing.  A task takes a slot reserved for its type, or else a shared one; if
    neither is left it is passed over, and its keys stay free for others.

    The worker's slots bound what the driver sees: in each pass the first tasks that are
    still free come to it (``LOOK_AHEAD`` a slot), and at least the first of them is
    taken, so there are no more passes than slots.
    """
    order = ["priority", "created_at", "operation_id"]
    spark, left = tasks.sparkSession, {**(reserved or {})}
    free = tasks.where((F.col("status") == "pending") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)))
    for key in keys:
        busy = tasks.where("status = 'processing'").select(key).where(F.col(key).isNotNull()).distinct()
        free = free.join(busy, key, "left_anti")
    free = settled(free.select(*order, "type", *keys))
    taken, used = [], {key: set() for key in keys}
    while shared > 0 or any(n > 0 for n in left.values()):
        open_ = free
        for key in keys:  # no more values than slots were taken
            if used[key]:
                open_ = open_.where(F.col(key).isNull() | ~F.col(key).isin(*used[key]))
        if shared <= 0:
            open_ = open_.where(F.col("type").isin(*[kind for kind, n in left.items() if n > 0]))
        if taken:
            open_ = open_.where(~F.col("operation_id").isin(*[found for found, _ in taken]))
        most = LOOK_AHEAD * (max(shared, 0) + sum(left.values()))
        seen = open_.orderBy(*order).limit(most).collect()
        for row in seen:
            if any(row[key] is not None and row[key] in used[key] for key in keys):
                continue
            if left.get(row["type"], 0) > 0:
                left[row["type"]] -= 1
                slot = row["type"]
            elif shared > 0:
                shared, slot = shared - 1, "shared"
            else:
                continue
            taken.append((row["operation_id"], slot))
            for key in keys:
                if row[key] is not None:
                    used[key].add(row[key])
        if len(seen) < most:
            break
    kind = tasks.schema["operation_id"].dataType.simpleString()
    return tasks.join(F.broadcast(spark.createDataFrame(taken, f"operation_id {kind}, slot string")), "operation_id")


def next_state(tasks: DataFrame, now: Column, most_retries: int, backoff_seconds: int = 60) -> DataFrame:
    """Tasks after an ``outcome``: done, error (retried up to ``most_retries`` times, later each time, then failed) or defer (again at ``defer_until``, not a retry)."""
    error, defer = F.col("outcome") == "error", F.col("outcome") == "defer"
    again = error & (F.col("retry_count") < most_retries)
    status = F.when(F.col("outcome") == "done", "completed").when(again | defer, "pending").when(error, "failed").otherwise(F.col("status"))
    wait = now + F.make_dt_interval(secs=(F.lit(backoff_seconds) * F.pow(F.lit(2), F.col("retry_count"))).cast("decimal(18,6)"))
    at = F.when(again, wait).when(defer, F.col("defer_until"))
    return tasks.withColumns({"status": status, "next_retry_at": at, "retry_count": F.col("retry_count") + again.cast("int")})


def prunable(tasks: DataFrame, cutoff: Column) -> DataFrame:
    """Ended tasks older than the cutoff, without those whose children still run; a parent that waits for none but ended children is ``cancelled``."""
    ended = F.col("status").isin("completed", "failed", "cancelled")
    children = tasks.where(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("operation_id")).agg(F.count_if(~ended).alias("open"), F.count("*").alias("children"))
    each = tasks.join(children, "operation_id", "left")
    gone = ended & (F.col("updated_at") < cutoff) & (F.coalesce("open", F.lit(0)) == 0)
    waiting = ~ended & (F.col("children") > 0) & (F.col("open") == 0)
    return each.where(gone | waiting).select("operation_id", F.when(waiting, "cancelled").otherwise("pruned").alias("action"))


def without_sources(observations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observations (``obs_id``, ``unit_id`` rows) that lost a source, and their other sources, which are to be consolidated again."""
    stale = observations.join(gone.select("unit_id"), "unit_id", "left_semi").select("obs_id").distinct()
    rest = observations.join(stale, "obs_id", "left_semi").join(gone.select("unit_id"), "unit_id", "left_anti")
    return stale, rest.select("unit_id").distinct()


def transcript_increment(lines: DataFrame, seen: DataFrame) -> DataFrame:
    """Lines (``source``, ``offset``, ``content``, ``complete``) not indexed yet, by source, offset and content hash; an incomplete last line waits.

    Where the source shrank or was rewritten its lines have other offsets or hashes,
    and are read again.
    """
    keyed = lines.where("complete").withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256))
    return keyed.join(seen.select("source", "offset", "content_hash"), ["source", "offset", "content_hash"], "left_anti")


def retained(df: DataFrame, at: str, cutoff: Column) -> DataFrame:
    """Rows at or after the cutoff; undated ones stay."""
    return df.where(F.col(at).isNull() | (F.col(at) >= cutoff))


#: Most tags of a row for all their combinations, which are 2 ** 16 rows then.
MOST_COMBINED = 16


def scopes(df: DataFrame, mode: str, tags: str = "tags", given: str = "scopes") -> DataFrame:
    """The scopes each row belongs to, as sorted tag arrays in ``scope``.

    ``combined``: all its tags; ``per_tag``: each; ``all_combinations``: every set of
    them, an error beyond ``MOST_COMBINED`` tags; ``shared``: the empty one;
    ``explicit``: those of its column ``given``, an array of tag arrays, each once: if
    that is null the combined one, if it is empty none.  Null tags are left out, and a
    row without tags is in the empty scope.
    """
    if mode not in ("combined", "per_tag", "all_combinations", "shared", "explicit"):
        raise ValueError(f"no such mode of scopes: {mode}")
    sets_of = lambda c: F.array_sort(F.array_distinct(F.array_compact(F.coalesce(c, F.array().cast("array<string>")))))
    held = sets_of(F.col(tags))
    if mode == "explicit":
        named = F.array_distinct(F.transform(F.col(given), sets_of))
        return df.withColumn("scope", F.explode(F.coalesce(named, F.array(held))))
    if mode == "combined":
        return df.withColumn("scope", held)
    if mode == "shared":
        return df.withColumn("scope", F.array().cast("array<string>"))
    if mode == "per_tag":
        one = F.transform(held, lambda t: F.array(t))
        return df.withColumn("scope", F.explode(F.when(F.size(held) > 0, one).otherwise(F.array(held))))
    many = F.raise_error(F.lit(f"all combinations of more than {MOST_COMBINED} tags")).cast("int")
    masks = F.sequence(F.lit(1), F.when(F.size(held) > MOST_COMBINED, many).otherwise((F.pow(F.lit(2), F.size(held)) - 1).cast("int")))
    sets = F.transform(masks, lambda m: F.filter(held, lambda t, i: F.shiftright(m, 0).bitwiseAND(F.pow(F.lit(2), i).cast("int")) != 0))
    return df.withColumn("scope", F.explode(F.when(F.size(held) > 0, sets).otherwise(F.array(held))))


def fold_observations(observations: DataFrame, updates: DataFrame) -> DataFrame:
    """Sources united, proof counted anew, times widened: ``obs_id``, ``sources``, ``low``, ``high``."""
    both = observations.unionByName(updates)
    folded = both.groupBy("obs_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"), F.min("low").alias("low"), F.max("high").alias("high"))
    return folded.withColumn("proof_count", F.size("sources"))


def last_wins(updates: DataFrame, key: str, order: str, text: str, sources: str) -> DataFrame:
    """Of repeated updates the last text, with the sources of all."""
    return updates.groupBy(key).agg(F.max_by(text, order).alias(text), F.array_sort(F.array_distinct(F.flatten(F.collect_list(sources)))).alias(sources))


def invalidate(live: DataFrame, ids: DataFrame, key: str = "unit_id") -> tuple[DataFrame, DataFrame]:
    """What stays, and what goes to the archive."""
    return live.join(ids, key, "left_anti"), live.join(ids, key, "left_semi")


def stale_scopes(scopes_: DataFrame, units: DataFrame, key: str, updated: str) -> DataFrame:
    """For each scope (``key``, ``seen``) whether any unit of it was updated since."""
    newest = units.groupBy(key).agg(F.max(updated).alias("newest"))
    return scopes_.join(newest, key, "left").select(key, F.coalesce(F.col("newest") > F.col("seen"), F.lit(False)).alias("stale"))


def retracted(groundings: DataFrame, live: DataFrame, key: str = "unit_id") -> DataFrame:
    """Groundings whose unit is gone."""
    return groundings.join(live.select(key), key, "left_anti")


def turns_to_keep(messages: DataFrame, keys: Sequence[str], order: str, most: int = 12_000) -> DataFrame:
    """User turns, and of the assistant's the last before the next user turn or the end; texts up to ``most`` characters."""
    spoken = messages.where(F.col("role").isin("user", "assistant"))
    after = F.lead("role").over(Window.partitionBy(*keys).orderBy(order))
    final = spoken.withColumn("_next", after).where((F.col("role") == "user") | F.col("_next").isNull() | (F.col("_next") == "user"))
    return final.select(*keys, order, "role", F.substring("text", 1, most).alias("text"))


def episodes(messages: DataFrame, keys: Sequence[str], order: str, starts: Column) -> DataFrame:
    """Ordered messages cut into episodes at the rows where ``starts`` holds."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("episode", F.sum(starts.cast("int")).over(upto))


def repaired_order(events: DataFrame, keys: Sequence[str], arrival: str, sequence: str) -> DataFrame:
    """Rows with a source sequence trade places among themselves; the others keep their slot (``slot``)."""
    slot = F.row_number().over(Window.partitionBy(*keys).orderBy(arrival))
    each = events.withColumn("slot", slot)
    numbered = each.where(F.col(sequence).isNotNull())
    places = numbered.select(*keys, "slot", F.row_number().over(Window.partitionBy(*keys).orderBy("slot")).alias("k"))
    ordered = numbered.drop("slot").withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(sequence, arrival)))
    return each.where(F.col(sequence).isNull()).unionByName(ordered.join(places, [*keys, "k"]).drop("k"))


def ledger_state(events: DataFrame, key: str, digest: str) -> DataFrame:
    """``stored``, ``replayed`` or ``conflict`` for each idempotency key, with its number of rows."""
    found = events.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(digest).alias("hashes"))
    state = F.when(F.col("hashes") > 1, "conflict").when(F.col("n") > 1, "replayed").otherwise("stored")
    return found.select(key, "n", state.alias("state"))


def tree_paths(nodes: DataFrame, view: str = "tree_nodes") -> DataFrame:
    """``id``, ``depth`` and ``path`` of every node of a forest (``id``, ``parent_id``, ``name``)."""
    nodes.createOrReplaceTempView(view)
    return nodes.sparkSession.sql(f"""
        WITH RECURSIVE t(id, depth, path) AS (
            SELECT id, 0, name FROM {view} WHERE parent_id IS NULL
            UNION ALL
            SELECT n.id, t.depth + 1, concat(t.path, '/', n.name) FROM {view} n JOIN t ON n.parent_id = t.id)
        SELECT id, depth, path FROM t""")
