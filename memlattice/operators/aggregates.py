"""Counts, histograms and statistics over banks of facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def freshness(df: DataFrame, keys: Sequence[str], at: Column, pending: Column, failed: Column) -> DataFrame:
    """Newest time and the numbers pending and failed, in one scan."""
    return df.groupBy(*keys).agg(F.max(at).alias("newest"), F.count_if(pending).alias("pending"), F.count_if(failed).alias("failed"))


def link_counts(links: DataFrame, postings: DataFrame, kind: str = "link_type", entity: str = "entity_id", cap: int = 10) -> DataFrame:
    """Links by type; the entity type counts ``min(postings - 1, cap)`` for each entity and is left out at 0."""
    typed = links.groupBy(F.col(kind).alias("link_type")).agg(F.count("*").alias("n"))
    each = postings.groupBy(entity).agg(F.least(F.count("*") - 1, F.lit(cap)).alias("edges"))
    shared = each.agg(F.sum("edges").alias("n")).where("n > 0").select(F.lit("entity").alias("link_type"), "n")
    return typed.unionByName(shared)


def timeseries(df: DataFrame, at: Column, unit: str, *keys: str) -> DataFrame:
    """Rows by truncated time and keys."""
    return df.groupBy(F.date_trunc(unit, at).cast("timestamp_ntz").alias("bucket"), *keys).agg(F.count("*").alias("n"))


def scope_histogram(df: DataFrame, tags: str = "tags") -> DataFrame:
    """Rows by their set of tags as a sorted list, empty for untagged."""
    scope = F.array_join(F.array_sort(F.coalesce(F.col(tags), F.array().cast("array<string>"))), ",")
    return df.groupBy(scope.alias("scope")).agg(F.count("*").alias("n"))


def tag_histogram(df: DataFrame, tags: str = "tags", pattern: str | None = None) -> DataFrame:
    """Rows by tag; ``*`` in a pattern stands for anything."""
    each = df.select(F.explode(tags).alias("tag"))
    if pattern:
        each = each.where(F.col("tag").ilike(pattern.replace("*", "%")))
    return each.groupBy("tag").agg(F.count("*").alias("n"))


def distinct_tags(df: DataFrame, tags: str = "tags") -> DataFrame:
    return df.select(F.explode(tags).alias("tag")).agg(F.countDistinct("tag").alias("tags"))


def bounded_count(df: DataFrame, most: int) -> DataFrame:
    """The number of rows, counted no further than ``most``."""
    return df.limit(most).agg(F.count("*").alias("n"))


def fingerprint(df: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str], parts: int = 256) -> DataFrame:
    """A digest of a group's rows in order of ``order``, whatever their partitions.

    Rows are digested first, so that only short digests are collected for a group.
    """
    row = F.md5(F.concat_ws("|", *(F.col(f).cast("string") for f in fields)).cast("binary"))
    each = df.select(*keys, F.struct(F.col(order).alias("o"), row.alias("d")).alias("s"))
    listed = each.groupBy(*keys).agg(F.array_sort(F.collect_list("s")).alias("s"))
    joined = F.array_join(F.transform("s", lambda x: x["d"]), "\n")
    return listed.select(*keys, F.md5(joined.cast("binary")).alias("fingerprint"))


def p95(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The sorted value at index ``int(n * .95) - 1``, at least 0, rounded to 2; nulls do not count.

    The rank is found by counting rows with equal value first, so a large group is
    summed rather than collected.
    """
    from pyspark.sql import Window

    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    order = Window.partitionBy(*keys).orderBy(value)
    ranked = counts.withColumn("upto", F.sum("c").over(order)).withColumn("total", F.sum("c").over(Window.partitionBy(*keys)))
    index = F.greatest(F.floor(F.col("total") * F.lit(0.95)) - 1, F.lit(0))
    return ranked.where((F.col("upto") > index) & (F.col("upto") - F.col("c") <= index)).select(*keys, F.round(value, 2).alias("p95"))


def selector_scores(cases: DataFrame) -> DataFrame:
    """Precision, recall and abstention of ``expected`` and ``selected`` arrays; 1 where a denominator is 0."""
    tp = F.size(F.array_intersect("expected", "selected"))
    sums = cases.agg(
        F.sum(tp).alias("tp"),
        F.sum(F.size("selected") - tp).alias("fp"),
        F.sum(F.size("expected") - tp).alias("fn"),
        F.count_if(F.size("expected") == 0).alias("empty"),
        F.count_if((F.size("expected") == 0) & (F.size("selected") == 0)).alias("abstained"),
    )
    share = lambda a, b: F.when(b > 0, a / b).otherwise(1.0)
    tp_, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select("tp", "fp", "fn", F.round(share(tp_, tp_ + fp), 6).alias("precision"), F.round(share(tp_, tp_ + fn), 6).alias("recall"), F.round(share(F.col("abstained"), F.col("empty")), 6).alias("abstention"))


def paired(a: DataFrame, b: DataFrame, key: str, failed: str, cost: str) -> DataFrame:
    """Two runs of the same tasks: mean difference in cost, and how often the second is worse or better."""
    both = a.select(key, F.col(failed).alias("fa"), F.col(cost).alias("ca")).join(b.select(key, F.col(failed).alias("fb"), F.col(cost).alias("cb")), key)
    worse, better = (~F.col("fa")) & F.col("fb"), F.col("fa") & ~F.col("fb")
    return both.agg(
        F.count("*").alias("pairs"),
        F.round(F.avg(F.col("cb") - F.col("ca")), 6).alias("mean_delta"),
        F.round(F.avg(worse.cast("double")), 6).alias("negative_rate"),
        F.round(F.avg(better.cast("double")), 6).alias("improved_rate"),
        ((F.avg(worse.cast("double")) <= 0.05) & (F.avg(F.col("cb") - F.col("ca")) <= 0)).alias("passes"),
    )


def entity_stats(old: DataFrame, mentions: DataFrame) -> DataFrame:
    """``entity_id``, ``mention_count``, ``last_seen`` after adding (entity_id, at) mentions."""
    new = mentions.groupBy("entity_id").agg(F.count("*").alias("mention_count"), F.max("at").alias("last_seen"))
    return old.select("entity_id", "mention_count", "last_seen").unionByName(new).groupBy("entity_id").agg(F.sum("mention_count").alias("mention_count"), F.max("last_seen").alias("last_seen"))


def cooccurrences(postings: DataFrame, unit: str, entity: str, most: int | None = None) -> DataFrame:
    """Pairs of entities (``e1`` < ``e2``) with the number of units that have both.

    ``most`` bounds the entities of one unit that are paired, by id.
    """
    each = postings.select(F.col(unit).alias("u"), F.col(entity).alias("e")).distinct()
    left, right = each.withColumnRenamed("e", "e1"), each.withColumnRenamed("e", "e2")
    return left.join(right, "u").where("e1 < e2").groupBy("e1", "e2").agg(F.count("*").alias("n"))


def fold_cooccurrences(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).groupBy("e1", "e2").agg(F.sum("n").alias("n"))


def degrees(pairs: DataFrame) -> DataFrame:
    """Degree of each entity and its weight, one over the root."""
    each = pairs.select(F.explode(F.array("e1", "e2")).alias("entity_id"))
    return each.groupBy("entity_id").agg(F.count("*").alias("degree")).withColumn("weight", F.round(1 / F.sqrt("degree"), 6))


def budget_saved(df: DataFrame, key: str, used: str, full: int = 2400) -> DataFrame:
    saved = F.greatest(F.lit(0), full - F.least(F.col(used), F.lit(full)))
    return df.groupBy(key).agg(F.sum(saved).cast("long").alias("saved"), F.count("*").alias("n"))


def _numbered(df: DataFrame, bank: str, kind: str, name: str) -> DataFrame:
    """Rows by bank as a map of kinds, in order; null kinds count as an empty one."""
    each = df.groupBy(F.col(bank).alias("bank_id"), F.coalesce(F.col(kind).cast("string"), F.lit("")).alias("_kind")).agg(F.count("*").alias("_n"))
    return each.groupBy("bank_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_kind", "_n")))).alias(name))


def bank_stats(units: DataFrame, links: DataFrame, postings: DataFrame, operations: DataFrame, cap: int = 10) -> DataFrame:
    """One row for each bank that has units or operations.

    ``units``: unit_id, bank_id, kind, document_id, created_at, consolidated_at, failed_at;
    ``links``: from_unit, link_type; ``postings``: unit_id, entity_id; ``operations``:
    bank_id, status.  Maps count units by kind, links by type, by kind of their unit, and by kind and type
    ("kind/type"); edges of an entity are its other units in the bank, ``cap`` at most.
    Pending are units neither consolidated nor failed; observations need no consolidation.
    Lists are of kinds and types, never of rows.
    """
    raw = F.col("kind") != "observation"
    pending = F.count_if(raw & F.col("consolidated_at").isNull() & F.col("failed_at").isNull()).alias("pending_consolidation")
    totals = units.groupBy("bank_id").agg(F.count("*").alias("nodes"), F.countDistinct("document_id").alias("documents"), F.count_if(F.col("kind") == "observation").alias("observations"), F.max("created_at").alias("last_write"), F.max("consolidated_at").alias("last_consolidated"), pending, F.count_if(raw & F.col("failed_at").isNotNull()).alias("failed_consolidation"))
    where = units.select("unit_id", "bank_id", "kind")
    linked = links.select(F.col("from_unit").alias("unit_id"), "link_type").join(where, "unit_id").withColumn("both", F.concat_ws("/", "kind", "link_type"))
    shared = postings.join(where, "unit_id").groupBy("bank_id", "entity_id").agg(F.least(F.count("*") - 1, F.lit(cap)).alias("edges"))
    shared = shared.groupBy("bank_id").agg(F.sum("edges").alias("entity_edges"))
    out = totals.join(operations.select("bank_id").distinct(), "bank_id", "full")
    for part in (_numbered(units, "bank_id", "kind", "nodes_by_kind"), _numbered(linked, "bank_id", "link_type", "links_by_type"), _numbered(linked, "bank_id", "kind", "links_by_kind"), _numbered(linked, "bank_id", "both", "links_by_kind_and_type"), shared, _numbered(operations, "bank_id", "status", "operations_by_status")):
        out = out.join(part, "bank_id", "left")
    numbers = ("nodes", "documents", "observations", "pending_consolidation", "failed_consolidation", "entity_edges")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in numbers})


#: Periods of charts: their days and the unit of their buckets.
PERIODS = {"1d": (1, "hour"), "7d": (7, "day"), "30d": (30, "day")}


def request_stats(requests: DataFrame, at: str, now: Column, period: str = "7d", *keys: str, failed: Column | None = None) -> DataFrame:
    """Requests of the last ``period`` up to ``now`` by bucket and keys: number, failures; buckets without any are left out."""
    if period not in PERIODS:
        raise ValueError(f"period must be one of {', '.join(PERIODS)}")
    days, unit = PERIODS[period]
    inside = requests.where((F.col(at) > now - F.make_dt_interval(days=F.lit(days))) & (F.col(at) <= now))
    failures = F.count_if(failed if failed is not None else F.lit(False))
    return inside.groupBy(F.date_trunc(unit, at).cast("timestamp_ntz").alias("bucket"), *keys).agg(F.count("*").alias("n"), failures.alias("failures"))


def topic_tree(members: DataFrame, assignment: DataFrame, leaves: DataFrame, roots: DataFrame) -> DataFrame:
    """Topics of two levels over all members: ``topic_id``, ``level``, members, distinct documents, time range.

    ``members``: unit_id, document_id, created_at, updated_at; ``assignment``: unit_id,
    leaf; ``leaves``: leaf; ``roots``: root, leaf, where a leaf may hang below several
    roots and then counts in each.  Units without an assignment to a known leaf are one
    topic ``pending``.  Topics without members are left out.  Documents of a root are
    counted over all its leaves, not added up.
    """
    known = assignment.join(leaves.select("leaf").distinct(), "leaf", "left_semi").select("unit_id", "leaf")
    each = members.join(known, "unit_id", "left")
    placed = each.where("leaf IS NOT NULL")
    numbers = (F.count("*").alias("members"), F.countDistinct("document_id").alias("documents"), F.min("created_at").alias("start"), F.max("updated_at").alias("end"))
    low = placed.groupBy(F.col("leaf").cast("string").alias("topic_id")).agg(*numbers).withColumn("level", F.lit("leaf"))
    high = placed.join(roots.select("root", "leaf").distinct(), "leaf").groupBy(F.col("root").cast("string").alias("topic_id")).agg(*numbers).withColumn("level", F.lit("root"))
    rest = each.where("leaf IS NULL").groupBy(F.lit("pending").alias("topic_id")).agg(*numbers).withColumn("level", F.lit("pending"))
    return low.unionByName(high).unionByName(rest)


def coverage(results: DataFrame, plan: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """For each query of ``plan`` (query_id, dimension) which required dimensions its ``results`` cover: ``covered``, ``missing``, ``complete``.

    ``checks`` give an aggregate over a query's results for each known dimension; one
    that is null or not known is missing.  A query without results misses all.
    """
    found = results.groupBy("query_id").agg(*[F.coalesce(test, F.lit(False)).alias(f"_c{n}") for n, test in enumerate(checks.values())])
    names = F.array(*[F.when(F.col(f"_c{n}"), F.lit(name)) for n, name in enumerate(checks)]) if checks else F.array().cast("array<string>")
    held = found.select("query_id", F.array_compact(names).alias("_held"))
    asked = plan.where("dimension IS NOT NULL").groupBy("query_id").agg(F.array_sort(F.collect_set("dimension")).alias("_required"))
    each = plan.select("query_id").distinct().join(asked, "query_id", "left").join(held, "query_id", "left")
    none = F.array().cast("array<string>")
    each = each.select("query_id", F.coalesce("_required", none).alias("_r"), F.coalesce("_held", none).alias("_h"))
    return each.select("query_id", F.array_intersect("_r", "_h").alias("covered"), F.array_except("_r", "_h").alias("missing"), (F.size(F.array_except("_r", "_h")) == 0).alias("complete"))
