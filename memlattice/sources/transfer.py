"""Archives of linked tables: export, and import in the order of their references.

Tables name their key, the columns that hold keys of other tables, and the column that
holds the key of a parent in the same table.  An import settles clashes of keys by one
policy, carries new keys through all references, and tells what became of every row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice.storage import settled

POLICIES = ("skip", "replace", "new_id", "fail")


class Clash(ValueError):
    """Keys of the archive are in the store already, and the policy is to fail."""


@dataclass(frozen=True)
class Table:
    name: str
    key: str
    refs: Mapping[str, str] = field(default_factory=dict)
    parent: str | None = None


def ordered(tables: Sequence[Table]) -> list[Table]:
    """Tables after those that they refer to; a circle of tables is an error."""
    out: list[Table] = []
    rest = list(tables)
    while rest:
        done = {t.name for t in out}
        ready = [t for t in rest if set(t.refs.values()) <= done | {t.name}]
        if not ready:
            raise ValueError(f"tables refer to each other in a circle, or to none there is: {sorted(t.name for t in rest)}")
        out += ready
        rest = [t for t in rest if t not in ready]
    return out


def layers(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """``key``, ``layer``, ``cycle``, ``on_cycle`` of each distinct key.

    Layer 0 has no parent, or one that is not among the nodes; every other node is a
    layer below its parent.  Nodes on a cycle or below one have no layer; ``cycle`` is
    the least key of theirs.  Each round looks twice as far up, so rounds grow with the
    logarithm of the depth.  Of a repeated key the least parent counts; rows without a
    key are left out.
    """
    one = nodes.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("node")).agg(F.min(parent).alias("up"))
    known = one.select(F.col("node").alias("up"))
    state = settled(one.join(known, "up", "left_semi").select("node", "up", F.lit(1).cast("long").alias("far"), F.least("node", "up").alias("least")).unionByName(one.join(known, "up", "left_anti").select("node", F.lit(None).cast(one.schema["up"].dataType).alias("up"), F.lit(0).cast("long").alias("far"), F.col("node").alias("least"))))
    left, reach = state.where("up IS NOT NULL").count(), 1
    settled_for_good = left == 0
    while not settled_for_good:
        above = state.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("far").alias("more"), F.col("least").alias("other"))
        state = settled(state.join(above, "up", "left").select("node", F.col("next").alias("up"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.least("least", "other").alias("least")))
        reach *= 2
        now = state.where("up IS NOT NULL").count()
        # Depths have no gaps: a round that frees nobody leaves cycles only, which it has to have gone round once.
        settled_for_good = now == 0 or (now == left and reach >= now)
        left = now
    circle = state.where("up IS NOT NULL").select(F.col("up").alias("node")).distinct().withColumn("on_cycle", F.lit(True))
    free = F.col("up").isNull()
    least_of = state.where("up IS NOT NULL").select(F.col("node").alias("up"), F.col("least").alias("cycle_least"))
    marked = state.join(circle, "node", "left").join(least_of, "up", "left")
    return marked.select(F.col("node").alias(key), F.when(free, F.col("far")).alias("layer"), F.when(~free, F.col("cycle_least")).alias("cycle"), F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))


def _fresh(clashing: DataFrame, stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """``old``, ``new``: digests of string keys, numbers above all there are of others."""
    kind = incoming.schema[key].dataType.simpleString()
    if kind == "string":
        return clashing.select("old", F.sha2(F.concat(F.lit("import of "), "old"), 256).alias("new"))
    top = stored.select(key).union(incoming.select(key)).agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    return settled(clashing.select("old", (F.lit(top + 1) + F.monotonically_increasing_id()).cast(kind).alias("new")))


def _decided(table: Table, stored: DataFrame, incoming: DataFrame, policy: str) -> DataFrame:
    """``old``, ``new``, ``outcome`` of each distinct incoming key; a skipped one has no new key."""
    ids = incoming.select(F.col(table.key).alias("old")).where("old IS NOT NULL").distinct()
    held = stored.select(F.col(table.key).alias("old")).distinct()
    clashing, free = ids.join(held, "old", "left_semi"), ids.join(held, "old", "left_anti").select("old", F.col("old").alias("new"), F.lit("inserted").alias("outcome"))
    if policy == "fail":
        if some := clashing.limit(5).collect():
            raise Clash(f"{table.name} has already: {[r.old for r in some]}")
        return free
    if policy == "new_id":
        settled_ids = _fresh(clashing, stored, incoming, table.key).withColumn("outcome", F.lit("renamed"))
        if table.key and incoming.schema[table.key].dataType.simpleString() == "string":
            taken = settled_ids.select(F.col("new").alias("old")).join(held, "old", "left_semi")
            if taken.limit(1).count():
                raise Clash(f"{table.name}: this archive was imported with new ids before")
        return free.unionByName(settled_ids)
    new = F.col("old") if policy == "replace" else F.lit(None).cast(ids.schema["old"].dataType)
    return free.unionByName(clashing.select("old", new.alias("new"), F.lit("replaced" if policy == "replace" else "skipped").alias("outcome")))


def imported(store: Mapping[str, DataFrame], archive: Mapping[str, DataFrame], tables: Sequence[Table], policy: str = "skip") -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables of the store after the import, and a report: ``table``, ``old``, ``new`` (as strings), ``outcome``, ``layer``, ``cycle``.

    Where a key of the archive is in the store already: ``skip`` leaves it and drops the
    archive's row with all that refers to it; ``replace`` removes the stored row and all
    stored rows that refer to it, and puts the archive's in; ``new_id`` imports it under
    a new key; ``fail`` changes nothing and raises.  A reference to a key that neither
    the archive nor the store has makes a row ``dangling``: it is not imported but
    reported.  Rows of a cycle of parents are imported and reported with their cycle;
    ``layer`` is the order in which a store that checks references takes the others.
    Null references are none.  Both sides have the same columns.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy {policy!r} is none of {POLICIES}")
    out, maps, gone, reports = {}, {}, {}, None
    for table in ordered(tables):
        stored, incoming = store[table.name], archive[table.name]
        columns = stored.columns
        before = stored
        for column, other in table.refs.items():  # what hangs on replaced rows goes with them
            if other in gone:
                stored = stored.join(gone[other].withColumnRenamed("old", column), column, "left_anti")
        plan = settled(_decided(table, stored, incoming, policy))
        if policy == "replace":
            lost = plan.where("outcome = 'replaced'").select("old")
            stored = stored.join(lost.withColumnRenamed("old", table.key), table.key, "left_anti")
            kept = stored.select(F.col(table.key).alias("old"))
            gone[table.name] = settled(before.select(F.col(table.key).alias("old")).distinct().join(kept, "old", "left_anti"))
        state = F.col("_outcome")
        rows = incoming.join(plan.select(F.col("old").alias(table.key), F.col("new").alias("_new"), F.col("outcome").alias("_outcome")), table.key, "left").withColumn("_old", F.col(table.key))
        for column, other in [*table.refs.items(), *([(table.parent, table.name)] if table.parent else [])]:
            ids = plan if other == table.name else maps[other]
            there = stored.select(F.col(table.key).alias(column)) if other == table.name else out[other].select(F.col({t.name: t.key for t in tables}[other]).alias(column))
            ids = ids.select(F.col("old").alias(column), F.col("new").alias("_to"), F.col("outcome").alias("_how"))
            rows = rows.join(ids, column, "left").join(there.distinct().withColumn("_there", F.lit(True)), column, "left")
            skipped = F.col("_how") == "skipped"
            # A parent that was skipped is still in the store, so its child hangs on that one.
            lost = F.when(skipped & F.lit(other != table.name), "skipped").when(F.col("_how") == "dangling", "dangling").when(F.col(column).isNotNull() & F.col("_how").isNull() & F.col("_there").isNull(), "dangling")
            rows = rows.withColumn("_outcome", F.when(state.isin("skipped", "dangling"), state).otherwise(F.coalesce(lost, state))).withColumn(column, F.coalesce("_to", column)).drop("_to", "_how", "_there")
        rows = settled(rows.withColumn("_outcome", F.coalesce("_outcome", F.lit("dangling"))))
        if table.parent:  # below a row that is left out nothing is put in
            rows = _without_orphans(rows, stored, table)
        maps[table.name] = settled(rows.groupBy(F.col("_old").alias("old")).agg(F.max(F.when(~F.col("_outcome").isin("skipped", "dangling"), F.col("_new"))).alias("new"), F.max("_outcome").alias("outcome")))
        put = rows.where(~F.col("_outcome").isin("skipped", "dangling")).withColumn(table.key, F.col("_new"))
        out[table.name] = stored.select(*columns).unionByName(put.select(*columns))
        report = maps[table.name].select(F.lit(table.name).alias("table"), F.col("old").cast("string").alias("old"), F.col("new").cast("string").alias("new"), "outcome")
        if table.parent:
            found = layers(incoming, table.key, table.parent).select(F.col(table.key).cast("string").alias("old"), "layer", F.col("cycle").cast("string").alias("cycle"))
            report = report.join(found, "old", "left").select("table", "old", "new", "outcome", "layer", "cycle")
        else:
            report = report.withColumns({"layer": F.lit(0).cast("long"), "cycle": F.lit(None).cast("string")})
        reports = report if reports is None else reports.unionByName(report)
    return out, reports


def _without_orphans(rows: DataFrame, stored: DataFrame, table: Table) -> DataFrame:
    """``rows`` with children of dangling rows dangling too, a generation a round."""
    left_out = F.col("_outcome") == "dangling"
    while True:
        bad = rows.where(left_out & F.col("_new").isNotNull()).select(F.col("_new").alias(table.parent)).distinct()
        bad = bad.join(stored.select(F.col(table.key).alias(table.parent)), table.parent, "left_anti").withColumn("_bad", F.lit(True))
        more = rows.join(bad, table.parent, "left").withColumn("_outcome", F.when(F.col("_bad") & ~F.col("_outcome").isin("skipped"), "dangling").otherwise(F.col("_outcome"))).drop("_bad")
        more = settled(more.select(*rows.columns))
        if more.where(left_out).count() == rows.where(left_out).count():
            return more
        rows = more


def export(store: Mapping[str, DataFrame], tables: Sequence[Table], path: str) -> None:
    """Each table as JSON lines below ``path``, nulls written out; an archive that exists is refused."""
    for table in ordered(tables):
        store[table.name].write.option("ignoreNullFields", "false").json(f"{path}/{table.name}")


def archive(spark: SparkSession, path: str, schemas: Mapping[str, str]) -> dict[str, DataFrame]:
    """The tables of an archive by their schemas; a line that is no such row is an error and not a row of nulls."""
    return {name: spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/{name}") for name, schema in schemas.items()}
