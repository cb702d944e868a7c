"""Registered queries: aggregates, joins, windows, top-k, sets, budgets, lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlattice.functions.texts import token_estimate
from memlattice.operators import aggregates as agg
from memlattice.operators import entities, graph, lifecycle, retrieval
from memlattice.operators.budget import pack, pack_sources
from memlattice.plans import views
from memlattice.plans.registry import query
from memlattice.storage import scratch
from memlattice.streaming import stateful

D, E, L, P, H, S = views.DOCUMENTS, views.EVENTS, views.LINKS, views.POSTINGS, views.HITS, views.SEEDS


@query("a1_count_by_kind", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return agg.count_by(t.events, "event_type")


@query("a2_freshness", "SELECT o_orderpriority, max(o_orderdate) AS newest, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus = 'P') AS failed FROM orders GROUP BY 1")
def _(t):
    return agg.freshness(t.orders, ["o_orderpriority"], F.col("o_orderdate"), F.col("o_orderstatus") == "O", F.col("o_orderstatus") == "P")


@query("a3_link_counts", f"SELECT link_type, count(*) AS n FROM {L} GROUP BY 1 UNION ALL SELECT 'entity', CAST(sum(e) AS BIGINT) FROM (SELECT least(count(*) - 1, 10) AS e FROM {P} GROUP BY entity_id) HAVING sum(e) > 0")
def _(t):
    return agg.link_counts(views.links(t), views.postings(t))


@query("a4_count_by_document", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    return agg.count_by(t.lineitem, "l_orderkey")


@query("a5_timeseries", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    return agg.timeseries(t.events, F.col("ts"), "day", "event_type")


@query("a6_scope_histogram", f"SELECT array_to_string(list_sort(coalesce(tags, [])), ',') AS scope, count(*) AS n FROM {D} GROUP BY 1")
def _(t):
    return agg.scope_histogram(views.documents(t))


@query("a7_tag_histogram", f"SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM {D}) WHERE tag ILIKE 'src%' GROUP BY 1")
def _(t):
    return agg.tag_histogram(views.documents(t), pattern="src*")


@query("a7_distinct_tags", f"SELECT count(DISTINCT tag) AS tags FROM (SELECT unnest(tags) AS tag FROM {D})")
def _(t):
    return agg.distinct_tags(views.documents(t))


@query("a8_entity_counts", f"SELECT entity_id, count(*) AS n FROM {P} GROUP BY 1")
def _(t):
    return agg.count_by(views.postings(t), "entity_id")


@query("a10_strongest_link", f"SELECT least(from_unit, to_unit) AS a, greatest(from_unit, to_unit) AS b, max(weight) AS weight FROM {L} GROUP BY 1, 2")
def _(t):
    return graph.bidirectional_max(views.links(t))


@query("a11_distinct_on", f"SELECT to_unit, from_unit, weight FROM (SELECT *, row_number() OVER (PARTITION BY to_unit ORDER BY weight DESC, from_unit) AS r FROM {L}) WHERE r = 1 ORDER BY to_unit LIMIT 100")
def _(t):
    one = graph.latest(views.links(t), ["to_unit"], F.desc("weight"), F.asc("from_unit"))
    return one.orderBy("to_unit").limit(100).select("to_unit", "from_unit", "weight")


@query("a12_bounded_count", "SELECT least(count(*), 500) AS n FROM events WHERE event_type = 'view'")
def _(t):
    return agg.bounded_count(t.events.where("event_type = 'view'"), 500)


@query("a13_source_union", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS priorities FROM orders GROUP BY 1")
def _(t):
    kinds = F.collect_set("o_orderpriority")
    return t.orders.groupBy("o_custkey").agg(F.size(kinds).cast("long").alias("n"), F.array_join(F.array_sort(kinds), ",").alias("priorities"))


@query("a14_time_folding", "SELECT o_custkey, min(o_orderdate) AS low, max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) AS high FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("low"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("high"))


@query("a15_entity_stats", "SELECT c_custkey AS entity_id, CAST(c_nationkey + count(o_orderkey) AS BIGINT) AS mention_count, max(o_orderdate) AS last_seen FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey")
def _(t):
    old = t.customer.select(F.col("c_custkey").alias("entity_id"), F.col("c_nationkey").cast("long").alias("mention_count"), F.lit(None).cast("timestamp_ntz").alias("last_seen"))
    return agg.entity_stats(old, t.orders.select(F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").alias("at")))


_PAIRS = f"(SELECT a.entity_id AS e1, b.entity_id AS e2, count(*) AS n FROM {P} a JOIN {P} b ON a.unit_id = b.unit_id AND a.entity_id < b.entity_id GROUP BY 1, 2)"


@query("a16_cooccurrences", f"SELECT e1, e2, n FROM {_PAIRS}")
def _(t):
    return agg.cooccurrences(views.postings(t), "unit_id", "entity_id")


@query("a16_cooccurrence_fold", f"SELECT e1, e2, CAST(sum(n) AS BIGINT) AS n FROM (SELECT e1, e2, n FROM {_PAIRS} UNION ALL SELECT s_suppkey, s_suppkey + 1, 5 FROM supplier) GROUP BY 1, 2")
def _(t):
    old = t.supplier.select(F.col("s_suppkey").alias("e1"), (F.col("s_suppkey") + 1).alias("e2"), F.lit(5).cast("long").alias("n"))
    return agg.fold_cooccurrences(old, agg.cooccurrences(views.postings(t), "unit_id", "entity_id"))


@query("g11_degrees", f"SELECT e AS entity_id, count(*) AS degree, round(1 / sqrt(count(*)), 6) AS weight FROM (SELECT e1 AS e FROM {_PAIRS} UNION ALL SELECT e2 FROM {_PAIRS}) GROUP BY 1")
def _(t):
    return agg.degrees(agg.cooccurrences(views.postings(t), "unit_id", "entity_id"))


@query("a17_fingerprint", "SELECT conv_id, md5(string_agg(md5(concat_ws('|', CAST(turn AS VARCHAR), role, text)), chr(10) ORDER BY turn)) AS fingerprint FROM conversations GROUP BY 1")
def _(t):
    return agg.fingerprint(t.conversations, ["conv_id"], "turn", ["turn", "role", "text"])


@query("a18_bank_stats", "SELECT o_orderpriority, count(*) AS nodes, CAST(sum(l.n) AS BIGINT) AS links, count(*) FILTER (o_orderstatus = 'O') AS pending FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey GROUP BY 1")
def _(t):
    each = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("links"))
    return t.orders.join(each, "o_orderkey").groupBy("o_orderpriority").agg(F.count("*").alias("nodes"), F.sum("links").alias("links"), F.count_if(F.col("o_orderstatus") == "O").alias("pending"))


@query("a19_backlog", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def _(t):
    return agg.count_by(t.orders, "o_orderpriority", "o_orderstatus")


@query("a20_request_stats", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS bucket, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(avg(value), 6) AS mean FROM events WHERE ts >= TIMESTAMP '2024-01-23' GROUP BY 1")
def _(t):
    since = t.events.where(F.col("ts") >= F.lit("2024-01-23").cast("timestamp_ntz"))
    return since.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.avg("value"), 6).alias("mean"))


@query("a21_selector_scores", """WITH c AS (SELECT l_orderkey, list(DISTINCT l_suppkey) FILTER (l_returnflag = 'R') AS e, list(DISTINCT l_suppkey) FILTER (l_linestatus = 'F') AS s FROM lineitem GROUP BY 1),
    x AS (SELECT coalesce(len(e), 0) AS ne, coalesce(len(s), 0) AS ns, len(list_intersect(coalesce(e, []), coalesce(s, []))) AS tp FROM c),
    y AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(ns - tp) AS BIGINT) AS fp, CAST(sum(ne - tp) AS BIGINT) AS fn, count(*) FILTER (ne = 0) AS em, count(*) FILTER (ne = 0 AND ns = 0) AS ab FROM x)
    SELECT tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END, 6) AS "precision", round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END, 6) AS recall, round(CASE WHEN em > 0 THEN ab / em ELSE 1.0 END, 6) AS abstention FROM y""")
def _(t):
    cases = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("expected"), F.collect_set(F.when(F.col("l_linestatus") == "F", F.col("l_suppkey"))).alias("selected"))
    return agg.selector_scores(cases)


@query("a22_paired", "WITH p AS (SELECT a.l_orderkey, a.l_returnflag = 'R' AS fa, b.l_returnflag = 'R' AS fb, a.l_quantity AS ca, b.l_quantity AS cb FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_linenumber = 1 AND b.l_linenumber = 2) SELECT count(*) AS pairs, round(avg(cb - ca), 6) AS mean_delta, round(avg(CAST(NOT fa AND fb AS DOUBLE)), 6) AS negative_rate, round(avg(CAST(fa AND NOT fb AS DOUBLE)), 6) AS improved_rate, avg(CAST(NOT fa AND fb AS DOUBLE)) <= 0.05 AND avg(cb - ca) <= 0 AS passes FROM p")
def _(t):
    side = lambda n: t.lineitem.where(F.col("l_linenumber") == n).select("l_orderkey", (F.col("l_returnflag") == "R").alias("failed"), F.col("l_quantity").alias("cost"))
    return agg.paired(side(1), side(2), "l_orderkey", "failed", "cost")


@query("a23_budget_saved", "SELECT source, CAST(sum(greatest(0, 2400 - least(n_chars, 2400))) AS BIGINT) AS saved, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    return agg.budget_saved(t.documents, "source", "n_chars")


@query("a24_p95", "SELECT event_type, round(l[CAST(greatest(floor(len(l) * 0.95) - 1, 0) AS INTEGER) + 1], 2) AS p95 FROM (SELECT event_type, list_sort(list(value)) AS l FROM events WHERE value IS NOT NULL GROUP BY 1)")
def _(t):
    return agg.p95(t.events, ["event_type"], "value")


@query("j1_postings_join", "SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
def _(t):
    found = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return found.select("l_orderkey", "l_linenumber", "p_name", "s_name")


@query("j2_left_aggregates", "SELECT c_custkey, count(o_orderkey) AS n, max(o_orderdate) AS newest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(t):
    each = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("newest"))
    return t.customer.select("c_custkey").join(each, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), "newest")


@query("j4_orphan_entities", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-06-01')")
def _(t):
    recent = t.orders.where(F.col("o_orderdate") >= F.lit("2000-06-01").cast("timestamp_ntz"))
    return graph.orphans(t.customer.select("c_custkey", "c_name"), recent.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("j5_stale_pairs", f"SELECT s_suppkey AS e1, s_suppkey + 1 AS e2 FROM supplier WHERE NOT EXISTS (SELECT 1 FROM {_PAIRS} p WHERE p.e1 = s_suppkey AND p.e2 = s_suppkey + 1)")
def _(t):
    stored = t.supplier.select(F.col("s_suppkey").alias("e1"), (F.col("s_suppkey") + 1).alias("e2"))
    return graph.stale_pairs(stored, views.postings(t), "unit_id", "entity_id")


@query("j6_pairs_of_unit", f"SELECT a.unit_id AS u, a.entity_id AS e1, b.entity_id AS e2 FROM {P} a JOIN {P} b ON a.unit_id = b.unit_id AND a.entity_id < b.entity_id")
def _(t):
    return graph.pairs(views.postings(t), "unit_id", "entity_id")


@query("j7_top_neighbours", f"SELECT from_unit, to_unit, weight FROM (SELECT *, row_number() OVER (PARTITION BY from_unit ORDER BY weight DESC, to_unit) AS r FROM (SELECT from_unit, to_unit, max(weight) AS weight FROM {L} WHERE weight >= 0.1 GROUP BY 1, 2)) WHERE r <= 3")
def _(t):
    best = views.links(t).where("weight >= 0.1").groupBy("from_unit", "to_unit").agg(F.max("weight").alias("weight"))
    return graph.cap_links(best, 3)


_NEAR = f"""(SELECT unit_id, o.u AS other_id, abs(o.t - epoch_us(ts)) AS d FROM (SELECT unit_id, ts, unnest(list_concat(
    coalesce(list({{'t': epoch_us(ts), 'u': unit_id}}) OVER (PARTITION BY kind ORDER BY ts, unit_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []),
    coalesce(list({{'t': epoch_us(ts), 'u': unit_id}}) OVER (PARTITION BY kind ORDER BY ts, unit_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), []))) AS o FROM {E}))"""
_NEAREST = f"(SELECT unit_id, other_id, d / 3600000000.0 AS hours, row_number() OVER (PARTITION BY unit_id ORDER BY d, other_id) AS rank FROM {_NEAR})"


@query("j9_temporal_neighbours", f"SELECT unit_id, other_id, round(hours, 6) AS hours, CAST(rank AS INTEGER) AS rank FROM {_NEAREST} WHERE rank <= 3")
def _(t):
    return graph.nearest_in_time(views.events(t), ["kind"], "ts", 3).withColumn("hours", F.round("hours", 6))


@query("g1_temporal_links", f"SELECT unit_id AS from_unit, other_id AS to_unit, 'temporal' AS link_type, round(greatest(0.3, 1 - hours / 24), 6) AS weight FROM {_NEAREST} WHERE rank <= 3")
def _(t):
    return graph.temporal_links(views.events(t), ["kind"], "ts", 3)


@query("g2_batch_links", f"SELECT a.unit_id AS from_unit, b.unit_id AS to_unit, round(greatest(0.3, 1 - abs(epoch_us(a.ts) - epoch_us(b.ts)) / 3600000000.0 / 24), 6) AS weight FROM {E} a JOIN {E} b ON a.kind = b.kind AND a.user_id = b.user_id AND a.unit_id <> b.unit_id WHERE abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 86400000000")
def _(t):
    return graph.batch_links(views.events(t), ["kind", "user_id"], "ts")


@query("g3_capped_links", f"SELECT from_unit, to_unit, weight FROM (SELECT *, row_number() OVER (PARTITION BY from_unit ORDER BY weight DESC, to_unit) AS r FROM (SELECT DISTINCT from_unit, to_unit, weight FROM {L})) WHERE r <= 2")
def _(t):
    return graph.cap_links(views.links(t).select("from_unit", "to_unit", "weight").distinct(), 2)


@query("g7_underlinked", f"SELECT o_orderkey AS unit_id, 3 - coalesce(n, 0) AS missing FROM orders LEFT JOIN (SELECT from_unit, count(*) AS n FROM {L} WHERE link_type = 'temporal' GROUP BY 1) ON from_unit = o_orderkey WHERE 3 - coalesce(n, 0) > 0")
def _(t):
    return graph.underlinked(t.orders.select(F.col("o_orderkey").alias("unit_id")), views.links(t), "temporal", 3)


@query("g8_victims", f"SELECT DISTINCT from_unit AS unit_id FROM {L} WHERE link_type IN ('temporal', 'semantic') AND to_unit IN (SELECT p_partkey FROM part WHERE p_size = 5) AND from_unit NOT IN (SELECT p_partkey FROM part WHERE p_size = 5)")
def _(t):
    return graph.victims(views.links(t), t.part.where("p_size = 5").select(F.col("p_partkey").alias("unit_id")))


@query("g6_causal_links", "SELECT DISTINCT a.l_orderkey * 10 + a.l_linenumber AS from_unit, b.l_orderkey * 10 + b.l_linenumber AS to_unit, 'caused_by' AS link_type, 1.0::DOUBLE AS weight FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber IN (1, a.l_linenumber - 1) WHERE a.l_linenumber <> b.l_linenumber")
def _(t):
    n = F.col("l_linenumber")
    facts = t.lineitem.select(F.col("l_orderkey").alias("batch"), (F.col("l_orderkey") * 10 + n).alias("unit_id"), n.alias("index"), F.array(F.lit(1), n - 1).alias("causes"))
    return graph.causal_links(facts)


@query("j12_array_overlap", f"SELECT DISTINCT unit_id FROM {D} WHERE list_has_any(tags, ['src1', 'src4', 'es'])")
def _(t):
    wanted = t.spark.createDataFrame([("src1",), ("src4",), ("es",)], "tag string")
    return views.documents(t).select("unit_id", F.explode("tags").alias("tag")).join(F.broadcast(wanted), "tag", "left_semi").select("unit_id").distinct()


@query("j13_set_scores", f"SELECT a.unit_id, count(DISTINCT a.entity_id) AS shared FROM {P} a JOIN {P} b ON a.entity_id = b.entity_id JOIN {S} s ON s.unit_id = b.unit_id GROUP BY 1")
def _(t):
    wanted = views.seeds(t).join(views.postings(t), "unit_id").select("entity_id").distinct()
    return views.postings(t).join(wanted, "entity_id", "left_semi").groupBy("unit_id").agg(F.countDistinct("entity_id").alias("shared"))


_UNITS_WITH_SOURCES = "(SELECT c_custkey + 1000000000 AS unit_id, list(o_orderkey) AS sources FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1)"


@query("j14_inherited_entities", f"SELECT DISTINCT u.unit_id, p.entity_id FROM (SELECT unit_id, unnest(sources) AS s FROM {_UNITS_WITH_SOURCES}) u JOIN {P} p ON p.unit_id = u.s")
def _(t):
    urgent = t.orders.where("o_orderpriority = '1-URGENT'")
    units = urgent.groupBy((F.col("o_custkey") + 1000000000).alias("unit_id")).agg(F.collect_list("o_orderkey").alias("sources"))
    return graph.inherited_entities(units, views.postings(t))


@query("j15_case_insensitive_join", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON lower(a.p_name) = lower(b.p_name) AND a.p_partkey < b.p_partkey")
def _(t):
    return entities.equal_names(t.part, "p_partkey", "p_name")


@query("j17_either_key", f"SELECT DISTINCT e1, e2, n FROM {_PAIRS} WHERE e1 IN (1, 2, 3) OR e2 IN (1, 2, 3)")
def _(t):
    pairs, wanted = agg.cooccurrences(views.postings(t), "unit_id", "entity_id"), [1, 2, 3]
    return pairs.where(F.col("e1").isin(wanted)).union(pairs.where(F.col("e2").isin(wanted) & ~F.col("e1").isin(wanted)))


@query("j18_older_peer", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'O') WHERE r = 1")
def _(t):
    return graph.latest(t.orders.where("o_orderstatus = 'O'"), ["o_custkey"], F.asc("o_orderdate"), F.asc("o_orderkey")).select("o_custkey", "o_orderkey")


@query("j19_json_recordset", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def _(t):
    return t.events.select("event_id", F.from_json("props", "k int").alias("p")).select("event_id", "p.k")


@query("j20_tree", "WITH RECURSIVE n AS (SELECT r_regionkey AS id, NULL AS parent_id, r_name AS name FROM region UNION ALL SELECT n_nationkey + 100, n_regionkey, n_name FROM nation UNION ALL SELECT s_suppkey + 1000, s_nationkey + 100, s_name FROM supplier), t AS (SELECT id, 0 AS depth, name AS path FROM n WHERE parent_id IS NULL UNION ALL SELECT n.id, t.depth + 1, t.path || '/' || n.name FROM n JOIN t ON n.parent_id = t.id) SELECT id, depth, path FROM t")
def _(t):
    nodes = t.region.selectExpr("cast(r_regionkey as long) as id", "cast(null as long) as parent_id", "r_name as name")
    nodes = nodes.union(t.nation.selectExpr("n_nationkey + 100L", "cast(n_regionkey as long)", "n_name")).union(t.supplier.selectExpr("s_suppkey + 1000", "s_nationkey + 100L", "s_name"))
    return lifecycle.tree_paths(nodes)


@query("j10_staleness_batch", "SELECT c_custkey, coalesce(max(o_orderdate) > TIMESTAMP '1997-06-01', false) AS stale FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(t):
    seen = t.customer.select("c_custkey", F.lit("1997-06-01").cast("timestamp_ntz").alias("seen"))
    return lifecycle.stale_scopes(seen, t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "o_orderdate")


@query("w2_fanout_cap", f"SELECT entity_id, unit_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY unit_id DESC) AS r FROM {P}) WHERE r <= 200")
def _(t):
    return retrieval.ranked(views.postings(t), ["entity_id"], F.desc("unit_id"), most=200, name="r").select("entity_id", "unit_id")


@query("w5_temporal_coverage", f"WITH p AS (SELECT *, least(7, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / (30 * 86400000000.0 / 8)) AS INTEGER)) AS bucket FROM {E}), q AS (SELECT *, row_number() OVER (PARTITION BY kind, bucket ORDER BY value DESC, unit_id) AS tier FROM p) SELECT kind, unit_id, bucket, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY tier, value DESC, unit_id) AS rank FROM q) WHERE rank <= 10")
def _(t):
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    from memlattice.functions.times import micros

    bucket = F.least(F.lit(7), F.floor((micros(F.col("ts")) - micros(start)) / (30 * 86_400_000_000.0 / 8)).cast("int"))
    return retrieval.coverage(views.events(t), ["kind"], bucket, 10, "value").select("kind", "unit_id", "bucket", "rank")


_TURNS = "(SELECT conv_id, turn, CAST(ceil(length(text) / 4.0) AS BIGINT) AS size FROM conversations)"
_GREEDY = """WITH RECURSIVE o AS (SELECT conv_id, turn, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn, size) AS r FROM {turns}),
    g AS (SELECT conv_id, 0::BIGINT AS r, 0::BIGINT AS used, []::BIGINT[] AS taken, false AS cut FROM (SELECT DISTINCT conv_id FROM o)
    UNION ALL SELECT g.conv_id, o.r, CASE WHEN {fits} THEN used + size ELSE used END, CASE WHEN {fits} THEN list_append(taken, turn) ELSE taken END, cut OR NOT ({fits}) FROM g JOIN o ON o.conv_id = g.conv_id AND o.r = g.r + 1)
    SELECT conv_id, used, CAST(len(taken) AS BIGINT) AS n, array_to_string(taken, ',') AS ranks, cut AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY r DESC) AS k FROM g) WHERE k = 1"""


@query("r23_fact_budget", _GREEDY.format(turns=_TURNS, fits="used + size <= 150 OR len(taken) = 0"))
def _(t):
    return pack(t.conversations, ["conv_id"], "turn", token_estimate(F.col("text")), 150)


@query("r36_pack_claims", _GREEDY.format(turns=_TURNS, fits="used + size <= 60"))
def _(t):
    return pack(t.conversations, ["conv_id"], "turn", token_estimate(F.col("text")), 60, floor_of_one=False)


@query("r24_source_budget", """WITH RECURSIVE items AS MATERIALIZED (SELECT l_orderkey, CAST(l_suppkey % 5 AS INTEGER) AS o, CAST(l_quantity AS BIGINT) AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey % 5, CAST(l_quantity AS BIGINT)) AS r FROM lineitem),
    taken AS (SELECT l_orderkey, 0 AS r, CAST(0 AS BIGINT) AS used, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS each, CAST(0 AS BIGINT) AS n FROM (SELECT DISTINCT l_orderkey FROM lineitem)
        UNION ALL SELECT l_orderkey, nr, used + own, list_transform(each, lambda x, k: CASE WHEN k = o + 1 THEN x + own ELSE x END), n + CASE WHEN fits THEN 1 ELSE 0 END
        FROM (SELECT *, CASE WHEN fits THEN size ELSE 0 END AS own FROM (SELECT t.l_orderkey, t.used, t.each, t.n, i.o, i.size, CAST(i.r AS INTEGER) AS nr, t.used + i.size <= 120 AND t.each[i.o + 1] + i.size <= 60 AS fits FROM taken t JOIN items i ON i.l_orderkey = t.l_orderkey AND i.r = t.r + 1)))
    SELECT l_orderkey, arg_max(used, r) AS used, arg_max(n, r) AS n FROM taken GROUP BY 1""")
def _(t):
    lines = t.lineitem.withColumn("o", F.col("l_suppkey") % 5)
    return pack_sources(lines, ["l_orderkey"], "o", "l_linenumber", F.col("l_quantity"), 120, 60)


@query("u1_union_all", "SELECT c_custkey AS id, 'c' AS side FROM customer UNION ALL SELECT s_suppkey, 's' FROM supplier")
def _(t):
    return t.customer.select(F.col("c_custkey").alias("id"), F.lit("c").alias("side")).unionByName(t.supplier.select(F.col("s_suppkey").alias("id"), F.lit("s").alias("side")))


@query("u2_union_distinct", "SELECT l_partkey AS id FROM lineitem UNION SELECT l_suppkey FROM lineitem")
def _(t):
    return t.lineitem.select(F.col("l_partkey").alias("id")).union(t.lineitem.select("l_suppkey")).distinct()


@query("u4_first_wins", "SELECT l_suppkey, min(l_orderkey) AS first FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.min("l_orderkey").alias("first"))


@query("k6_cap_per_source", f"SELECT query_id, unit_id, arm FROM {H} WHERE rank <= 5")
def _(t):
    return retrieval.cap_per_source(views.hits(t), 5).select("query_id", "unit_id", "arm")


@query("k8_margin_head", "SELECT kind, unit_id FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY value DESC, unit_id) AS r FROM (SELECT event_type AS kind, event_id AS unit_id, value, max(value) OVER (PARTITION BY event_type) AS top FROM events) WHERE value >= greatest(1, top - 30)) WHERE r <= 12")
def _(t):
    return retrieval.margin_head(views.events(t), ["kind"], "value", 1.0, 30.0).select("kind", "unit_id")


@query("k9_reserved_slots", f"SELECT kind, unit_id, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY recent DESC, value DESC, unit_id) AS r FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ts DESC, unit_id) <= 4 AS recent FROM {E})) WHERE r <= 20")
def _(t):
    return retrieval.reserved_slots(views.events(t), ["kind"], "ts", "value", 20).select("kind", "unit_id", "rank")


def _chunk_sql(text: str, size: int) -> str:
    return f"(SELECT doc_id, i AS chunk_index, sha256(substring({text}, CAST(i * {size} + 1 AS INTEGER), {size})) AS h FROM (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil(length({text}) / {size}.0) AS BIGINT), 1))) AS i FROM documents))"


@query("t1_chunk_diff", f"SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CAST(coalesce(a.chunk_index, b.chunk_index) AS INTEGER) AS chunk_index, CASE WHEN a.h IS NULL THEN 'new' WHEN b.h IS NULL THEN 'removed' WHEN a.h = b.h THEN 'same' ELSE 'changed' END AS state FROM {_chunk_sql('text', 1400)} a FULL JOIN {_chunk_sql('replace(text, chr(10), chr(32))', 1400)} b ON a.doc_id = b.doc_id AND a.chunk_index = b.chunk_index")
def _(t):
    old = lifecycle.fixed_chunks(t.documents, 1400)
    new = lifecycle.fixed_chunks(t.documents.withColumn("text", F.replace("text", F.lit("\n"), F.lit(" "))), 1400)
    return lifecycle.chunk_diff(old, new)


@query("s11_chunks", f"SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, h AS content_hash FROM {_chunk_sql('text', 1400)}")
def _(t):
    return lifecycle.fixed_chunks(t.documents, 1400).select("doc_id", "chunk_index", "content_hash")


@query("t2_append_detection", "SELECT a.conv_id, a.turn, length(b.text) > length(a.text) AND starts_with(b.text, a.text) AS append FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def _(t):
    a = t.conversations.select("conv_id", "turn", F.col("text").alias("stored"))
    b = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("new"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", lifecycle.is_append(F.col("stored"), F.col("new")).alias("append"))


@query("t3_fold", "SELECT conv_id, turn FROM (SELECT conv_id, turn, count(*) OVER w AS place, sum(length(text)) OVER w AS used FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) WHERE place = 1 OR (place <= 16 AND used <= 600)")
def _(t):
    sized = t.conversations.withColumn("size", F.length("text"))
    return lifecycle.fold(sized, ["conv_id"], "turn", "size", 16, 600).select("conv_id", "turn")


@query("t4_claimable", """WITH RECURSIVE due AS (SELECT o_orderkey AS operation_id, o_custkey AS bank, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 500 END AS document, o_orderpriority AS type, CAST(left(o_orderpriority, 1) AS INTEGER) AS priority, o_orderdate AS created_at, o_orderstatus AS s FROM orders),
    busy AS (SELECT * FROM due WHERE s = 'P' AND operation_id % 4 = 0),
    free AS MATERIALIZED (SELECT row_number() OVER (ORDER BY priority, created_at, operation_id) AS n, operation_id, bank, document, type FROM due
        WHERE s = 'O' AND bank NOT IN (SELECT bank FROM busy) AND (document IS NULL OR document NOT IN (SELECT document FROM busy WHERE document IS NOT NULL))),
    taken AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS operation_id, CAST(NULL AS VARCHAR) AS slot, CAST([] AS BIGINT[]) AS banks, CAST([] AS BIGINT[]) AS documents, 5 AS own, 25 AS shared
        UNION ALL SELECT x.n, x.operation_id, x.slot, list_append(x.banks, x.bank), CASE WHEN x.document IS NULL THEN x.documents ELSE list_append(x.documents, x.document) END, x.own - CAST(x.slot <> 'shared' AS INTEGER), x.shared - CAST(x.slot = 'shared' AS INTEGER)
        FROM (SELECT arg_min({'n': f.n, 'operation_id': f.operation_id, 'bank': f.bank, 'document': f.document, 'banks': t.banks, 'documents': t.documents, 'own': t.own, 'shared': t.shared, 'slot': CASE WHEN f.type = '5-LOW' AND t.own > 0 THEN f.type ELSE 'shared' END}, f.n) AS x
            FROM taken t JOIN free f ON f.n > t.n AND NOT list_contains(t.banks, f.bank) AND NOT coalesce(list_contains(t.documents, f.document), false) AND (t.shared > 0 OR (f.type = '5-LOW' AND t.own > 0)) HAVING count(*) > 0))
    SELECT operation_id, slot FROM taken WHERE n > 0""")
def _(t):
    status = F.when(F.col("o_orderstatus") == "O", "pending").when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 4 == 0), "processing").otherwise("completed")
    document = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 500)
    tasks = t.orders.select(F.col("o_orderkey").alias("operation_id"), F.col("o_custkey").alias("bank"), document.alias("document"), F.col("o_orderpriority").alias("type"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), status.alias("status"), F.lit(None).cast("timestamp_ntz").alias("next_retry_at"), F.col("o_orderdate").alias("created_at"))
    return lifecycle.claimable(tasks, F.lit("1998-01-01").cast("timestamp_ntz"), ["bank", "document"], 25, {"5-LOW": 5}).select("operation_id", "slot")


@query("t3_fold_runs", """WITH q AS (SELECT conv_id, turn, length(text) AS size, CASE WHEN turn % 5 <> 4 THEN 'a' END AS shape, conv_id % 6 AS tries, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations),
    f AS (SELECT conv_id, shape AS first_shape, CAST(floor(16 / pow(2, tries)) AS INTEGER) AS width FROM q WHERE place = 1),
    u AS (SELECT q.*, first_shape, width, sum(size) OVER (PARTITION BY conv_id ORDER BY turn) AS used, sum(CASE WHEN place > 1 AND (shape IS NULL OR first_shape IS NULL OR shape <> first_shape) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS other FROM q JOIN f USING (conv_id))
    SELECT conv_id, turn, place FROM u WHERE place = 1 OR (other = 0 AND place <= width + 1 AND used <= 900)""")
def _(t):
    queue = t.conversations.select("conv_id", "turn", F.length("text").alias("size"), F.when(F.col("turn") % 5 != 4, "a").alias("shape"), (F.col("conv_id") % 6).alias("tries"))
    return lifecycle.fold_runs(queue, ["conv_id"], ["turn"], "size", "shape", "tries", 16, 900).select("conv_id", "turn", F.col("place").cast("long").alias("place"))


_OUTCOMES = """WITH e AS (SELECT 'u' || user_id || event_type AS key, event_id AS id, ts AS met, CAST(event_id % 3 AS VARCHAR) AS digest FROM events),
    g AS (SELECT *, CASE WHEN lag(met) OVER w IS NULL OR met - lag(met) OVER w > INTERVAL 72 HOUR THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY key ORDER BY met, id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY met, id) AS stretch FROM g),
    f AS (SELECT *, first_value(id) OVER w AS stored_id, first_value(digest) OVER w AS stored FROM s WINDOW w AS (PARTITION BY key, stretch ORDER BY met, id))
    SELECT key, id, CASE WHEN fresh = 1 THEN 'stored' WHEN digest = stored THEN 'replayed' ELSE 'conflict' END AS state, stored_id FROM f"""


def _keyed_events(events):
    return events.select(F.concat(F.lit("u"), F.col("user_id").cast("string"), "event_type").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") % 3).cast("string").alias("digest"))


@query("t10_ledger_outcomes", _OUTCOMES)
def _(t):
    return lifecycle.ledger_outcomes(_keyed_events(t.events), 3 * 86_400)


@query("s22_stream_ledger", _OUTCOMES)
def _(t):
    source = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "*.parquet").parquet(_as_folder(t))
    return stateful.settled_stream(stateful.ledger_outcomes(_keyed_events(source), "40 days", 3 * 86_400), scratch(t.spark, "ledger"))


def _as_folder(t):
    """Events as a folder of files, a range of time each, so that they arrive in order."""
    path = scratch(t.spark, "events")
    t.events.repartitionByRange(8, "ts").sortWithinPartitions("ts").write.parquet(path)
    return path


@query("t7_retention", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def _(t):
    return lifecycle.retained(t.events, "ts", F.lit("2024-01-15").cast("timestamp_ntz")).select("event_id")


@query("t11_order_repair", "WITH s AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS slot FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY slot) AS k FROM s WHERE value > 20), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, slot) AS k2 FROM s WHERE value > 20) SELECT event_id, slot FROM s WHERE value IS NULL OR value <= 20 UNION ALL SELECT o.event_id, n.slot FROM o JOIN n ON o.user_id = n.user_id AND o.k2 = n.k")
def _(t):
    arrival = F.struct("ts", "event_id")
    e = t.events.select("event_id", "user_id", arrival.alias("arrival"), F.when(F.col("value") > 20, F.col("value")).alias("sequence"))
    return lifecycle.repaired_order(e, ["user_id"], "arrival", "sequence").select("event_id", F.col("slot").cast("long").alias("slot"))


@query("s22_ledger", "SELECT text_key, count(*) AS n, CASE WHEN count(DISTINCT h) > 1 THEN 'conflict' WHEN count(*) > 1 THEN 'replayed' ELSE 'stored' END AS state FROM (SELECT md5(substring(text, 1, 40)) AS text_key, md5(text) AS h FROM documents) GROUP BY 1")
def _(t):
    rows = t.documents.select(F.md5(F.substring("text", 1, 40).cast("binary")).alias("text_key"), F.md5(F.col("text").cast("binary")).alias("h"))
    return lifecycle.ledger_state(rows, "text_key", "h")


@query("c1_unconsolidated", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 100")
def _(t):
    return t.orders.where("o_orderstatus = 'O'").orderBy("o_orderdate", "o_orderkey").limit(100).select("o_orderkey")


@query("c3_scopes_all", f"SELECT unit_id, scope FROM (SELECT unit_id, unnest(CASE WHEN coalesce(len(tags), 0) = 0 THEN [''] ELSE [list_sort(tags)[1], list_sort(tags)[2], array_to_string(list_sort(tags), ',')] END) AS scope FROM {D})")
def _(t):
    return lifecycle.scopes(views.documents(t), "all_combinations").select("unit_id", F.array_join("scope", ",").alias("scope"))


@query("c3_scopes_per_tag", f"SELECT unit_id, unnest(CASE WHEN coalesce(len(tags), 0) = 0 THEN [''] ELSE tags END) AS scope FROM {D}")
def _(t):
    return lifecycle.scopes(views.documents(t), "per_tag").select("unit_id", F.array_join("scope", ",").alias("scope"))


@query("c8_fold_observations", "SELECT o_custkey AS obs_id, array_to_string(list_sort(list(DISTINCT o_orderkey)), ',') AS sources, min(o_orderdate) AS low, max(o_orderdate) AS high, CAST(count(DISTINCT o_orderkey) AS INTEGER) AS proof_count FROM orders GROUP BY 1")
def _(t):
    rows = t.orders.select(F.col("o_custkey").alias("obs_id"), F.array("o_orderkey").alias("sources"), F.col("o_orderdate").alias("low"), F.col("o_orderdate").alias("high"))
    low, high = rows.where(F.size("sources") > 0), rows.where("low > '1996-01-01'")
    return lifecycle.fold_observations(low, high).withColumn("sources", F.array_join(F.col("sources").cast("array<string>"), ","))


@query("c9_last_wins", "SELECT o_custkey, max_by(o_orderpriority, o_orderkey) AS o_orderpriority, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS s FROM orders GROUP BY 1")
def _(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderpriority", F.array("o_orderstatus").alias("s"))
    return lifecycle.last_wins(rows, "o_custkey", "o_orderkey", "o_orderpriority", "s").withColumn("s", F.array_join("s", ","))


@query("c11_invalidate", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(t):
    poor = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return lifecycle.invalidate(t.orders, poor, "o_custkey")[0].select("o_orderkey")


@query("c13_retracted", "SELECT l_orderkey AS unit_id, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')")
def _(t):
    groundings = t.lineitem.select(F.col("l_orderkey").alias("unit_id"), "l_linenumber")
    return lifecycle.retracted(groundings, t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("unit_id")))


@query("c15_banks_to_consolidate", "SELECT DISTINCT o_custkey FROM orders a WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = 'P')")
def _(t):
    pending, busy = t.orders.where("o_orderstatus = 'O'"), t.orders.where("o_orderstatus = 'P'")
    return pending.join(busy.select("o_custkey"), "o_custkey", "left_anti").select("o_custkey").distinct()


@query("c17_shared_or_null", "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) END AS shared FROM orders GROUP BY 1")
def _(t):
    p = "o_orderpriority"
    return t.orders.groupBy("o_custkey").agg(F.when(F.countDistinct(p) == 1, F.min(p)).alias("shared"))


@query("x9_episodes", "SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS episode FROM conversations")
def _(t):
    return lifecycle.episodes(t.conversations, ["conv_id"], "turn", F.col("role") == "user").select("conv_id", "turn", "episode")


@query("x8_topic_rollup", "SELECT r_name, count(*) AS members, count(DISTINCT c_nationkey) AS leaves, max(c_acctbal) AS best FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _(t):
    leaves = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("m"), F.max("c_acctbal").alias("best"))
    tree = leaves.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return tree.groupBy("r_name").agg(F.sum("m").alias("members"), F.count("*").alias("leaves"), F.max("best").alias("best"))


@query("x5_promotion_groups", "SELECT l_suppkey, count(*) AS members, count(DISTINCT l_partkey) AS contexts FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT l_partkey) >= 2")
def _(t):
    groups = t.lineitem.where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count("*").alias("members"), F.countDistinct("l_partkey").alias("contexts"))
    return groups.where("members >= 2 AND contexts >= 2")


@query("x2_messages", "SELECT conv_id, turn, role, substring(text, 1, 12000) AS text FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations WHERE role IN ('user', 'assistant')) WHERE role = 'user' OR after IS NULL OR after = 'user'")
def _(t):
    return lifecycle.turns_to_keep(t.conversations, ["conv_id"], "turn")


@query("x10_effectiveness", "SELECT o_orderkey, max(l_returnflag) AS flag, array_to_string(list(l_suppkey ORDER BY l_linenumber, l_suppkey), ',') AS ids, count(DISTINCT l_linestatus) > 1 AS mixed FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(t):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"].cast("string")), ",")
    each = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_returnflag").alias("flag"), ids.alias("ids"), (F.countDistinct("l_linestatus") > 1).alias("mixed"))
    out = t.orders.select("o_orderkey").join(each, "o_orderkey", "left")
    return out.select("o_orderkey", "flag", "ids", F.coalesce("mixed", F.lit(False)).alias("mixed"))


@query("x11_coverage", "SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS urgent, count(DISTINCT o_orderpriority) >= 3 AS varied FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), (F.countDistinct("o_orderpriority") >= 3).alias("varied"))


