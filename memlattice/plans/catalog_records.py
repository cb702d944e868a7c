"""Registered queries: process records, bank and request statistics, topics, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlattice.operators import aggregates as agg
from memlattice.operators import lifecycle, processes, retrieval
from memlattice.plans import views
from memlattice.plans.registry import Tables, query

L, P, H = views.LINKS, views.POSTINGS, views.HITS


def records(t: Tables):
    """Documents as records of work: traces, episodes derived from some of them, patterns."""
    n, size = F.col("doc_id"), F.col("n_chars")
    pick = lambda values, k: F.get(F.array(*map(F.lit, values)), k.cast("int"))
    kind = F.when(n % 10 < 6, "trace").when(n % 10 < 9, "episode").otherwise("pattern")
    return t.documents.select(
        n.alias("record_id"), kind.alias("kind"), pick(["verified", "observed", "replicated", "generalized"], n % 4).alias("maturity"), pick(["correct", "failed", "recovered"], size % 3).alias("outcome"),
        F.when(kind == "episode", F.array(n - 6, n - 5)).alias("sources"), (size % 2 == 0).alias("verified"), F.array("source", "lang").alias("traits"), F.concat(F.lit("c"), (size % 3).cast("string")).alias("context"),
        pick(["shadow", "rolled_back", "canary", "active", None, "active", "active"], n % 7).alias("rollout_state"), pick(["deprecated", "revalidation_required", "watch", "stable", "stable"], n % 5).alias("drift_status"),
        F.concat(F.lit("x"), (size % 2).cast("string")).alias("experiment_id"), "text", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(n_chars % 365)").alias("updated_at"))


R = """(SELECT doc_id AS record_id, CASE WHEN doc_id % 10 < 6 THEN 'trace' WHEN doc_id % 10 < 9 THEN 'episode' ELSE 'pattern' END AS kind, (['verified', 'observed', 'replicated', 'generalized'])[doc_id % 4 + 1] AS maturity,
    (['correct', 'failed', 'recovered'])[n_chars % 3 + 1] AS outcome, CASE WHEN doc_id % 10 IN (6, 7, 8) THEN [doc_id - 6, doc_id - 5] END AS sources, n_chars % 2 = 0 AS verified, list_sort([source, lang]) AS traits, 'c' || n_chars % 3 AS context,
    (['shadow', 'rolled_back', 'canary', 'active', NULL, 'active', 'active'])[doc_id % 7 + 1] AS rollout_state, (['deprecated', 'revalidation_required', 'watch', 'stable', 'stable'])[doc_id % 5 + 1] AS drift_status, 'x' || n_chars % 2 AS experiment_id, text, TIMESTAMP '2024-01-01' + INTERVAL (n_chars % 365) DAY AS updated_at FROM documents)"""
_SETTLED = "maturity IN ('verified', 'replicated', 'generalized')"


@query("x5_promoted_episodes", f"SELECT record_id FROM {R} WHERE kind = 'trace' AND verified AND outcome IN ('correct', 'recovered', 'partially_correct') AND record_id NOT IN (SELECT unnest(sources) FROM {R} WHERE kind = 'episode')")
def _(t):
    return processes.promotable_traces(records(t)).select("record_id")


@query("x5_promoted_patterns", f"""SELECT array_to_string(traits, ',') AS traits, array_to_string(list(record_id ORDER BY record_id), ',') AS members, count(*) AS n_members, count(DISTINCT context) AS n_contexts,
    CASE WHEN count(DISTINCT outcome) = 1 THEN min(outcome) END AS outcome FROM {R} r WHERE kind = 'episode' AND {_SETTLED} GROUP BY r.traits HAVING count(*) >= 2 AND count(DISTINCT context) >= 2""")
def _(t):
    found = processes.promotable_patterns(records(t), ["outcome"])
    return found.select(F.array_join("traits", ",").alias("traits"), F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), "n_members", "n_contexts", "outcome")


_CHANGES = "(SELECT conv_id AS record_id, turn AS seq, (['stable', 'watch', 'deprecated', 'unheard', 'revalidation_required'])[(conv_id + turn) % 5 + 1] AS status, turn % 2 = 0 AS proved FROM conversations)"


@query("c17_drift", f"""WITH c AS (SELECT record_id, max_by(status, seq) AS status, bool_or(proved) AS proved FROM {_CHANGES} WHERE status <> 'unheard' AND (status <> 'stable' OR proved) GROUP BY 1)
    SELECT r.record_id, coalesce(c.status, r.drift_status) AS drift_status, r.verified OR coalesce(c.proved, false) AS verified FROM {R} r LEFT JOIN c USING (record_id)""")
def _(t):
    status = F.get(F.array(*map(F.lit, ["stable", "watch", "deprecated", "unheard", "revalidation_required"])), ((F.col("conv_id") + F.col("turn")) % 5).cast("int"))
    changes = t.conversations.select(F.col("conv_id").alias("record_id"), F.col("turn").alias("seq"), status.alias("status"), (F.col("turn") % 2 == 0).alias("verified"), F.lit("2025-01-01").cast("timestamp_ntz").alias("at"))
    return processes.with_drift(records(t), changes).select("record_id", "drift_status", "verified")


@query("c17_rollout", f"""WITH a AS (SELECT conv_id AS record_id, turn AS seq, (['shadow', 'canary', 'publish', 'rollback', 'unheard'])[(conv_id + turn) % 5 + 1] AS action, CASE WHEN turn % 3 <> 0 THEN 'e' || turn END AS experiment_id, conv_id % 2 = 0 AS passed FROM conversations),
    l AS (SELECT record_id, max_by({{'action': action, 'experiment_id': a.experiment_id}}, seq) AS last FROM a JOIN {R} r USING (record_id) WHERE (action IN ('shadow', 'canary') AND a.experiment_id IS NOT NULL) OR (action = 'publish' AND passed AND {_SETTLED}) OR action = 'rollback' GROUP BY 1)
    SELECT r.record_id, CASE WHEN last IS NULL THEN r.rollout_state ELSE CASE last.action WHEN 'publish' THEN 'active' WHEN 'rollback' THEN 'rolled_back' ELSE last.action END END AS rollout_state, CASE WHEN last IS NULL THEN r.experiment_id ELSE last.experiment_id END AS experiment_id FROM {R} r LEFT JOIN l USING (record_id)""")
def _(t):
    action = F.get(F.array(*map(F.lit, ["shadow", "canary", "publish", "rollback", "unheard"])), ((F.col("conv_id") + F.col("turn")) % 5).cast("int"))
    experiment = F.when(F.col("turn") % 3 != 0, F.concat(F.lit("e"), F.col("turn").cast("string")))
    actions = t.conversations.select(F.col("conv_id").alias("record_id"), F.col("turn").alias("seq"), action.alias("action"), experiment.alias("experiment_id"), (F.col("conv_id") % 2 == 0).alias("passed"), F.lit("2025-01-01").cast("timestamp_ntz").alias("at"))
    return processes.with_rollout(records(t), actions).select("record_id", "rollout_state", "experiment_id")


@query("x4_process_search", f"""WITH q AS (SELECT conv_id AS query_id, lower(text) AS low, CASE WHEN conv_id % 40 = 0 THEN 'en' END AS archetype, CASE WHEN conv_id % 60 = 0 THEN 'c1' END AS context, 'x0' AS experiment FROM conversations WHERE conv_id % 20 = 0 AND turn = 0),
    w AS (SELECT DISTINCT query_id, unnest(list_filter(string_split_regex(low, '\\s+'), lambda x: x <> '')) AS word FROM q),
    s AS (SELECT query_id, record_id, updated_at, count(*) AS score FROM w JOIN q USING (query_id) JOIN {R} r ON contains(lower(r.text), word)
        WHERE coalesce(rollout_state, 'active') NOT IN ('shadow', 'rolled_back') AND drift_status NOT IN ('deprecated', 'revalidation_required') AND {_SETTLED} AND (coalesce(rollout_state, 'active') <> 'canary' OR experiment_id = experiment)
        AND (archetype IS NULL OR list_contains(traits, archetype)) AND (q.context IS NULL OR q.context = r.context) GROUP BY ALL)
    SELECT query_id, record_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, updated_at, record_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 8""")
def _(t):
    asked = t.conversations.where("conv_id % 20 = 0 AND turn = 0").select(F.col("conv_id").alias("query_id"), "text", F.when(F.col("conv_id") % 40 == 0, "en").alias("archetype"), F.when(F.col("conv_id") % 60 == 0, "c1").alias("context"), F.lit("x0").alias("experiment_id"))
    return processes.search(records(t), asked, 8)


_UNITS = "(SELECT o_orderkey AS unit_id, o_orderpriority AS bank_id, CASE o_orderstatus WHEN 'F' THEN 'observation' WHEN 'O' THEN 'world' ELSE 'experience' END AS kind, o_custkey AS document_id, o_orderdate AS created_at, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS consolidated_at, CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate END AS failed_at FROM orders)"
_SHOWN = "array_to_string(list({k} || '=' || n ORDER BY {k}), ' ')"


@query("a18_bank_composite", f"""WITH u AS (SELECT * FROM {_UNITS}), l AS (SELECT bank_id, kind, link_type FROM {L} JOIN u ON from_unit = unit_id), o AS (SELECT l_shipmode AS bank_id, l_linestatus AS status FROM (SELECT o_orderpriority AS l_shipmode, l_linestatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey)),
    e AS (SELECT bank_id, CAST(sum(x) AS BIGINT) AS entity_edges FROM (SELECT bank_id, entity_id, least(count(*) - 1, 10) AS x FROM {P} JOIN u USING (unit_id) GROUP BY ALL) GROUP BY 1)
    SELECT bank_id, count(*) AS nodes, count(DISTINCT document_id) AS documents, count(*) FILTER (kind = 'observation') AS observations, max(created_at) AS last_write, max(consolidated_at) AS last_consolidated,
    count(*) FILTER (kind <> 'observation' AND consolidated_at IS NULL AND failed_at IS NULL) AS pending_consolidation, count(*) FILTER (kind <> 'observation' AND failed_at IS NOT NULL) AS failed_consolidation, min(entity_edges) AS entity_edges,
    (SELECT {_SHOWN.format(k='kind')} FROM (SELECT kind, count(*) AS n FROM u v WHERE v.bank_id = u.bank_id GROUP BY 1)) AS nodes_by_kind, (SELECT {_SHOWN.format(k='link_type')} FROM (SELECT link_type, count(*) AS n FROM l WHERE l.bank_id = u.bank_id GROUP BY 1)) AS links_by_type,
    (SELECT {_SHOWN.format(k='kind')} FROM (SELECT kind, count(*) AS n FROM l WHERE l.bank_id = u.bank_id GROUP BY 1)) AS links_by_kind, (SELECT {_SHOWN.format(k='b')} FROM (SELECT kind || '/' || link_type AS b, count(*) AS n FROM l WHERE l.bank_id = u.bank_id GROUP BY 1)) AS links_by_kind_and_type,
    (SELECT {_SHOWN.format(k='status')} FROM (SELECT status, count(*) AS n FROM o WHERE o.bank_id = u.bank_id GROUP BY 1)) AS operations_by_status FROM u JOIN e USING (bank_id) GROUP BY bank_id""")
def _(t):
    kind = F.when(F.col("o_orderstatus") == "F", "observation").when(F.col("o_orderstatus") == "O", "world").otherwise("experience")
    day = F.col("o_orderdate")
    units = t.orders.select(F.col("o_orderkey").alias("unit_id"), F.col("o_orderpriority").alias("bank_id"), kind.alias("kind"), F.col("o_custkey").alias("document_id"), day.alias("created_at"), F.when(F.col("o_orderkey") % 3 == 0, day).alias("consolidated_at"), F.when(F.col("o_orderkey") % 7 == 0, day).alias("failed_at"))
    operations = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderpriority").alias("bank_id"), F.col("l_linestatus").alias("status"))
    found = agg.bank_stats(units, views.links(t), views.postings(t), operations)
    shown = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), " ").alias(c)
    return found.select(*[shown(c) if c.endswith(("_kind", "_type", "_status")) else c for c in found.columns])


def _requests(period):
    days, unit = agg.PERIODS[period]
    sql = f"SELECT CAST(date_trunc('{unit}', ts) AS TIMESTAMP) AS bucket, event_type, count(*) AS n, count(*) FILTER (value > 50) AS failures FROM events WHERE ts > TIMESTAMP '2024-01-25 12:30:00' - INTERVAL {days} DAY AND ts <= TIMESTAMP '2024-01-25 12:30:00' GROUP BY ALL"
    query(f"a20_requests_{period}", sql)(lambda t: agg.request_stats(t.events, "ts", F.lit("2024-01-25 12:30:00").cast("timestamp_ntz"), period, "event_type", failed=F.col("value") > 50))


for _period in agg.PERIODS:
    _requests(_period)


@query("x8_topic_tree", """WITH m AS (SELECT o_orderkey AS unit_id, o_custkey AS document_id, o_orderdate AS created_at, o_orderdate + INTERVAL (o_orderkey % 9) DAY AS updated_at, c_nationkey AS leaf FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey % 6 <> 5),
    r AS (SELECT n_regionkey AS root, n_nationkey AS leaf FROM nation UNION SELECT 9, n_nationkey FROM nation WHERE n_nationkey < 4)
    SELECT CAST(leaf AS VARCHAR) AS topic_id, 'leaf' AS level, count(*) AS members, count(DISTINCT document_id) AS documents, min(created_at) AS start, max(updated_at) AS "end" FROM m WHERE leaf IS NOT NULL GROUP BY 1
    UNION ALL SELECT 'r' || root, 'root', count(*), count(DISTINCT document_id), min(created_at), max(updated_at) FROM m JOIN r USING (leaf) GROUP BY 1 UNION ALL SELECT 'pending', 'pending', count(*), count(DISTINCT document_id), min(created_at), max(updated_at) FROM m WHERE leaf IS NULL HAVING count(*) > 0""")
def _(t):
    end = F.col("o_orderdate") + F.make_dt_interval(days=(F.col("o_orderkey") % 9).cast("int"))
    members = t.orders.select(F.col("o_orderkey").alias("unit_id"), F.col("o_custkey").alias("document_id"), F.col("o_orderdate").alias("created_at"), end.alias("updated_at"))
    assignment = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("unit_id"), F.col("c_nationkey").alias("leaf"))
    leaves = t.nation.select(F.col("n_nationkey").alias("leaf")).where("leaf % 6 <> 5")
    roots = t.nation.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("root"), F.col("n_nationkey").alias("leaf"))
    return agg.topic_tree(members, assignment, leaves, roots.union(t.nation.where("n_nationkey < 4").select(F.lit("r9"), "n_nationkey")))


@query("x11_required_coverage", """WITH p AS (SELECT DISTINCT c_custkey AS query_id, (['dated', 'varied', 'urgent', 'unheard'])[c_custkey % 4 + 1] AS a, (['urgent', 'large', 'dated'])[c_custkey % 3 + 1] AS b FROM customer),
    d AS (SELECT query_id, a AS dimension FROM p UNION SELECT query_id, b FROM p), h AS (SELECT o_custkey AS query_id, count(DISTINCT o_orderdate) >= 2 AS dated, count(DISTINCT o_orderpriority) >= 3 AS varied, bool_or(o_orderpriority = '1-URGENT') AS urgent, max(o_totalprice) > 300000 AS large FROM orders GROUP BY 1),
    x AS (SELECT query_id, dimension, coalesce(CASE dimension WHEN 'dated' THEN dated WHEN 'varied' THEN varied WHEN 'urgent' THEN urgent WHEN 'large' THEN large END, false) AS ok FROM d LEFT JOIN h USING (query_id))
    SELECT query_id, coalesce(array_to_string(list(dimension ORDER BY dimension) FILTER (ok), ','), '') AS covered, coalesce(array_to_string(list(dimension ORDER BY dimension) FILTER (NOT ok), ','), '') AS missing, bool_and(ok) AS complete FROM x GROUP BY 1""")
def _(t):
    key = F.col("c_custkey")
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (key % len(values)).cast("int"))
    plan = t.customer.select(key.alias("query_id"), F.explode(F.array(pick(["dated", "varied", "urgent", "unheard"]), pick(["urgent", "large", "dated"]))).alias("dimension"))
    checks = {"dated": F.countDistinct("o_orderdate") >= 2, "varied": F.countDistinct("o_orderpriority") >= 3, "urgent": F.bool_or(F.col("o_orderpriority") == "1-URGENT"), "large": F.max("o_totalprice") > 300000}
    found = agg.coverage(t.orders.withColumnRenamed("o_custkey", "query_id"), plan, checks)
    return found.select("query_id", F.array_join("covered", ",").alias("covered"), F.array_join("missing", ",").alias("missing"), "complete")


@query("f23_backfilled", """WITH RECURSIVE o AS (SELECT c_nationkey AS query_id, c_custkey AS unit_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
    s AS (SELECT a.query_id, a.rank AS by_rank, b.rank FROM o a JOIN o b ON a.query_id = b.query_id AND b.unit_id % 3 <> 0 AND b.rank BETWEEN a.rank - 2 AND a.rank + 3 AND a.unit_id % 3 = 0),
    f AS (SELECT DISTINCT query_id, n, least(10, n) AS upto, 0 AS step FROM o UNION ALL SELECT f.query_id, f.n, least(f.n, 10 + (SELECT count(DISTINCT s.rank) FROM s WHERE s.query_id = f.query_id AND s.by_rank <= f.upto AND s.rank <= f.upto)), step + 1 FROM f WHERE step < 40),
    z AS (SELECT query_id, max(upto) AS upto FROM f GROUP BY 1)
    SELECT query_id, unit_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS rank, rank > 10 AS backfilled FROM o JOIN z USING (query_id) WHERE rank <= z.upto AND NOT EXISTS (SELECT 1 FROM s WHERE s.query_id = o.query_id AND s.rank = o.rank AND s.by_rank <= z.upto) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 10""")
def _(t):
    """Customers of a nation by balance; every third stands for those about it in the order."""
    order = retrieval.ranked(t.customer.select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("unit_id"), F.col("c_acctbal").alias("score")), ["query_id"], F.desc("score"), F.asc("unit_id"))
    near = order.select("query_id", F.col("unit_id").alias("obs_id"), F.explode(F.sequence(F.col("rank") - 2, F.col("rank") + 3)).alias("rank")).where("obs_id % 3 = 0")
    sources = near.join(order.select("query_id", "rank", "unit_id"), ["query_id", "rank"]).where("unit_id % 3 <> 0").select("obs_id", "unit_id")
    return retrieval.prefer_observations(order, sources, 10)


@query("c3_scopes_explicit", f"""WITH d AS (SELECT unit_id, CASE WHEN unit_id % 4 = 0 THEN NULL WHEN unit_id % 4 = 1 THEN [[kind, bank_id], [bank_id, kind], ['all']] WHEN unit_id % 4 = 2 THEN [[]] ELSE [] END AS scopes, tags FROM {views.DOCUMENTS})
    SELECT DISTINCT unit_id, array_to_string(list_sort(scope), ',') AS scope FROM (SELECT unit_id, unnest(coalesce(scopes, [coalesce(tags, [])])) AS scope FROM d)""")
def _(t):
    some = F.array(F.array("kind", "bank_id"), F.array("bank_id", "kind"), F.array(F.lit("all")))
    k, none = F.col("unit_id") % 4, F.array().cast("array<array<string>>")
    given = F.when(k == 1, some).when(k == 2, F.array(F.array().cast("array<string>"))).when(k == 3, none)
    return lifecycle.scopes(views.documents(t).withColumn("scopes", given), "explicit").select("unit_id", F.array_join("scope", ",").alias("scope"))
