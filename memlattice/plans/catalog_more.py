"""Registered queries: the remaining operators of every family."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlattice.functions import texts, times
from memlattice.functions.scoring import cosine
from memlattice.operators import aggregates as agg
from memlattice.operators import evidence, graph, lifecycle, retrieval
from memlattice.plans import views
from memlattice.plans.catalog_retrieval import vector_units
from memlattice.plans.registry import query
from memlattice.sources import files

D, E, L, P, H, S = views.DOCUMENTS, views.EVENTS, views.LINKS, views.POSTINGS, views.HITS, views.SEEDS


@query("f12_min_scores", f"SELECT query_id, unit_id FROM (SELECT query_id, unit_id, max(CASE WHEN arm = 'semantic' THEN 1.0 / rank ELSE 0 END) AS s, sum(1.0 / (60 + rank)) AS f FROM {H} GROUP BY 1, 2) WHERE s >= 0.05 AND f >= 0.02")
def _(t):
    semantic = F.max(F.when(F.col("arm") == "semantic", 1 / F.col("rank")).otherwise(0.0))
    both = views.hits(t).groupBy("query_id", "unit_id").agg(semantic.alias("s"), F.sum(1 / (60 + F.col("rank"))).alias("f"))
    return both.where("s >= 0.05 AND f >= 0.02").select("query_id", "unit_id")


@query("f14_documents_through_sources", "SELECT c_custkey AS unit_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '3-MEDIUM') OR c_mktsegment = 'BUILDING'")
def _(t):
    through = t.orders.where("o_orderpriority = '3-MEDIUM'").select(F.col("o_custkey").alias("unit_id"))
    direct = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("unit_id"))
    return t.customer.select(F.col("c_custkey").alias("unit_id")).join(through.union(direct).distinct(), "unit_id", "left_semi")


@query("j3_semi_join", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def _(t):
    wanted = t.customer.where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(wanted, "o_custkey", "left_semi").select("o_orderkey")


@query("j8_lateral_nearest", """SELECT from_unit, to_unit, weight FROM (SELECT *, row_number() OVER (PARTITION BY from_unit ORDER BY weight DESC, to_unit) AS r FROM (
    SELECT a.vec_id AS from_unit, b.vec_id AS to_unit, round(least(1.0, greatest(0.0, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS weight FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)) WHERE r <= 3""")
def _(t):
    return graph.semantic_links(vector_units(t), ["kind"], 3, 0.0).select("from_unit", "to_unit", "weight")


@query("j11_range_overlap", "SELECT a.event_id FROM events a WHERE a.ts <= TIMESTAMP '2024-01-20' AND a.ts + INTERVAL 2 DAY >= TIMESTAMP '2024-01-18'")
def _(t):
    low, high = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-18", "2024-01-20"))
    return t.events.where((F.col("ts") <= high) & (F.col("ts") + F.expr("INTERVAL 2 DAY") >= low)).select("event_id")


@query("a9_distinct_entities", f"SELECT unit_id, count(DISTINCT entity_id) AS shared FROM {P} GROUP BY 1")
def _(t):
    return views.postings(t).groupBy("unit_id").agg(F.countDistinct("entity_id").alias("shared"))


@query("w1_nearest_capped", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY abs(epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1996-01-01')), o_orderkey) AS r FROM orders) WHERE r <= 3")
def _(t):
    away = F.abs(times.micros(F.col("o_orderdate")) - times.micros(F.lit("1996-01-01").cast("timestamp_ntz")))
    return retrieval.ranked(t.orders, ["o_custkey"], away.asc(), F.asc("o_orderkey"), most=3).select("o_custkey", "o_orderkey")


@query("w4_top_links", f"SELECT from_unit, to_unit, weight FROM (SELECT *, row_number() OVER (PARTITION BY from_unit ORDER BY weight DESC, to_unit) AS r FROM (SELECT DISTINCT from_unit, to_unit, weight FROM {L})) WHERE r <= 20")
def _(t):
    return graph.cap_links(views.links(t).select("from_unit", "to_unit", "weight").distinct(), 20)


@query("w6_older_peers", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS place FROM orders")
def _(t):
    return retrieval.ranked(t.orders, ["o_custkey"], F.asc("o_orderdate"), F.asc("o_orderkey"), name="place").select("o_orderkey", "place")


@query("k1_top_of_each_arm", f"SELECT query_id, arm, unit_id FROM {H} WHERE rank <= 3")
def _(t):
    return views.hits(t).where("rank <= 3").select("query_id", "arm", "unit_id")


@query("k3_nulls_last", "SELECT event_id FROM events ORDER BY CASE WHEN value > 5 THEN value END DESC NULLS LAST, event_id LIMIT 60")
def _(t):
    return t.events.orderBy(F.when(F.col("value") > 5, F.col("value")).desc_nulls_last(), "event_id").limit(60).select("event_id")


@query("k4_offset_page", "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 40")
def _(t):
    return t.part.orderBy(F.desc("p_retailprice"), "p_partkey").offset(40).limit(20).select("p_partkey")


@query("k5_cheap_rank_cut", "SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY abs(p_size - 25), length(p_name), p_partkey) AS r FROM part) WHERE r <= 4")
def _(t):
    return retrieval.ranked(t.part, ["p_brand"], F.abs(F.col("p_size") - 25).asc(), F.length("p_name").asc(), F.asc("p_partkey"), most=4).select("p_brand", "p_partkey")


@query("k10_recall_depth", "SELECT n_nationkey, CAST(least(greatest(round(n_nationkey * 100 * 0.25), 20), 2000) AS BIGINT) AS depth FROM nation")
def _(t):
    return t.nation.select("n_nationkey", evidence.recall_depth(F.col("n_nationkey") * 100, 0.25).alias("depth"))


@query("u3_direct_and_inherited", f"SELECT unit_id, entity_id FROM {P} UNION SELECT o_custkey + 1000000000, entity_id FROM orders JOIN {P} p ON p.unit_id = o_orderkey")
def _(t):
    through = t.orders.select(F.col("o_orderkey").alias("unit_id"), (F.col("o_custkey") + 1000000000).alias("owner")).join(views.postings(t), "unit_id").select("owner", "entity_id")
    return views.postings(t).union(through).distinct()


_OBS = "(SELECT o_custkey AS obs, o_orderkey AS src FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))"


@query("r9_observation_expansion", f"""WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY unit_id DESC) AS r FROM {P}) WHERE r <= 200),
    seed AS (SELECT DISTINCT p2.entity_id FROM {_OBS} o JOIN {P} p2 ON p2.unit_id = o.src WHERE o.obs <= 3)
    SELECT o.obs AS unit_id, count(DISTINCT p.entity_id) AS shared FROM seed JOIN p USING (entity_id) JOIN {_OBS} o ON o.src = p.unit_id WHERE o.obs > 3 GROUP BY 1""")
def _(t):
    sources = t.orders.where("o_orderpriority IN ('1-URGENT', '2-HIGH')").select(F.col("o_custkey").alias("obs"), F.col("o_orderkey").alias("unit_id"))
    seeds = t.customer.where("c_custkey <= 3").select(F.lit(0).alias("query_id"), F.col("c_custkey").alias("unit_id"))
    found = evidence.observation_expansion(seeds, sources, views.postings(t))
    return found.select("unit_id", "shared")


@query("r12_temporal_pool", f"""WITH e AS (SELECT *, ts + CAST(unit_id % 72 AS INTEGER) * INTERVAL 1 HOUR AS ended FROM {E}) SELECT kind, unit_id FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY value DESC, unit_id) AS r FROM e WHERE ts <= TIMESTAMP '2024-01-12' AND ended >= TIMESTAMP '2024-01-10' AND value >= 0.1) WHERE r <= 60""")
def _(t):
    low, high = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-10", "2024-01-12"))
    ended = F.col("ts") + F.make_dt_interval(hours=(F.col("unit_id") % 72).cast("int"))
    pool = views.events(t).where(times.overlaps(F.col("ts"), ended, F.lit(None).cast("timestamp_ntz"), low, high) & (F.col("value") >= 0.1))
    return retrieval.ranked(pool, ["kind"], F.desc("value"), F.asc("unit_id"), most=60).select("kind", "unit_id")


@query("r13_coverage_pick", f"""WITH p AS (SELECT *, CAST(day(ts) % 8 AS INTEGER) AS bucket FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY value DESC, unit_id) AS k FROM {E}) WHERE k <= 60),
    q AS (SELECT *, row_number() OVER (PARTITION BY kind, bucket ORDER BY value DESC, unit_id) AS tier, count(*) OVER (PARTITION BY kind) AS n FROM p)
    SELECT kind, unit_id FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN n <= 10 THEN 0 ELSE tier END, value DESC, unit_id) AS r FROM q) WHERE r <= 10""")
def _(t):
    pool = retrieval.ranked(views.events(t), ["kind"], F.desc("value"), F.asc("unit_id"), most=60, name="k")
    return retrieval.coverage(pool, ["kind"], F.dayofmonth("ts") % 8, 10, "value").select("kind", "unit_id")


@query("r19_rerank_text", "SELECT event_id, '[Date: ' || strftime(ts, '%Y-%m-%d') || '] ' || CASE WHEN event_type <> 'view' THEN event_type || ': ' ELSE '' END || props AS text FROM events")
def _(t):
    context = F.when(F.col("event_type") != "view", F.col("event_type"))
    return t.events.select("event_id", evidence.rerank_text(F.col("props"), context, F.col("ts")).alias("text"))


@query("r27_anchor_adjustment", "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') THEN 0.18 WHEN contains(lower(p_type), 'brass') THEN -0.12 ELSE 0.0 END::DOUBLE AS adjustment FROM part")
def _(t):
    return t.part.select("p_partkey", evidence.anchor_adjustment(F.lower("p_type"), ["steel"], ["brass"]).alias("adjustment"))


@query("r28_recency_bonus", "SELECT event_id, round(0.10 * (epoch_us(ts) - min(epoch_us(ts)) OVER w) / greatest(max(epoch_us(ts)) OVER w - min(epoch_us(ts)) OVER w, 1) + CASE WHEN event_type = 'purchase' THEN 0.04 WHEN event_type = 'error' THEN -0.08 ELSE 0 END, 6) AS bonus FROM events WINDOW w AS (PARTITION BY user_id)")
def _(t):
    at, user = times.micros(F.col("ts")), Window.partitionBy("user_id")
    fresh = 0.10 * (at - F.min(at).over(user)) / F.greatest(F.max(at).over(user) - F.min(at).over(user), F.lit(1))
    valid = F.when(F.col("event_type") == "purchase", 0.04).when(F.col("event_type") == "error", -0.08).otherwise(0.0)
    return t.events.select("event_id", F.round(fresh + valid, 6).alias("bonus"))


_TOK = r"list_distinct(list_filter(string_split_regex(lower({c}), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> ''))"
_ASKED = "['small', 'ring', 'promo', 'large']"


@query("r29_lexical_cache", f"SELECT p_partkey, h AS hits, round(0.34 + 0.055 * h + 0.4 * h / 4.0 + CASE WHEN contains(lower(w), 'small ring') THEN 0.16 ELSE 0 END, 6) AS score FROM (SELECT *, len(list_intersect({_TOK.format(c='w')}, {_ASKED})) AS h FROM (SELECT *, p_name || ' ' || p_type AS w FROM part)) WHERE h >= 2")
def _(t):
    rows = t.part.withColumn("w", F.concat_ws(" ", "p_name", "p_type"))
    return evidence.lexical_search(rows, F.col("w"), ["small", "ring", "promo", "large"], "small ring").select("p_partkey", "hits", "score")


@query("r31_weighted_terms", "SELECT p_partkey, round(3.0 * (CASE WHEN contains(lower(p_type), 'steel') THEN 1 ELSE 0 END) + 0.55 * (CASE WHEN contains(lower(p_type), 'ste') THEN 1 ELSE 0 END) + 0.25 * (CASE WHEN contains(lower(p_type), 'st') THEN 1 ELSE 0 END) + CASE WHEN p_size > 25 THEN 6 ELSE 0 END, 6) AS score FROM part")
def _(t):
    weights = {"steel": 3.0, "ste": 0.55, "st": 0.25}
    return t.part.select("p_partkey", F.round(evidence.weighted_terms(F.lower("p_type"), weights) + F.when(F.col("p_size") > 25, 6.0).otherwise(0.0), 6).alias("score"))


@query("r33_hybrid_files", f"SELECT p_partkey, round(0.6 * len(list_intersect({_TOK.format(c='p_name')}, {_ASKED})) / 4.0 + 0.4 * greatest(0.0, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))), 6) AS score FROM part JOIN embeddings e ON e.vec_id = p_partkey CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def _(t):
    shared = F.size(F.array_intersect(texts.tokens(F.col("p_name")), F.array(*map(F.lit, ["small", "ring", "promo", "large"]))))
    asked = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))
    both = t.part.join(t.embeddings, F.col("vec_id") == F.col("p_partkey")).crossJoin(F.broadcast(asked))  # one row
    near = F.greatest(F.lit(0.0), cosine(F.col("embedding"), F.col("q")))
    return both.select("p_partkey", F.round(0.6 * shared / 4 + 0.4 * near, 6).alias("score"))


@query("r34_claims", r"""WITH k AS (SELECT lang AS slot, trim(regexp_replace(lower(text), '[ \t\n\r\f]+', ' ', 'g')) AS claim, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, doc_id AS authority FROM documents
        UNION ALL SELECT lang, trim(regexp_replace(lower(substring(text, 1, 60 + CAST(doc_id % 3 AS INTEGER) * 30)), '[ \t\n\r\f]+', ' ', 'g')), 7, doc_id FROM documents WHERE doc_id % 5 = 0),
    d AS (SELECT DISTINCT slot, claim FROM k),
    root AS (SELECT d.slot, d.claim, coalesce(arg_min(p.claim, length(p.claim)), d.claim) AS root FROM d LEFT JOIN d p ON p.slot = d.slot AND length(p.claim) >= 48 AND left(p.claim, 48) = left(d.claim, 48) AND starts_with(d.claim, p.claim) GROUP BY 1, 2)
    SELECT slot, md5(root) AS claim, min(tokens) AS tokens, max(authority) AS authority, count(*) AS n FROM k JOIN root USING (slot, claim) GROUP BY 1, 2""")
def _(t):
    rows = t.documents.select(F.col("lang").alias("slot"), F.col("text").alias("claim"), texts.token_estimate(F.col("text")).alias("tokens"), F.col("doc_id").alias("authority"))
    begun = t.documents.where("doc_id % 5 = 0").select("lang", F.substring("text", F.lit(1), (60 + F.col("doc_id") % 3 * 30).cast("int")), F.lit(7).cast("long"), "doc_id")
    return evidence.claims(rows.union(begun)).withColumn("claim", F.md5(F.col("claim").cast("binary")))


@query("r35_slot_coverage", "SELECT o_custkey, array_to_string(list_sort(list_filter(['1-URGENT', '2-HIGH', '5-LOW'], lambda x: NOT list_contains(list(DISTINCT o_orderpriority), x))), ',') AS missing FROM orders GROUP BY 1")
def _(t):
    held = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("covered"))
    return held.select("o_custkey", F.array_join(evidence.missing_slots(["1-URGENT", "2-HIGH", "5-LOW"], F.col("covered")), ",").alias("missing"))


@query("g5_batch_semantic_links", """SELECT a.vec_id AS from_unit, b.vec_id AS to_unit, round(least(1.0, greatest(0.0, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS weight FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) >= 0.25""")
def _(t):
    return graph.semantic_links(vector_units(t), ["kind"], None, 0.25).select("from_unit", "to_unit", "weight")


@query("g9_prune", f"SELECT 'entity' AS what, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'pair', count(*) FROM supplier WHERE NOT EXISTS (SELECT 1 FROM {P} a JOIN {P} b ON a.unit_id = b.unit_id WHERE a.entity_id = s_suppkey AND b.entity_id = s_suppkey + 1)")
def _(t):
    lone = graph.orphans(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
    stale = graph.stale_pairs(t.supplier.select(F.col("s_suppkey").alias("e1"), (F.col("s_suppkey") + 1).alias("e2")), views.postings(t), "unit_id", "entity_id")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return count(lone, "entity").union(count(stale, "pair"))


@query("g12_token_compatibility")
def _(t):
    """Names of parts that share a word, the second with a letter lost: which are alike word by word."""
    names = t.part.select(F.col("p_name").alias("a"), F.explode(texts.tokens(F.col("p_name"))).alias("w")).distinct()
    other = names.select(F.col("a").alias("b0"), "w")
    pairs = names.join(other, "w").select("a", F.regexp_replace("b0", "([a-z]{2})[a-z]", "$1").alias("b")).distinct()
    return evidence.token_compatible(pairs, "a", "b").where("compatible").select("a", "b")


@query("g16_canonical_pairs", "SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_partkey <> l_suppkey")
def _(t):
    return t.lineitem.where("l_partkey <> l_suppkey").select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).distinct()


@query("g18_causal_snapshot", f"SELECT DISTINCT from_unit, to_unit, weight FROM {L} WHERE link_type = 'caused_by' AND (from_unit IN (SELECT unit_id FROM {S}) OR to_unit IN (SELECT unit_id FROM {S}))")
def _(t):
    causes, gone = views.links(t).where("link_type = 'caused_by'"), views.seeds(t).select("unit_id").distinct()
    out = causes.join(gone.withColumnRenamed("unit_id", "from_unit"), "from_unit", "left_semi").select("from_unit", "to_unit", "weight")
    back = causes.join(gone.withColumnRenamed("unit_id", "to_unit"), "to_unit", "left_semi").select("from_unit", "to_unit", "weight")
    return out.union(back).distinct()


@query("g19_topic_assignment", """WITH m AS (SELECT c_nationkey AS leaf, n_regionkey AS root, c_custkey AS unit_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT root, count(*) AS members, count(DISTINCT leaf) AS leaves, array_to_string(list(unit_id ORDER BY r) FILTER (r <= 12), ',') AS samples FROM m GROUP BY 1""")
def _(t):
    leaf = t.nation.select(F.col("n_nationkey").alias("leaf"), F.col("n_regionkey").alias("root"))
    members = t.customer.select(F.col("c_nationkey").alias("leaf"), F.col("c_custkey").alias("unit_id"), F.col("c_acctbal").alias("weight"))
    return evidence.topics(members, leaf, 12).select("root", "members", "leaves", F.array_join(F.col("samples").cast("array<string>"), ",").alias("samples"))


@query("c2_mark_consolidated", "SELECT o_orderkey, CASE WHEN c_acctbal > 0 THEN TIMESTAMP '1998-01-01' END AS consolidated_at FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def _(t):
    done = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("done"))
    return t.orders.join(done, "o_custkey", "left").select("o_orderkey", F.when(F.col("done"), F.lit("1998-01-01").cast("timestamp_ntz")).alias("consolidated_at"))


@query("c4_inherited_fields", "SELECT o_custkey, min(o_orderdate) AS low, max(o_orderdate) AS high, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("low"), F.max("o_orderdate").alias("high"), F.count("*").alias("n"))


@query("c5_scope_counts", f"SELECT s.scope, count(d.unit_id) AS n FROM (SELECT 'en' AS scope UNION ALL SELECT 'src3' UNION ALL SELECT 'none') s LEFT JOIN (SELECT unit_id, unnest(tags) AS tag FROM {D}) d ON d.tag = s.scope GROUP BY 1")
def _(t):
    scopes = t.spark.createDataFrame([("en",), ("src3",), ("none",)], "scope string")
    each = views.documents(t).select("unit_id", F.explode("tags").alias("scope"))
    return scopes.join(each, "scope", "left").groupBy("scope").agg(F.count("unit_id").alias("n"))


@query("c7_dedup_probe", """WITH u AS (SELECT vec_id, label, embedding FROM embeddings UNION ALL SELECT vec_id + 1000000, label, embedding FROM embeddings WHERE vec_id % 7 = 0)
    SELECT from_unit, to_unit FROM (SELECT *, row_number() OVER (PARTITION BY from_unit ORDER BY w DESC, to_unit) AS r FROM (
    SELECT a.vec_id AS from_unit, b.vec_id AS to_unit, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS w FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE w >= 0.97) WHERE r <= 5""")
def _(t):
    units = vector_units(t)
    copies = units.where("unit_id % 7 = 0").withColumn("unit_id", F.col("unit_id") + 1000000)
    return graph.semantic_links(units.union(copies), ["kind"], 5, 0.97).select("from_unit", "to_unit")


@query("c10_stale_observations", """WITH o AS (SELECT DISTINCT l_suppkey AS obs_id, l_orderkey AS unit_id FROM lineitem), gone AS (SELECT o_orderkey AS unit_id FROM orders WHERE o_totalprice > 499000),
    stale AS (SELECT DISTINCT obs_id FROM o JOIN gone USING (unit_id))
    SELECT 'delete' AS what, obs_id AS id FROM stale UNION ALL SELECT DISTINCT 'requeue', unit_id FROM o JOIN stale USING (obs_id) WHERE unit_id NOT IN (SELECT unit_id FROM gone)""")
def _(t):
    observations = t.lineitem.select(F.col("l_suppkey").alias("obs_id"), F.col("l_orderkey").alias("unit_id")).distinct()
    gone = t.orders.where("o_totalprice > 499000").select(F.col("o_orderkey").alias("unit_id"))
    stale, again = lifecycle.without_sources(observations, gone)
    return stale.select(F.lit("delete").alias("what"), F.col("obs_id").alias("id")).union(again.select(F.lit("requeue"), "unit_id"))


@query("c12_staleness", """WITH s AS (SELECT DISTINCT user_id, TIMESTAMP '2024-01-01' + CAST(user_id % 31 AS INTEGER) * INTERVAL 1 DAY AS seen FROM events) SELECT user_id, coalesce(max(ts) > seen, false) AS stale FROM s LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'purchase') USING (user_id) GROUP BY user_id, seen""")
def _(t):
    seen = (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("user_id") % 31).cast("int"))).alias("seen")
    models = t.events.select("user_id").distinct().select("user_id", seen)
    return lifecycle.stale_scopes(models, t.events.where("event_type = 'purchase'"), "user_id", "ts")


@query("c16_due_refreshes", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def _(t):
    busy = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.where("c_mktsegment = 'AUTOMOBILE'").join(busy, "c_custkey", "left_anti").select("c_custkey")


def _operations(t):
    """A conversation's turns as operations of every kind on one of four sections."""
    op = F.get(F.array(*map(F.lit, ["add_section", "append_block", "insert_block", "append_block", *evidence.OPERATIONS])), (F.abs(F.xxhash64("conv_id", "turn")) % 12).cast("int"))
    number = lambda label, n: F.concat(F.lit("b"), (F.abs(F.xxhash64("turn", "conv_id", F.lit(label))) % n + 1).cast("string"))
    section = F.concat(F.lit("s"), (F.abs(F.xxhash64("turn", F.lit("section"))) % 2).cast("string"))
    start = t.conversations.select(F.col("conv_id").alias("doc_id"), F.explode(F.array(F.lit(-2), F.lit(-1))).alias("seq")).distinct()
    start = start.select("doc_id", "seq", F.lit("add_section").alias("op"), F.concat(F.lit("s"), (F.col("seq") + 2).cast("string")).alias("section"), F.lit(None).cast("string").alias("block"), F.lit(None).cast("string").alias("after"), F.lit("First").alias("text"))
    after = F.when(op == "insert_block", F.when(F.col("turn") % 2 == 0, number("after", 3)))
    return start.union(t.conversations.select("conv_id", "turn", op, section, number("block", 4), after, "text"))


@query("c14_document_operations")
def _(t):
    return evidence.apply_operations(_operations(t)).select("doc_id", "place", "section", F.md5(F.array_join("blocks", "|").cast("binary")).alias("blocks"), "applied", "skipped")


@query("t5_dirty_batch", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 50")
def _(t):
    return t.orders.where("o_orderstatus = 'P'").orderBy("o_orderdate", "o_orderkey").limit(50).select("o_orderkey")


@query("t6_since_watermark", "SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-25'")
def _(t):
    return t.events.where(times.updated_within(F.col("ts"), F.lit("2024-01-25").cast("timestamp_ntz"))).select("event_id", "ts")


@query("t8_terminal_pruning", """WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey - o_orderkey % 3 END AS parent, o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderkey % 3 = 0) AS open, o_orderdate AS ended FROM orders),
    c AS (SELECT parent AS id, count(*) FILTER (open) AS n, count(*) AS children FROM t WHERE parent IS NOT NULL GROUP BY 1)
    SELECT id AS operation_id, CASE WHEN open THEN 'cancelled' ELSE 'pruned' END AS action FROM t LEFT JOIN c USING (id) WHERE (NOT open AND ended < TIMESTAMP '1997-01-01' AND coalesce(n, 0) = 0) OR (open AND children > 0 AND n = 0)""")
def _(t):
    open_ = (F.col("o_orderstatus") == "P") | ((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 3 == 0))
    parent = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") - F.col("o_orderkey") % 3)
    tasks = t.orders.select(F.col("o_orderkey").alias("operation_id"), parent.alias("parent_id"), F.when(open_, "pending").otherwise("completed").alias("status"), F.col("o_orderdate").alias("updated_at"))
    return lifecycle.prunable(tasks, F.lit("1997-01-01").cast("timestamp_ntz"))


@query("t9_retry_state", """WITH t AS (SELECT o_orderkey, o_orderstatus AS s, CAST(o_orderkey % 5 AS INTEGER) AS tries FROM orders)
    SELECT o_orderkey, CASE WHEN s = 'F' THEN 'completed' WHEN s = 'P' OR tries < 3 THEN 'pending' ELSE 'failed' END AS status, tries + CASE WHEN s = 'O' AND tries < 3 THEN 1 ELSE 0 END AS retry_count,
    CASE WHEN s = 'O' AND tries < 3 THEN TIMESTAMP '1998-01-01' + CAST(60 * pow(2, tries) AS INTEGER) * INTERVAL 1 SECOND WHEN s = 'P' THEN TIMESTAMP '1998-02-01' END AS next_retry_at FROM t""")
def _(t):
    outcome = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "defer").otherwise("error")
    tasks = t.orders.select("o_orderkey", outcome.alias("outcome"), (F.col("o_orderkey") % 5).cast("int").alias("retry_count"), F.lit("processing").alias("status"), F.lit("1998-02-01").cast("timestamp_ntz").alias("defer_until"))
    return lifecycle.next_state(tasks, F.lit("1998-01-01").cast("timestamp_ntz"), 3).select("o_orderkey", "status", "retry_count", "next_retry_at")


@query("t10_outbox", "SELECT md5(text) AS key, min(doc_id) AS first FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy(F.md5(F.col("text").cast("binary")).alias("key")).agg(F.min("doc_id").alias("first"))


@query("x1_transcript_increment", """WITH l AS (SELECT conv_id AS source, turn, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", text, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT NULL OR conv_id % 2 = 0 AS complete FROM conversations)
    SELECT source, "offset", turn FROM l WHERE complete AND NOT (turn < 2 AND source % 5 <> 0)""")
def _(t):
    order = Window.partitionBy("conv_id").orderBy("turn")
    before = F.coalesce(F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    complete = F.lead("turn").over(order).isNotNull() | (F.col("conv_id") % 2 == 0)
    lines = t.conversations.select(F.col("conv_id").alias("source"), "turn", before.cast("long").alias("offset"), F.col("text").alias("content"), complete.alias("complete"))
    changed = F.when(F.col("source") % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    seen = lines.where("turn < 2").select("source", "offset", F.sha2(changed.cast("binary"), 256).alias("content_hash"))
    return lifecycle.transcript_increment(lines, seen).select("source", "offset", "turn")


@query("x3_context_search", f"SELECT p_partkey, h + 2 * th AS score FROM (SELECT p_partkey, len(list_intersect({_TOK.format(c='p_type')}, {_ASKED})) AS h, len(list_intersect({_TOK.format(c='p_name')}, {_ASKED})) AS th FROM part) WHERE h + th > 0 ORDER BY score DESC, th DESC, p_partkey LIMIT 20")
def _(t):
    return evidence.context_search(t.part, F.col("p_type"), F.col("p_name"), ["small", "ring", "promo", "large"], "p_partkey", 20)


@query("x4_record_search", "SELECT event_id, (CASE WHEN contains(props, '1') THEN 1 ELSE 0 END) + (CASE WHEN contains(props, '7') THEN 1 ELSE 0 END) AS score FROM events WHERE event_type IN ('click', 'view') AND (contains(props, '1') OR contains(props, '7')) ORDER BY score DESC, ts, event_id LIMIT 50")
def _(t):
    open_ = t.events.where(F.col("event_type").isin("click", "view"))
    scored = open_.withColumn("score", evidence.terms_in(F.col("props"), ["1", "7"])).where("score > 0")
    return scored.orderBy(F.desc("score"), "ts", "event_id").limit(50).select("event_id", "score")


@query("x6_memory_packet")
def _(t):
    rows = t.conversations.select(F.col("conv_id").alias("packet"), F.col("role").alias("claim"), F.col("turn").alias("priority"), "text", F.array(F.col("turn")).alias("evidence"))
    return evidence.packets(rows, 400)


@query("x7_samples")
def _(t):
    rows = t.embeddings.select(F.col("label").alias("topic"), F.col("vec_id").alias("unit_id"), F.col("vec_id").alias("at"), "embedding")
    return evidence.diverse_samples(rows, 6)


@query("x12_structured_operations")
def _(t):
    found = evidence.apply_operations(_operations(t))
    return found.groupBy("doc_id").agg(F.count("section").alias("sections"), F.sum(F.size("blocks")).alias("blocks"), F.max("applied").alias("applied"), F.max("skipped").alias("skipped"))


@query("s12_layered_sources", "SELECT c_custkey AS id, 'c' AS layer FROM customer UNION ALL SELECT s_suppkey, 's' FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)")
def _(t):
    one = lambda df, key, name: df.select(F.col(key).alias("id"), F.lit(name).alias("layer"))
    return files.layered("id", one(t.customer, "c_custkey", "c"), one(t.supplier, "s_suppkey", "s"))


@query("s13_log_tail", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 30")
def _(t):
    return files.tail(t.events, "event_id", 30).select("event_id")


@query("s14_export_nesting", "SELECT o_orderkey, CAST(len(list(l_linenumber)) AS INTEGER) AS lines, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(t):
    nested = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("lines"))
    total = F.aggregate("lines", F.lit(0.0), lambda s, x: s + x["l_quantity"])
    return t.orders.select("o_orderkey").join(nested, "o_orderkey").select("o_orderkey", F.size("lines").alias("lines"), total.alias("quantity"))


@query("s15_id_remap", "SELECT o_orderkey, coalesce(s_suppkey + 500000, o_custkey) AS owner FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey")
def _(t):
    ids = t.supplier.select(F.col("s_suppkey").alias("old"), (F.col("s_suppkey") + 500000).alias("new"))
    return files.remapped(t.orders.select("o_orderkey", F.col("o_custkey").alias("owner")), "owner", ids).select("o_orderkey", "owner")


@query("s17_parallel_arrays", "SELECT l_orderkey, l_suppkey, l_linenumber FROM lineitem")
def _(t):
    packed = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_suppkey", "l_linenumber")).alias("r"))
    packed = packed.select(F.transform("r", lambda x: x["l_suppkey"]).alias("l_suppkey"), F.transform("r", lambda x: x["l_linenumber"]).alias("l_linenumber"), F.expr("transform(r, x -> l_orderkey)").alias("l_orderkey"))
    return files.from_arrays(packed, "l_orderkey", "l_suppkey", "l_linenumber")


@query("s18_link_insert", f"SELECT DISTINCT from_unit, to_unit, link_type FROM {L} WHERE from_unit IN (SELECT p_partkey FROM part) AND link_type <> 'semantic'")
def _(t):
    units = t.part.select(F.col("p_partkey").alias("unit_id"))
    new = views.links(t).select("from_unit", "to_unit", "link_type")
    return files.insert_links(new.where("link_type = 'semantic'"), new, units)


@query("s19_chunk_upsert", "SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM (SELECT DISTINCT conv_id FROM conversations)")
def _(t):
    old = t.conversations.select("conv_id").distinct().withColumn("version", F.lit(1))
    return files.upsert(old, old.where("conv_id % 3 = 0").withColumn("version", F.lit(2)), ["conv_id"], "version")


@query("s20_signed_outbox", "SELECT event_id, sha256(unhex(concat('373925', repeat('5C', 61))) || unhex(sha256(unhex(concat('5D534F', repeat('36', 61))) || encode(props)))) AS signature FROM events")
def _(t):
    return files.signed_outbox(t.events.select("event_id", "props"), F.col("props"), "key").select("event_id", "signature")


@query("s21_content_archive", "SELECT DISTINCT sha256(text) AS address FROM documents")
def _(t):
    return files.archived(t.documents, "text").select("address")


@query("a19_backlog_by_bank", "SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def _(t):
    return agg.count_by(t.orders, "o_custkey", "o_orderstatus")


@query("t12_cached_stats", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def _(t):
    return agg.count_by(t.documents, "lang", "source")


@query("x9_partition_source", "SELECT conv_id, episode, count(*) AS turns FROM (SELECT conv_id, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS episode FROM conversations) GROUP BY ALL")
def _(t):
    cut = lifecycle.episodes(t.conversations, ["conv_id"], "turn", F.col("role") == "user")
    return cut.groupBy("conv_id", "episode").agg(F.count("*").alias("turns"))


@query("date_offsets", r"SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '\byesterday\b|\blast night\b') THEN -1 WHEN regexp_matches(lower(text), '\btoday\b|\bthis morning\b|\btonight\b') THEN 0 WHEN regexp_matches(lower(text), '\btomorrow\b') THEN 1 WHEN regexp_matches(lower(text), '\blast week\b') THEN -7 WHEN regexp_matches(lower(text), '\bnext week\b') THEN 7 WHEN regexp_matches(lower(text), '\blast month\b') THEN -30 WHEN regexp_matches(lower(text), '\bnext month\b') THEN 30 END AS days FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", times.infer_offset(F.col("text")).alias("days"))
