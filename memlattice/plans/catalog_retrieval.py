"""Registered queries: retrieval arms, fusion, graph expansion, entities, hybrid recall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.functions.scoring import cosine, graph_score
from memlattice.operators import entities, evidence, graph, retrieval, vectors
from memlattice.plans import recall, views
from memlattice.plans.registry import Tables, query
from memlattice.storage import settled

#: Lists of the inverted file, and those that a query looks at.
LISTS, PROBES = 32, 12

H, L, P, S = views.HITS, views.LINKS, views.POSTINGS, views.SEEDS


def vector_units(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("unit_id"), F.col("label").alias("kind"), "embedding")


def vector_queries(t: Tables) -> DataFrame:
    """The query set of searches: every row whose id is divisible by 20."""
    return t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


_COS = "round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(u.embedding AS DOUBLE[])), 6)"


def _semantic(most: int, floor: float) -> str:
    return f"""SELECT query_id, kind, unit_id, score, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, unit_id) AS rank FROM (
            SELECT q.vec_id AS query_id, u.label AS kind, u.vec_id AS unit_id, {_COS} AS score FROM embeddings q CROSS JOIN embeddings u WHERE q.vec_id % 20 = 0)
        WHERE score >= {floor}) WHERE rank <= {most}"""


@query("r2_semantic_topk", _semantic(5, 0.0))
def _(t):
    found = retrieval.semantic(vector_queries(t), vector_units(t), 5, 0.0, digits=6)
    return found.select("query_id", "kind", "unit_id", "score", "rank")


@query("k2_vector_topk", f"SELECT query_id, unit_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS r FROM (SELECT q.vec_id AS query_id, u.vec_id AS unit_id, {_COS} AS score FROM embeddings q CROSS JOIN embeddings u WHERE q.vec_id % 20 = 0)) WHERE r <= 20")
def _(t):
    return retrieval.semantic(vector_queries(t), vector_units(t), 20, -1.0, keys=(), digits=6).select("query_id", "unit_id", "score")


@query("r2_inverted_file")
def _(t):
    held = vectors.centroids(vector_units(t), LISTS)
    return vectors.search(vector_queries(t), vectors.index(vector_units(t), held, 2), held, 10, PROBES, digits=6).select("query_id", "unit_id", "score", "rank")


@query("r5_graph_seeds", _semantic(2, 0.3).replace("SELECT query_id, kind, unit_id, score, CAST(rank AS INTEGER) AS rank", "SELECT query_id, unit_id"))
def _(t):
    return retrieval.semantic(vector_queries(t), vector_units(t), 2, 0.3, digits=6).select("query_id", "unit_id")


@query("f11_similarity_floor", f"SELECT q.vec_id AS query_id, u.vec_id AS unit_id FROM embeddings q CROSS JOIN embeddings u WHERE q.vec_id % 20 = 0 AND {_COS} >= 0.2")
def _(t):
    return retrieval.nearest(vector_queries(t), vector_units(t), None, 0.2, digits=6).select("query_id", "unit_id")


@query("r32_zero_guarded_cosine", f"SELECT u.vec_id, {_COS} AS similarity FROM embeddings q JOIN embeddings u ON u.vec_id = q.vec_id + 1")
def _(t):
    a = t.embeddings.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("a"))
    both = a.join(t.embeddings, "vec_id")
    return both.select("vec_id", F.round(cosine(F.col("a"), F.col("embedding")), 6).alias("similarity"))


_TERMS = r"""(SELECT unit_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '')) AS term FROM (SELECT doc_id AS unit_id, text FROM documents))"""
_QUERIES = r"(SELECT conv_id AS query_id, text FROM conversations WHERE turn = 0 AND conv_id % 20 = 0)"
_QTERMS = rf"""(SELECT query_id, term, min(pos) AS pos FROM (SELECT query_id, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM (SELECT query_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '') AS w FROM {_QUERIES})) GROUP BY 1, 2)"""
_SELECTED = f"""(SELECT query_id, term, pos, df FROM (SELECT q.*, coalesce(d.df, 0) AS df, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(d.df, 0), pos) AS r FROM {_QTERMS} q LEFT JOIN (SELECT term, count(DISTINCT unit_id) AS df FROM {_TERMS} GROUP BY 1) d USING (term)) WHERE r <= 8)"""


def text_units(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("unit_id"), "text")


def text_queries(t: Tables) -> DataFrame:
    return t.conversations.where("turn = 0 AND conv_id % 20 = 0").select(F.col("conv_id").alias("query_id"), "text")


def chosen_terms(t: Tables) -> DataFrame:
    return retrieval.selective_terms(text_queries(t), retrieval.document_frequencies(text_units(t), wanted=retrieval.query_terms(text_queries(t))), most=8)


@query("r4_document_frequencies", f"SELECT term, count(DISTINCT unit_id) AS df FROM {_TERMS} GROUP BY 1")
def _(t):
    return retrieval.document_frequencies(text_units(t))


@query("r4_selective_terms", f"SELECT query_id, term, CAST(pos AS INTEGER) AS pos, df FROM {_SELECTED}")
def _(t):
    return chosen_terms(t)


_BM25 = f"""(SELECT query_id, unit_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
    FROM (SELECT unit_id, term, count(*) AS tf FROM {_TERMS} GROUP BY 1, 2) c
    JOIN (SELECT term, count(DISTINCT unit_id) AS df FROM {_TERMS} GROUP BY 1) d USING (term)
    JOIN (SELECT unit_id, count(*) AS len FROM {_TERMS} GROUP BY 1) l USING (unit_id)
    JOIN (SELECT query_id, term FROM {_SELECTED}) q USING (term)
    CROSS JOIN (SELECT count(*) AS n FROM documents) CROSS JOIN (SELECT (SELECT count(*) FROM {_TERMS}) / count(*) AS avg_len FROM documents)
    GROUP BY 1, 2)"""


@query("r3_keyword_topk", f"SELECT query_id, unit_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM {_BM25} WHERE score > 0) WHERE rank <= 10")
def _(t):
    return retrieval.keyword(chosen_terms(t), text_units(t), 10, counted=True).select("query_id", "unit_id", "score", "rank")


@query("r16_rrf_fusion", f"SELECT query_id, unit_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place, unit_id) AS INTEGER) AS rank FROM (SELECT query_id, unit_id, round(sum(1 / (60.0::DOUBLE + rank)), 6) AS score, min(arm_no * 1000 + rank) AS place FROM {H} GROUP BY 1, 2)")
def _(t):
    return retrieval.rrf(views.hits(t)).select("query_id", "unit_id", "score", "rank")


@query("r17_interleave_fusion", f"SELECT query_id, unit_id, CAST(row_number() OVER w AS INTEGER) AS rank, count(*) OVER (PARTITION BY query_id) - row_number() OVER w + 1 AS score FROM (SELECT query_id, unit_id, min(rank * 10 + arm_no) AS place FROM {H} GROUP BY 1, 2) WINDOW w AS (PARTITION BY query_id ORDER BY place, unit_id)")
def _(t):
    return retrieval.interleave(views.hits(t)).select("query_id", "unit_id", "rank", "score")


_BOOST = f"(SELECT query_id, unit_id, round(sum(CASE arm WHEN 'semantic' THEN 3.0 WHEN 'graph' THEN 6.0 ELSE 1.0 END::DOUBLE / (60.0 + rank)), 6) AS score, round(sum(CASE arm WHEN 'semantic' THEN 0.2 WHEN 'graph' THEN 0.5 ELSE 0.0 END::DOUBLE / rank), 6) AS additive FROM {H} GROUP BY 1, 2)"


@query("r18_boosted_rrf", f"SELECT query_id, unit_id, score, additive, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS INTEGER) AS rank FROM {_BOOST}")
def _(t):
    return retrieval.boosted(views.hits(t), {"semantic": "medium", "graph": "high"})


@query("k7_rerank_cap", f"SELECT query_id, unit_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS r FROM {_BOOST}) WHERE r <= 15")
def _(t):
    return retrieval.boosted(views.hits(t), {"semantic": "medium", "graph": "high"}, most=15).select("query_id", "unit_id")


@query("r20_normalized_reranker", f"SELECT query_id, unit_id, round(CASE WHEN min(raw / 5000) OVER w >= 0 AND max(raw / 5000) OVER w <= 1 THEN raw / 5000 ELSE 1 / (1 + exp(-raw / 5000)) END, 6) AS ce FROM {H} WHERE arm_no = 1 WINDOW w AS (PARTITION BY query_id)")
def _(t):
    raw = views.hits(t).where("arm_no = 1").withColumn("raw", F.col("raw") / 5000)
    return retrieval.normalized_reranker(raw).select("query_id", "unit_id", F.round("ce", 6).alias("ce"))


_ENTITY = f"""(SELECT query_id, p.unit_id, count(DISTINCT p.entity_id) AS shared FROM (SELECT DISTINCT s.query_id, p.entity_id FROM {S} s JOIN {P} p USING (unit_id)) e
    JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY unit_id DESC) AS r FROM {P}) WHERE r <= 200) p USING (entity_id)
    WHERE NOT EXISTS (SELECT 1 FROM {S} s2 WHERE s2.query_id = e.query_id AND s2.unit_id = p.unit_id) GROUP BY 1, 2)"""


@query("r6_entity_expansion", f"SELECT query_id, unit_id, shared FROM {_ENTITY}")
def _(t):
    return retrieval.entity_expansion(views.seeds(t), views.postings(t))


_WAYS = f"(SELECT from_unit AS seed, to_unit AS unit_id, weight, link_type FROM {L} UNION ALL SELECT to_unit, from_unit, weight, link_type FROM {L})"
_SEM = f"(SELECT s.query_id, w.unit_id, max(w.weight) AS weight FROM {S} s JOIN {_WAYS} w ON w.seed = s.unit_id WHERE link_type = 'semantic' AND NOT EXISTS (SELECT 1 FROM {S} x WHERE x.query_id = s.query_id AND x.unit_id = w.unit_id) GROUP BY 1, 2)"
_CAUSE = f"(SELECT s.query_id, l.to_unit AS unit_id, max(l.weight) AS weight FROM {S} s JOIN {L} l ON l.from_unit = s.unit_id WHERE link_type = 'caused_by' GROUP BY 1, 2)"


def _links(t: Tables, kind: str) -> DataFrame:
    return views.links(t).where(F.col("link_type") == kind)


@query("r7_semantic_expansion", f"SELECT query_id, unit_id, weight FROM {_SEM}")
def _(t):
    return retrieval.link_expansion(views.seeds(t), _links(t, "semantic"))


@query("r8_causal_expansion", f"SELECT query_id, unit_id, weight FROM {_CAUSE}")
def _(t):
    return retrieval.link_expansion(views.seeds(t), _links(t, "caused_by"), both=False, keep_seeds=True)


@query("r10_graph_merge", f"SELECT query_id, unit_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS r FROM (SELECT query_id, unit_id, round(tanh(0.5 * coalesce(max(e), 0)) + coalesce(max(s), 0) + coalesce(max(c), 0), 6) AS score FROM (SELECT query_id, unit_id, CAST(shared AS DOUBLE) AS e, NULL::DOUBLE AS s, NULL::DOUBLE AS c FROM {_ENTITY} UNION ALL SELECT query_id, unit_id, NULL, weight, NULL FROM {_SEM} UNION ALL SELECT query_id, unit_id, NULL, NULL, weight FROM {_CAUSE}) GROUP BY 1, 2)) WHERE r <= 50")
def _(t):
    seeds = views.seeds(t)
    merged = retrieval.graph_merge(retrieval.entity_expansion(seeds, views.postings(t)), retrieval.link_expansion(seeds, _links(t, "semantic")), retrieval.link_expansion(seeds, _links(t, "caused_by"), both=False, keep_seeds=True), 50)
    return merged.select("query_id", "unit_id", "score")


@query("r11_graph_without_entities", f"SELECT query_id, unit_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS r FROM (SELECT query_id, unit_id, round(coalesce(max(s), 0) + coalesce(max(c), 0), 6) AS score FROM (SELECT query_id, unit_id, weight AS s, NULL::DOUBLE AS c FROM {_SEM} UNION ALL SELECT query_id, unit_id, NULL, weight FROM {_CAUSE}) GROUP BY 1, 2)) WHERE r <= 50")
def _(t):
    arm = retrieval.graph_arm(views.seeds(t), views.postings(t), _links(t, "semantic"), _links(t, "caused_by"), 50, expand_entities=False)
    return arm.select("query_id", "unit_id", "score")


@query("r10_graph_score", "SELECT n, round(tanh(0.5 * n), 6) AS score FROM (SELECT c_nationkey AS n FROM customer GROUP BY 1)")
def _(t):
    return t.customer.select(F.col("c_nationkey").alias("n")).distinct().select("n", F.round(graph_score(F.col("n"), F.lit(0.0), F.lit(0.0)), 6).alias("score"))


@query("r15_temporal_spreading")
def _(t):
    entries = views.seeds(t).withColumn("score", F.lit(1.0))
    return retrieval.spread(entries, views.links(t).select("from_unit", "to_unit", "weight"))


@query("g4_semantic_links", """SELECT from_unit, to_unit, weight FROM (SELECT *, row_number() OVER (PARTITION BY from_unit ORDER BY weight DESC, to_unit) AS r FROM (
    SELECT a.vec_id AS from_unit, b.vec_id AS to_unit, round(least(1.0, greatest(0.0, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS weight FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE weight >= 0.3) WHERE r <= 10""")
def _(t):
    return graph.semantic_links(vector_units(t), ["kind"], 10, 0.3).select("from_unit", "to_unit", "weight")


def _names(t: Tables) -> tuple[DataFrame, DataFrame]:
    mentions = t.supplier.select(F.col("s_suppkey").alias("mention_id"), F.col("s_name").alias("name"))
    return mentions, t.part.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("canonical_name"))


def _gram_sql(table: str, key: str, name: str) -> str:
    return rf"(SELECT DISTINCT {key} AS k, unnest(list_transform(range(1, len('  ' || w || ' ') - 1), lambda i: substring('  ' || w || ' ', CAST(i AS INTEGER), 3))) AS g FROM (SELECT {key}, unnest(list_filter(string_split_regex(lower({name}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS w FROM {table}))"


@query("j16_trigram_match", f"""WITH m AS (SELECT k, g, count(*) OVER (PARTITION BY k) AS n FROM {_gram_sql('part', 'p_partkey', 'p_name')}), x AS (SELECT a.k AS a, b.k AS b, round(count(*) / (a.n + b.n - count(*)), 6) AS similarity FROM m a JOIN m b ON a.g = b.g GROUP BY a.k, b.k, a.n, b.n)
    SELECT a AS mention_id, b AS entity_id, similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS rank FROM x WHERE similarity >= 0.15) WHERE rank <= 200""")
def _(t):
    _, parts = _names(t)
    mentions = parts.select(F.col("entity_id").alias("mention_id"), F.col("canonical_name").alias("name"))
    return entities.trigram_matches(mentions, parts, 0.15, 200)


@query("g14_exact_names", "SELECT s_suppkey AS mention_id, c_custkey AS entity_id FROM supplier JOIN customer ON lower(replace(s_name, 'Supplier', 'Customer')) = lower(c_name)")
def _(t):
    mentions = t.supplier.select(F.col("s_suppkey").alias("mention_id"), F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("name"))
    found = entities.exact_names(mentions, t.customer.select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("canonical_name")))
    return found.select("mention_id", "entity_id")


@query("g13_entity_resolution")
def _(t):
    """Part names, some written in another way, resolved among the names; suppliers stand for what occurs together."""
    parts = t.part.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("canonical_name"))
    name = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).when(F.col("p_partkey") % 3 == 1, F.regexp_replace("p_name", "([a-z])([a-z])", "$2$1")).otherwise(F.col("p_name"))
    mentions = t.part.select(F.col("p_partkey").alias("mention_id"), name.alias("name"), F.lit("1998-01-01").cast("date").alias("at"))
    supplied = t.lineitem.select(F.col("l_partkey").alias("k"), F.col("l_suppkey").cast("string").alias("companion")).distinct()
    seen = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_partkey").alias("entity_id")).agg(F.max("o_orderdate").cast("date").alias("last_seen"))
    known = parts.join(seen, "entity_id", "left")
    found = entities.scored_candidates(mentions, known, supplied.withColumnRenamed("k", "mention_id"), supplied.withColumnRenamed("k", "entity_id"), 0.3, 20)
    return entities.resolve(found, threshold=0.5).select("mention_id", "entity_id", "score")


@query("g15_name_clusters")
def _(t):
    return entities.cluster_names(t.part.select(F.col("p_name").alias("name"), F.lit(1).alias("mentions")), 0.8)


@query("g17_find_or_create", "SELECT min(s_name) AS canonical_name, count(*) AS mention_count FROM supplier WHERE lower(s_name) NOT IN (SELECT lower(c_name) FROM customer) GROUP BY lower(s_name)")
def _(t):
    return entities.find_or_create(t.supplier.select(F.col("s_name").alias("name")), t.customer.select(F.col("c_name").alias("canonical_name")))


@query("r26_merge_responses", f"SELECT query_id, unit_id, round(max(1.0 / rank) + sum(CASE WHEN arm_no = 0 THEN 5.0 ELSE 2.0 END::DOUBLE / (60 + rank)) + 0.65 * max(CASE WHEN arm = 'semantic' THEN 1.0 / rank ELSE 0 END), 6) AS score FROM {H} GROUP BY 1, 2")
def _(t):
    weight = F.when(F.col("arm_no") == 0, 5.0).otherwise(2.0)
    semantic = F.when(F.col("arm") == "semantic", 1.0 / F.col("rank")).otherwise(0.0)
    score = F.max(1.0 / F.col("rank")) + F.sum(weight / (60 + F.col("rank"))) + 0.65 * F.max(semantic)
    return views.hits(t).groupBy("query_id", "unit_id").agg(F.round(score, 6).alias("score"))


@query("r25_literal_search", """WITH s AS (SELECT conv_id, turn, text, list_filter([instr(lower(text), w) FOR w IN ['the', 'and', 'der']], lambda x: x > 0) AS p FROM conversations WHERE role = 'user')
    SELECT conv_id, turn, list_min(p) AS at, substring(text, greatest(1, list_min(p) - 700), list_min(p) - greatest(1, list_min(p) - 700) + 700) AS around FROM s WHERE len(p) > 0""")
def _(t):
    spoken = t.conversations.where("role = 'user'")
    found = evidence.literal_search(spoken, "text", ["the", "and", "der"], every=False)
    return found.select("conv_id", "turn", F.col("at").cast("long").alias("at"), "around")


@query("r30_preference_rank", f"""WITH d AS (SELECT DISTINCT unit_id, term FROM {_TERMS}), f AS (SELECT term, ln(1 + (SELECT count(*) FROM documents) / count(*)) AS idf FROM d GROUP BY 1), n AS (SELECT unit_id, sqrt(sum(idf * idf)) AS norm FROM d JOIN f USING (term) GROUP BY 1),
    q AS (SELECT query_id, term FROM {_SELECTED}), x AS (SELECT query_id, unit_id, round(sum(idf * idf) / norm, 4) AS score FROM q JOIN d USING (term) JOIN f USING (term) JOIN n USING (unit_id) GROUP BY 1, 2, norm) SELECT query_id, unit_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS r FROM x) WHERE r <= 10""")
def _(t):
    frequencies = settled(retrieval.document_frequencies(text_units(t)))
    return retrieval.idf_cosine(retrieval.selective_terms(text_queries(t), frequencies, most=8), text_units(t), frequencies, 10)


@query("f23_prefer_observations", f"SELECT query_id, unit_id FROM (SELECT DISTINCT query_id, unit_id FROM {H}) h WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT query_id, unit_id + 1 AS source FROM {H} WHERE unit_id % 10 = 0) o WHERE o.query_id = h.query_id AND o.source = h.unit_id)")
def _(t):
    found = views.hits(t).select("query_id", "unit_id").distinct()
    sources = found.where("unit_id % 10 = 0").select("query_id", (F.col("unit_id") + 1).alias("unit_id"))
    return found.join(sources, ["query_id", "unit_id"], "left_anti")


@query("hybrid_recall")
def _(t):
    """Four arms over documents: vectors, words, links of shared sources and languages, and time."""
    day = F.make_dt_interval(days=(F.col("unit_id") % 400).cast("int"))
    units = t.embeddings.join(t.documents, F.col("vec_id") == F.col("doc_id")).select(F.col("doc_id").alias("unit_id"), F.col("lang").alias("kind"), "embedding", "text", F.col("n_chars").alias("proof_count"))
    units = settled(units.withColumn("at", F.lit("2023-01-01").cast("timestamp_ntz") + day))  # read by every arm
    asked = vector_queries(t).join(text_queries(t), "query_id")
    asked = asked.withColumns({"low": F.lit("2023-03-01").cast("timestamp_ntz"), "high": F.lit("2023-06-01").cast("timestamp_ntz"), "now": F.lit("2024-03-01").cast("timestamp_ntz")})
    linked = settled(graph.semantic_links(vector_units(t), ["kind"], 5, 0.3).select("from_unit", "to_unit", "weight", "link_type"))  # read in every round
    following = units.select(F.col("unit_id").alias("from_unit"), (F.col("unit_id") + 1).alias("to_unit"), F.lit(0.8).alias("weight"), F.lit("caused_by").alias("link_type"))
    postings = t.documents.select(F.col("doc_id").alias("unit_id"), F.concat("source", F.lit("/"), "lang").alias("entity_id"))
    return recall.hybrid(asked, units, links=linked.unionByName(following), postings=postings)
