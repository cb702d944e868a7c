"""Registered queries: scans, predicates, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlattice.functions import tags as tag
from memlattice.functions import texts, times
from memlattice.functions.scoring import combined, link_weight, passthrough, proof_factor
from memlattice.plans import views
from memlattice.plans.registry import query

D = views.DOCUMENTS


def _tags(mode: str, given: list[str]):
    return lambda t: views.documents(t).where(tag.match(F.col("tags"), given, mode)).select("unit_id")


_HAS = {"any": "(tags IS NULL OR len(tags) = 0 OR list_has_any(tags, {q}))", "all": "(tags IS NULL OR len(tags) = 0 OR list_has_all(tags, {q}))", "any_strict": "coalesce(list_has_any(tags, {q}), false)", "all_strict": "coalesce(list_has_all(tags, {q}), false)", "exact": "coalesce(list_has_all(tags, {q}) AND list_has_all({q}, tags), false)"}
for _n, (_mode, _given) in enumerate((("any", ["en", "src3"]), ("all", ["en", "src3"]), ("any_strict", ["en", "src3"]), ("all_strict", ["de", "src5"]), ("exact", ["fr", "src7"])), 1):
    query(f"f{_n}_tag_filter_{_mode}", f"SELECT unit_id FROM {D} WHERE {_HAS[_mode].format(q=_given)}")(_tags(_mode, _given))
query("f5_tag_filter_exact_empty", f"SELECT unit_id FROM {D} WHERE tags IS NULL OR len(tags) = 0")(_tags("exact", []))
query("f6_tag_filter_none", f"SELECT unit_id FROM {D}")(_tags("any", []))


@query("f7_tag_groups", f"SELECT unit_id FROM {D} WHERE (coalesce(list_has_any(tags, ['en', 'fr']), false) AND NOT coalesce(list_has_any(tags, ['src3']), false)) OR (tags IS NULL OR len(tags) = 0 OR list_has_all(tags, ['es', 'src1']))")
def _(t):
    tree = {"or": [{"and": [{"tags": ["en", "fr"]}, {"not": {"tags": ["src3"]}}]}, {"tags": ["es", "src1"], "match": "all"}]}
    return views.documents(t).where(tag.groups(F.col("tags"), [tree])).select("unit_id")


@query("f8_updated_window", "SELECT event_id AS unit_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def _(t):
    low, high = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-05", "2024-01-12"))
    return t.events.where(times.updated_within(F.col("ts"), low, high)).select(F.col("event_id").alias("unit_id"), "ts")


_RANGES = "(SELECT o_orderkey AS unit_id, o_orderdate AS s, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 30 DAY END AS e, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate + INTERVAL 60 DAY END AS m FROM orders)"


def _ranges(t):
    day = lambda n: F.col("o_orderdate") + F.expr(f"INTERVAL {n} DAY")
    return t.orders.select(F.col("o_orderkey").alias("unit_id"), F.col("o_orderdate").alias("s"), F.when(F.col("o_orderstatus") != "O", day(30)).alias("e"), F.when(F.col("o_orderpriority") != "5-LOW", day(60)).alias("m"))


_LOW, _HIGH = "1995-01-01", "1995-03-01"


def _window():
    return F.lit(_LOW).cast("timestamp_ntz"), F.lit(_HIGH).cast("timestamp_ntz")


@query("f9_event_window_overlap", f"SELECT unit_id FROM {_RANGES} WHERE (s <= TIMESTAMP '{_HIGH}' AND e >= TIMESTAMP '{_LOW}') OR s BETWEEN TIMESTAMP '{_LOW}' AND TIMESTAMP '{_HIGH}' OR e BETWEEN TIMESTAMP '{_LOW}' AND TIMESTAMP '{_HIGH}' OR m BETWEEN TIMESTAMP '{_LOW}' AND TIMESTAMP '{_HIGH}'")
def _(t):
    return _ranges(t).where(times.overlaps(F.col("s"), F.col("e"), F.col("m"), *_window())).select("unit_id")


@query("f10_effective_time", f"SELECT unit_id, coalesce(e, m, s) AS at FROM {_RANGES}")
def _(t):
    return _ranges(t).select("unit_id", times.effective(F.col("e"), F.col("m"), F.col("s")).alias("at"))


@query("f13_consolidation_state", "SELECT o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'failed' ELSE 'pending' END AS state, count(*) AS n FROM orders GROUP BY ALL")
def _(t):
    s = F.col("o_orderstatus")
    return t.orders.groupBy("o_orderstatus", F.when(s == "F", "done").when(s == "P", "failed").otherwise("pending").alias("state")).agg(F.count("*").alias("n"))


@query("f15_metadata_contains", "SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def _(t):
    return t.events.where(F.get_json_object("props", "$.k") == "7").select("event_id", "user_id")


@query("f16_wildcard_search", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RING%' AND p_type ILIKE 's%'")
def _(t):
    return t.part.where(F.col("p_name").ilike("%RING%") & F.col("p_type").ilike(texts.glob_like("s*"))).select("p_partkey", "p_name")


@query("f17_as_of", f"SELECT unit_id FROM {_RANGES} WHERE m IS NULL OR m <= TIMESTAMP '{_LOW}'")
def _(t):
    return _ranges(t).where(times.as_of(F.col("m"), _window()[0])).select("unit_id")


@query("f18_scope_filter", f"SELECT unit_id FROM {D} WHERE NOT (coalesce(len(tags), 0) > 0 AND NOT coalesce(list_has_any(tags, ['en', 'src2']), false))")
def _(t):
    required = F.coalesce(F.size("tags"), F.lit(0)) > 0
    return views.documents(t).where(~(required & ~tag.match(F.col("tags"), ["en", "src2"], "any_strict"))).select("unit_id")


@query("f19_review_state", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
def _(t):
    return t.orders.where(F.col("o_orderstatus").isin("F", "P")).select("o_orderkey")


@query("f20_compatibility", "SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#11', 'Brand#12') AND p_size >= 10 AND list_has_all(['a', 'b', 'c', 'SMALL', 'STANDARD', 'PROMO', 'ECONOMY', 'MEDIUM', 'LARGE', 'BRASS', 'STEEL', 'TIN', 'COPPER', 'NICKEL'], string_split(p_type, ' '))")
def _(t):
    tools = F.array(*map(F.lit, ["a", "b", "c", "SMALL", "STANDARD", "PROMO", "ECONOMY", "MEDIUM", "LARGE", "BRASS", "STEEL", "TIN", "COPPER", "NICKEL"]))
    fits = F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#11", "Brand#12") & (F.col("p_size") >= 10) & (F.size(F.array_except(F.split("p_type", " "), tools)) == 0)
    return t.part.where(fits).select("p_partkey")


@query("f21_scope_cover", f"SELECT unit_id FROM {D} WHERE tags IS NOT NULL AND len(list_filter(tags, lambda x: regexp_matches(x, '^src1.*$'))) > 0 AND len(list_filter(tags, lambda x: regexp_matches(x, '^e.$'))) > 0 AND len(list_filter(tags, lambda x: regexp_matches(x, '^src1.*$') OR regexp_matches(x, '^e.$'))) = len(tags)")
def _(t):
    return views.documents(t).where(tag.scope_cover(F.col("tags"), ["src1*", "e?"])).select("unit_id")


def _sql_redact() -> str:
    """The rules without lookaround: a token's neighbours are matched and put back, twice, as two tokens may share one."""
    out = "text"
    for label, body in texts.TOKENS:
        if body is None:
            out = "regexp_replace({}, '{}', '[REDACTED:{}]', 'g')".format(out, texts.ANYWHERE[label].replace("'", "''"), label)
        else:
            for _ in range(2):
                out = f"regexp_replace({out}, '(^|[^A-Za-z0-9_])(?:{body})($|[^A-Za-z0-9_])', '\\1[REDACTED:{label}]\\2', 'g')"
    return out


@query("f22_redaction", f"SELECT doc_id, md5(r) AS redacted, CASE WHEN r <> text THEN 'redact' ELSE 'allow' END AS outcome FROM (SELECT doc_id, text, {_sql_redact()} AS r FROM documents)")
def _(t):
    return texts.screened(t.documents.select("doc_id", "text"), "text").select("doc_id", F.md5(F.col("redacted").cast("binary")).alias("redacted"), "outcome")


@query("r1_query_tokens", r"SELECT conv_id, turn, array_to_string(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> ''), ' ') AS tokens FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", F.array_join(texts.tokens(F.col("text")), " ").alias("tokens"))


@query("r14_temporal_proximity", f"SELECT unit_id, round(CASE WHEN m IS NULL THEN 0.5 ELSE 1 - least(abs(epoch_us(m) - (epoch_us(TIMESTAMP '{_LOW}') + epoch_us(TIMESTAMP '{_HIGH}')) / 2.0) / 86400000000.0 / ((epoch_us(TIMESTAMP '{_HIGH}') - epoch_us(TIMESTAMP '{_LOW}')) / 86400000000.0 / 2), 1.0) END, 6) AS proximity FROM {_RANGES}")
def _(t):
    return _ranges(t).select("unit_id", F.round(times.proximity(F.col("m"), *_window()), 6).alias("proximity"))


_AGE = "date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01')"


@query("r21_recency", f"SELECT o_orderkey, round(greatest(1 - greatest({_AGE}, 0) / 365.0, 0.1), 6) AS linear, round(pow(0.5, greatest({_AGE}, 0) / 90.0), 6) AS exponential FROM orders")
def _(t):
    days = F.datediff(F.lit("1998-01-01").cast("date"), F.col("o_orderdate").cast("date"))
    return t.orders.select("o_orderkey", F.round(times.recency(days), 6).alias("linear"), F.round(times.recency(days, "exponential"), 6).alias("exponential"))


@query("r22_combined_score", f"SELECT o_orderkey, round((o_totalprice / 1000000) * (1 + 0.2 * (greatest(1 - greatest({_AGE}, 0) / 365.0, 0.1) - 0.5)) * (1 + 0.1 * (CASE WHEN o_custkey < 1 THEN 0.5 ELSE least(greatest(0.5 + ln(greatest(o_custkey, 1)) / 10, 0), 1) END - 0.5)), 6) AS score FROM orders")
def _(t):
    days = F.datediff(F.lit("1998-01-01").cast("date"), F.col("o_orderdate").cast("date"))
    return t.orders.select("o_orderkey", F.round(combined(F.col("o_totalprice") / 1000000, days, F.lit(None).cast("double"), F.col("o_custkey")), 6).alias("score"))


@query("r22_proof_factor", "SELECT p_partkey, round(1 + 0.1 * (least(greatest(0.5 + ln(p_size) / 10, 0), 1) - 0.5), 6) AS factor FROM part")
def _(t):
    return t.part.select("p_partkey", F.round(proof_factor(F.col("p_size")), 6).alias("factor"))


@query("w7_passthrough_rescale", f"SELECT query_id, unit_id, round(CASE WHEN count(*) OVER (PARTITION BY query_id) <= 1 THEN 1.0 ELSE 1 - 0.9 * (rank - 1) / (count(*) OVER (PARTITION BY query_id) - 1) END, 6) AS ce FROM {views.HITS} WHERE arm_no = 0")
def _(t):
    from pyspark.sql import Window

    one = views.hits(t).where("arm_no = 0")
    return one.select("query_id", "unit_id", F.round(passthrough(F.col("rank"), F.count("*").over(Window.partitionBy("query_id"))), 6).alias("ce"))


@query("g1_link_weight", "SELECT event_id, round(greatest(0.3, 1 - value / 24.0), 6) AS weight FROM events")
def _(t):
    return t.events.select("event_id", F.round(link_weight(F.col("value")), 6).alias("weight"))


@query("g10_trigrams", r"WITH w AS (SELECT p_partkey, unnest(list_filter(string_split_regex(lower(p_name), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS w FROM part), g AS (SELECT DISTINCT p_partkey, unnest(list_transform(range(1, len('  ' || w || ' ') - 1), lambda i: substring('  ' || w || ' ', CAST(i AS INTEGER), 3))) AS g FROM w) SELECT p_partkey, count(*) AS n, min(g) AS first, max(g) AS last FROM g GROUP BY p_partkey")
def _(t):
    each = t.part.select("p_partkey", F.explode(texts.trigrams(F.col("p_name"))).alias("g"))
    return each.groupBy("p_partkey").agg(F.count("*").alias("n"), F.min("g").alias("first"), F.max("g").alias("last"))


@query("c6_folded_duplicates", r"SELECT md5(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g'))) AS folded, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(t):
    key = F.md5(texts.folded(F.col("text")).cast("binary"))
    return t.documents.groupBy(key.alias("folded")).agg(F.count("*").alias("n")).where("n > 1")


@query("s1_scan_page", "SELECT event_id, ts FROM events WHERE event_type = 'click' ORDER BY ts, event_id LIMIT 50 OFFSET 100")
def _(t):
    return t.events.where("event_type = 'click'").orderBy("ts", "event_id").offset(100).limit(50).select("event_id", "ts")


@query("s2_point_lookup", "SELECT doc_id, lang FROM documents WHERE doc_id IN (3, 17, 42, 99)")
def _(t):
    return t.documents.where(F.col("doc_id").isin(3, 17, 42, 99)).select("doc_id", "lang")


@query("s3_live_ids", "SELECT DISTINCT l_partkey AS unit_id FROM lineitem SEMI JOIN part ON l_partkey = p_partkey")
def _(t):
    return t.lineitem.select(F.col("l_partkey").alias("unit_id")).distinct().join(t.part.select(F.col("p_partkey").alias("unit_id")), "unit_id", "left_semi")


@query("s4_live_or_archive", "SELECT o_orderkey, 'live' AS state FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, 'archived' FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    live, gone = t.orders.where("o_orderstatus <> 'F'"), t.orders.where("o_orderstatus = 'F'")
    return live.select("o_orderkey", F.lit("live").alias("state")).unionByName(gone.select("o_orderkey", F.lit("archived").alias("state")))


@query("s5_list_units", "SELECT o_orderkey, o_totalprice, count(*) OVER () AS total FROM orders WHERE o_orderpriority = '2-HIGH' AND o_totalprice > 50000 ORDER BY CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate END DESC NULLS LAST, o_orderkey LIMIT 40")
def _(t):
    found = t.orders.where("o_orderpriority = '2-HIGH' AND o_totalprice > 50000")
    total = found.agg(F.count("*").alias("total"))
    page = found.orderBy(F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).desc_nulls_last(), "o_orderkey").limit(40)
    return page.select("o_orderkey", "o_totalprice").crossJoin(F.broadcast(total))


@query("s6_list_entities", "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%1%' ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def _(t):
    return t.customer.where(F.col("c_name").ilike("%1%")).orderBy(F.desc("c_acctbal"), "c_custkey").limit(25).select("c_custkey", "c_name")


@query("s7_list_banks", "SELECT n_nationkey, n_name, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers, greatest(c.top, s.top) AS best FROM nation LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n, max(c_acctbal) AS top FROM customer GROUP BY 1) c ON n_nationkey = c.k LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n, max(s_acctbal) AS top FROM supplier GROUP BY 1) s ON n_nationkey = s.k")
def _(t):
    side = lambda df, key, value, n, top: df.groupBy(F.col(key).alias("n_nationkey")).agg(F.count("*").alias(n), F.max(value).alias(top))
    c, s = side(t.customer, "c_nationkey", "c_acctbal", "customers", "ct"), side(t.supplier, "s_nationkey", "s_acctbal", "suppliers", "st")
    both = t.nation.join(c, "n_nationkey", "left").join(s, "n_nationkey", "left")
    return both.select("n_nationkey", "n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"), F.greatest("ct", "st").alias("best"))


@query("s8_graph_links", f"SELECT l.from_unit, l.to_unit, l.weight FROM {views.LINKS} l SEMI JOIN {views.SEEDS} a ON l.from_unit = a.unit_id SEMI JOIN {views.SEEDS} b ON l.to_unit = b.unit_id")
def _(t):
    nodes = views.seeds(t).select("unit_id").distinct()
    found = views.links(t).join(nodes.withColumnRenamed("unit_id", "from_unit"), "from_unit", "left_semi")
    return found.join(nodes.withColumnRenamed("unit_id", "to_unit"), "to_unit", "left_semi").select("from_unit", "to_unit", "weight")
