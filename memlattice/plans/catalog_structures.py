"""Registered queries: operators with data structures of their own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlattice.functions import cron, time_words
from memlattice.operators import matching, scope_limits, selection, windows
from memlattice.plans.registry import Tables, query
from memlattice.sources import appended, backup, transfer
from memlattice.storage import scratch

_ESCAPED = r"""replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(9), '\t')"""
_LOG = f"""WITH l AS (SELECT conv_id // 64 AS bucket, conv_id, turn, md5(text) AS digest, '{{"conv_id":' || conv_id || ',"turn":' || turn || ',"text":"' || {_ESCAPED} || '"}}' AS line FROM conversations),
    o AS (SELECT *, strlen(line) AS n_bytes, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY bucket ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
        CAST(sum(strlen(line) + 1) OVER (PARTITION BY bucket) AS BIGINT) AS size, row_number() OVER (PARTITION BY bucket ORDER BY conv_id DESC, turn DESC) AS back FROM l)
    SELECT bucket, "offset", n_bytes, conv_id, turn, digest FROM o"""


def _log(t: Tables) -> str:
    """Conversations as JSON lines, a file for 64 of them, in the shared folder."""
    text = F.col("text")
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    line = F.concat(F.lit('{"conv_id":'), F.col("conv_id").cast("string"), F.lit(',"turn":'), F.col("turn").cast("string"), F.lit(',"text":"'), text, F.lit('"}'))
    path = scratch(t.spark, "log")
    rows = t.conversations.select(F.expr("conv_id div 64").alias("bucket"), "conv_id", "turn", line.alias("line"))
    rows.repartition("bucket").sortWithinPartitions("bucket", "conv_id", "turn").select("bucket", "line").write.partitionBy("bucket").text(path)
    return path


def _shown(rows):
    record = appended.parsed(rows, "conv_id long, turn long, text string")
    bucket = F.regexp_extract("source", "bucket=([0-9]+)", 1).cast("long")
    return record.select(bucket.alias("bucket"), "offset", "n_bytes", "record.conv_id", "record.turn", F.md5(F.col("record.text").cast("binary")).alias("digest"))


@query("x1_byte_ranges", _LOG)
def _(t):
    return _shown(appended.read(t.spark, _log(t), rangeBytes=16_384))


@query("s13_byte_tail", _LOG + ' WHERE "offset" >= size - 8192 AND back <= 20')
def _(t):
    return _shown(appended.tail(t.spark, _log(t), 8192, 20))


_ASKED = "(SELECT conv_id AS query_id, text FROM conversations WHERE conv_id % 20 = 0 AND turn = 0)"


@query("r31_weighted_selection", f"""WITH w AS (SELECT DISTINCT query_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS term FROM {_ASKED}),
    d AS (SELECT doc_id AS unit_id, lower(text || ' ' || left(source, 2) || ' ' || lang || '.') AS low, lang || '.' AS condition FROM documents),
    o AS (SELECT query_id, unit_id, sum(CASE WHEN length(term) > 1 THEN 3.0 ELSE 1.0 END) AS s FROM w JOIN d ON contains(low, term) GROUP BY 1, 2
        UNION ALL SELECT query_id, unit_id, 6.0 FROM {_ASKED} q JOIN d ON contains(lower(q.text), 'sr') OR contains(lower(q.text), condition)),
    b AS (SELECT query_id, unit_id, round(CAST(sum(s) AS DOUBLE), 6) AS score FROM o GROUP BY 1, 2)
    SELECT query_id, unit_id, score FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) <= 20""")
def _(t):
    asked = t.conversations.where("conv_id % 20 = 0 AND turn = 0").select(F.col("conv_id").alias("query_id"), "text")
    units = t.documents.select(F.col("doc_id").alias("unit_id"), "text", F.array(F.substring("source", 1, 2), F.concat("lang", F.lit("."))).alias("conditions"))
    return matching.select_weighted(asked, units, 20).select("query_id", "unit_id", "score")


_NOW, _GONE = ("the ", "tion", "der", "current"), ("no longer", "ing the", "ation")


def _bonus(markers, weight, cap):
    return f"round(CAST(least({cap}, {weight} * (" + " + ".join(f"CAST(contains(lower(text), '{m}') AS INTEGER)" for m in markers) + ")) AS DOUBLE), 6)"


@query("r28_marker_bonus", f"SELECT doc_id, {_bonus(_NOW, 0.09, 0.27)} AS current, {_bonus(_GONE, 0.15, 0.30)} AS retired FROM documents")
def _(t):
    return matching.marker_bonus(t.documents.select("doc_id", "text"), "doc_id", "text", {"current": (_NOW, 0.09, 0.27), "retired": (_GONE, 0.15, 0.30)})


_PIECE = "'[role: ' || role || '] ' || text || ' [' || role || ':end]'"


@query("r25_role_spans", f"""WITH p AS (SELECT conv_id, turn, role, text, {_PIECE} AS piece, lead(role) OVER w AS role2, lead(text) OVER w AS text2, lead({_PIECE}) OVER w AS piece2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    s AS (SELECT conv_id, turn, role AS r, text AS b, length('[role: ' || role || '] ') AS pos FROM p
        UNION ALL SELECT conv_id, turn, role2, text2, length(piece) + length('[role: ' || role2 || '] ') FROM p WHERE role2 IS NOT NULL),
    b AS (SELECT conv_id, turn, r, trim(b, E' \\n\\t\\r') AS b, pos + length(b) - length(ltrim(b, E' \\n\\t\\r')) AS pos FROM s WHERE r = 'user'),
    h AS (SELECT *, list_min(list_filter([instr(lower(b), x) FOR x IN ['the', 'and', 'der']], lambda x: x > 0)) - 1 AS anchor FROM b)
    SELECT conv_id, turn, CAST(pos + greatest(0, anchor - 700) AS INTEGER) AS span_start, CAST(pos + least(length(b), anchor + 703) AS INTEGER) AS span_end, substring(b, greatest(0, anchor - 700) + 1, least(length(b), anchor + 703) - greatest(0, anchor - 700)) AS span FROM h WHERE anchor IS NOT NULL""")
def _(t):
    piece = F.concat(F.lit("[role: "), "role", F.lit("] "), "text", F.lit(" ["), "role", F.lit(":end]"))
    said = t.conversations.select("conv_id", "turn", piece.alias("piece"))
    both = said.withColumn("text", F.concat("piece", F.coalesce(F.lead("piece").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))))
    return matching.literal_spans(both, ["conv_id", "turn"], "text", ["the", "and", "der"], role="user").drop("format_role")


_LENGTHS = (0, 1, 7, 30, 365, 3650)
_WINDOWS = """(SELECT c_custkey AS window_id, CASE WHEN c_custkey % 7 <> 0 THEN TIMESTAMP '2024-01-01' + INTERVAL (c_custkey % 29) DAY + INTERVAL (c_custkey) SECOND END AS low,
    CASE WHEN c_custkey % 11 <> 0 THEN TIMESTAMP '2024-01-01' + INTERVAL (c_custkey % 29) DAY + INTERVAL (c_custkey) SECOND + INTERVAL ([0, 1, 7, 30, 365, 3650][c_custkey % 6 + 1]) DAY END AS high FROM customer WHERE c_custkey % 20 = 0)"""


def _windows(t: Tables):
    """Windows of no to 3,650 days and with open ends, of the customers whose key is divisible by 20."""
    begin = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("c_custkey") % 29).cast("int"), secs=F.col("c_custkey").cast("decimal(18,6)"))
    length = F.get(F.array(*map(F.lit, _LENGTHS)), (F.col("c_custkey") % 6).cast("int"))
    end = begin + F.make_dt_interval(days=length)
    return t.customer.where("c_custkey % 20 = 0").select(F.col("c_custkey").alias("window_id"), F.when(F.col("c_custkey") % 7 != 0, begin).alias("low"), F.when(F.col("c_custkey") % 11 != 0, end).alias("high"))


@query("j11_many_windows", f"SELECT window_id, count(*) AS n, min(event_id) AS first_event, CAST(sum(event_id) AS BIGINT) AS ids FROM {_WINDOWS} JOIN events ON (low IS NULL OR ts >= low) AND (high IS NULL OR ts <= high) GROUP BY 1")
def _(t):
    measures = {"n": ("sum", F.lit(1).cast("long")), "first_event": ("min", F.col("event_id")), "ids": ("sum", F.col("event_id"))}
    return windows.tallied(_windows(t), t.events.select("event_id", F.col("ts").alias("at")), "window_id", measures)


@query("f9_many_overlaps", f"""WITH s AS (SELECT event_id, ts AS b, CASE WHEN event_id % 13 <> 0 THEN ts + INTERVAL (event_id % 90) HOUR END AS e FROM events)
    SELECT window_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM {_WINDOWS} JOIN s ON (high IS NULL OR b <= high) AND (low IS NULL OR e IS NULL OR e >= low) GROUP BY 1""")
def _(t):
    end = F.when(F.col("event_id") % 13 != 0, F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 90).cast("int")))
    return windows.overlap_sums(_windows(t), t.events.select("event_id", F.col("ts").alias("start"), end.alias("end")), "window_id", {"ids": F.col("event_id")})


@query("r12_window_pools", f"""SELECT window_id, event_type AS kind, event_id AS unit_id, k FROM (SELECT window_id, event_type, event_id, row_number() OVER (PARTITION BY window_id, event_type ORDER BY value DESC, event_id) AS k
    FROM {_WINDOWS} JOIN events ON (low IS NULL OR ts >= low) AND (high IS NULL OR ts <= high)) WHERE k <= 60""")
def _(t):
    units = t.events.select(F.col("event_id").alias("unit_id"), F.col("event_type").alias("kind"), "value", F.col("ts").alias("at"))
    return windows.best(_windows(t), units, "window_id", "kind", "value", "unit_id", 60)


_INTENTS = {"motion": (6.0, ("tion", "ment")), "article": (3.0, ("the ", "der ", "que ")), "being": (2.0, ("heit", "ing"))}


@query("r30_preferences")
def _(t):
    """Documents as preferences, their lines as quotes, for each conversation whose id is divisible by 20."""
    asked = t.conversations.where("conv_id % 20 = 0").groupBy(F.col("conv_id").alias("query_id")).agg(F.min_by("text", "turn").alias("text"), F.max_by("text", "turn").alias("context"))
    units = t.documents.select(F.col("doc_id").alias("unit_id"), "text", F.array(F.concat("lang", F.lit(" "))).alias("conditions"), F.split("text", "\n").alias("quotes"))
    return selection.preferences(asked, units, _INTENTS).select("query_id", "unit_id", "place", "score", "tier")


def slotted(t: Tables):
    """Turns as items of packets of 800 characters, their roles as types; slots are words that they hold."""
    slots = F.filter(F.array(F.lit("the"), F.lit("der"), F.lit("que"), F.lit("tion")), lambda s: F.contains(F.lower("text"), s))
    role = F.when(F.col("turn").isin(0, 2), "guidance").when(F.col("turn") % 3 == 0, "direct").otherwise("bridge")
    items = t.conversations.select(F.col("conv_id").alias("packet"), F.expr("turn div 2").alias("claim"), F.col("turn").alias("place"), F.col("turn").alias("record_id"), role.alias("role"), F.col("role").alias("type"), F.substring("text", 1, 240).alias("text"), slots.alias("slots"))
    items = items.withColumn("text", F.when(F.col("place") % 7 != 3, F.col("text")))
    requests = t.conversations.select(F.col("conv_id").alias("packet")).distinct().select("packet", F.array(F.lit("tion"), F.lit("der"), F.lit("the")).alias("required"), F.lit(800).alias("budget"), F.lit(400).alias("reserve"), F.array(F.lit("user")).alias("preferred"))
    return items, requests


@query("x6_slotted_packets")
def _(t):
    items, requests = slotted(t)
    built = selection.packets(items, requests)
    return built.select("packet", "claim", "state", F.array_join("covers", ",").alias("covers"), F.array_join("evidence", ",").alias("evidence"))


_TREE = "(SELECT p_partkey AS page, CASE WHEN p_partkey % 50 = 11 THEN p_partkey + 2 WHEN p_partkey % 10 <> 1 THEN p_partkey - 1 WHEN p_partkey % 40 = 1 THEN -1 END AS parent FROM part)"


@query("s15_page_layers", f"""WITH RECURSIVE p AS {_TREE}, d AS (SELECT page, 0 AS layer FROM p WHERE parent IS NULL OR parent NOT IN (SELECT page FROM p) UNION ALL SELECT p.page, d.layer + 1 FROM d JOIN p ON p.parent = d.page),
    w AS (SELECT page, parent AS up, 1 AS n FROM p WHERE page NOT IN (SELECT page FROM d) UNION ALL SELECT w.page, p.parent, n + 1 FROM w JOIN p ON p.page = w.up WHERE n < 12),
    c AS (SELECT page, bool_or(up = page) AS on_cycle FROM w GROUP BY 1), l AS (SELECT w.page, min(w.up) AS cycle FROM w JOIN c ON c.page = w.up AND c.on_cycle GROUP BY 1)
    SELECT p.page, CAST(layer AS BIGINT) AS layer, l.cycle, coalesce(on_cycle, FALSE) AS on_cycle FROM p LEFT JOIN d USING (page) LEFT JOIN c USING (page) LEFT JOIN l USING (page)""")
def _(t):
    key = F.col("p_partkey")
    parent = F.when(key % 50 == 11, key + 2).when(key % 10 != 1, key - 1).when(key % 40 == 1, F.lit(-1))
    return transfer.layers(t.part.select(key.alias("page"), parent.alias("parent")), "page", "parent")


def _transferred(policy):
    bank = [transfer.Table("customers", "c"), transfer.Table("orders", "o", {"c": "customers"})]

    def run(t: Tables):
        customers, orders = t.customer.select(F.col("c_custkey").alias("c"), F.col("c_name").alias("name")), t.orders.select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c"), F.lit("old").alias("side"))
        store = {"customers": customers.where("c % 3 <> 0"), "orders": orders.where("c % 3 <> 0")}
        sent = {"customers": customers.where("c % 2 = 0").withColumn("name", F.lit("new")), "orders": orders.where("c % 2 = 0 AND o % 5 <> 0").withColumn("side", F.lit("new"))}
        out, _ = transfer.imported(store, sent, bank, policy)
        return out["orders"].join(out["customers"], "c").select("o", "c", "side", F.col("name").alias("name"))

    return run


_OLD = "SELECT o_orderkey AS o, o_custkey AS c, 'old' AS side, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey % 3 <> 0"
_NEW = "SELECT o_orderkey AS o, o_custkey AS c, 'new' AS side, 'new' AS name FROM orders WHERE o_custkey % 2 = 0 AND o_orderkey % 5 <> 0"
query("s15_import_skip", f"{_OLD} UNION ALL {_NEW} AND o_custkey % 3 = 0")(_transferred("skip"))
query("s15_import_replace", f"{_OLD} AND o_custkey % 2 <> 0 UNION ALL {_NEW}")(_transferred("replace"))


_PART_TAGS = "list_sort([p_brand, 'size_' || (p_size % 10), lower(string_split(p_type, ' ')[1])])"
_RULES = """(SELECT s_suppkey AS rule_id, CASE s_suppkey % 4 WHEN 0 THEN ['Brand#' || (s_suppkey % 5 + 1) || '*', 'size_' || (s_suppkey % 10), '*'] WHEN 1 THEN ['Brand#?' || (s_suppkey % 7), 'size_[0-5]', '*o*']
    WHEN 2 THEN ['*_' || (s_suppkey % 10), '*' || (s_suppkey % 5 + 1), 's*'] ELSE ['Brand#*', '*'] END AS globs, CAST(s_suppkey % 40 AS INTEGER) AS "limit" FROM supplier)"""


@query("c5_scope_limits", f"""WITH s AS (SELECT DISTINCT {_PART_TAGS} AS scope FROM part), o AS (SELECT {_PART_TAGS} AS tags FROM part),
    g AS (SELECT rule_id, "limit", unnest(globs) AS gl, len(globs) AS n FROM {_RULES}), t AS (SELECT scope, unnest(scope) AS tag FROM s),
    f AS (SELECT scope, rule_id, n, count(DISTINCT gl) AS globs, count(DISTINCT tag) AS tags FROM t JOIN g ON tag GLOB gl GROUP BY ALL), w AS (SELECT scope, min(rule_id) AS rule_id FROM f WHERE globs = n AND tags = len(scope) GROUP BY 1),
    c AS (SELECT tags AS scope, count(*) AS n FROM o GROUP BY 1)
    SELECT array_to_string(s.scope, ',') AS scope, w.rule_id, coalesce(r."limit", 25) AS "limit", c.n, CAST(greatest(coalesce(r."limit", 25) - c.n, 0) AS BIGINT) AS room FROM s JOIN c USING (scope) LEFT JOIN w USING (scope) LEFT JOIN {_RULES} r USING (rule_id)""")
def _(t):
    tags = F.array_sort(F.array("p_brand", F.concat(F.lit("size_"), (F.col("p_size") % 10).cast("string")), F.lower(F.split("p_type", " ")[0])))
    rows = t.part.select(tags.alias("tags"))
    key = F.col("s_suppkey")
    of = lambda n: (key % n).cast("string")
    plus = (key % 5 + 1).cast("string")
    kinds = (
        F.array(F.concat(F.lit("Brand#"), plus, F.lit("*")), F.concat(F.lit("size_"), of(10)), F.lit("*")), F.array(F.concat(F.lit("Brand#?"), of(7)), F.lit("size_[0-5]"), F.lit("*o*")),
        F.array(F.concat(F.lit("*_"), of(10)), F.concat(F.lit("*"), plus), F.lit("s*")), F.array(F.lit("Brand#*"), F.lit("*")),
    )
    globs = F.when(key % 4 == 0, kinds[0]).when(key % 4 == 1, kinds[1]).when(key % 4 == 2, kinds[2]).otherwise(kinds[3])
    rules = t.supplier.select(key.alias("rule_id"), globs.alias("globs"), (key % 40).cast("int").alias("limit"))
    return scope_limits.room(rows.select(F.col("tags").alias("scope")), rules, rows, 25).withColumn("scope", F.array_join("scope", ","))


@query("c16_cron_due", """SELECT o_orderkey, date_trunc('day', o_orderdate) + INTERVAL 1 DAY * ((CASE WHEN o_orderkey % 2 = 0 THEN 7 ELSE 8 END - isodow(o_orderdate)) % 7 + CASE WHEN (CASE WHEN o_orderkey % 2 = 0 THEN 7 ELSE 8 END - isodow(o_orderdate)) % 7 = 0
        AND o_orderdate >= date_trunc('day', o_orderdate) + INTERVAL 1 HOUR * (o_orderkey % 24) + INTERVAL 30 MINUTE THEN 7 ELSE 0 END) + INTERVAL 1 HOUR * (o_orderkey % 24) + INTERVAL 30 MINUTE AS due
    FROM orders WHERE o_orderkey % 3 <> 0""")
def _(t):
    """Orders as schedules: Sundays or Mondays at half past an hour; those with an open order are not asked."""
    expression = F.concat(F.lit("30 "), (F.col("o_orderkey") % 24).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, " * * 7").otherwise(" * * mon"))
    return cron.with_next_due(t.orders.where("o_orderkey % 3 <> 0"), expression, F.col("o_orderdate")).select("o_orderkey", "due")


@query("s16_backup_restored", "SELECT c_nationkey, count(*) AS customers, CAST(sum(orders) AS BIGINT) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1")
def _(t):
    """Customers and orders, backed up, verified and read back."""
    path = scratch(t.spark, "backup")
    backup.backup({"customer": t.customer, "orders": t.orders}, path)
    held = backup.restore(t.spark, path)
    placed = held["orders"].groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return held["customer"].join(placed, "c_custkey", "left").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("orders").alias("orders"))


@query("date_time_windows", """WITH p AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 6 AS k, CAST(o_orderkey % 40 + 1 AS INTEGER) AS n FROM orders),
    w AS (SELECT o_orderkey, CASE k WHEN 0 THEN date_trunc('month', d) WHEN 1 THEN d - n WHEN 2 THEN date_trunc('week', d) - INTERVAL 7 DAY WHEN 3 THEN d - to_months(n) WHEN 4 THEN make_date(year(d) - 1, 1, 1) END AS a,
        CASE k WHEN 0 THEN last_day(d) WHEN 1 THEN d - n WHEN 2 THEN date_trunc('week', d) - INTERVAL 1 DAY WHEN 3 THEN d WHEN 4 THEN make_date(year(d) - 1, 12, 31) END AS b FROM p)
    SELECT o_orderkey, CAST(a AS TIMESTAMP) AS low, CAST(b AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS high FROM w""")
def _(t):
    """Phrases about orders of five kinds, and texts without one, seen from each order's date."""
    n, kind, day = (F.col("o_orderkey") % 40 + 1).cast("string"), F.col("o_orderkey") % 6, F.col("o_orderdate")
    phrases = (F.concat(F.lit("What was spent in "), F.date_format(day, "MMMM yyyy")), F.concat(n, F.lit(" days ago, I think")), F.lit("Was kam letzte Woche?"), F.concat(F.lit("the last "), n, F.lit(" months")), F.concat(F.lit("en "), (F.year(day) - 1).cast("string")))
    text = F.col("o_orderpriority")
    for number, phrase in enumerate(phrases):
        text = F.when(kind == number, phrase).otherwise(text)
    return time_words.windows(t.orders.select("o_orderkey", text.alias("text"), day.alias("now"))).select("o_orderkey", "low", "high")
