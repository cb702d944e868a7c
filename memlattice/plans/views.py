"""The memory model over the given tables, as frames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.plans.registry import Tables

KIND = {"A": "temporal", "N": "semantic", "R": "caused_by"}


def links(t: Tables) -> DataFrame:
    """Lines as links from orders to parts, by return flag, weighted by discount."""
    kind = F.when(F.col("l_returnflag") == "A", "temporal").when(F.col("l_returnflag") == "N", "semantic").otherwise("caused_by")
    return t.lineitem.select(F.col("l_orderkey").alias("from_unit"), F.col("l_partkey").alias("to_unit"), kind.alias("link_type"), F.round(F.col("l_discount") * 10, 6).alias("weight"))


LINKS = "(SELECT l_orderkey AS from_unit, l_partkey AS to_unit, CASE l_returnflag WHEN 'A' THEN 'temporal' WHEN 'N' THEN 'semantic' ELSE 'caused_by' END AS link_type, round(l_discount * 10, 6) AS weight FROM lineitem)"


def postings(t: Tables) -> DataFrame:
    """Orders as units, suppliers as their entities."""
    return t.lineitem.select(F.col("l_orderkey").alias("unit_id"), F.col("l_suppkey").alias("entity_id")).distinct()


POSTINGS = "(SELECT DISTINCT l_orderkey AS unit_id, l_suppkey AS entity_id FROM lineitem)"


def events(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_id").alias("unit_id"), F.col("event_type").alias("kind"), "user_id", "ts", "value", F.array("event_type", F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string"))).alias("tags"))


EVENTS = "(SELECT event_id AS unit_id, event_type AS kind, user_id, ts, value, [event_type, 'u' || CAST(user_id % 7 AS VARCHAR)] AS tags FROM events)"


def documents(t: Tables) -> DataFrame:
    """Documents with tags; those of the first source are untagged."""
    tags = F.when(F.col("source") != "src0", F.array("lang", "source"))
    return t.documents.select(F.col("doc_id").alias("unit_id"), F.col("lang").alias("bank_id"), F.col("source").alias("kind"), "text", "n_chars", tags.alias("tags"))


DOCUMENTS = "(SELECT doc_id AS unit_id, lang AS bank_id, source AS kind, text, n_chars, CASE WHEN source <> 'src0' THEN [lang, source] END AS tags FROM documents)"


def hits(t: Tables) -> DataFrame:
    """Customers of a nation in three rankings."""
    from pyspark.sql import Window

    nation = Window.partitionBy("c_nationkey")
    arms = (("semantic", nation.orderBy(F.desc("c_acctbal"), F.asc("c_custkey"))), ("keyword", nation.orderBy("c_custkey")), ("graph", nation.orderBy("c_acctbal", "c_custkey")))
    out = None
    for number, (arm, order) in enumerate(arms):
        one = t.customer.select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("unit_id"), F.lit(arm).alias("arm"), F.lit(number).alias("arm_no"), F.row_number().over(order).alias("rank"), F.col("c_acctbal").alias("raw"))
        out = one if out is None else out.union(one)
    return out.where("rank <= 40")


HITS = """(SELECT * FROM (
    SELECT c_nationkey AS query_id, c_custkey AS unit_id, 'semantic' AS arm, 0 AS arm_no, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank, c_acctbal AS raw FROM customer
    UNION ALL SELECT c_nationkey, c_custkey, 'keyword', 1, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey), c_acctbal FROM customer
    UNION ALL SELECT c_nationkey, c_custkey, 'graph', 2, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey), c_acctbal FROM customer) WHERE rank <= 40)"""


def seeds(t: Tables) -> DataFrame:
    """Urgent orders of large value, by year, as queries' seeds."""
    big = t.orders.where("o_orderpriority = '1-URGENT' AND o_totalprice > 300000")
    return big.select(F.year("o_orderdate").alias("query_id"), F.col("o_orderkey").alias("unit_id"))


SEEDS = "(SELECT CAST(year(o_orderdate) AS INTEGER) AS query_id, o_orderkey AS unit_id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000)"
