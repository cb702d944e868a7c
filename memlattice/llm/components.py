"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlattice.llm.common import remove, scratch


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges (``u`` over ``v``) with every node and its smaller neighbours hung on the smallest of them, which leaves far fewer."""
    marked = edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    ahead = marked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return ahead.union(marked.select("u", F.col("m").alias("v"))).distinct()


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node``, ``root`` (the smallest node reachable) for every node but the roots.

    ``edges`` has long columns ``a`` and ``b``; loops, repeats and either direction
    are fine, nulls are dropped.  Each round hangs every node on the smallest
    neighbour (large star, then small star); the number of edges never grows and
    the rounds needed grow with the logarithm of the longest chain.  Rounds are
    written to the shared folder, which cuts lineage and survives lost executors.
    """
    spark = edges.sparkSession
    state = F.struct(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003))
    kept, seen = None, None
    current = _small_star(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        path = scratch(spark, "edges")
        current.write.parquet(path)
        current = spark.read.schema("u long, v long").parquet(path)
        if kept:
            remove(spark, kept)
        kept = path
        found = current.agg(state.alias("s")).first().s
        if found == seen or not found[0]:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = found
        both = current.union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        current = _small_star(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")
