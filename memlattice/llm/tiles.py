"""Large keys dealt into tiles, of which every two meet in a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlattice.llm.common import materialized


def hot_keys(rows: DataFrame, key: str, tiles: Column) -> DataFrame:
    """The keys whose rows take more than one tile, with their number ``tiles`` (an aggregate); a row for each tile of rows at most."""
    return materialized(rows.groupBy(key).agg(tiles.cast("int").alias("tiles")).where("tiles > 1"), "tiles")


def dealt(rows: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Rows with the two tiles ``x``, ``y`` in which they meet others of their key and the ``side`` they are on.

    Most keys have one tile; ``hot`` has the others.  Tiles are dealt by hash of ``node``.
    """
    each = rows.join(hot, key, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    each = each.withColumn("t", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    each = each.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("o"))
    return each.withColumns({"x": F.least("t", "o"), "y": F.greatest("t", "o"), "side": (F.col("t") > F.col("o")).cast("int")})
