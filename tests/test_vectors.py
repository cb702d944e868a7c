"""Vector search over tables with missing, short and zero vectors, and over none."""

import math
from datetime import datetime

from pyspark.sql import functions as F

from memlattice.operators import retrieval, vectors
from memlattice.plans.recall import hybrid

UNITS = "unit_id long, kind string, embedding array<float>, text string, proof_count int"


def frames(spark, units, queries):
    return spark.createDataFrame(queries, "query_id string, vector array<float>, text string"), spark.createDataFrame(units, UNITS)


ODD = [(1, "a", [1.0, 0.0], "red stone", 1), (2, "a", None, "red house", 1), (3, "b", [0.0, 0.0], "x", 1), (4, "b", [1.0], "stone", 1), (5, "a", [None, 1.0], "y", 1), (6, None, [0.8, 0.6], "blue", 1), (7, "a", [math.nan, 1.0], None, 1)]
ASKED = [("q", [1.0, 0.0], "red stone"), ("none", None, "blue"), ("short", [2.0], "")]


def test_semantic_skips_what_is_no_vector(spark):
    queries, units = frames(spark, ODD, ASKED)
    rows = retrieval.semantic(queries, units, 5, floor=-1.0, digits=6).collect()
    assert {(r.query_id, r.unit_id, r.score) for r in rows} == {("q", 1, 1.0), ("q", 3, 0.0), ("q", 6, 0.8), ("short", 4, 1.0)}


def test_semantic_without_a_side(spark):
    queries, units = frames(spark, ODD, ASKED)
    assert retrieval.semantic(queries, units.limit(0), 5).collect() == []
    assert retrieval.semantic(queries.limit(0), units, 5).collect() == []
    assert retrieval.semantic(queries.where("query_id = 'none'"), units, 5).count() == 0


def test_inverted_file_of_odd_and_no_rows(spark):
    queries, units = frames(spark, ODD, ASKED)
    held = vectors.centroids(units, 2)
    rows = vectors.search(queries, vectors.index(units, held), held, 5, 2, digits=6).collect()
    assert {(r.query_id, r.unit_id) for r in rows} == {("q", 1), ("q", 3), ("q", 6)}
    none = vectors.centroids(units.limit(0), 4)
    assert vectors.search(queries, vectors.index(units, none), none, 5, 2).count() == 0


def test_recall_over_an_empty_bank(spark):
    queries, units = frames(spark, ODD, ASKED)
    assert hybrid(queries, units.limit(0)).count() == 0
    assert {r.unit_id for r in hybrid(queries, units).where("query_id = 'q'").collect()} >= {1, 6}


def test_recall_takes_its_window_from_the_text(spark):
    units = spark.createDataFrame([(n, "fact", [1.0, 0.1 * n], f"note {n}", 1, datetime(2024, n, 5)) for n in range(1, 9)], "unit_id long, kind string, embedding array<double>, text string, proof_count long, at timestamp_ntz")
    asked = [("q", "what happened in March 2024", [1.0, 0.2], datetime(2024, 9, 1))]
    queries = spark.createDataFrame(asked, "query_id string, text string, vector array<double>, now timestamp_ntz")
    window = queries.select("*", F.lit(datetime(2024, 3, 1)).cast("timestamp_ntz").alias("low"), F.lit("2024-03-31 23:59:59.999999").cast("timestamp_ntz").alias("high"))
    ours, given = ([tuple(r) for r in hybrid(q, units).orderBy("rank").collect()] for q in (queries, window))
    assert ours == given and ours[0][1] == 3
