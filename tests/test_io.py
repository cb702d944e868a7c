"""Sources, sinks, streams and the Python surface."""

import hashlib
import hmac

from pyspark.sql import functions as F

from memlattice.plans.engine import Engine
from memlattice.sources import files
from memlattice.streaming import events


def test_directory_and_converter(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x" * 3000)
    (tmp_path / "b.md").write_text("short")
    (tmp_path / "c.bin").write_bytes(b"\xff")
    chunks = files.directory(spark, str(tmp_path)).collect()
    assert sorted(len(r.chunk_text) for r in chunks) == [5, 200, 1400, 1400]
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.converted(spark, str(tmp_path), lambda raw, name: raw.decode()).collect()}
    assert rows["b.md"].text == "short" and rows["c.bin"].text is None and "UnicodeDecodeError" in rows["c.bin"].error


def test_layers_and_upserts(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    over = spark.createDataFrame([(2, "B"), (3, "C")], "id int, v string")
    assert {(r.id, r.v) for r in files.layered("id", over, base).collect()} == {(1, "a"), (2, "B"), (3, "C")}
    old, new = base.withColumn("n", F.lit(1)), over.withColumn("n", F.lit(1))
    assert {(r.id, r.v) for r in files.upsert(old, new, ["id"], "n").collect()} == {(1, "a"), (2, "B"), (3, "C")}
    arrays = spark.createDataFrame([([1, 2], ["x", "y"])], "a array<int>, b array<string>")
    assert [(r.a, r.b) for r in files.from_arrays(arrays, "a", "b").collect()] == [(1, "x"), (2, "y")]


def test_links_need_both_ends(spark):
    units = spark.createDataFrame([(1,), (2,), (3,)], "unit_id int")
    new = spark.createDataFrame([(1, 2, "t"), (1, 2, "t"), (1, 9, "t"), (2, 3, "t")], "from_unit int, to_unit int, link_type string")
    stored = new.where("from_unit = 2")
    assert [(r.from_unit, r.to_unit) for r in files.insert_links(stored, new, units).collect()] == [(1, 2)]


def test_export_snapshot_archive(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    files.export({"t": rows}, str(tmp_path / "e"))
    assert files.load_export(spark, str(tmp_path / "e"), {"t": "id int, v string"})["t"].count() == 2
    files.snapshot({"t": rows}, str(tmp_path / "s"))
    assert files.restored(spark, str(tmp_path / "s"), {"t": "id int, v string"})["t"].count() == 2
    try:
        files.restored(spark, str(tmp_path / "s"), {"t": "id long, v string"})
    except ValueError:
        pass
    else:
        raise AssertionError("a backup of another schema was taken")
    archive = files.archived(rows.union(rows), "v")
    assert archive.count() == 2 and files.damaged(archive).count() == 0
    assert files.damaged(archive.withColumn("content", F.lit("z"))).count() == 2
    ids = spark.createDataFrame([(1, 10)], "old int, new int")
    assert sorted(r.id for r in files.remapped(rows, "id", ids).collect()) == [2, 10]


def test_signature(spark):
    row = files.signed_outbox(spark.createDataFrame([("body",)], "p string"), F.col("p"), "key").first()
    assert row.signature == hmac.new(b"key", b"body", hashlib.sha256).hexdigest()


def test_streams(spark, sf_dir, tmp_path):
    stored = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    stored.write.parquet(str(tmp_path / "in"))
    stream = events.source(spark, str(tmp_path / "in"), stored.schema.simpleString()[7:-1].replace(":", " "))
    got = {}

    def work(batch, _):
        for r in batch.groupBy("event_type").count().collect():
            got[r.event_type] = got.get(r.event_type, 0) + r["count"]

    events.drain(stream, work, str(tmp_path / "c1")).awaitTermination()
    assert got == {r.event_type: r["count"] for r in stored.groupBy("event_type").count().collect()}
    counts = events.timeseries(stream, "ts", "1 day", "1 hour", "event_type")
    query = counts.writeStream.format("memory").queryName("ts_counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("ts_counts").agg(F.sum("n")).first()[0] == stored.count()
    once = events.ledger(stream, "user_id", "ts", "100 days")
    query = once.writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("once").count() == stored.select("user_id").distinct().count()


def test_engine(spark):
    units = spark.createDataFrame(
        [(1, "en", "w", "red apple pie", [1.0, 0.0], ["a"], 1), (2, "en", "w", "green pear", [0.8, 0.6], [], 3), (3, "de", "w", "apple tree", [0.0, 1.0], None, 2)],
        "unit_id int, bank_id string, kind string, text string, embedding array<float>, tags array<string>, proof_count int",
    )
    engine = Engine({"units": units})
    asked = spark.createDataFrame([(0, "apple", [1.0, 0.0])], "query_id int, text string, vector array<float>")
    found = engine.recall(asked, bank="en").orderBy("rank").collect()
    assert [r.unit_id for r in found] == [1, 2] and found[0].packed
    assert engine.units(tags=["a"], mode="all_strict").count() == 1 and engine.stats().count() == 2


def test_entry_without_the_corpus_subpackage(tmp_path):
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "memlattice", tmp_path / "memlattice", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
