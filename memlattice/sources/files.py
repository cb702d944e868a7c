"""Sources and sinks: directories of files, JSON lines, archives, snapshots, ledgers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlattice.operators.lifecycle import fixed_chunks

CHUNK = 1400


def directory(spark: SparkSession, path: str, size: int = CHUNK, pattern: str = "*.{txt,md,csv,json,html}") -> DataFrame:
    """Text files below a path as chunks: ``path``, ``chunk_index``, ``chunk_text``, ``content_hash``."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return fixed_chunks(files, size, "path")


def converted(spark: SparkSession, path: str, convert: Callable[[bytes, str], str], pattern: str = "*") -> DataFrame:
    """Binary files through an injected converter: ``path``, ``text``, ``error``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, errors = [], []
            for content, name in zip(frame["content"], frame["path"], strict=True):
                try:
                    texts.append(convert(bytes(content), name))
                    errors.append(None)
                except Exception as e:  # a file that cannot be read is a row, not a failed job
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"path": frame["path"], "text": texts, "error": errors})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def layered(key: str, *layers: DataFrame) -> DataFrame:
    """Layers merged by key: of each key the row of the first layer that has it."""
    out = None
    for place, layer in enumerate(layers):
        marked = layer.withColumn("_layer", F.lit(place))
        out = marked if out is None else out.unionByName(marked, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("_layer")
    return out.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_layer")


def tail(log: DataFrame, order: str, rows: int) -> DataFrame:
    """The last rows of a log."""
    return log.orderBy(F.desc(order)).limit(rows)


def upsert(stored: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Stored and new rows, of each key the one with the highest version; new wins a tie."""
    both = stored.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_n"))
    return both.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_n")


def from_arrays(rows: DataFrame, *columns: str) -> DataFrame:
    """Parallel arrays as rows."""
    return rows.select(F.explode(F.arrays_zip(*columns)).alias("r")).select("r.*")


def insert_links(stored: DataFrame, new: DataFrame, units: DataFrame) -> DataFrame:
    """Links to append: both ends exist, and no link of the same ends and type is stored."""
    ids = units.select("unit_id").distinct()
    ends = new.join(ids.withColumnRenamed("unit_id", "from_unit"), "from_unit", "left_semi").join(ids.withColumnRenamed("unit_id", "to_unit"), "to_unit", "left_semi")
    key = ["from_unit", "to_unit", "link_type"]
    return ends.dropDuplicates(key).join(stored.select(*key), key, "left_anti")


def export(banks: Mapping[str, DataFrame], path: str) -> None:
    """Tables as typed JSON, one folder a table."""
    for name, frame in banks.items():
        frame.write.mode("overwrite").json(f"{path}/{name}")


def load_export(spark: SparkSession, path: str, schemas: Mapping[str, str]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items()}


def remapped(frame: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """``frame`` with the ids of a column replaced through (``old``, ``new``); unknown ids stay."""
    joined = frame.join(ids.select(F.col("old").alias(column), F.col("new").alias("_new")), column, "left")
    return joined.withColumn(column, F.coalesce("_new", column)).drop("_new")


def snapshot(tables: Mapping[str, DataFrame], path: str) -> None:
    """A backup of tables as Parquet."""
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")


def restored(spark: SparkSession, path: str, schemas: Mapping[str, str]) -> dict[str, DataFrame]:
    """Tables of a backup, checked against the schemas asked for."""
    out = {}
    for name, schema in schemas.items():
        frame = spark.read.parquet(f"{path}/{name}")
        wanted = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema}
        held = {f.name: f.dataType for f in frame.schema}
        if wanted != held:
            raise ValueError(f"{name}: the backup has {held}, asked for {wanted}")
        out[name] = frame
    return out


def archived(rows: DataFrame, content: str) -> DataFrame:
    """Content-addressed rows: ``address`` (SHA-256) and content, one for each address."""
    return rows.select(F.sha2(F.col(content).cast("binary"), 256).alias("address"), F.col(content).alias("content")).dropDuplicates(["address"])


def damaged(archive: DataFrame) -> DataFrame:
    """Archived rows whose content no longer has their address."""
    return archive.where(F.sha2(F.col("content").cast("binary"), 256) != F.col("address"))


def signed_outbox(events: DataFrame, payload: Column, secret: str) -> DataFrame:
    """Deliveries with a keyed digest, ready for a sink; the digest follows the usual two-pass construction."""
    block = secret.encode()[:64].ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), payload.cast("binary")), 256))
    return events.withColumn("signature", F.sha2(F.concat(F.lit(outer), first), 256))
