"""Backups that are whole or not there: a manifest of all files, published last.

Tables are written first, then every file's length and digest, and at last the manifest
gets its name in one rename.  A backup without a manifest is none, whatever else lies
there, and one whose files differ from its manifest is refused with their names.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST, SCHEMA = "_manifest", "table string, file string, length long, digest string, columns string"


class Torn(RuntimeError):
    """What lies there is no whole backup."""


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _digests(spark: SparkSession, path: str, tables: Sequence[str]) -> DataFrame:
    """``table``, ``file``, ``length``, ``digest`` of every data file, read where it lies."""
    found = None
    for table in tables:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/{table}")
        name = F.regexp_extract("path", f"/{table}/(.*)$", 1)
        one = files.select(F.lit(table).alias("table"), name.alias("file"), "length", F.sha2("content", 256).alias("digest"))
        found = one if found is None else found.unionByName(one)
    return found


def backup(tables: Mapping[str, DataFrame], path: str) -> None:
    """Write the tables and their manifest below ``path``; an existing backup is refused.

    What an interrupted backup left there is written over.
    """
    if not tables:
        raise ValueError("a backup needs tables")
    spark = next(iter(tables.values())).sparkSession
    system, hadoop = _files(spark, path)
    if system.exists(hadoop(f"{path}/{MANIFEST}")):
        raise FileExistsError(f"{path} holds a backup")
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")
    columns = spark.createDataFrame([(name, frame.schema.json()) for name, frame in tables.items()], "table string, columns string")
    rows = _digests(spark, path, list(tables)).withColumn("columns", F.lit(None).cast("string"))
    rows = rows.unionByName(columns.select("table", F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("length"), F.lit(None).cast("string").alias("digest"), "columns"))
    rows.write.mode("overwrite").json(f"{path}/{MANIFEST}.part")
    if not system.rename(hadoop(f"{path}/{MANIFEST}.part"), hadoop(f"{path}/{MANIFEST}")):
        raise Torn(f"{path}: the manifest could not be published")


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    system, hadoop = _files(spark, path)
    if not system.exists(hadoop(f"{path}/{MANIFEST}")):
        raise Torn(f"{path} has no manifest: the backup was not finished")
    return spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(f"{path}/{MANIFEST}")


def faults(spark: SparkSession, path: str) -> DataFrame:
    """``table``, ``file``, ``fault`` (missing, unknown, changed) where the files are not those of the manifest."""
    manifest = _manifest(spark, path)
    system, hadoop = _files(spark, path)
    tables = [r.table for r in manifest.where("columns IS NOT NULL").select("table").collect()]  # a row a table
    there = [t for t in tables if system.exists(hadoop(f"{path}/{t}"))]
    told = manifest.where("file IS NOT NULL").select("table", "file", F.col("length").alias("_length"), F.col("digest").alias("_digest"))
    held = _digests(spark, path, there) if there else told.limit(0).select("table", "file", F.col("_length").alias("length"), F.col("_digest").alias("digest"))
    both = told.join(held, ["table", "file"], "full")
    fault = F.when(F.col("digest").isNull(), "missing").when(F.col("_digest").isNull(), "unknown").when((F.col("length") != F.col("_length")) | (F.col("digest") != F.col("_digest")), "changed")
    return both.select("table", "file", fault.alias("fault")).where("fault IS NOT NULL")


def restore(spark: SparkSession, path: str, tables: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The tables of a whole backup; every file is verified before any is given out."""
    if found := faults(spark, path).orderBy("table", "file").limit(5).collect():
        raise Torn(f"{path}: " + ", ".join(f"{r.table}/{r.file} {r.fault}" for r in found))
    schemas = {r.table: StructType.fromJson(json.loads(r.columns)) for r in _manifest(spark, path).where("columns IS NOT NULL").collect()}
    if unknown := set(tables or []) - set(schemas):
        raise KeyError(f"the backup has no table {sorted(unknown)}")
    return {name: spark.read.schema(schemas[name]).parquet(f"{path}/{name}") for name in tables or schemas}
