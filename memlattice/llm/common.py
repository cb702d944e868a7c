"""Helpers that several corpus operators share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may be of any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It comes from ``spark.checkpoint.dir``; only where that is unset (tests on one
    machine) a folder below the warehouse is set for the session.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder for a table that cuts lineage.

    Results are read from such tables for as long as they are used, so they go only
    with ``clear_scratch``.
    """
    return f"{shared_folder(spark)}/memlattice/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all tables that this application wrote with ``scratch``; call it when no result of theirs is needed any more."""
    remove(spark, f"{shared_folder(spark)}/memlattice/{spark.sparkContext.applicationId}")


def materialized(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table once nothing reads it any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are evaluated once a row, here.

    A row generator of one row stands between them and what follows, which keeps the
    optimizer from putting their expressions into later filters or lambda functions,
    where they would be evaluated again for each use.
    """
    kept = [named(c) for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))))


def named(column: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def guarded(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame], dict[str, str]]:
    """``docs`` with plain column names of which none begins with "_", the way back, and the new name of each column.

    The operators' work columns begin with "_", so none of a caller's columns can be
    taken for one.  Columns that begin with "_", are written with other characters, or
    repeat a name, are renamed for the work and get their names back.
    """
    plain, used, names = re.compile("[A-Za-z][A-Za-z0-9_]*").fullmatch, {c.lower() for c in docs.columns}, []
    for k, name in enumerate(docs.columns):
        if not plain(name) or name.lower() in {n.lower() for n in names}:
            name = f"own{k}"
            while name in used:
                name += "_"
            used.add(name)
        names.append(name)
    back = dict(zip(names, docs.columns, strict=True))
    return docs.toDF(*names), lambda df: df.toDF(*(back.get(c, c) for c in df.columns)), dict(zip(docs.columns, names, strict=True))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def arrow_rows(spark: SparkSession, rows: int = 512) -> None:
    """Small Arrow batches, by rows and bytes: whole texts can be long, and a batch sits in memory.

    The setting stays with the session; other queries only get smaller batches by it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
