"""Helpers the operators share: table reading, landed intermediate tables, digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traymetrics.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

NULL_ID = -(1 << 63)  # stands for a null doc_id inside an operator; sorts before every id


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` and, where SQL can express it, the SQL of the same rows."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def land(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts lineage, survives lost executors.

    Spark is told to delete the shuffle files of this job when it ends; nothing reads them after it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_landed(*tables: DataFrame) -> None:
    """Delete landed tables that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def null_as_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def id_or_null(name: str = "doc_id") -> Column:
    """A doc_id that equals itself when null."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def back_to_null(name: str = "doc_id") -> Column:
    return F.when(F.col(name) != F.lit(NULL_ID), F.col(name))


def keep_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``ids`` (null equals null)."""
    wanted = ids.select(F.col("doc_id").alias("_wanted_id"))
    return docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["_wanted_id"]), "left_semi")
