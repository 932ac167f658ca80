"""Session helpers: defaults for new sessions and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", partitions: int = 8, scratch: str | None = None) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own.

    ``scratch`` becomes ``spark.checkpoint.dir``; finished checkpoints in it are deleted.
    """
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("traymetrics")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config(map={"spark.checkpoint.dir": scratch} if scratch else {})
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a folder of the
    warehouse serves, which every executor reaches as well.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared scratch folder."""
    return f"{scratch_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Rows frozen as a table in the shared folder: computed once, lineage cut, safe from executor loss."""
    path = scratch_path(df.sparkSession, "frozen")
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; frames that read them can't be used afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
