"""Run a streaming frame over all available input into a table in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from traymetrics.session import scratch_path


def read_files(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A file or a folder of parquet files as a stream (a glob, so that a single file is allowed too)."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def write_in_turn(rows: DataFrame, at: Column, parts: int, label: str, whole: bool = True) -> str:
    """A folder of files written one after another in the order of ``at`` (numbers), for replays.

    A part is one file; unless ``whole``, each task that reads ``rows`` writes its own.
    """
    cuts = rows.agg(F.percentile_approx(at, [k / parts for k in range(1, parts)], 10_000)).first()[0] or []
    path = scratch_path(rows.sparkSession, label)
    rows = rows.withColumn("_part", sum(((at > c).cast("int") for c in sorted(set(cuts))), F.lit(0)))
    for k in range(len(set(cuts)) + 1):
        part = rows.filter(F.col("_part") == k).drop("_part")
        (part.coalesce(1) if whole else part).write.mode("append").parquet(path)
    return path


def land(
    stream: DataFrame, mode: str = "append", label: str = "stream", state_store: str | None = None, each: Callable[[DataFrame], DataFrame] | None = None, schema: StructType | None = None
) -> DataFrame:
    """Drain a stream with availableNow and return what it wrote, with ``_batch``.

    Every micro-batch overwrites its own folder, so a replayed batch leaves no duplicates. ``each``
    turns a batch into the rows to write, of ``schema``.
    """
    root = scratch_path(stream.sparkSession, label)
    schema = schema or stream.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        (each(batch) if each else batch).write.mode("overwrite").parquet(f"{root}/rows/_batch={batch_id}")

    _drain(stream, mode, root, write, state_store)
    return stream.sparkSession.read.schema(StructType(schema.fields).add("_batch", "long")).parquet(f"{root}/rows")


Step = Callable[[DataFrame, dict[str, DataFrame], bool], dict[str, DataFrame]]


def land_carrying(stream: DataFrame, step: Step, tables: dict[str, str], label: str = "stream", flush: bool = True) -> DataFrame:
    """Drain a stream through ``step(batch, tables of the batch before, flush)`` and return its ``rows``.

    ``tables`` gives the schema of ``rows``, which are kept, and of the tables that a batch hands to the
    next one. Every batch writes folders of its own and reads those of the batch before, so a replay
    starts from the same place. With ``flush`` one more step settles at the end what still waits.
    """
    spark = stream.sparkSession
    root = scratch_path(spark, label)
    last = [-1]

    def write(batch: DataFrame, batch_id: int, flush: bool = False) -> None:
        session = batch.sparkSession
        read = lambda name: session.read.schema(tables[name]).parquet(f"{root}/{name}/_batch={batch_id - 1}") if batch_id else session.createDataFrame([], tables[name])
        for name, df in step(batch, {n: read(n) for n in tables if n != "rows"}, flush).items():
            df.write.mode("overwrite").parquet(f"{root}/{name}/_batch={batch_id}")
        last[0] = batch_id

    _drain(stream, "append", root, write)
    if flush:
        write(spark.createDataFrame([], stream.schema), last[0] + 1, True)
    return spark.read.schema(StructType(StructType.fromDDL(tables["rows"]).fields).add("_batch", "long")).parquet(f"{root}/rows")


def _drain(stream: DataFrame, mode: str, root: str, write: Callable, state_store: str | None = None) -> None:
    spark = stream.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    if state_store:
        spark.conf.set(key, state_store)
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
        writer.foreachBatch(lambda batch, batch_id: write(batch, batch_id)).start().awaitTermination()
    finally:
        spark.conf.set(key, before)


def latest_update(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The newest version of each key of an update-mode stream."""
    rest = [c for c in rows.columns if c not in keys and c != "_batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*")
