"""Operator 9, sharding by sampled splitters (law ``bytes``: sizes near equal).

Rows are ordered by (hash of the text, doc_id), so equal texts lie side by side. A sample in which a
row's chance grows with its size gives splitters at the quantiles; they cut the order into many
small ranges. A range whose exact size is too large is divided by further splitters drawn inside it.
Exact running sizes over the ranges then place every row, and the row's place in its shard follows
from counts per range, so no task ever holds a shard.

Equal texts stay in one shard as long as their total is small beside a shard; a larger group of
copies is an overfull range like any other and is divided by doc_id.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traymetrics.llm.common import land, null_as_empty, query, table

SHARDS = 24
RANGES = 768  # ranges asked for; with those of overfull ones the table of splitters stays below RANGE_LIMIT
OVERSAMPLE = 16  # sampled keys per range
ROUNDS = 3  # of dividing overfull ranges
WHOLE = 0.02  # copies up to this part of a shard's size stay together

_ORDER = ["_g", "_has_id", "_id", "_n"]


def _chance(total: int, wanted: int, salt: int) -> Column:
    """True with a chance of size * wanted / total; the same rows on every run."""
    draw = F.pmod(F.xxhash64("_g", "_id", "_n", F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)
    return draw < F.col("size") * float(wanted) / float(max(total, 1))


def _with_range(rows: DataFrame, splits: list[tuple]) -> DataFrame:
    """Adds the number of splitters at or below the row: a binary search in a constant sorted array."""
    if not splits:
        return rows.withColumn("_range", F.lit(0))
    points = F.from_json(F.lit(json.dumps([dict(zip(_ORDER, p)) for p in splits])), "array<struct<_g:bigint,_has_id:boolean,_id:bigint,_n:bigint>>")
    steps = F.array(*[F.lit(1 << k) for k in range(len(splits).bit_length() - 1, -1, -1)])
    found = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when((at + step <= len(splits)) & (F.get(F.col("_points"), at + step - 1) <= F.col("_row")), at + step).otherwise(at),
    )
    return rows.select("*", F.struct(*_ORDER).alias("_row"), points.alias("_points")).withColumn("_range", found).drop("_row", "_points")


def _quantiles(sample: list[tuple], pieces: int) -> list[tuple]:
    sample = sorted(sample)
    return sorted({sample[len(sample) * k // pieces] for k in range(1, pieces)}) if sample else []


def splitters(rows: DataFrame, total: int, ranges: int, oversample: int, rounds: int) -> list[tuple]:
    """Sorted splitters; the driver sees the sample (about ranges * oversample keys) and range sizes."""
    key = lambda r: (r["_g"], r["_has_id"], r["_id"], r["_n"])
    sample = [key(r) for r in rows.filter(_chance(total, ranges * oversample, 0)).select(*_ORDER).collect()]
    splits = _quantiles(sample, ranges)
    for turn in range(1, rounds + 1):
        sized = _with_range(rows, splits).groupBy("_range").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("c")).collect()
        over = {r["_range"]: r["b"] for r in sized if r["c"] > 1 and r["b"] > 2 * max(1, total // ranges)}
        if not over:
            break
        inside = _with_range(rows, splits).filter(F.col("_range").isin(list(over)) & _chance(total, 4 * ranges * oversample, turn))
        by: dict[int, list[tuple]] = {}
        for r in inside.select("_range", *_ORDER).collect():
            by.setdefault(r["_range"], []).append(key(r))
        more = [q for k, keys in by.items() for q in _quantiles(keys, -(-over[k] * ranges // max(total, 1)))]
        if not set(more) - set(splits):
            break
        splits = sorted(set(splits) | set(more))
    return splits


def shard(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", ranges: int = RANGES, oversample: int = OVERSAMPLE, rounds: int = ROUNDS, whole: float = WHOLE) -> DataFrame:
    """One row per row of ``docs``: key, size, text_crc32, law, shard, slot, grown_shard (null).

    The size is the text's UTF-8 bytes plus 8; a null text has none and counts as empty. Null keys
    come first among equal texts; rows that repeat key and text are told apart by a running number.
    ``slot`` runs from 0 without gaps in each shard. Other columns of ``docs`` are not read.
    """
    value = null_as_empty(text)
    rows = docs.select(
        F.col(key).alias("_key"),
        F.col(key).isNotNull().alias("_has_id"),
        F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("_id"),
        (F.octet_length(value) + 8).cast("long").alias("size"),
        F.crc32(value.cast("binary")).alias("text_crc32"),
        F.xxhash64(value).alias("_g"),
    )
    # rows that repeat everything: one running number each
    times = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_times"))
    rows = times.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).drop("_times")
    rows = land(rows, "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 0
    rows = land(_with_range(rows, splitters(rows, total, ranges, oversample, rounds)), "ranges")

    sized = rows.groupBy("_range").agg(F.sum("size").alias("_bytes"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range, a bounded number
    starts = sized.select("_range", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(F.broadcast(starts), "_range").withColumn("_at", F.col("_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = land(placed.drop("_start"), "places")

    # middle of the group if it is small enough to stay whole, else of the row
    share = max(total, 1) / shards
    groups = placed.groupBy("_g").agg(F.min("_at").alias("_from"), F.sum("size").alias("_weight"))
    middle = F.when(F.col("_weight") <= whole * share, F.col("_from") + F.col("_weight") / 2).otherwise(F.col("_at") + F.col("size") / 2)
    number = F.least(F.lit(shards - 1), F.floor(middle / F.lit(share))).cast("int")
    numbered = land(placed.join(groups, "_g").withColumn("shard", number).drop("_from", "_weight"), "shards")

    counts = numbered.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_range", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_offset"))
    w = Window.partitionBy("shard", "_range").orderBy(*_ORDER)
    out = numbered.join(F.broadcast(offsets), ["shard", "_range"]).withColumn("slot", (F.col("_offset") + F.row_number().over(w) - 1).cast("long"))
    return out.select(F.col("_key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op9_sharding")
def op9_sharding(spark, folder):
    return shard(table(spark, folder, "documents"))
