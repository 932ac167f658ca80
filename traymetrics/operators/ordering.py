"""Order-dependent work without putting one key, or the whole table, in one task.

``ordered_chunks`` range-partitions rows by their full order, so a hot key is split over many
chunks, and freezes that layout. Ranks, running sums and carried values are then computed inside
each chunk and completed with one small row per chunk (or per key that crosses a chunk border).
"""

from __future__ import annotations

import functools
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traymetrics.session import materialize

CHUNK, POS = "_chunk", "_pos"
BROADCAST_ROWS = 100_000
_POS_MASK = (1 << 33) - 1


def ordered_chunks(df: DataFrame, *order: Column) -> DataFrame:
    """Rows in total order, tagged with their range chunk and their position inside it.

    ``order`` must end in a unique column; the checkpoint keeps the sampled range bounds fixed.
    """
    tagged = df.orderBy(*order).select(
        "*",
        F.spark_partition_id().alias(CHUNK),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_POS_MASK)).alias(POS),
    )
    return materialize(tagged)


def drop_chunks(df: DataFrame) -> DataFrame:
    return df.drop(CHUNK, POS)


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """1-based rank over the whole table."""
    chunks = ordered_chunks(df, *order)
    # one row per chunk: bounded by the number of shuffle partitions
    sizes = chunks.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(CHUNK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return drop_chunks(
        chunks.join(F.broadcast(offsets), CHUNK).withColumn(name, (F.col("_offset") + F.col(POS) + 1).cast("long")).drop("_offset")
    )


class Last(NamedTuple):
    """Latest non-null value of the key before each row (or up to it, if inclusive)."""

    name: str
    value: Column
    inclusive: bool = False


class Total(NamedTuple):
    """Running total of the key up to and including each row."""

    name: str
    value: Column


def scan(chunks: DataFrame, keys: list[str], *specs: Last | Total) -> DataFrame:
    """Running values per key in chunk order, all in one pass.

    Inside a chunk they are plain windows. What earlier chunks of the same key hand over exists only
    for keys that cross a chunk border, so that table has fewer rows than there are chunks: it is
    frozen, and broadcast once its size is checked.
    """
    df = chunks.withColumns({f"_v{i}": s.value for i, s in enumerate(specs)})
    summary, handed, local, final = [], [], {}, {}
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, CHUNK).orderBy(POS)
    for i, s in enumerate(specs):
        v, h = F.col(f"_v{i}"), F.col(f"_h{i}")
        if isinstance(s, Last):
            summary.append(F.max_by(v, F.when(v.isNotNull(), F.col(POS))).alias(f"_s{i}"))
            handed.append(F.last(f"_s{i}", ignorenulls=True).over(before).alias(f"_h{i}"))
            local[s.name] = F.last(v, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0 if s.inclusive else -1))
            final[s.name] = F.coalesce(F.col(s.name), h)
        else:
            summary.append(F.sum(v).alias(f"_s{i}"))
            handed.append(F.sum(f"_s{i}").over(before).alias(f"_h{i}"))
            local[s.name] = F.sum(v).over(inside.rowsBetween(Window.unboundedPreceding, 0))
            final[s.name] = F.col(s.name) + F.coalesce(h, F.lit(0))
    some = functools.reduce(lambda a, b: a | b, [F.col(f"_h{i}").isNotNull() for i in range(len(specs))])
    carried = materialize(df.groupBy(*keys, CHUNK).agg(*summary).select(*keys, CHUNK, *handed).filter(some))
    on = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, CHUNK])])
    renamed = carried.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate([*keys, CHUNK])})
    # keys that lie together hand over once per chunk border; other keys may need more rows than fit a broadcast
    renamed = F.broadcast(renamed) if carried.count() <= BROADCAST_ROWS else renamed
    out = df.withColumns(local).join(renamed, on, "left").withColumns(final)
    return out.drop(*[f"_v{i}" for i in range(len(specs))], *[f"_h{i}" for i in range(len(specs))], *renamed.columns)


def carry_last(chunks: DataFrame, keys: list[str], value: Column, name: str, inclusive: bool = False) -> DataFrame:
    return scan(chunks, keys, Last(name, value, inclusive))


def running_sum(chunks: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    return scan(chunks, keys, Total(name, value))


def previous_value(chunks: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """lag(value): the previous row's value of the same key, null included."""
    wrapped = carry_last(chunks, keys, F.struct(value.alias("v")), "_previous_row")
    return wrapped.withColumn(name, F.col("_previous_row.v")).drop("_previous_row")
