"""Left joins to lookup tables whose keys may be hot on the side of the facts."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traymetrics.session import materialize

LOOKUP_ROWS = 100_000  # a counted lookup of up to so many short rows is broadcast
HEAVY_PARTS = 1_000  # a key is heavy from one row in so many on, so at most so many keys are


def small(lookup: DataFrame, lookup_rows: int = LOOKUP_ROWS) -> DataFrame:
    """The lookup, marked for a broadcast if it is counted as small, so the rows it meets stay where they are."""
    return F.broadcast(lookup) if lookup.limit(lookup_rows + 1).count() <= lookup_rows else lookup


def lookup_join(df: DataFrame, lookup: DataFrame, keys: list[str], lookup_rows: int = LOOKUP_ROWS, heavy_parts: int = HEAVY_PARTS) -> DataFrame:
    """``df.join(lookup, keys, "left")`` for a lookup with one row per key, without a hot task.

    A lookup counted as small is broadcast, and no row of ``df`` moves. Beyond that the keys of
    ``df`` are counted (combined before the shuffle): rows of heavy keys meet the lookup rows of
    these keys, which are few by the definition of heavy, in a broadcast join; rows with a null in
    their key match nothing and stay where they are; only the rest is shuffled by key.
    """
    if lookup.limit(lookup_rows + 1).count() <= lookup_rows:
        return df.join(F.broadcast(lookup), keys, "left")
    df, lookup = materialize(df), materialize(lookup)
    missing = functools.reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    least = df.count() / heavy_parts
    counted = df.filter(~missing).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    heavy = materialize(counted.filter(F.col("_rows") >= least).select(*keys, F.lit(True).alias("_heavy")))
    marked = df.join(F.broadcast(heavy), keys, "left").withColumn("_stays", F.col("_heavy").isNotNull() | missing).drop("_heavy")
    of_heavy = lookup.join(F.broadcast(heavy), keys, "left_semi")
    stay = marked.filter("_stays").join(F.broadcast(of_heavy), keys, "left")
    move = marked.filter("NOT _stays").join(lookup, keys, "left")
    return stay.unionByName(move).drop("_stays")
