"""Connected components of a link table, by spreading the smallest label with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traymetrics.llm.common import drop_landed, land


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of links (a, b), longs; the label is the component's least node.

    Each round hangs every node's neighbours and parent on the least of them (large and small star
    in one step), which shortens paths by a factor, so rounds grow with the logarithm of the longest
    path. A node of very many links only ever combines a minimum before the shuffle.
    """
    edges = land(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    while True:
        # large star: larger neighbours of u to its least neighbour or u itself
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = land(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "links")
        # small star: smaller neighbours of u, and u, to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        after = land(small, "links")
        drop_landed(edges, large)
        edges = after
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label").union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
