"""Operator 1, exact dedup by deterministic block naming.

Texts are cut into blocks of fixed size. Equal blocks, and only equal blocks, get one integer name:
the distinct blocks are sorted and numbered. Then adjacent names are paired and the distinct pairs
are sorted and numbered again, until one name is left for each text. Two texts are equal exactly
when they finish in the same round with the same name; no hash decides it.

Blocks are told apart by a hash first, so only 8 bytes per block travel after the distinct blocks
are known; hashes that different blocks share are split by the blocks themselves. Distinct blocks
and pairs combine on the map side, so a text that a third of all rows repeat is one row per task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traymetrics.llm.common import drop_landed, land, null_as_empty, query, table

BLOCK_BYTES = 2048

_KEY = ["_id", "_sha"]


def _blocks(texts: DataFrame, size: int, hashed: Callable[[Column], Column]) -> DataFrame:
    """(id, sha, n, i, hash, block): one row per block; an empty text is one empty block."""
    data = F.col("_text").cast("binary")
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("_text") / size).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.substring(F.col("_data"), i * size + 1, F.lit(size)))
    rows = texts.select("_id", "_sha", data.alias("_data"), count.alias("_n")).select("_id", "_sha", "_n", F.posexplode(cut).alias("_i", "_block"))
    return rows.withColumn("_hash", hashed(F.col("_block")))


def _numbered(distinct: DataFrame, *order: str) -> DataFrame:
    """Sorted rows with an integer name each; landed, so a lost executor cannot rename them."""
    return land(distinct.orderBy(*order).withColumn("_name", F.monotonically_increasing_id()), "names")


def _first_names(blocks: DataFrame) -> DataFrame:
    """(id, sha, n, i, name) of level 0."""
    distinct = blocks.select("_hash", "_block").distinct()
    hashes = land(distinct.groupBy("_hash").agg(F.count(F.lit(1)).alias("_different")), "hashes")
    names = _numbered(hashes.filter("_different = 1").select("_hash"), "_hash")
    slim = blocks.drop("_block")
    named = slim.join(names, "_hash").select(*_KEY, "_n", "_i", "_name")
    shared = hashes.filter("_different > 1").select("_hash")
    if not shared.isEmpty():  # different blocks under one hash: named by their bytes, below zero
        by_bytes = _numbered(distinct.join(shared, "_hash", "left_semi"), "_hash", "_block")
        some = blocks.join(by_bytes, ["_hash", "_block"]).select(*_KEY, "_n", "_i", (-1 - F.col("_name")).alias("_name"))
        named = named.unionByName(some)
    return land(named, "level0")


def identities(texts: DataFrame, size: int, hashed: Callable[[Column], Column]) -> DataFrame:
    """(id, sha, level, name): equal (level, name) exactly for equal texts."""
    rows = _first_names(_blocks(texts, size, hashed))
    done, level = [rows.filter("_n = 1").select(*_KEY, F.lit(0).alias("_level"), "_name")], 0
    rest = rows.filter("_n > 1")
    while not rest.isEmpty():
        level += 1
        half = F.floor(F.col("_i") / 2).cast("int")
        left, right = (F.max(F.when(F.col("_i") % 2 == k, F.col("_name"))) for k in (0, 1))
        # a missing right neighbour is told apart from every name by its own column
        pairs = rest.groupBy(*_KEY, "_n", half.alias("_j")).agg(left.alias("_l"), F.coalesce(right, F.lit(0)).alias("_r"), right.isNull().alias("_odd"))
        pairs = land(pairs, "pairs")
        names = _numbered(pairs.select("_l", "_r", "_odd").distinct(), "_l", "_r", "_odd")
        named = pairs.join(names, ["_l", "_r", "_odd"]).select(*_KEY, F.ceil(F.col("_n") / 2).cast("int").alias("_n"), F.col("_j").alias("_i"), "_name")
        rows = land(named, "level")
        drop_landed(pairs, names)
        done.append(rows.filter("_n = 1").select(*_KEY, F.lit(level).alias("_level"), "_name"))
        rest = rows.filter("_n > 1")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.distinct()


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = BLOCK_BYTES, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. The largest key of a group stays; a null key is smaller than any
    other. Rows that repeat key and text are counted as they are and share their ``kept``. Other
    columns of ``docs`` are not read. ``hashed`` only sorts blocks into bins; any function gives the
    same result.
    """
    texts = docs.select(F.col(key).alias("_id"), null_as_empty(text).alias("_text"))
    texts = texts.withColumn("_sha", F.sha2("_text", 256))
    named = identities(texts, size, hashed)
    rows = texts.select("_id", "_sha").groupBy("_id", "_sha").agg(F.count(F.lit(1)).alias("_times"))
    on = rows["_id"].eqNullSafe(named["_id"]) & (rows["_sha"] == named["_sha"])
    rows = land(rows.join(named, on).select(rows["_id"], rows["_sha"], "_times", "_level", "_name"), "identities")
    groups = rows.groupBy("_level", "_name").agg(F.max("_id").alias("keep_id"), F.sum("_times").alias("group_size"))
    out = rows.join(groups, ["_level", "_name"]).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    kept = F.col("_id").eqNullSafe(F.col("keep_id"))
    return out.select(F.col("_id").alias(key), "keep_id", "group_size", kept.alias("kept"), F.col("_sha").alias("text_sha256"))


@query(
    "op1_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
)
def op1_exact_dedup(spark, folder):
    return exact_dedup(table(spark, folder, "documents"))
