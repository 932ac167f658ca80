"""The stages of the corpus pipeline; each takes (spark, docs, folder of tables) and gives documents.

Dedup stages decide on rows, told apart by doc_id and text: a null doc_id is one like any other, the
smallest of all, and a doc_id that several texts have says nothing about the others of its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traymetrics.llm import bpe, decontaminate, exact_dedup, quality, similar, simhash
from traymetrics.llm.common import back_to_null, id_or_null, land, null_as_empty, table
from traymetrics.llm.components import components


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    return scored.filter(F.col("_accepted") & (F.col("_toxic") < quality.THRESHOLD)).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = exact_dedup.exact_dedup(docs).filter("kept")
    return keep_rows(docs, kept.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("times")))


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of ``docs`` for each (doc_id, text_sha256) of ``kept``; ``times`` says how often ``docs`` has it."""
    kept = land(kept, "kept")
    wanted = kept.select(F.col("doc_id").alias("_wanted_id"), F.col("text_sha256").alias("_wanted_sha"))
    out = docs.withColumn("_row_sha", F.sha2(null_as_empty(), 256))
    out = out.join(wanted, F.col("doc_id").eqNullSafe(F.col("_wanted_id")) & (F.col("_row_sha") == F.col("_wanted_sha")), "left_semi")
    if not kept.filter("times > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "_row_sha"])
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by operator 8, at few differing bits of their SimHash, the row of the least doc_id stays."""
    rows = simhash.fingerprints(docs.withColumn("text_sha256", F.sha2(null_as_empty(), 256)), carried="text_sha256")
    rows = rows.groupBy("fp", F.col("doc_id").alias("id"), "text_sha256").agg(F.count(F.lit(1)).alias("times"))
    return keep_least(docs, simhash.name_groups(land(least_row(rows, "fp"), "least")), "root")


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str, similarity: float = similar.SIMILARITY) -> DataFrame:
    """Of texts linked by similar sets of five-word shingles the row of the least doc_id stays; not in the pipeline."""
    rows = land(similar.prefixes(docs, similarity=similarity), "rows")
    found = similar.links(docs, rows, similarity)
    labels = components(land(found, "found"))
    rows = rows.groupBy(id_or_null().alias("id"), "text_sha256", "node").agg(F.count(F.lit(1)).alias("times"))
    rows = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return keep_least(docs, rows.withColumn("least", F.struct("id", "text_sha256", "times")), "label")


def least_row(rows: DataFrame, group: str) -> DataFrame:
    """(group, least): the first (id, text_sha256, times) of each group."""
    return rows.groupBy(group).agg(F.min(F.struct("id", "text_sha256", "times")).alias("least"))


def keep_least(docs: DataFrame, rows: DataFrame, group: str) -> DataFrame:
    """The rows of ``docs`` named by the least ``least`` (id, text_sha256, times) of each group."""
    kept = rows.groupBy(group).agg(F.min("least").alias("least")).select("least.*")
    return keep_rows(docs, kept.select(back_to_null("id").alias("doc_id"), "text_sha256", "times"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark_contamination(docs, table(spark, sf_dir, "benchmark"))
    return marked.filter(F.size("_hit_spans") == 0).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, checked="round_trip").withColumn("n_tokens", F.size("ids").cast("long"))
