"""A training corpus from raw documents, in five stages; each is written and read again.

1. quality: the co-trained classifiers score all documents; the rejected and the toxic ones go.
2. exact dedup: of equal texts the one with the largest doc_id stays.
3. near dedup: of each group linked by operator 8 (SimHash fingerprints that differ in four bits or
   fewer) the smallest doc_id stays.
4. decontamination: documents that hold a window of the benchmark go.
5. tokens: every text is encoded by byte-level BPE and checked against its decoding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from traymetrics.llm import stages
from traymetrics.llm.common import land, table

ORACLE_SQL = None  # a learned model and BPE merges; tests compare the stages with plain Python

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", stages.keep_good),
    ("exact_dedup", stages.drop_copies),
    ("near_dedup", stages.drop_near_copies),
    ("decontaminate", stages.drop_contaminated),
    ("tokens", stages.tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = land(stage(spark, docs, sf_dir), name)
    return docs
