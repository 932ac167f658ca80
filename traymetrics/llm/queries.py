"""The queries of this subpackage; importing the operators registers them."""

import corpus_pipeline
from traymetrics.llm import bpe, conversations, decontaminate, exact_dedup, pii, quality, search, sharding, simhash, substring_dedup, suffix_dedup, toxicity, warc  # noqa: F401
from traymetrics.llm.common import ORACLE as LLM_ORACLE
from traymetrics.llm.common import QUERIES as LLM_QUERIES

LLM_QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    LLM_ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL

__all__ = ["LLM_ORACLE", "LLM_QUERIES"]
