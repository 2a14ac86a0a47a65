"""From raw documents to token digests: quality, near copies, repeats, mixture, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import byte_bpe, mixing, near_copies, quality_rules, substring_dedup
from quire.llm.common import table, written

#: Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("quality rules", quality_rules.stage),
    ("near duplicates", near_copies.stage),
    ("substring dedup", substring_dedup.stage),
    ("mixing", mixing.stage),
    ("byte-level BPE", byte_bpe.stage),
]

#: No SQL: the covariance estimate, XXH64 and BPE are beyond it; tests/llm/test_bpe_pipeline.py has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
