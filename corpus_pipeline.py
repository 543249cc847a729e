"""A corpus from raw documents to packed sequences.

Language identification, exact dedup, near dedup, packing; each stage is written
as Parquet to the shared folder and works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oddline.llm.exact_dedup import exact_stage
from oddline.llm.language_id import language_stage
from oddline.llm.near_dedup import near_stage
from oddline.llm.packing import packing_stage
from oddline.session import durable

STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("ngram_jaccard_join", near_stage),
    ("best_fit_packing", packing_stage),
]

# Segmentation sums, similarity components and best-fit packing have no SQL; the
# tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name)
    return docs
