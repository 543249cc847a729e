"""Exact duplicates by a tree-merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from oddline.llm.common import columns, hot_lookup, keep_rows, lower_ascii
from oddline.session import durable

FAN_IN = 8
DIGEST = ["text_sha256", "_length", "_check"]


def digest_runs(docs: DataFrame) -> DataFrame:
    """One narrow row per document; every input split is a run."""
    text = lower_ascii(F.coalesce("text", F.lit("")))
    return columns(docs, "doc_id", "text").select(
        "doc_id",
        F.sha2(text, 256).alias("text_sha256"),
        F.octet_length(text).alias("_length"),
        F.xxhash64(text).alias("_check"),
        F.monotonically_increasing_id().alias("_row"),
        F.spark_partition_id().alias("_run"),
    )


def merge_runs(rows: DataFrame, best, fan_in: int = FAN_IN) -> DataFrame:
    """Merge runs ``fan_in`` at a time until one is left; ``best`` picks the row that stays.

    Every level combines equal digests inside each task first, so a group that
    holds a third of all rows shrinks to one row per task before anything moves.
    A level is dealt by run and digest, is sorted, and is written to the shared
    folder, so that a lost executor costs one level.  The last run, too, lies in
    as many parts as the session has shuffle partitions.
    """
    level = rows.select("_run", *DIGEST, F.struct("doc_id", "_row").alias("_best"), F.lit(1).alias("_n"))
    runs = rows.agg(F.max("_run")).first()[0]
    runs = 1 if runs is None else runs + 1
    while True:
        runs = -(-runs // fan_in)
        level = level.withColumn("_run", F.floor(F.col("_run") / fan_in))
        merged = level.groupBy("_run", *DIGEST).agg(best("_best").alias("_best"), F.sum("_n").alias("_n"))
        level = durable(merged.sortWithinPartitions("_run", *DIGEST), "runs")
        if runs == 1:
            return level.drop("_run")


def exact_dedup(docs: DataFrame, keep: str = "largest", fan_in: int = FAN_IN) -> DataFrame:
    """Group documents whose texts are equal after lower-casing A-Z.

    Takes ``doc_id`` and ``text``; returns per row ``doc_id, keep_id, group_size,
    kept, text_sha256``.  Equal means equal SHA-256, length and a second hash.
    The row with the largest (or smallest) ``doc_id`` stays; of repeated rows with
    one id exactly one stays.  A null text counts as empty, a null id as lower than
    any other.  An empty table gives an empty result; other columns are ignored.
    """
    best = {"largest": F.max, "smallest": F.min}[keep]
    rows = durable(digest_runs(docs), "digests")
    groups = merge_runs(rows, best, fan_in)
    total = groups.agg(F.sum("_n")).first()[0] or 0
    found = hot_lookup(rows, groups, DIGEST, "_n", total, ["_row"])
    return found.select(
        "doc_id",
        F.col("_best.doc_id").alias("keep_id"),
        F.col("_n").cast("bigint").alias("group_size"),
        (F.col("_row") == F.col("_best._row")).alias("kept"),
        "text_sha256",
    )


def exact_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of every group of equal texts stays."""
    return keep_rows(docs, exact_dedup(docs).filter("kept"))


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = {
    "op10_exact_dedup": """
        WITH t AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                     'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
        ), g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.body) AS text_sha256
        FROM t JOIN g ON t.body = g.body
    """
}
