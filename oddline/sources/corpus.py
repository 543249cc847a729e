"""The vector corpus as a table.

Columns: ``seq`` (unique, arrival order), ``id``, ``embedding``,
``metadata map<string,string>``, ``ts``.  Every appended row keeps its vector;
look-ups by id see the latest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from oddline.sources import models

COLUMNS = ["seq", "id", "embedding", "metadata", "ts"]


def append_entries(corpus: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of both; absent metadata and times become null."""
    return corpus.unionByName(new, allowMissingColumns=True)


def last_given(column: str) -> Column:
    """The latest value that is not null.

    ``max_by`` merges inside each map task, so an id with very many rows sends
    one row per task.
    """
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("seq"))).alias(column)


def latest_entries(corpus: DataFrame) -> DataFrame:
    """One row per id: the last vector, the last given metadata and time."""
    return corpus.groupBy("id").agg(*[last_given(c) for c in ("embedding", "metadata", "ts")])


def latest_metadata(corpus: DataFrame) -> DataFrame:
    """``(id, metadata)``: the last given metadata of each id; vectors are not read."""
    return corpus.groupBy("id").agg(last_given("metadata"))


def lookup(corpus: DataFrame, id_value: str) -> DataFrame:
    """Vector, metadata and time of one id; no row if it is absent."""
    return latest_entries(corpus.filter(F.col("id") == id_value))


def lookup_many(corpus: DataFrame, ids: DataFrame) -> DataFrame:
    """The entries of all ``ids(id)`` that the corpus has; others are not aggregated."""
    return latest_entries(corpus.join(ids.select("id").distinct(), "id", "left_semi"))


def corpus_stats(corpus: DataFrame, index_type: str = "Flat", is_trained: bool = True) -> DataFrame:
    return corpus.agg(
        F.count(F.lit(1)).alias("total_vectors"),
        F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("embedding_dim"),
        F.lit(index_type).alias("index_type"),
        F.lit(is_trained).alias("is_trained"),
        F.coalesce(F.bool_or(F.col("metadata").isNotNull()), F.lit(False)).alias("has_metadata"),
        F.coalesce(F.bool_or(F.col("ts").isNotNull()), F.lit(False)).alias("has_timestamps"),
    )


def save_corpus(corpus: DataFrame, path: str, settings: dict[str, str] | None = None) -> None:
    """Write a new version; the folder may be the one that ``corpus`` is read from."""
    spark, version = corpus.sparkSession, models.new_version(path)
    corpus.write.parquet(f"{version}/corpus")
    models.write_settings(spark, f"{version}/settings", settings or {})
    models.publish(spark, path, version)


def load_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """The newest version and its settings."""
    version = models.newest_version(spark, path)
    return spark.read.parquet(f"{version}/corpus"), models.read_settings(spark, f"{version}/settings")
