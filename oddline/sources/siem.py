"""Security-event records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from oddline import fixed_values as fv
from oddline.functions.severity import is_anomaly_severity, risk_score
from oddline.sources.logs import read_json


def load_records(
    spark: SparkSession, path: str, max_rows: int | None = None, order: str = "event_id"
) -> DataFrame:
    """Records from parquet or JSON, all of them or the first ``max_rows`` by id."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith("parquet") else read_json(spark, path)
    return first_rows(df, max_rows, order)


def first_rows(df: DataFrame, max_rows: int | None, order: str = "event_id") -> DataFrame:
    return df if not max_rows else df.orderBy(order).limit(max_rows)


def label_records(df: DataFrame) -> DataFrame:
    """Add the flat ``risk_score`` and the severity label ``is_anomaly``."""
    if "risk_score" not in df.columns:
        df = df.withColumn("risk_score", risk_score(df))
    return df.withColumn("is_anomaly", is_anomaly_severity(F.col("severity")))


def log_texts(df: DataFrame) -> DataFrame:
    return df.select("description")


def raw_logs(df: DataFrame) -> DataFrame:
    return df.select("raw_log")


def split_normal_anomaly(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(normal, anomalous) as ``(event_id, description)``; two pushed-down filters."""
    columns = ["event_id", "description"]
    return (
        labelled.filter(~F.col("is_anomaly")).select(*columns),
        labelled.filter(F.col("is_anomaly")).select(*columns),
    )


def record_metadata(labelled: DataFrame) -> DataFrame:
    return labelled.select(
        "event_id",
        "event_type",
        "severity",
        "source",
        "risk_score",
        "is_anomaly",
        F.substring("description", 1, fv.DESCRIPTION_CHARS).alias("description"),
    )


def totals(labelled: DataFrame) -> DataFrame:
    return labelled.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if("is_anomaly").alias("anomaly_count"),
        F.count_if(~F.col("is_anomaly")).alias("normal_count"),
        F.avg("risk_score").alias("avg_risk_score"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, missing values left out."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
