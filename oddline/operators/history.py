"""Queries over the table of past detections.

Columns used: ``seq, log_id, cleaned_log, score, is_anomaly, confidence,
neighbors, explanation`` and, for trends and categories, ``ts`` and a category.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from oddline import fixed_values as fv
from oddline.functions.explain import percent
from oddline.functions.scoring import alert_band


def status(corpus: DataFrame | None, history: DataFrame, is_fitted: bool) -> DataFrame:
    """One row: fitted or not, corpus rows, history rows."""
    parts = [history.select(F.lit(0).alias("_corpus"), F.lit(1).alias("_history"))]
    if corpus is not None:
        parts.append(corpus.select(F.lit(1).alias("_corpus"), F.lit(0).alias("_history")))
    return reduce(DataFrame.unionByName, parts).agg(
        F.lit(is_fitted).alias("is_fitted"),
        F.coalesce(F.sum("_corpus"), F.lit(0)).alias("vector_db_size"),
        F.coalesce(F.sum("_history"), F.lit(0)).alias("history_count"),
    )


def anomaly_rate(history: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Total, anomalies and their share; zeros for an empty history."""
    return history.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_anomaly").alias("anomalies")
    ).withColumn(
        "rate", F.coalesce(F.try_divide(F.col("anomalies"), F.col("total")), F.lit(0.0))
    )


def recent(history: DataFrame, n: int = fv.HISTORY_ROWS) -> DataFrame:
    """The last ``n`` rows, newest first."""
    return history.orderBy(F.desc("seq")).limit(n)


def anomalies_newest_first(history: DataFrame) -> DataFrame:
    return history.filter("is_anomaly").orderBy(F.desc("seq"))


def recent_alerts(
    history: DataFrame, n: int = fv.ALERT_ROWS, within: int = fv.HISTORY_ROWS
) -> DataFrame:
    """The newest ``n`` anomalies among the last ``within`` rows."""
    return anomalies_newest_first(recent(history, within)).limit(n)


def alert_summary(summary: Column) -> Column:
    """First sentence of the summary without its dot."""
    head = F.nullif(F.substring_index(summary, ".", 1), F.lit(""))
    return F.coalesce(head, F.lit(fv.NO_SUMMARY))


def alert_view(alerts: DataFrame) -> DataFrame:
    """What an alert list shows."""
    return alerts.select(
        "seq",
        F.concat(F.substring("log_id", 1, 8), F.lit("...")).alias("short_id"),
        percent(F.col("score"), "0").alias("score_text"),
        alert_band(F.col("score")).alias("severity"),
        alert_summary(F.col("explanation.summary")).alias("summary"),
    )


def detection_response(results: DataFrame) -> DataFrame:
    """Flat view of detector output; a result without confidence gets 0.5."""
    nested = "anomaly_score" in results.columns
    prefix = "anomaly_score." if nested else ""
    names = F.col("anomaly_score.nearest_neighbors") if nested else F.col("neighbors")
    confidence = F.col("anomaly_score.confidence") if nested else F.lit(fv.HYBRID_CONFIDENCE)
    return results.select(
        "seq",
        "log_id",
        "cleaned_log",
        F.col(f"{prefix}score").alias("score"),
        F.col(f"{prefix}is_anomaly").alias("is_anomaly"),
        confidence.alias("confidence"),
        F.slice(names, 1, fv.SIMILAR_LOGS).alias("neighbors"),
        F.when(
            F.col("explanation").isNotNull(),
            F.struct(
                "explanation.summary", "explanation.details", "explanation.recommendations"
            ),
        ).alias("explanation"),
    )


def trend(history: DataFrame, bucket: str = fv.TREND_BUCKET, ts: str = "ts") -> DataFrame:
    """Rows and anomalies per time bucket."""
    return (
        history.groupBy(F.window(ts, bucket).alias("w"))
        .agg(F.count(F.lit(1)).alias("total"), F.count_if("is_anomaly").alias("anomalies"))
        .select(F.col("w.start").alias("bucket_start"), "total", "anomalies")
    )


def by_category(history: DataFrame, category: str) -> DataFrame:
    """Anomalies per category with their share of all anomalies."""
    counts = history.filter("is_anomaly").groupBy(category).agg(F.count(F.lit(1)).alias("alerts"))
    total = counts.agg(F.sum("alerts").alias("_total"), F.lit(1).alias("_all"))  # one row
    return (
        counts.withColumn("_all", F.lit(1))
        .join(F.broadcast(total), "_all")
        .select(category, "alerts", (F.col("alerts") / F.col("_total")).alias("share"))
    )
