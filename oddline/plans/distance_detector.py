"""Detector by distance to normal logs: fit, detect, save, load."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from oddline import fixed_values as fv
from oddline.functions import explain, scoring
from oddline.functions.text import CleanOptions, parse_logs
from oddline.operators.baseline import Baseline, baseline_of_lists, fit_baseline, neighbor_lists
from oddline.operators.encode import TokenHashEncoder
from oddline.operators.knn import (
    CellIndex, build_index, extend, fits, kmeans_index, knn, load_index, replace_parts, save_index,
)
from oddline.operators.similarity import neighborhood_stats, with_neighbor_metadata
from oddline.operators.skew import salted_lookup
from oddline.operators.windows import adjust_scores
from oddline.session import durable
from oddline.sources import models
from oddline.sources.corpus import append_entries, last_given, latest_metadata


@dataclass(frozen=True)
class DetectorOptions:
    k: int = fv.K_NEIGHBORS
    percentile: float = fv.THRESHOLD_PERCENTILE
    min_distance: float = fv.MIN_DISTANCE
    window_size: int = fv.WINDOW_SIZE
    temporal_weight: float = fv.TEMPORAL_WEIGHT
    index_type: str = "Flat"
    metric: str = "L2"
    cells: int = fv.IVF_CELLS
    probes: int = fv.IVF_PROBES
    clean: CleanOptions = CleanOptions()
    encoder: object = field(default_factory=TokenHashEncoder)


@dataclass(frozen=True)
class DistanceModel:
    corpus: DataFrame
    index: CellIndex
    baseline: Baseline
    options: DetectorOptions
    near: DataFrame | None = None  # (seq, distances): what the baseline was made of

    @property
    def probes(self) -> int | None:
        return self.options.probes if self.options.index_type == "IVF" else None


def corpus_entries(
    logs: DataFrame, options: DetectorOptions, source: str | Column | None = "training"
) -> DataFrame:
    """Parsed and encoded corpus rows of ``logs(seq, raw_text)``."""
    parsed = parse_logs(logs, source=source, options=options.clean)
    encoded = options.encoder.encode(
        parsed.select("seq", "log_id", "cleaned_text", "source", "timestamp"), "cleaned_text"
    )
    metadata = F.create_map(
        F.lit("cleaned_text"), F.col("cleaned_text"), F.lit("source"), F.col("source")
    )
    return encoded.select(
        "seq", F.col("log_id").alias("id"), "embedding", metadata.alias("metadata"),
        F.col("timestamp").alias("ts"),
    )


# L2: squared distances.  IP: products, of which the largest are the nearest; scores take
# them as they take distances.
METRICS = {"L2": "squared_l2", "IP": "inner_product"}


def _index(corpus: DataFrame, options: DetectorOptions) -> CellIndex:
    metric = METRICS[options.metric]
    if options.index_type == "IVF":
        return kmeans_index(corpus, options.k + 1, options.cells, metric)
    return build_index(corpus, options.k + 1, metric)


def fit(
    logs: DataFrame,
    options: DetectorOptions = DetectorOptions(),
    source: str | Column | None = "training",
    previous: DistanceModel | None = None,
    refit_on_all: bool = True,
) -> DistanceModel:
    """Corpus, index and baseline from normal ``logs(seq, raw_text)``.

    With ``previous`` the corpus grows; the baseline then comes from all rows,
    or from the new ones only with ``refit_on_all=False``.
    """
    return fit_entries(durable(corpus_entries(logs, options, source), "corpus"), options, previous, refit_on_all)


def fit_entries(
    new: DataFrame, options: DetectorOptions, previous: DistanceModel | None = None, refit_on_all: bool = True
) -> DistanceModel:
    """The model of stored corpus rows ``new``, after those of ``previous``.

    An exact index of one level grows: the new rows become blocks of their own.  Rows of
    before are compared with those blocks only, new rows with all, which gives the same
    baseline as a new model of all rows.
    """
    if previous:
        # Numbers are arrival order and identity: a batch that counts anew goes on after the old ones.
        last = previous.corpus.agg(F.max("seq")).first()[0]
        first = new.agg(F.min("seq")).first()[0]
        if last is not None and first is not None and first <= last:
            new = durable(new.withColumn("seq", F.col("seq") - first + last + 1), "corpus")
    corpus = append_entries(previous.corpus, new) if previous else new
    k, probes = options.k, options.probes if options.index_type == "IVF" else None
    near, rows = None, corpus if refit_on_all else new
    if previous and _grows(previous, options):
        index = extend(previous.index, new)
        if refit_on_all and previous.near is not None and index is not previous.index:
            near = durable(_renewed(previous, new, index, k), "near")
    else:
        index = _index(corpus, options)
    if near is None:
        if not fits(index):  # grouped by vector, which keeps no list per row
            return DistanceModel(corpus, index, fit_baseline(rows, index, k, options.percentile, probes=probes), options)
        near = durable(neighbor_lists(rows, index, k + 1, probes=probes).select("seq", "distances"), "near")
    baseline = baseline_of_lists(near, rows, options.percentile)
    return DistanceModel(corpus, index, baseline, options, near if refit_on_all or not previous else None)


def _grows(previous: DistanceModel, options: DetectorOptions) -> bool:
    same = all(getattr(previous.options, o) == getattr(options, o) for o in ("k", "metric", "index_type"))
    return same and options.index_type == "Flat" and previous.index.cells is None


def _renewed(previous: DistanceModel, new: DataFrame, index: CellIndex, k: int) -> DataFrame:
    """``(seq, distances)`` of all rows: the lists of before with what the new blocks bring, and the new rows' own."""
    delta = replace_parts(index, index.parts[len(previous.index.parts) :])
    came = neighbor_lists(previous.corpus, delta, k + 1).select("seq", F.col("distances").alias("_new"))
    nothing = F.array().cast("array<double>")
    both = F.concat(F.coalesce("distances", nothing), F.coalesce("_new", nothing))
    nearest = F.sort_array(both, asc=index.metric != "inner_product")
    old = previous.near.join(came, "seq").select("seq", F.slice(nearest, 1, k + 1).alias("distances"))
    return old.union(neighbor_lists(new, index, k + 1).select("seq", "distances"))


def score_vectors(rows: DataFrame, model: DistanceModel) -> DataFrame:
    """``(seq, nearest_neighbors, distances, mean_distance, score, is_anomaly,
    confidence)`` for stored ``rows(seq, embedding)``."""
    options = model.options
    found = neighbor_lists(rows, model.index, options.k, probes=model.probes)
    scored = model.baseline.add_scores(
        found.withColumn("mean_distance", scoring.mean_valid(F.col("distances"))), options.min_distance
    )
    return scored.withColumns(
        {
            "nearest_neighbors": F.coalesce("nearest_neighbors", F.array().cast("array<string>")),
            "distances": F.coalesce("distances", F.array().cast("array<double>")),
        }
    )


def similar_logs(anomalies: DataFrame, corpus: DataFrame | None) -> DataFrame:
    """``(seq, similar_logs)``: the first neighbours with the text kept for them."""
    first = anomalies.select(
        "seq",
        F.posexplode(
            F.slice(F.arrays_zip("nearest_neighbors", "distances"), 1, fv.SIMILAR_LOGS)
        ).alias("pos", "n"),
    ).select(
        "seq",
        (F.col("pos") + 1).alias("rank"),
        F.col("n.nearest_neighbors").alias("id"),
        F.col("n.distances").alias("distance"),
    )
    if corpus is None:
        first = first.withColumn("text", F.lit(fv.NO_TEXT))
    else:
        # Only entries that are somebody's neighbour; vectors are not read.
        named = corpus.select("seq", "id", "metadata").join(
            first.select("id").distinct(), "id", "left_semi"
        )
        texts = named.groupBy("id").agg(last_given("metadata")).select(
            "id", F.col("metadata")["cleaned_text"].alias("text")
        )
        first = salted_lookup(first, texts, ["id"], "left", ["seq"])
    text = F.substring(F.coalesce("text", F.lit(fv.NO_TEXT)), 1, fv.SIMILAR_TEXT_CHARS)
    entry = F.struct("rank", "id", "distance", text.alias("text"))
    return first.groupBy("seq").agg(F.array_sort(F.collect_list(entry)).alias("similar_logs"))


NO_SIMILAR = "array<struct<rank:int,id:string,distance:double,text:string>>"


def add_explanations(results: DataFrame, corpus: DataFrame | None) -> DataFrame:
    """``explanation`` for flagged rows only, null for the others.

    Needs ``seq, score, is_anomaly, cleaned_text, nearest_neighbors, distances``.
    """
    similar = similar_logs(results.filter("is_anomaly"), corpus)
    parts = explain.explanation(
        F.col("score"),
        F.col("cleaned_text"),
        F.col("distances"),
        F.coalesce("similar_logs", F.array().cast(NO_SIMILAR)),
    )
    return (
        results.join(similar, "seq", "left")
        .withColumn("explanation", F.when(F.col("is_anomaly"), parts))
        .drop("similar_logs")
    )


def search_texts(
    texts: DataFrame, model: DistanceModel, k: int | None = None, text_col: str = "text"
) -> DataFrame:
    """The nearest corpus entries of ``texts(query_id, text)`` with their metadata.

    Adds the mean, smallest and largest distance of each query to its rows.
    """
    k = k or model.options.k
    queries = durable(
        model.options.encoder.encode(texts, text_col).select("query_id", "embedding"), "texts"
    )
    neighbors = knn(queries, model.index, k, probes=model.probes)
    found = neighbors.long()
    # Only entries that are somebody's neighbour; vectors are not read.
    named = model.corpus.join(found.select(F.col("neighbor_id").alias("id")).distinct(), "id", "left_semi")
    rows = with_neighbor_metadata(found, latest_metadata(named))
    stats = neighborhood_stats(neighbors).drop("num_neighbors", "std_distance")
    return rows.join(stats, "query_id")


def encode_queries(logs: DataFrame, options: DetectorOptions, source=None) -> DataFrame:
    """Parsed and encoded rows, stored: searching, scoring and the final join read them."""
    parsed = parse_logs(logs, source=source, options=options.clean)
    return durable(options.encoder.encode(parsed, "cleaned_text"), "encoded")


def detect(
    logs: DataFrame,
    model: DistanceModel,
    window_key: list[str] | None = None,
    source: str | Column | None = None,
    processing_time: Column | None = None,
    with_explanations: bool = True,
) -> DataFrame:
    """Score ``logs(seq, raw_text[, source])`` against the model.

    ``seq`` is the arrival order.  ``window_key`` names the columns that keep
    separate score windows (none: one window over everything).  A line without
    a time takes ``processing_time`` (default: the current time).
    """
    options = model.options
    stored = encode_queries(logs, options, source)
    now = processing_time if processing_time is not None else F.current_timestamp()
    key = window_key or []
    clock = stored.select("seq", *key, F.coalesce("timestamp", now).alias("ts"))
    # Only narrow rows take part in windows; texts join once, at the end.
    scored = adjust_scores(
        clock.join(score_vectors(stored.select("seq", "embedding"), model), "seq"),
        key,
        ["seq"],
        window_size=options.window_size,
        weight=options.temporal_weight,
    )
    results = (
        stored.drop("embedding", *key)
        .join(
            scored.withColumnRenamed("score", "original_score").withColumnRenamed(
                "time_adjusted_score", "score"
            ),
            "seq",
        )
    )
    if not with_explanations:
        results = results.withColumn("explanation", F.lit(None).cast("string"))
    else:
        results = add_explanations(durable(results, "scored"), model.corpus)
    return results.select(
        "seq",
        *key,
        "log_id",
        F.col("raw_text").alias("raw_log"),
        F.col("cleaned_text").alias("cleaned_log"),
        F.struct(
            "score", "is_anomaly", "confidence", "distances", "nearest_neighbors", "timestamp"
        ).alias("anomaly_score"),
        "explanation",
        F.struct(
            F.col("score").alias("score"),
            F.col("temporal_weight").alias("weight"),
            F.col("original_score"),
            F.col("window_stats"),
        ).alias("temporal_context"),
    )


STORED_OPTIONS = {
    "k": int, "percentile": float, "min_distance": float, "window_size": int,
    "temporal_weight": float, "index_type": str, "metric": str, "cells": int, "probes": int,
}


def save(model: DistanceModel, path: str) -> None:
    """Corpus, its cells, settings and the fitted numbers, as a new version."""
    options, spark = model.options, model.corpus.sparkSession
    b, index, version = model.baseline, model.index, models.new_version(path)
    model.corpus.write.parquet(f"{version}/corpus")
    save_index(index, f"{version}/index")
    models.write_settings(
        spark,
        f"{version}/settings",
        {name: getattr(options, name) for name in STORED_OPTIONS}
        | models.text_settings(options.encoder, options.clean),
    )
    spark.createDataFrame(
        [(b.threshold, b.mean, b.std)], "threshold double, mean double, std double"
    ).coalesce(1).write.parquet(f"{version}/baseline")
    if model.near is not None:
        model.near.write.parquet(f"{version}/near")
    spark.createDataFrame([(model.near is not None,)], "near boolean").coalesce(1).write.parquet(f"{version}/holds")
    models.publish(spark, path, version)


def load(
    spark: SparkSession,
    path: str,
    options: DetectorOptions = DetectorOptions(),
    with_baseline: bool = True,
) -> DistanceModel:
    """The newest stored model; encoder and cleaning come from ``options`` and must
    be those the model was fitted with.

    ``with_baseline=False`` scores as an unfitted detector does: by the fixed
    distance, with the score as confidence.
    """
    version = models.newest_version(spark, path)
    stored = models.read_settings(spark, f"{version}/settings")
    models.check_settings(stored, models.text_settings(options.encoder, options.clean))
    options = replace(options, **{name: kind(stored[name]) for name, kind in STORED_OPTIONS.items()})
    baseline = Baseline()
    if with_baseline:
        row = spark.read.parquet(f"{version}/baseline").first()
        baseline = Baseline(row["threshold"], row["mean"], row["std"])
    corpus = spark.read.parquet(f"{version}/corpus")
    near = spark.read.parquet(f"{version}/near") if spark.read.parquet(f"{version}/holds").first()["near"] else None
    return DistanceModel(corpus, load_index(spark, f"{version}/index"), baseline, options, near)
