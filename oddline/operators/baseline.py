"""Baselines: what distances among normal rows look like."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from oddline import fixed_values as fv
from oddline.functions import scoring
from oddline.operators.knn import CellIndex, Neighbors, digest, fits, knn, neighbor_columns
from oddline.operators.quantile import exact_percentile
from oddline.session import durable


@dataclass(frozen=True)
class Baseline:
    """Distribution of the mean neighbour distances of normal rows."""

    threshold: float | None = None
    mean: float | None = None
    std: float | None = None

    def _lit(self, value: float | None) -> Column:
        return F.lit(value).cast("double")

    def add_scores(self, df: DataFrame, min_distance: float = fv.MIN_DISTANCE) -> DataFrame:
        """Score, flag and confidence from the column ``mean_distance``."""
        mean, threshold = F.col("mean_distance"), self._lit(self.threshold)
        return df.withColumns(
            {
                "score": scoring.distance_score(mean, threshold, min_distance),
                "is_anomaly": scoring.distance_flag(mean, threshold, min_distance),
            }
        ).withColumn(
            "confidence",
            scoring.confidence(mean, self._lit(self.mean), self._lit(self.std), F.col("score")),
        )


def neighbor_arrays(neighbors: Neighbors) -> DataFrame:
    """``(vec_key, nearest_neighbors, distances)``, at most k entries in rank order."""
    entry = F.struct("rank", "neighbor_id", "distance")
    return (
        neighbors.rows.groupBy("vec_key")
        .agg(F.array_sort(F.collect_list(entry)).alias("nn"))
        .select(
            "vec_key",
            F.transform("nn", lambda n: n["neighbor_id"]).alias("nearest_neighbors"),
            F.transform("nn", lambda n: n["distance"]).alias("distances"),
        )
    )


def neighbor_lists(
    rows: DataFrame, index: CellIndex, k: int, id_col: str = "seq", vec_col: str = "embedding", probes: int | None = None
) -> DataFrame:
    """``(id_col, nearest_neighbors, distances)`` of every row; null lists for a row without vector.

    Over a corpus that fits a task the rows stay where they are; else they are searched by :func:`knn`.
    """
    rows = rows.select(id_col, vec_col)
    if fits(index):
        return neighbor_columns(rows, index, k, vec_col, probes).drop(vec_col)
    neighbors = knn(rows, index, k, id_col, vec_col, probes)
    found = neighbors.expand(neighbor_arrays(neighbors)).withColumnRenamed("query_id", id_col)
    return rows.select(id_col).join(found, id_col, "left")


def self_distances(
    corpus: DataFrame, index: CellIndex, k: int, id_col: str, vec_col: str = "embedding", probes: int | None = None,
    skip_self_by_rank: bool = False,
) -> DataFrame:
    """``(mean_distance, n)`` of a self-search, as :func:`baseline_distances` has it; a corpus that fits moves no row."""
    if not fits(index):
        neighbors = knn(corpus, index, k + 1, id_col, vec_col, probes)
        return baseline_distances(neighbors, skip_self_by_rank).select("mean_distance", "n")
    lists = neighbor_lists(corpus, index, k + 1, id_col, vec_col, probes)
    kept = F.slice("distances", 2, k) if skip_self_by_rank else F.filter("distances", lambda d: d > 0)
    means = lists.select(scoring.stable(scoring.mean_valid(kept)).alias("mean_distance"), F.lit(1).alias("n"))
    return means.filter("mean_distance IS NOT NULL")


def baseline_distances(neighbors: Neighbors, skip_self_by_rank: bool = False) -> DataFrame:
    """``(vec_key, n, mean_distance)`` of a self-search with k + 1 neighbours.

    By default all distances of 0 are left out, the row itself and its copies;
    a row with nothing left counts for nothing.  ``skip_self_by_rank`` drops
    just the first neighbour instead.  ``n`` rows share the vector.
    """
    kept = neighbors.rows.filter("rank > 1" if skip_self_by_rank else "distance > 0")
    means = kept.groupBy("vec_key").agg(scoring.stable(F.avg("distance")).alias("mean_distance"))
    return means.join(neighbors.groups, "vec_key")


def weighted_moments(df: DataFrame, value: str, weight: str) -> tuple[float, float]:
    """Mean and population deviation, each row counted ``weight`` times."""
    x, w = F.col(value), F.col(weight)
    mean = df.agg(F.try_divide(F.sum(x * w), F.sum(w))).first()[0]
    if mean is None:
        raise ValueError("the baseline is empty")
    spread = (x - mean) * (x - mean) * w
    return mean, df.agg(F.sqrt(F.sum(spread) / F.sum(w))).first()[0]


def fit_baseline(
    corpus: DataFrame,
    index: CellIndex,
    k: int = fv.K_NEIGHBORS,
    percentile: float = fv.THRESHOLD_PERCENTILE,
    id_col: str = "seq",
    probes: int | None = None,
) -> Baseline:
    """Threshold, mean and deviation from the corpus' own distances; none where :func:`only_copies`."""
    means = durable(self_distances(corpus, index, k, id_col, probes=probes), "baseline")
    if means.isEmpty() and only_copies(corpus):
        return Baseline()
    threshold = exact_percentile(means, "mean_distance", percentile / 100.0, "n")
    mean, std = weighted_moments(means, "mean_distance", "n")
    return Baseline(threshold, mean, std)


def only_copies(corpus: DataFrame, vec_col: str = "embedding") -> bool:
    """Whether a corpus none of whose rows has a distance left holds different vectors.

    Then each of them has more than k copies, which are all its neighbours; a detector without
    a threshold scores by the fixed distance.  A corpus of one vector knows no distances at all.
    """
    keyed = corpus.filter(F.col(vec_col).isNotNull()).select(*digest(vec_col))
    return bool(keyed.agg((F.min("_h1") < F.max("_h1")) | (F.min("_h2") < F.max("_h2"))).first()[0])


def baseline_of_lists(
    lists: DataFrame, corpus: DataFrame, percentile: float = fv.THRESHOLD_PERCENTILE
) -> Baseline:
    """The same from stored ``(seq, distances)`` of a self-search of ``corpus`` with k + 1 neighbours."""
    kept = F.filter("distances", lambda d: d > 0)
    means = lists.select(scoring.stable(scoring.mean_valid(kept)).alias("mean_distance"))
    means = durable(means.filter("mean_distance IS NOT NULL"), "baseline")
    if means.isEmpty() and only_copies(corpus):
        return Baseline()
    return fit_from_distances(means, "mean_distance", percentile)


def fit_from_distances(
    df: DataFrame, value: str, percentile: float = fv.THRESHOLD_PERCENTILE
) -> Baseline:
    """Baseline from a stored column of mean distances."""
    one = df.withColumn("_one", F.lit(1))
    threshold = exact_percentile(df, value, percentile / 100.0)
    mean, std = weighted_moments(one, value, "_one")
    return Baseline(threshold, mean, std)


def anomalies_by_score(
    scored: DataFrame, min_confidence: float = fv.MIN_CONFIDENCE, id_col: str = "log_id"
) -> DataFrame:
    """Flagged rows that are sure enough, highest score first."""
    return scored.filter(F.col("is_anomaly") & (F.col("confidence") >= min_confidence)).orderBy(
        F.desc("score"), id_col
    )
