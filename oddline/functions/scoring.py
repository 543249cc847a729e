"""Scores, flags and confidences as expressions over a few numbers per row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from oddline import fixed_values as fv

# Means of distances are kept to this many decimals, so that a flag does not
# depend on the order in which a sum was formed.
DECIMALS = 9


def stable(x: Column) -> Column:
    return F.round(x, DECIMALS)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def mean_valid(distances: Column) -> Column:
    """Mean of the non-negative distances of an array, null if there are none.

    The array is in rank order, so the sum is formed the same way every time.
    """
    valid = F.filter(distances, lambda d: d >= 0)
    return stable(
        F.try_divide(
            F.aggregate(valid, F.lit(0.0), lambda acc, d: acc + d), F.size(valid).cast("double")
        )
    )


def distance_score(mean: Column, threshold: Column, min_distance: float = fv.MIN_DISTANCE) -> Column:
    """Share of twice the threshold (or of the fixed distance without one), at most 1.

    No neighbour at all scores 1; mean and threshold both 0 score 0.
    """
    fitted = F.coalesce(F.try_divide(mean, threshold * 2.0), F.when(mean > 0, 1.0).otherwise(0.0))
    unfitted = mean / min_distance
    score = F.when(threshold.isNotNull(), fitted).otherwise(unfitted)
    return F.when(mean.isNull(), 1.0).otherwise(F.least(score, F.lit(1.0)))


def distance_flag(mean: Column, threshold: Column, min_distance: float = fv.MIN_DISTANCE) -> Column:
    """Beyond the threshold; a threshold of 0 counts as not set."""
    limit = F.coalesce(F.nullif(threshold, F.lit(0.0)), F.lit(float(min_distance)))
    return F.coalesce(mean > limit, F.lit(True))


def confidence(mean: Column, base_mean: Column, base_std: Column, score: Column) -> Column:
    """A third of the distance from the baseline in deviations, at most 1.

    Without a baseline it is the score.
    """
    z = F.abs(mean - base_mean) / F.greatest(base_std, F.lit(fv.STD_FLOOR))
    return (
        F.when(mean.isNull(), 1.0)
        .when(base_mean.isNull(), score)
        .otherwise(F.least(z / 3.0, F.lit(1.0)))
    )


def hybrid_z(mean: Column, base_mean: Column, base_std: Column) -> Column:
    return (mean - base_mean) / F.greatest(base_std, F.lit(fv.STD_FLOOR))


def hybrid_score(z: Column, forest: Column) -> Column:
    """Half distance, half forest (lower forest decision = odder), at most 1."""
    return F.least(
        clamp(z / 3.0, 0.0, 1.0) * 0.5 + clamp(F.lit(0.5) - forest, 0.0, 1.0) * 0.5, F.lit(1.0)
    )


def hybrid_flag(z: Column, forest: Column, severity_flag: Column) -> Column:
    return (forest < 0) | (z > 2.0) | severity_flag


def display_band(score: Column) -> Column:
    return (
        F.when(score > fv.DISPLAY_CRITICAL, "CRITICAL")
        .when(score > fv.DISPLAY_SUSPICIOUS, "SUSPICIOUS")
        .otherwise("NORMAL")
    )


def alert_band(score: Column) -> Column:
    return F.when(score > fv.DISPLAY_CRITICAL, "Critical").otherwise("High")
