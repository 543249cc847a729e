"""Exact percentiles without gathering all values in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

BINS = 10_000


def exact_percentile(
    df: DataFrame, value: str, fraction: float, weight: str | None = None, bins: int = BINS
) -> float:
    """Percentile with linear interpolation, the same as after sorting everything.

    Each round counts the rows of at most ``bins`` equal-width bins (one scan, a
    partial aggregation, ``bins`` rows to the driver), finds the bin that holds
    the wanted ranks and goes on inside it.  A bin of equal values, or two ranks
    in different bins, ends the search exactly; three rounds are enough for
    10^11 spread-out rows.  ``weight`` tells how often a row counts.  ``df``
    should be a stored table, as every round reads it once.
    """
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    data = df.select(F.col(value).cast("double").alias("v"), w.alias("w")).filter(
        F.col("v").isNotNull() & (F.col("w") > 0)
    )
    head = data.agg(F.sum("w").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not head["n"]:
        raise ValueError("no values to take a percentile of")
    position = fraction * (head["n"] - 1)
    low, high = math.floor(position), math.ceil(position)
    below, lo, hi = 0, head["lo"], head["hi"]
    while lo < hi:
        width = (hi - lo) / bins
        place = (F.col("v") - F.lit(lo)) / F.lit(width) if width > 0 else F.lit(0.0)
        rows = (
            data.filter(F.col("v").between(lo, hi))
            .groupBy(F.least(F.floor(place), F.lit(bins - 1)).alias("bin"))
            .agg(F.sum("w").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .orderBy("bin")
            .collect()
        )
        found = {}
        seen = below
        for row in rows:
            for rank in (low, high):
                if seen <= rank < seen + row["w"]:
                    found[rank] = (row, seen)
            seen += row["w"]
        (low_bin, low_seen), (high_bin, _) = found[low], found[high]
        if low_bin["bin"] != high_bin["bin"]:
            return _between(low_bin["hi"], high_bin["lo"], position - low)
        if (lo, hi) == (low_bin["lo"], low_bin["hi"]) and len(rows) == 1:
            # Neighbouring doubles: no bin border fits between them any more.
            at_lo = data.filter(F.col("v") == lo).agg(F.sum("w").alias("w")).first()["w"]
            first = lo if low - below < at_lo else hi
            second = lo if high - below < at_lo else hi
            return _between(first, second, position - low)
        below, lo, hi = low_seen, low_bin["lo"], low_bin["hi"]
    return float(lo)


def _between(a: float, b: float, share: float) -> float:
    return float(a + (b - a) * share)
