"""Keeping hot keys from landing in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

HOT_ROWS = 1_000_000  # left rows of one sub-key
HOT_KEYS = 100_000


def salted_lookup(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "left",
    spread: list[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``left`` to a ``right`` that is unique on ``on``, hot keys split.

    Hot are the up to ``HOT_KEYS`` heaviest keys with more than ``hot_rows`` rows
    on the left, found by a partial aggregation; a key beyond those holds less than
    a hundred-thousandth of all rows, a million of 10^11.  Only that list is
    broadcast, so keys should be narrow (ids, digests).  The left
    rows of a hot key spread over as many sub-keys as it has ``hot_rows`` rows, and
    only its right row is repeated; all other keys keep one copy.  ``spread`` names the columns
    whose hash picks the sub-key (default: all others).
    """
    hot = (
        left.groupBy(*on)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > hot_rows)
        .orderBy(F.desc("_rows"), *on)  # a total order: both sides get the same list
        .limit(HOT_KEYS)
        .select(*on, F.ceil(F.col("_rows") / hot_rows).alias("_salts"))
    )
    spread = spread or [c for c in left.columns if c not in on]
    left = left.join(F.broadcast(hot), on, "left").withColumn(
        "_salt",
        F.pmod(F.xxhash64(*spread), F.coalesce("_salts", F.lit(1))),
    )
    right = right.join(F.broadcast(hot), on, "left").withColumn(
        "_salt",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_salts", F.lit(1)) - 1)),
    )
    return left.drop("_salts").join(right.drop("_salts"), [*on, "_salt"], how).drop("_salt")


def first_per_group(
    df: DataFrame, keys: list, order: list, n: int, rank_col: str = "rank"
) -> DataFrame:
    """The first ``n`` rows of every group.

    ``row_number() <= n`` lets Spark cut each group to ``n`` rows in every map
    task before the shuffle, so a hot group costs no more than a small one.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(window)).filter(F.col(rank_col) <= n)
