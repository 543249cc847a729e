"""Count windows over arrival order that do not depend on one task per key.

The plain window ``partitionBy(key).orderBy(seq)`` sorts a whole key in one
task.  A source with a third of all rows, or the global window without a key,
would not survive that.  Here the rows are range-partitioned by key and order
into even chunks, and every chunk gets a copy of the few rows that precede it;
each window function then runs inside one chunk and is still exact.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from oddline import fixed_values as fv
from oddline.functions.scoring import clamp
from oddline.operators.skew import first_per_group
from oddline.session import durable

CHUNK_ROWS = 500_000
BROADCAST_CHUNKS = 50_000
CHUNK = "_chunk"
KEY = "_key"
HALO = "_halo"


def with_history(
    df: DataFrame,
    key: list[str],
    order: list[str],
    rows: int,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add ``_key``, ``_chunk`` and ``_halo`` so that windows can run per chunk.

    Every group ``(_key, _chunk)`` holds about ``chunk_rows`` rows plus up to
    ``rows`` preceding rows of the same key marked ``_halo``; drop those after
    the window functions.  ``order`` must be a total order within a key.  Chunk
    borders come from sampling, so the chunked rows are stored once and all
    branches read the stored borders.
    """
    keyed = df.withColumn(KEY, F.struct(*key) if key else F.struct(F.lit(0).alias("all")))
    stored = durable(keyed, "window-input")
    chunks = ceil(stored.count() / chunk_rows)
    if chunks <= 1:
        return stored.withColumns({CHUNK: F.lit(0), HALO: F.lit(False)})
    stored = durable(
        stored.repartitionByRange(chunks, KEY, *order).withColumn(CHUNK, F.spark_partition_id()),
        "window-chunks",
    )
    # One row per key and chunk: at most keys + chunks of them.
    sizes = stored.groupBy(KEY, CHUNK).agg(F.count(F.lit(1)).alias("n"))
    by_chunk = Window.partitionBy(KEY).orderBy(CHUNK)
    until = F.sum("n").over(by_chunk.rowsBetween(Window.unboundedPreceding, 0))
    later = F.collect_list(F.struct(CHUNK, F.col("until") - F.col("n"))).over(
        by_chunk.rowsBetween(1, rows)
    )
    # At most one key goes on from a chunk to the next, and only chunks shorter
    # than the window feed more than one: about one row per chunk.  Up to
    # BROADCAST_CHUNKS of them are broadcast; beyond that the chunks, which are even,
    # make a good join key.
    forward = (
        sizes.withColumn("until", until)
        .withColumn("later", later)
        .select(
            F.col(KEY).alias("_from_key"),
            F.col(CHUNK).alias("_from"),
            F.explode(
                F.filter("later", lambda c: c["col2"] < F.col("until") + rows)
            ).alias("to"),
        )
        .select("_from_key", "_from", F.col(f"to.{CHUNK}").alias("_to"))
    )
    sources = forward.select("_from_key", "_from").distinct()
    if chunks <= BROADCAST_CHUNKS:
        forward, sources = F.broadcast(forward), F.broadcast(sources)
    here = (F.col(KEY) == F.col("_from_key")) & (F.col(CHUNK) == F.col("_from"))
    tails = first_per_group(
        stored.join(sources, here, "left_semi"),
        [KEY, CHUNK],
        [F.desc(c) for c in order],
        rows,
        "_tail",
    )
    halo = (
        tails.join(forward, here)
        .withColumn(CHUNK, F.col("_to"))
        .drop("_tail", "_to", "_from", "_from_key")
        .withColumn(HALO, F.lit(True))
    )
    return stored.withColumn(HALO, F.lit(False)).unionByName(halo)


def without_history(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(HALO)).drop(KEY, CHUNK, HALO)


def _frame(order: list[str], start: int, end: int) -> Window:
    return Window.partitionBy(KEY, CHUNK).orderBy(*order).rowsBetween(start, end)


def window_stats(score: Column, frame: Window) -> dict[str, Column]:
    """Mean, population deviation, extremes and count; zeros for no rows."""

    def or_zero(c: Column) -> Column:
        return F.coalesce(c.over(frame), F.lit(0.0))

    return {
        "mean": or_zero(F.avg(score)),
        "std": or_zero(F.stddev_pop(score)),
        "min": or_zero(F.min(score)),
        "max": or_zero(F.max(score)),
        "count": F.count(score).over(frame),
    }


def temporal_weight(latest: Column, ts: Column, decay: float = fv.DECAY_PER_HOUR) -> Column:
    """Decay per hour behind the latest time in the window, floor 0.1.

    A row newer than the window gets a weight above 1; an empty window gives 1.
    """
    hours = (F.unix_micros(latest) - F.unix_micros(ts)) / 3_600_000_000.0
    weight = F.greatest(F.pow(F.lit(decay), hours), F.lit(fv.MIN_TEMPORAL_WEIGHT))
    return F.when(latest.isNull(), 1.0).otherwise(weight)  # greatest() skips nulls


def context_score(score: Column, stats: dict[str, Column], weight: float = fv.TEMPORAL_WEIGHT) -> Column:
    """Raise or lower a score by its place among the window's scores."""
    z = F.try_divide(score - stats["mean"], stats["std"])
    factor = clamp(z * weight + 1.0, *fv.CONTEXT_RANGE)
    usable = (stats["count"] > fv.WINDOW_MIN_COUNT) & (stats["std"] > 0)
    return F.when(usable, score * factor).otherwise(score)


def add_temporal_context(
    df: DataFrame,
    order: list[str],
    score: str = "score",
    ts: str = "ts",
    window_size: int = fv.WINDOW_SIZE,
    weight: float = fv.TEMPORAL_WEIGHT,
    decay: float = fv.DECAY_PER_HOUR,
) -> DataFrame:
    """Window columns on rows that already carry chunks (see :func:`with_history`)."""
    frame = _frame(order, -window_size, -1)
    value = F.col(score)
    df = df.withColumns(
        {f"_w_{k}": c for k, c in window_stats(value, frame).items()}
        | {"_w_latest": F.max(ts).over(frame)}
    )
    stats = {k: F.col(f"_w_{k}") for k in ("mean", "std", "min", "max", "count")}
    df = df.withColumns(
        {
            "window_stats": F.struct(*[c.alias(k) for k, c in stats.items()]),
            "temporal_weight": temporal_weight(F.col("_w_latest"), F.col(ts), decay),
        }
    )
    adjusted = F.least(
        context_score(value, stats, weight) * F.col("temporal_weight"), F.lit(1.0)
    )
    return df.withColumn("time_adjusted_score", adjusted).drop(
        "_w_latest", *[f"_w_{k}" for k in stats]
    )


def adjust_scores(
    df: DataFrame,
    key: list[str],
    order: list[str],
    score: str = "score",
    ts: str = "ts",
    processing_time: str | None = None,
    window_size: int = fv.WINDOW_SIZE,
    chunk_rows: int = CHUNK_ROWS,
    **options,
) -> DataFrame:
    """Adjust every score by the ``window_size`` rows before it.

    Adds ``window_stats``, ``temporal_weight`` and ``time_adjusted_score``.
    ``key=[]`` is the global window.  A missing time is taken from the column
    ``processing_time``.
    """
    time = ts
    if processing_time:
        df = df.withColumn("_ts", F.coalesce(ts, processing_time))
        time = "_ts"
    chunked = with_history(df, key, order, window_size, chunk_rows)
    out = without_history(
        add_temporal_context(chunked, order, score, time, window_size, **options)
    )
    return out.drop("_ts")


def add_burst(
    df: DataFrame,
    order: list[str],
    score: str = "score",
    factor: float = fv.BURST_FACTOR,
    window_size: int = fv.WINDOW_SIZE,
) -> DataFrame:
    recent = _frame(order, -(fv.BURST_RECENT - 1), 0)
    older = _frame(order, -(window_size - 1), -fv.BURST_RECENT)
    enough = (F.count(score).over(recent) >= fv.BURST_RECENT) & (
        F.count(score).over(older) >= fv.BURST_MIN_OLDER
    )
    burst = F.avg(score).over(recent) > F.avg(score).over(older) * factor
    return df.withColumn("is_burst", F.coalesce(enough & burst, F.lit(False)))


def burst_flags(
    df: DataFrame,
    key: list[str],
    order: list[str],
    score: str = "score",
    factor: float = fv.BURST_FACTOR,
    window_size: int = fv.WINDOW_SIZE,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Whether the last 10 scores, this row's included, beat the older ones in
    the window by ``factor`` on average; needs 5 older rows."""
    chunked = with_history(df, key, order, window_size - 1, chunk_rows)
    return without_history(add_burst(chunked, order, score, factor, window_size))


def time_series(
    df: DataFrame,
    key: list[str],
    order: list[str],
    score: str = "score",
    ts: str = "ts",
    window_size: int = fv.WINDOW_SIZE,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The window after each row as an array of (time, score)."""
    chunked = with_history(df, key, order, window_size - 1, chunk_rows)
    series = F.collect_list(F.struct(F.col(ts).alias("ts"), F.col(score).alias("score")))
    frame = _frame(order, -(window_size - 1), 0)
    return without_history(chunked.withColumn("series", series.over(frame)))


def last_rows(df: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of every key: the state a continued window needs."""
    keyed = df.withColumn(KEY, F.struct(*key) if key else F.struct(F.lit(0).alias("all")))
    return first_per_group(keyed, [KEY], [F.desc(c) for c in order], n, "_tail").drop(KEY, "_tail")
