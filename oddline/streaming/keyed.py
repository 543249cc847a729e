"""Streams with Spark's own state: score windows per key, trends per time bucket.

Both are ``transformWithState`` jobs.  A key's window state is a list of its last
scores; a bucket's state is its counts until the watermark has passed it.  The
micro-batches hold no batch plans, so an epoch costs one shuffle.

All rows of a key in one micro-batch meet in one task, which holds their numbers and keeps
their other columns on disk; a stream whose batches hold very many rows of one key belongs to
``jobs.window_stream``, which cuts it into chunks.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from oddline import fixed_values as fv
from oddline.functions import scoring
from oddline.functions.text import parse_logs
from oddline.operators.knn import fits, neighbor_columns
from oddline.plans.distance_detector import DistanceModel
from oddline.session import remove, written
from oddline.streaming.jobs import epoch_path, for_each_epoch, read_files, scored_batch, spread, write_append

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WINDOW_ROWS = 20_000  # rows whose windows are laid out at once
WAITING_BYTES = 16 * 2**20  # rows of a key that wait in memory for the last one; more wait on disk
STATS = ["mean", "std", "min", "max"]


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in a store that has lists and timers."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


# --- score windows -----------------------------------------------------------------


def window_columns(
    score: np.ndarray, ts: np.ndarray, before_score: np.ndarray, before_ts: np.ndarray, window_size: int = fv.WINDOW_SIZE,
    weight: float = fv.TEMPORAL_WEIGHT, decay: float = fv.DECAY_PER_HOUR, factor: float = fv.BURST_FACTOR,
) -> dict[str, np.ndarray]:
    """What ``operators.windows`` adds, for one key's rows in order after the rows before them.

    ``ts`` are microseconds; a missing score is NaN.
    """
    n, held = len(score), len(before_score)
    pad = window_size - held
    scores = np.r_[np.full(pad, np.nan), before_score, score]
    times = np.r_[np.full(pad, np.iinfo(np.int64).min), before_ts, ts]
    out = {c: np.zeros(n) for c in (*STATS, "temporal_weight", "time_adjusted_score")}
    out["count"], out["is_burst"] = np.zeros(n, np.int64), np.zeros(n, bool)
    for start in range(0, n, WINDOW_ROWS):
        stop = min(n, start + WINDOW_ROWS)
        rows = slice(start, stop)
        seen = np.lib.stride_tricks.sliding_window_view(scores[start : stop + window_size - 1], window_size)
        given = ~np.isnan(seen)
        count = given.sum(1)
        some = np.maximum(count, 1)
        filled = np.where(given, seen, 0.0)
        mean = filled.sum(1) / some
        std = np.sqrt((np.where(given, seen - mean[:, None], 0.0) ** 2).sum(1) / some)
        none = count == 0
        low = np.where(none, 0.0, np.where(given, seen, np.inf).min(1))
        high = np.where(none, 0.0, np.where(given, seen, -np.inf).max(1))
        latest = np.lib.stride_tricks.sliding_window_view(times[start : stop + window_size - 1], window_size).max(1)
        hours = (latest - ts[rows]) / 3_600_000_000.0
        first = np.arange(start, stop) + held == 0
        timed = np.where(first, 1.0, np.maximum(decay ** np.where(first, 0.0, hours), fv.MIN_TEMPORAL_WEIGHT))
        own = score[rows]
        usable = (count > fv.WINDOW_MIN_COUNT) & (std > 0)
        z = (own - mean) / np.where(usable, std, 1.0)
        in_context = np.where(usable, own * np.clip(z * weight + 1.0, *fv.CONTEXT_RANGE), own)
        # The burst windows end with the row itself.
        ended = np.lib.stride_tricks.sliding_window_view(scores[start + 1 : stop + window_size], window_size)
        recent, older = ended[:, -fv.BURST_RECENT :], ended[:, : -fv.BURST_RECENT]
        recent_n, older_n = (~np.isnan(recent)).sum(1), (~np.isnan(older)).sum(1)
        enough = (recent_n >= fv.BURST_RECENT) & (older_n >= fv.BURST_MIN_OLDER)
        burst = np.nansum(recent, 1) / np.maximum(recent_n, 1) > np.nansum(older, 1) / np.maximum(older_n, 1) * factor
        for name, values in zip(
            (*STATS, "count", "temporal_weight", "time_adjusted_score", "is_burst"),
            (mean, std, low, high, count, timed, np.fmin(in_context * timed, 1.0), enough & burst),
        ):
            out[name][rows] = values
    return out


class _ScoreWindows(StatefulProcessor):
    """Keeps the last scores of a key and their times."""

    def __init__(self, order: str, score: str, ts: str, window_size: int, weight: float):
        self.order, self.score, self.ts, self.window_size, self.weight = order, score, ts, window_size, weight

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "score double, at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """Only order, score and time of all rows are held at once; whole rows wait as they came."""
        orders, scores, ats = [], [], []
        with tempfile.SpooledTemporaryFile(WAITING_BYTES) as waiting:
            for pdf in rows:
                orders.append(pdf[self.order].copy())
                scores.append(pdf[self.score].to_numpy(float, copy=True))
                ats.append(pdf[self.ts].to_numpy("datetime64[us]").astype(np.int64))
                pickle.dump(pdf, waiting, pickle.HIGHEST_PROTOCOL)
            sizes = [len(part) for part in scores]
            place = pd.concat(orders, ignore_index=True).sort_values(kind="stable").index.to_numpy()
            score, at = np.concatenate(scores)[place], np.concatenate(ats)[place]
            del orders, scores, ats
            held = list(self.last.get())
            before = np.array([np.nan if r[0] is None else r[0] for r in held], float)
            before_at = np.array([r[1] for r in held], np.int64)
            found = window_columns(score, at, before, before_at, self.window_size, self.weight)
            last, times = np.r_[before, score][-self.window_size :], np.r_[before_at, at][-self.window_size :]
            self.last.put([(None if np.isnan(s) else float(s), int(t)) for s, t in zip(last, times)])
            back = np.empty(len(place), np.int64)
            back[place] = np.arange(len(place))
            del score, at, place
            waiting.seek(0)
            for part in np.split(back, np.cumsum(sizes)[:-1]):
                yield pickle.load(waiting).assign(**{f"_{c}": found[c][part] for c in (*STATS, "count")}, **{
                    c: found[c][part] for c in ("temporal_weight", "time_adjusted_score", "is_burst")
                })

    def close(self) -> None:
        pass


def keyed_windows(
    stream: DataFrame, key: list[str], order: str = "seq", score: str = "score", ts: str = "ts",
    window_size: int = fv.WINDOW_SIZE, weight: float = fv.TEMPORAL_WEIGHT,
) -> DataFrame:
    """Adds the window columns to a stream of scores; start it inside :func:`keyed_state`.

    A micro-batch goes on where the ones before it ended, in the order of ``order``;
    no row is dropped for being late.  Output mode is append.
    """
    grouped = stream if key else stream.withColumn("_all", F.lit(0))
    double = [StructField(f"_{c}", DoubleType()) for c in STATS]
    added = [
        *double, StructField("_count", LongType()), StructField("temporal_weight", DoubleType()),
        StructField("time_adjusted_score", DoubleType()), StructField("is_burst", BooleanType()),
    ]
    out = grouped.groupBy(*(key or ["_all"])).transformWithStateInPandas(
        statefulProcessor=_ScoreWindows(order, score, ts, window_size, weight),
        outputStructType=StructType([*stream.schema.fields, *added]), outputMode="Append", timeMode="None",
    )
    stats = F.struct(*[F.col(f"_{c}").alias(c) for c in (*STATS, "count")])
    return out.withColumn("window_stats", stats).drop(*[f"_{c}" for c in (*STATS, "count")])


def detect_keyed(
    stream: DataFrame, model: DistanceModel, key: list[str], source: str | Column | None = None
) -> DataFrame:
    """The distance detector on a stream of ``(seq, raw_text[, key])`` as one streaming plan.

    Lines are parsed, encoded and compared where they arrive with a corpus that fits a
    task; only then they are shuffled to the state of their key.  For larger corpora there is
    :func:`write_detected`, for hot keys ``jobs.detect_stream``, with the same rows.
    """
    options = model.options
    parsed = parse_logs(spread(stream), source=source, options=options.clean)
    encoded = options.encoder.encode(parsed, "cleaned_text").select(
        "seq", *key, "log_id", "cleaned_text", F.coalesce("timestamp", F.current_timestamp()).alias("ts"), "embedding"
    )
    found = neighbor_columns(encoded, model.index, options.k, probes=model.probes).drop("embedding")
    scored = model.baseline.add_scores(
        found.withColumn("mean_distance", scoring.mean_valid(F.col("distances"))), options.min_distance
    )
    return keyed_windows(scored, key, "seq", window_size=options.window_size, weight=options.temporal_weight)


def write_detected(
    stream: DataFrame, model: DistanceModel, key: list[str], output: str, checkpoint: str,
    source: str | Column | None = None, **trigger,
) -> StreamingQuery:
    """Run :func:`detect_keyed` into parquet, for a corpus of any size; start it inside :func:`keyed_state`.

    A streaming plan cannot search a corpus that no task holds.  Then a micro-batch is searched
    by the batch plan, its rows are stored below ``checkpoint``, and a stream of those files goes
    through the state of the keys before the next one begins.  Rows stored to their end are not
    searched again when an epoch is repeated, so the state meets every row once.
    """
    if fits(model.index):
        return write_append(detect_keyed(stream, model, key, source), output, checkpoint, **trigger)
    scored, options = f"{checkpoint}/scored", model.options

    def work(batch: DataFrame, epoch: int) -> None:
        spark, own = batch.sparkSession, epoch_path(scored, epoch)
        if not written(spark, own):
            scored_batch(batch, model, key, source).write.mode("overwrite").parquet(own)
        files = read_files(spark, f"{scored}/epoch=*", spark.read.parquet(own).schema)
        adjusted = keyed_windows(files, key, "seq", window_size=options.window_size, weight=options.temporal_weight)
        write_append(adjusted, output, f"{checkpoint}/windows").awaitTermination()
        remove(spark, epoch_path(scored, epoch - 1))  # read by an epoch that has ended

    return for_each_epoch(stream, work, f"{checkpoint}/search", **trigger)


# --- trend -------------------------------------------------------------------------


class _Buckets(StatefulProcessor):
    """Counts of a bucket until the watermark has passed its end."""

    def __init__(self, width: int):
        self.width = width  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "total bigint, anomalies bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total = anomalies = 0
        for pdf in rows:
            total, anomalies = total + int(pdf["total"].sum()), anomalies + int(pdf["anomalies"].sum())
        ends = (key[0] + self.width) // 1000
        if ends <= timerValues.getCurrentWatermarkInMs():
            yield self._row(key, total, anomalies, "late")
            return
        if self.counts.exists():
            before = self.counts.get()
            total, anomalies = total + before[0], anomalies + before[1]
        else:
            self.handle.registerTimer(ends)
        self.counts.update((total, anomalies))
        yield self._row(key, total, anomalies, "open")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        total, anomalies = self.counts.get()
        self.counts.clear()
        yield self._row(key, total, anomalies, "closed")

    def _row(self, key, total: int, anomalies: int, kind: str) -> pd.DataFrame:
        return pd.DataFrame({"bucket_us": [key[0]], "total": [total], "anomalies": [anomalies], "kind": [kind]})

    def close(self) -> None:
        pass


def event_time_trend(
    stream: DataFrame, bucket: str = fv.TREND_BUCKET, lateness: str = "1 hour", ts: str = "ts"
) -> DataFrame:
    """``bucket_start, total, anomalies, kind`` of tumbling event-time buckets; start it inside :func:`keyed_state`.

    ``open``: the counts so far of a bucket that got rows in this micro-batch.  ``closed``:
    the last counts of a bucket, once, when the watermark (``lateness`` behind the newest
    time) has passed its end; its state is gone then.  ``late``: rows for a bucket closed
    before, counted by themselves, so nothing is lost.  Rows are counted per task first, so a
    full bucket sends a row per task.
    """
    kept = stream.withWatermark(ts, lateness)
    width = F.window(ts, bucket)
    # Plain numbers carry no watermark, so late rows reach the processor.
    start = F.unix_micros(width["start"])
    size = F.unix_micros(width["end"]) - start
    rows = kept.select(start.alias("bucket_us"), size.alias("_size"), F.col("is_anomaly").alias("odd"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            odd = pdf["odd"].fillna(False).astype(bool).astype(int)
            sums = pdf.assign(total=1, anomalies=odd).groupby("bucket_us", as_index=False)[["total", "anomalies"]].sum()
            yield sums

    span = stream.sparkSession.sql(f"SELECT unix_micros(timestamp'1970-01-01' + INTERVAL {bucket}) - unix_micros(timestamp'1970-01-01')").first()[0]
    partial = rows.drop("_size").mapInPandas(counted, "bucket_us bigint, total bigint, anomalies bigint")
    schema = StructType([
        StructField("bucket_us", LongType()), StructField("total", LongType()), StructField("anomalies", LongType()),
        StructField("kind", StringType()),
    ])
    out = partial.groupBy("bucket_us").transformWithStateInPandas(
        statefulProcessor=_Buckets(int(span)), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )
    return out.select(F.timestamp_micros("bucket_us").alias("bucket_start"), "total", "anomalies", "kind")


def trend_of_epochs(epochs: DataFrame) -> DataFrame:
    """``bucket_start, total, anomalies, is_closed, late`` from stored epochs of :func:`event_time_trend`.

    The newest open or closed counts of a bucket plus all its late rows.
    """
    late = F.col("kind") == "late"
    # Counts of a bucket only grow, so its largest are its newest; a closed bucket has its largest twice.
    return epochs.groupBy("bucket_start").agg(
        (F.coalesce(F.max(F.when(~late, F.col("total"))), F.lit(0)) + F.coalesce(F.sum(F.when(late, F.col("total"))), F.lit(0))).alias("total"),
        (F.coalesce(F.max(F.when(~late, F.col("anomalies"))), F.lit(0)) + F.coalesce(F.sum(F.when(late, F.col("anomalies"))), F.lit(0))).alias("anomalies"),
        F.bool_or(F.col("kind") == "closed").alias("is_closed"),
        F.coalesce(F.sum(F.when(late, F.col("total"))), F.lit(0)).alias("late"),
    )


