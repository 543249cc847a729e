"""Online detection as Structured Streaming jobs.

Parsing and trends are plain streaming plans.  Scoring needs ranked neighbours
and score windows, which a streaming plan does not offer, so it runs the batch
plans on each micro-batch.  Every micro-batch writes to its own ``epoch``
folder and overwrites it when it is repeated, so a restart leaves no doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from oddline import fixed_values as fv
from oddline.functions.text import CleanOptions, parse_logs
from oddline.operators import windows
from oddline.operators.history import anomaly_rate, trend
from oddline.plans.distance_detector import DistanceModel, encode_queries, score_vectors
from oddline.session import durable, removed_afterwards, remove


FULL_STATE = 20  # epochs from one state of all keys to the next


def read_files(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    file_format: str = "parquet",
    glob: str | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """A stream of the files in a folder."""
    reader = spark.readStream.format(file_format).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def parse_stream(
    lines: DataFrame, source: str | Column | None = None, options: CleanOptions = CleanOptions()
) -> DataFrame:
    """The batch parser: it is stateless, so it runs on a stream as it is."""
    return parse_logs(lines, source=source, options=options)


def epoch_path(root: str, epoch: int) -> str:
    return f"{root}/epoch={epoch}"


def spread(batch: DataFrame) -> DataFrame:
    """A micro-batch over all cores: it may be one file, and its rows are searched where they lie."""
    return batch.repartition(batch.sparkSession.sparkContext.defaultParallelism)


def for_each_epoch(
    stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, **trigger
) -> StreamingQuery:
    """Run ``work(batch, epoch)``; by default on all there is, then stop.

    What ``work`` stores on the way is removed when the epoch's output is written.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        with removed_afterwards(batch.sparkSession):
            work(batch, epoch)

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def score_stream(
    stream: DataFrame, score: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Apply a batch scoring plan to each micro-batch and keep its rows.

    ``score`` closes over the static model and sees one micro-batch only, so it
    must not look at rows before it; score windows are :func:`detect_stream`'s.
    """

    def work(batch: DataFrame, epoch: int) -> None:
        score(spread(batch)).write.mode("overwrite").parquet(epoch_path(output, epoch))

    return for_each_epoch(stream, work, checkpoint, **trigger)


def window_stream(
    stream: DataFrame,
    key: list[str],
    order: list[str],
    output: str,
    state: str,
    checkpoint: str,
    score: str = "score",
    ts: str = "ts",
    window_size: int = fv.WINDOW_SIZE,
    chunk_rows: int = windows.CHUNK_ROWS,
    **trigger,
) -> StreamingQuery:
    """Score windows that go on across micro-batches.

    The state is the last ``window_size`` rows of each key.  An epoch reads the
    states of the epochs before it and writes that of its own keys only, so
    repeating it gives the same result; every ``FULL_STATE`` epochs the state of all
    keys is written together and states no longer read are removed.  No row is dropped for being late: arrival order (``order``) rules,
    and lateness lowers the weight.  A hot key is cut into chunks like any
    other, not fed to one task.
    """

    def work(batch: DataFrame, epoch: int) -> None:
        _window_epoch(batch, epoch, key, order, output, state, score, ts, window_size, chunk_rows)

    return for_each_epoch(stream, work, checkpoint, **trigger)


def _window_epoch(
    batch: DataFrame, epoch: int, key: list[str], order: list[str], output: str, state: str,
    score: str, ts: str, window_size: int, chunk_rows: int, **options,
) -> None:
    """Windows of one epoch's rows over those that the epochs before left."""
    spark = batch.sparkSession
    new = durable(batch.withColumn("_new", F.lit(True)), "batch")
    whole = epoch > 0 and epoch % FULL_STATE == 0
    rows = new
    if epoch > 0:
        first = (epoch - 1) // FULL_STATE * FULL_STATE  # that epoch's state is of all keys
        before = (
            spark.read.schema(new.schema).parquet(state)
            .filter(F.col("epoch").between(first, epoch - 1))
            .withColumn("_new", F.lit(False))
        )
        if key and not whole:
            named = new.select(F.struct(*key).alias("_named")).distinct()
            before = before.join(named, F.struct(*key).eqNullSafe(F.col("_named")), "left_semi")
        # A key's newest state holds all that is known of it: at most FULL_STATE states meet here.
        newest = F.max("epoch").over(Window.partitionBy(*(key or [F.lit(0)])))
        before = before.withColumn("_newest", newest).filter("epoch = _newest")
        rows = before.drop("epoch", "_newest").unionByName(new)
    chunked = windows.with_history(rows, key, order, window_size, chunk_rows)
    adjusted = windows.add_temporal_context(chunked, order, score, ts, window_size, **options)
    flagged = windows.add_burst(adjusted, order, score, window_size=window_size)
    windows.without_history(flagged).filter("_new").drop("_new").write.mode("overwrite").parquet(
        epoch_path(output, epoch)
    )
    kept = windows.without_history(chunked).select(rows.columns)
    windows.last_rows(kept, key, order, window_size).write.mode("overwrite").parquet(
        epoch_path(state, epoch)
    )
    if whole:  # repeating this epoch would read those from epoch - FULL_STATE on
        for old in range(max(0, epoch - 2 * FULL_STATE), epoch - FULL_STATE):
            remove(spark, epoch_path(state, old))


def scored_batch(batch: DataFrame, model: DistanceModel, key: list[str], source: str | Column | None) -> DataFrame:
    """A micro-batch parsed, encoded, searched and scored, with the columns windows need."""
    stored = encode_queries(spread(batch), model.options, source)
    found = score_vectors(stored.select("seq", "embedding"), model)
    clock = stored.select(
        "seq", *key, "log_id", "cleaned_text", F.coalesce("timestamp", F.current_timestamp()).alias("ts")
    )
    return clock.join(found, "seq")


def detect_stream(
    stream: DataFrame,
    model: DistanceModel,
    key: list[str],
    output: str,
    state: str,
    checkpoint: str,
    source: str | Column | None = None,
    chunk_rows: int = windows.CHUNK_ROWS,
    **trigger,
) -> StreamingQuery:
    """The whole distance detector on a stream of ``(seq, raw_text[, key])``.

    Every micro-batch is parsed, encoded and searched; its scores then go on in the
    windows of the batches before it, so the result does not depend on how the
    stream is cut.  A line without a time takes the time of its batch.  Rows of
    ``output``: ``seq``, the key, ``log_id, cleaned_text, ts``, the score with its
    flag and confidence, the neighbours, and the window columns.
    """
    options = model.options

    def work(batch: DataFrame, epoch: int) -> None:
        rows = durable(scored_batch(batch, model, key, source), "scored")
        _window_epoch(
            rows, epoch, key, ["seq"], output, state, "score", "ts", options.window_size, chunk_rows,
            weight=options.temporal_weight,
        )

    return for_each_epoch(stream, work, checkpoint, **trigger)


def trend_stream(
    stream: DataFrame, counts: str, checkpoint: str, bucket: str = fv.TREND_BUCKET, ts: str = "ts", **trigger
) -> StreamingQuery:
    """Keep the rows and anomalies per time bucket of every epoch.

    :func:`running_trend` adds them up, so no row is too late and the newest bucket
    is there, too.
    """

    def work(batch: DataFrame, epoch: int) -> None:
        trend(batch, bucket, ts).write.mode("overwrite").parquet(epoch_path(counts, epoch))

    return for_each_epoch(stream, work, checkpoint, **trigger)


def running_trend(spark: SparkSession, counts: str) -> DataFrame:
    """Rows and anomalies per time bucket over all epochs so far."""
    return read_epochs(spark, counts).groupBy("bucket_start").agg(
        F.sum("total").alias("total"), F.sum("anomalies").alias("anomalies")
    )


def write_append(stream: DataFrame, output: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append-only parquet sink."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def alert_stream(
    detections: DataFrame, output: str, rates: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Append flagged rows per epoch and keep one row of counts per epoch.

    The running rate is :func:`running_rate` over the counts: it reads a row
    per epoch instead of all detections.
    """

    def work(batch: DataFrame, epoch: int) -> None:
        stored = durable(batch, "alerts")
        stored.filter("is_anomaly").write.mode("overwrite").parquet(epoch_path(output, epoch))
        anomaly_rate(stored).drop("rate").write.mode("overwrite").parquet(epoch_path(rates, epoch))

    return for_each_epoch(detections, work, checkpoint, **trigger)


def running_rate(spark: SparkSession, rates: str) -> DataFrame:
    """Totals and share of anomalies over all epochs so far."""
    counts = spark.read.parquet(rates)
    return counts.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("anomalies"), F.lit(0)).alias("anomalies"),
    ).withColumn("rate", F.coalesce(F.try_divide(F.col("anomalies"), F.col("total")), F.lit(0.0)))


def read_epochs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root).drop("epoch")
