"""What several operators of this subpackage share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from oddline.session import durable

HOT_ROWS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that columns of the caller never clash."""
    return df.select(*[df[n] for n in names])


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_lookup(
    left: DataFrame, right: DataFrame, on: list[str], rows: str, total: int, spread: list[str], how: str = "inner"
) -> DataFrame:
    """Join ``left`` to ``right``, which has one row per key and in ``rows`` its number of left rows.

    A key with more than a thousandth of all ``total`` rows, or more than ``HOT_ROWS``,
    is cut into salted sub-keys of at most so many.  Up to 10^9 rows there are fewer
    than a thousand such keys, at 10^11 fewer than 100,000, so their list can be broadcast.
    """
    share = max(min(total // 1000, HOT_ROWS), 1)
    heavy = right.filter(F.col(rows) > share).select(*on, F.ceil(F.col(rows) / share).alias("_salts"))
    salted = left.join(F.broadcast(heavy), on, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*spread), F.coalesce("_salts", F.lit(1)))
    )
    last = F.when(F.col(rows) > share, F.ceil(F.col(rows) / share) - 1).otherwise(F.lit(0))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))))
    return salted.drop("_salts").join(repeated, [*on, "_salt"], how).drop("_salt")


def ranked(df: DataFrame, order: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """Number all rows from 0 without gaps in the given order, no task holding them all.

    Rows are dealt by ranges of the order; only the number of rows per range
    meets in one place.
    """
    dealt = durable(
        df.repartitionByRange(parts or partitions(df), *order).withColumn("_part", F.spark_partition_id()), "ranges"
    )
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        dealt.withColumn("_place", place)
        .join(F.broadcast(starts), "_part")  # one row per range
        .withColumn(name, (F.col("_start") + F.col("_place") - 1).cast("bigint"))
        .drop("_part", "_place", "_start")
    )


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of the nodes of the undirected edges ``(a, b)``.

    The component is its smallest node.  Large and small stars alternate until
    nothing changes, so the number of rounds follows the logarithm of the size;
    each round writes its edges to the shared folder.  No node's edges meet in
    one task: minima are combined before the shuffle, hubs are salted.
    """
    ordered = edges.filter("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    current, seen = durable(ordered.distinct(), "edges"), None
    while True:
        mark = current.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)")).alias("s")
        ).first()
        if mark["n"] == 0 or mark == seen:
            return current.select(F.col("high").alias("node"), F.col("low").alias("component")).union(
                current.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
            )
        seen = mark
        # Large star: every higher neighbour is tied to the lowest one.
        both = current.select(F.col("low").alias("u"), F.col("high").alias("v")).union(
            current.select(F.col("high").alias("u"), F.col("low").alias("v"))
        )
        lowest = both.groupBy("u").agg(
            F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("_rows")
        )
        tied = hot_lookup(both, lowest, ["u"], "_rows", 2 * mark["n"], ["v"])
        large = durable(
            tied.filter("v > u").select(F.col("m").alias("low"), F.col("v").alias("high")).distinct(), "edges"
        )
        # Small star: every lower neighbour and the node itself are tied to the lowest one.
        lowest = large.groupBy("high").agg(F.min("low").alias("m"), F.count(F.lit(1)).alias("_rows"))
        tied = hot_lookup(large, lowest, ["high"], "_rows", large.count(), ["low"])
        current = durable(
            tied.filter("low <> m")
            .select(F.col("m").alias("low"), F.col("low").alias("high"))
            .union(lowest.select(F.col("m").alias("low"), "high"))
            .distinct(),
            "edges",
        )


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``kept``, with all columns.

    Rows repeated with one id and text become one.  Rows that share an id, or have
    none, but differ in text cannot be told apart by ``kept``: all stay if one does.
    """
    ids = kept.select(F.col("doc_id").alias("_kept")).distinct()
    held = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_kept"]), "left_semi")
    return held.dropDuplicates(["doc_id", "text"])


# --- inside tasks ----------------------------------------------------------------


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; null is empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(batches, most_bytes: int, column: str = "text"):
    """Arrow batches cut so that each holds about ``most_bytes`` of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // most_bytes
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        for start, stop in zip(starts, np.r_[starts[1:], len(sizes)]):
            yield batch.slice(int(start), int(stop - start))
            pa.default_memory_pool().release_unused()  # the next slice may need it in another shape
