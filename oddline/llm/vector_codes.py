"""Product codes of vectors: codebooks per part, trained with exact integers and pruned by pivots."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from oddline.llm.common import columns, hot_lookup
from oddline.session import durable

PARTS, ENTRIES, ROUNDS, PIVOTS, SCALE = 8, 16, 6, 4, 4096
LARGEST = 2**26  # so that errors fit a long
CHUNK_VALUES = 2_000_000
MARGIN = 4e-6  # more than the rounding of two distances in single precision


@dataclass(frozen=True)
class Codes:
    """What ``compress`` gives: a row per vector, and the entries by part, entry and place."""

    rows: DataFrame  # vec_id, label, codes array<int>, error
    entries: np.ndarray


def scaled_parts(embeddings: DataFrame, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """``vec_id, label, ints`` of the usable rows, all of one length that ``parts`` divides."""
    rows = columns(embeddings, "vec_id", "embedding", "label").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("v")
    )
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = rows.filter(F.col("v").isNotNull() & ~F.exists("v", bad))
    longest = usable.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(-(-longest // parts), 1) * parts
    ints = F.transform("v", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(LARGEST)), F.lit(-LARGEST))).cast("int"))
    return usable.select(
        "vec_id", "label", F.concat(ints, F.array_repeat(F.lit(0), F.lit(width) - F.size("v"))).alias("ints")
    )


def _cut(column: pa.Array, rows: int, parts: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, parts, -1).astype(kind)


def _distances(values: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Euclidean distances by part: ``(rows, parts, width)`` and ``(parts, m, width)`` give ``(rows, parts, m)``."""
    out = np.empty((len(values), others.shape[0], others.shape[1]), np.float32)
    for m in range(others.shape[1]):
        step = values - others[None, :, m]
        out[:, :, m] = np.sqrt((step * step).sum(2).astype(np.float64))
    return out


def nearest(values: np.ndarray, far: np.ndarray, entries: np.ndarray, entry_far: np.ndarray):
    """Index and squared distance of the nearest entry of every part, and how many distances were computed.

    ``|far - entry_far|`` is a lower bound by each pivot.  Entries are tried in the order
    of the largest bound; a part is done when the next bound exceeds its best distance.
    Of equal distances the lower index wins.
    """
    n, parts = values.shape[:2]
    index, squared, computed = np.zeros((n, parts), np.int64), np.full((n, parts), np.iinfo(np.int64).max), 0
    for p in range(parts):
        lower = np.zeros((n, entries.shape[1]), np.float32)
        for pivot in range(far.shape[2]):
            a, b = far[:, p, pivot, None], entry_far[None, p, :, pivot]
            np.maximum(lower, np.abs(a - b) - np.float32(MARGIN) * (a + b), out=lower)
        order = np.argsort(lower, axis=1, kind="stable")
        live = np.arange(n)
        for step in range(entries.shape[1]):
            entry = order[live, step]
            bound = lower[live, entry].astype(np.float64)
            open_ = bound * bound * (1 - 1e-6) <= squared[live, p]
            live, entry = live[open_], entry[open_]
            if not len(live):
                break
            computed += len(live)
            difference = values[live, p] - entries[p, entry]
            distance = (difference * difference).sum(1)
            best = squared[live, p]
            won = (distance < best) | ((distance == best) & (entry < index[live, p]))
            squared[live[won], p], index[live[won], p] = distance[won], entry[won]
    return index, squared, computed


def _chunks(batch: pa.RecordBatch, parts: int, *names: str) -> Iterator[tuple]:
    """Slices of a batch of bounded size, with integer parts and pivot distances."""
    at = [batch.schema.get_field_index(n) for n in names]
    rows = batch.num_rows
    if rows:
        width = len(batch.column(at[0]).flatten()) // rows
        step = max(1, CHUNK_VALUES // width)
        for start in range(0, rows, step):
            part = batch.slice(start, step)
            kinds = (np.int64, np.float32)
            yield part, *[_cut(part.column(i), part.num_rows, parts, k) for i, k in zip(at, kinds)]


def compress(
    embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
    pivots: int = PIVOTS, scale: int = SCALE,
) -> Codes:
    """Codes of the vectors of ``embeddings(vec_id, embedding, label)``.

    Rows whose vector is null or holds a null or non-finite component are left out.
    Components become ``floor(scale * x)``, at most 2^26 in size; shorter vectors are
    filled up with zeros to the longest, and that to a multiple of ``parts``.  The
    codebooks start as the vectors of the smallest ids (null last, then by components;
    of fewer rows, all); each round moves an entry to the floored mean of its parts, and
    an entry without parts stays.  Distances to the pivots, a few of the first entries,
    are computed once and stored with the parts.  Per task and round, only sums per
    entry leave the task; the driver holds the codebooks.  No usable row: no code.
    """
    ints = scaled_parts(embeddings, scale, parts)
    start = [r["ints"] for r in ints.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).collect()]
    width = len(start[0]) // parts if start else 1
    book = np.array(start, np.int64).reshape(len(start), parts, width).transpose(1, 0, 2)
    fixed = book[:, np.unique(np.linspace(0, len(start) - 1, pivots).astype(int)) if start else []]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, values in _chunks(batch, parts, "ints"):
                far = _distances(values, fixed).reshape(part.num_rows, -1)
                lists = pa.ListArray.from_arrays(
                    np.arange(0, far.size + 1, max(far.shape[1], 1), dtype=np.int32), far.ravel()
                )
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "far"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ints.schema)
    if not start:
        return Codes(ints.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("bigint").alias("error")), book)
    table = durable(ints.mapInArrow(measured, f"{types}, far array<float>"), "parts")
    for _ in range(rounds):
        book = _moved(table.select("ints", "far"), book, _distances(book.transpose(1, 0, 2), fixed).transpose(1, 0, 2))
    entry_far = _distances(book.transpose(1, 0, 2), fixed).transpose(1, 0, 2)
    last = book

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, values, far in _chunks(batch, parts, "ints", "far"):
                index, squared, _ = nearest(values, far, last, entry_far)
                lists = pa.ListArray.from_arrays(
                    np.arange(0, index.size + 1, parts, dtype=np.int32), index.astype(np.int32).ravel()
                )
                kept = [part.column(part.schema.get_field_index(n)) for n in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*kept, lists, pa.array(squared.sum(1))], ["vec_id", "label", "codes", "error"])

    types = {f.name: f.dataType.simpleString() for f in table.schema}
    schema = f"vec_id {types['vec_id']}, label {types['label']}, codes array<int>, error bigint"
    return Codes(durable(table.mapInArrow(coded, schema), "codes"), last)


def _moved(table: DataFrame, book: np.ndarray, entry_far: np.ndarray) -> np.ndarray:
    """The codebook after one round."""
    parts, entries, width = book.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(book.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, values, far in _chunks(batch, parts, "ints", "far"):
                index = nearest(values, far, book, entry_far)[0]
                for p in range(parts):
                    n[p] += np.bincount(index[:, p], minlength=entries)
                    for e in np.flatnonzero(n[p]):
                        total[p, e] += values[index[:, p] == e, p].sum(0)
        used = np.argwhere(n > 0)
        lists = pa.ListArray.from_arrays(
            np.arange(0, len(used) * width + 1, width, dtype=np.int32), total[n > 0].ravel()
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array(used[:, 0], pa.int32()), pa.array(used[:, 1], pa.int32()), pa.array(n[n > 0]), lists],
            ["part", "entry", "n", "total"],
        )

    found = table.mapInArrow(summed, "part int, entry int, n bigint, total array<bigint>")
    sums = found.select("part", "entry", "n", F.posexplode("total").alias("place", "x")).groupBy("part", "entry", "place").agg(
        F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("total")
    )
    moved = book.copy()
    for r in sums.collect():  # one row per number of the codebooks
        moved[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return moved


def codebooks_sha256(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def with_label_error(rows: DataFrame) -> DataFrame:
    """Adds ``label_error``, the error of all rows with the same label; rows without label are one group."""
    keyed = rows.withColumns({"_none": F.col("label").isNull(), "_label": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    keys = ["_none", "_label"]
    sums = keyed.groupBy(*keys).agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n"))
    return hot_lookup(keyed, sums, keys, "_n", rows.count(), ["vec_id", "error"]).drop(*keys, "_n")


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    found = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return with_label_error(found.rows).select(
        "vec_id", code.alias("code"), "error", "label_error", F.lit(codebooks_sha256(found.entries)).alias("codebooks_sha256")
    )


def _sql() -> str:
    """The rounds written out: parts, the nearest of all entries, floored means."""
    steps = [
        """v AS (
            SELECT vec_id, label, p, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT)
                [p * len(embedding) // 8 + 1:(p + 1) * len(embedding) // 8] AS x
            FROM embeddings, range(8) r(p)
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        )""",
        """b0 AS MATERIALIZED (
            SELECT p, rank() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM v
            QUALIFY rank() OVER (PARTITION BY p ORDER BY vec_id) <= 16
        )""",
    ]
    for i in range(ROUNDS + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (
            SELECT vec_id, label, p, x, min((d, e)) AS best FROM (
                SELECT v.*, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
                FROM v JOIN b{i} USING (p)
            ) GROUP BY vec_id, label, p, x
        )"""
        )
        if i < ROUNDS:
            steps.append(
                f"""s{i} AS (
            SELECT p, best[2] AS e, i, sum(x[i])::HUGEINT AS s, count(*)::HUGEINT AS n
            FROM a{i}, range(1, 1 + (SELECT max(len(x)) FROM v)) r(i) GROUP BY p, best[2], i
        ), b{i + 1} AS MATERIALIZED (
            SELECT p, e, coalesce(m, c) AS c FROM b{i} LEFT JOIN (
                SELECT p, e, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY i) AS m FROM s{i} GROUP BY p, e
            ) USING (p, e)
        )"""
            )
    return (
        "WITH " + ", ".join(steps) + f""", r AS (
            SELECT vec_id, label, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error
            FROM a{ROUNDS} GROUP BY vec_id, label
        )
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
               (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{ROUNDS}) AS codebooks_sha256
        FROM r"""
    )


SQL = {"op12_vector_codes": _sql()}
