"""Similarities and statistics around neighbour searches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from oddline.functions.vectors import cosine, l2_normalize
from oddline.operators.cells import CellIndex, _pivot_distances, _slack, build_index, digest, route, stack
from oddline.operators.knn import KERNEL_VALUES, SENT_BYTES, Neighbors, fits
from oddline.operators.skew import salted_lookup
from oddline.session import durable

SIMILAR_DECIMALS = 9  # a similarity this near the threshold reaches it


@dataclass(frozen=True)
class SimilarPairs:
    """All pairs of different directions that are similar, and who has a direction."""

    pairs: DataFrame  # (left_id, right_id, similarity, left_rows, right_rows), left_id < right_id, both smallest of their class
    members: DataFrame  # (id, class_id): rows with the same direction


def _similar(q: np.ndarray, c: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions in ``q`` and ``c`` of pairs with at least the similarity, and their similarity, in pieces.

    Products in single precision narrow the candidates; each gets its exact product.  A piece has
    65,536 pairs at most, however many are similar.
    """
    right = np.ascontiguousarray(c.T, dtype=np.float32)
    low = np.float32(threshold - 1e-5)
    step = max(1, KERNEL_VALUES // max(1, len(c)))
    for start in range(0, len(q), step):
        at, hit = np.divmod(np.flatnonzero(q[start : start + step].astype(np.float32) @ right >= low), len(c))
        for part in range(0, len(at), 65_536):
            a, h = start + at[part : part + 65_536], hit[part : part + 65_536]
            value = (q[a] * c[h]).sum(1)
            keep = np.round(value, SIMILAR_DECIMALS) >= threshold
            yield a[keep], h[keep], value[keep]


def _similar_in_block(
    keys: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, threshold: float,
    key_rows: np.ndarray | None = None, id_rows: np.ndarray | None = None,
) -> Iterator[pd.DataFrame]:
    """Pairs of one block with at least the similarity, the smaller key first, in pieces; with rows where given."""
    for a, h, value in _similar(q, c, threshold):
        keep = keys[a] < ids[h]
        if keep.any():
            a, h = a[keep], h[keep]
            found = pd.DataFrame({"vec_key": keys[a], "neighbor_id": ids[h], "distance": value[keep]})
            yield found if key_rows is None else found.assign(left_rows=key_rows[a], right_rows=id_rows[h])


def similar_pairs(
    rows: DataFrame, threshold: float, id_col: str = "id", vec_col: str = "embedding", cells: int | None = None
) -> SimilarPairs:
    """All pairs of ``rows`` whose cosine is at least ``threshold``, and how many rows each of the two has.

    Rows of one direction form a class, so a group of copies is one vector.  Unit vectors
    of cosine ``t`` are ``sqrt(2 - 2 t)`` apart, so a vector meets only cells whose centre,
    less their radius, is that near.  Pairs leave the task that finds them as they are returned:
    none is stored or shuffled, as they grow with the square of the rows.
    Rows without vector, or of length 0, have no direction and no class.
    """
    unit = rows.select(F.col(id_col).alias("id"), l2_normalize(F.col(vec_col).cast("array<double>")).alias("vec"))
    length = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    unit = durable(unit.filter(length > 0.5), "directions")
    keyed = unit.select("id", *digest(), "vec")
    classes = durable(
        keyed.groupBy("_h1", "_h2").agg(F.min("id").alias("vec_key"), F.first("vec").alias("vec")), "classes"
    )
    members = salted_lookup(keyed.drop("vec"), classes.select("_h1", "_h2", F.col("vec_key").alias("class_id")), ["_h1", "_h2"], "inner", ["id"])
    members = members.select("id", "class_id")
    heads = classes.select("vec_key", "vec").filter("vec_key IS NOT NULL")
    index = build_index(heads, 1, "squared_l2", "vec_key", "vec", cells=cells)
    sizes = members.groupBy(F.col("class_id").alias("_id")).agg(F.count(F.lit(1)).alias("rows"))
    within = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6)
    if fits(index):
        found = _pairs_of_sent(heads, index, sizes, threshold, within)
    else:
        found = _pairs_of_blocks(index, sizes, threshold, within)
    return SimilarPairs(found, members)


def _rows_of_blocks(index: CellIndex, sizes: DataFrame) -> DataFrame:
    """``(block, rows)``: how many rows the class of each id of a block has, in the order of the ids."""
    ids = index.blocks.select("block", F.posexplode("ids").alias("_at", "_id"))
    listed = ids.join(sizes, "_id").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("_at", "rows"))).alias("_rows"))
    return durable(listed.select("block", F.transform("_rows", lambda r: r["rows"]).alias("rows")), "class-rows")


def _schema(index: CellIndex) -> str:
    return f"left_id {index.id_type}, right_id {index.id_type}, similarity double, left_rows bigint, right_rows bigint"


NAMES = {"vec_key": "left_id", "neighbor_id": "right_id", "distance": "similarity"}


def _pairs_of_sent(heads: DataFrame, index: CellIndex, sizes: DataFrame, threshold: float, within: float) -> DataFrame:
    """Where the tasks that read vectors hold all blocks."""
    shared, held = index.sent(), _rows_of_blocks(index, sizes).toArrow()
    numbers = dict(zip(held["block"].to_pylist(), (np.array(r) for r in held["rows"].to_pylist())))
    counts = index.spark.sparkContext.broadcast(numbers)
    routed = route(heads.join(sizes.withColumnRenamed("_id", "vec_key"), "vec_key"), index, 1, None, within=within)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            keys, rows, asked = pdf["vec_key"].to_numpy(), pdf["rows"].to_numpy(), [set(b) for b in pdf["blocks"]]
            q = stack(pdf["vec"])
            for number, ids, c in shared.value:
                at = np.flatnonzero([number in own for own in asked])
                if len(at):
                    for found in _similar_in_block(keys[at], q[at], ids, c, threshold, rows[at], counts.value[number]):
                        yield found.rename(columns=NAMES)

    return routed.mapInPandas(search, _schema(index))


def _pairs_of_blocks(index: CellIndex, sizes: DataFrame, threshold: float, within: float) -> DataFrame:
    """Every two blocks whose cells are near enough meet in a task, once; a task holds few blocks."""
    level = index.level
    bounded = index.cells is None and level.bounded
    rows = _rows_of_blocks(index, sizes)
    blocks = index.blocks.join(F.broadcast(rows) if index.size * 16 <= SENT_BYTES else rows, "block")
    if bounded:
        reach = within + level.radius + _slack(level.pivots, level.pivots)
        full = level.counts > 0
        near = [np.flatnonzero((d <= reach + level.radius[i]) & full).tolist() for i, d in enumerate(_pivot_distances(level.pivots, level.pivots))]
        near = index.spark.createDataFrame(list(enumerate(near)), "cell int, near array<int>")  # one row per cell of a level
        blocks = blocks.join(F.broadcast(near), "cell")
    # By ranges: about one block in a partition, so that two partitions are little for a task.
    dealt = blocks.repartitionByRange(max(1, index.layout.count()), "block")
    left, right = (dealt.select(*[F.col(c).alias(f"{side}_{c}") for c in dealt.columns]) for side in ("l", "r"))
    meet = F.col("l_block") <= F.col("r_block")
    if bounded:
        meet = meet & F.array_contains("l_near", F.col("r_cell"))
    shared = index.spark.sparkContext.broadcast((level.pivots, reach)) if bounded else None
    columns = ("block", "cell", "ids", "vecs", "rows")
    kind, schema = index.kind, _schema(index)

    def unpack(batch: pa.RecordBatch, side: str, i: int):
        block, cell, ids, vecs, rows = (batch.column(batch.schema.get_field_index(f"{side}_{c}"))[i] for c in columns)
        ids = ids.values.to_numpy(zero_copy_only=False)
        x = np.frombuffer(vecs.as_buffer(), kind).reshape(len(ids), -1).astype(np.float64)
        return block.as_py(), cell.as_py(), ids, x, rows.values.to_numpy(zero_copy_only=False)

    def near_rows(x: np.ndarray, cell: int) -> np.ndarray:
        if shared is None:
            return np.arange(len(x))
        pivots, reach = shared.value
        return np.flatnonzero(_pivot_distances(x, pivots[cell : cell + 1])[:, 0] <= reach[cell])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i in ((b, i) for b in batches for i in range(b.num_rows)):
            a, a_cell, a_ids, a_vecs, a_rows = unpack(batch, "l", i)
            b, b_cell, b_ids, b_vecs, b_rows = unpack(batch, "r", i)
            own, other = near_rows(a_vecs, b_cell), near_rows(b_vecs, a_cell)
            if not len(own) or not len(other):
                continue
            for at, hit, value in _similar(a_vecs[own], b_vecs[other], threshold):
                at, hit = own[at], other[hit]
                first = a_ids[at] < b_ids[hit]
                keep = first if a == b else a_ids[at] != b_ids[hit]
                if not keep.any():
                    continue
                at, hit, first = at[keep], hit[keep], first[keep]
                both = [(a_ids[at], b_ids[hit]), (a_rows[at], b_rows[hit])]
                (left_id, right_id), (left_rows, right_rows) = ((np.where(first, x, y), np.where(first, y, x)) for x, y in both)
                yield pa.RecordBatch.from_pydict({
                    "left_id": left_id, "right_id": right_id, "similarity": value[keep], "left_rows": left_rows, "right_rows": right_rows,
                })

    # Not broadcast, not by a key: every partition meets every other one where it is read.
    pairs = left.join(right.hint("shuffle_replicate_nl"), meet, "inner")
    return pairs.select(*[f"{side}_{c}" for side in ("l", "r") for c in columns]).mapInArrow(search, schema)


def pair_similarity(
    pairs: DataFrame, left: DataFrame, right: DataFrame, normalized: bool = True
) -> DataFrame:
    """Cosine of given ``(left_id, right_id)`` pairs; tables are ``(id, embedding)``."""
    l = left.select(F.col("id").alias("left_id"), F.col("embedding").alias("_l"))
    r = right.select(F.col("id").alias("right_id"), F.col("embedding").alias("_r"))
    joined = salted_lookup(salted_lookup(pairs, l, ["left_id"], "inner"), r, ["right_id"], "inner")
    return joined.withColumn("similarity", cosine(F.col("_l"), F.col("_r"), normalized)).drop("_l", "_r")


def neighborhood_stats(neighbors: Neighbors) -> DataFrame:
    """Count, mean, population deviation and extremes of each query's distances."""
    valid = neighbors.rows.filter("distance >= 0")
    stats = valid.groupBy("vec_key").agg(
        F.count(F.lit(1)).alias("num_neighbors"),
        F.avg("distance").alias("mean_distance"),
        F.stddev_pop("distance").alias("std_distance"),
        F.min("distance").alias("min_distance"),
        F.max("distance").alias("max_distance"),
    )
    infinite = F.lit(float("inf"))
    whole = neighbors.groups.select("vec_key").join(stats, "vec_key", "left")
    return neighbors.expand(
        whole.select(
            "vec_key",
            F.coalesce("num_neighbors", F.lit(0)).alias("num_neighbors"),
            F.coalesce("mean_distance", infinite).alias("mean_distance"),
            "std_distance",
            F.coalesce("min_distance", infinite).alias("min_distance"),
            F.coalesce("max_distance", infinite).alias("max_distance"),
        )
    )


def with_neighbor_metadata(neighbors: DataFrame, latest: DataFrame) -> DataFrame:
    """Add ``metadata`` of each neighbour, an empty map where there is none."""
    lookup = latest.select(F.col("id").alias("neighbor_id"), "metadata")
    empty = F.create_map().cast("map<string,string>")
    return salted_lookup(neighbors, lookup, ["neighbor_id"]).withColumn(
        "metadata", F.coalesce("metadata", empty)
    )
