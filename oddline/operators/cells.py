"""The stored form of a vector corpus: cells around centres, cut into packed blocks.

A corpus is written once.  A block is one row: the ids and the vectors of up to
``BLOCK_BYTES`` of one cell, sorted by id.  Searches read the blocks where they
lie; only queries travel.  Files are bucketed by block, so that a join on the
block needs no exchange of the corpus either.

Small corpora have one level of cells, whose centres every task holds.  Larger
ones have two: groups of cells, whose centres every task holds, and the cells of
each group in a table that queries meet group by group.  So no table that grows
with the corpus is held in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import ceil, isqrt
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from oddline import fixed_values as fv
from oddline.operators.skew import first_per_group
from oddline.session import durable, scratch_path

METRICS = ("squared_l2", "euclidean", "inner_product")
CELL_ROWS = 16_384
# Every task that routes holds the centres of one level; more cells take two levels.
LEVEL_BYTES = 64 * 2**20
LEVEL_CELLS = 4096
BLOCK_BYTES = 8 * 2**20  # vectors of a block, in double precision
GROUP_ROWS = 65_536  # rows or queries that meet the cells of a group at once
BUCKET_BYTES = 128 * 2**20
# Centres are trained on so many rows per cell, within SAMPLE_BYTES.
SAMPLE_ROWS = 256
SAMPLE_BYTES = 64 * 2**20
MATRIX_VALUES = 4_000_000


@dataclass(frozen=True)
class Level:
    """What bounds need to know of cells, or of groups of cells."""

    pivots: np.ndarray
    counts: np.ndarray  # rows per cell
    reach: np.ndarray  # per cell, distances of the rows nearest to the centre, padded with inf
    radius: np.ndarray  # per cell, distance of the farthest row

    @property
    def bounded(self) -> bool:
        return self.pivots.shape[1] > 0


@dataclass(frozen=True)
class Part:
    """A folder of blocks, written by one build or one extension."""

    path: str
    buckets: int


@dataclass(frozen=True)
class CellIndex:
    """A stored corpus.

    ``blocks`` has ``(block, cell, ids, vecs)``, ``layout`` ``(cell, block, n)``.  ``level``
    describes the cells; with ``cells(node, cell, pivot, n, reach, radius)`` it describes
    the groups (nodes) and the table the cells.
    """

    spark: SparkSession
    parts: tuple[Part, ...]
    layout: DataFrame
    level: Level
    cells: DataFrame | None
    metric: str
    copies: int  # at most so many equal vectors are kept
    id_type: str
    double: bool
    width: int
    tail: int = 0  # values at the end of a vector that rows with the same text differ in

    @property
    def pivots(self) -> np.ndarray:
        return self.level.pivots

    @property
    def counts(self) -> np.ndarray:
        return self.level.counts

    @property
    def size(self) -> int:
        return int(self.level.counts.sum())

    @property
    def schema(self) -> str:
        return f"block int, cell int, ids array<{self.id_type}>, vecs binary"

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[p.path for p in self.parts])

    @property
    def kind(self) -> str:
        return "<f8" if self.double else "<f4"

    def sent(self):
        """All blocks as a broadcast, for callers that have checked the size; made once per index."""
        key = tuple(p.path for p in self.parts)
        if key not in _SENT:
            _SENT.clear()  # the one used last is held
            held = self.blocks.select("block", "ids", "vecs").toArrow()
            blocks = [b for part in held.to_batches() for b in unpacked(part, self.kind)]
            _SENT[key] = self.spark.sparkContext.broadcast(blocks)
        return _SENT[key]

    def blocks_of_cells(self) -> dict[int, np.ndarray]:
        """Blocks by cell, of an index of one level: few cells."""
        out: dict[int, list[int]] = {}
        for row in self.layout.collect():
            out.setdefault(row["cell"], []).append(row["block"])
        return {c: np.array(sorted(b), np.int32) for c, b in out.items()}


_SENT: dict = {}


def unpacked(batch: pa.RecordBatch, kind: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Block number, ids and vectors of every block of a batch."""
    ids, vecs = batch.column("ids"), batch.column("vecs")
    for i, block in enumerate(batch.column("block").to_pylist()):
        own = ids[i].values.to_numpy(zero_copy_only=False)
        yield block, own, np.frombuffer(vecs[i].as_buffer(), kind).reshape(len(own), -1).astype(np.float64)


def stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def digest(vec: str = "vec") -> list:
    """128 bits that stand for a vector in keys."""
    return [F.xxhash64(vec).alias("_h1"), F.xxhash64(F.lit(1), vec).alias("_h2")]


def head_digest(vec: str, tail: int) -> Column:
    """Stands for all but the last ``tail`` values where rows are dealt out."""
    return F.xxhash64(F.slice(vec, F.lit(1), F.size(vec) - tail))


# --- build -----------------------------------------------------------------------


def build_index(
    corpus: DataFrame,
    k: int,
    metric: str = "squared_l2",
    id_col: str = "id",
    vec_col: str = "embedding",
    cells: int | None = None,
    pivots: np.ndarray | None = None,
    members: list[np.ndarray] | None = None,
    groups: int | None = None,
    cell_rows: int = CELL_ROWS,
    block_rows: int | None = None,
    tail: int = 0,
) -> CellIndex:
    """Split ``corpus`` into cells; the index serves searches for up to ``k`` rows.

    ``corpus`` should be a stored table: it is counted first.  ``pivots`` are given
    centres or picked by a hash of the id, one for every ``cell_rows`` rows.  ``groups``
    asks for two levels, which is the default beyond ``LEVEL_CELLS`` cells or
    ``LEVEL_BYTES``; then ``pivots`` are the centres of the groups and ``members`` those
    of the cells of each group.  Of equal vectors the ``k`` smallest ids are kept.  Rows that
    are equal but for their last ``tail`` values share a cell, and a block if they are few.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    vectors = corpus.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).filter(F.col("vec").isNotNull())
    keyed = vectors.select("*", *digest())
    copies = first_per_group(keyed, ["_h1", "_h2"], ["id"], k, "_copy").drop("_h1", "_h2")
    numbers = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    size, width = numbers["n"], numbers["d"] or 1
    wanted = cells or size // cell_rows
    if groups is None and members is None and pivots is None and (wanted > LEVEL_CELLS or wanted * 8 * width > LEVEL_BYTES):
        groups = isqrt(wanted)
    if pivots is None:
        pivots = np.zeros((1, 0))
        if wanted > 1:
            pivots = _pick_pivots(copies.filter("_copy = 1"), groups or wanted, width)
    kept = copies.drop("_copy")
    if len(pivots) <= 1 and members is None:
        pivots = np.zeros((1, 0))
    build = _Build(kept, k, metric, size, width, block_rows, tail)
    if groups is None and members is None:
        return build.flat(pivots)
    per_group = ceil(wanted / max(groups or 1, 1))
    return build.grouped(pivots, members, lambda rows: _hash_members(rows, per_group))


def kmeans_index(
    corpus: DataFrame,
    k: int,
    cells: int = fv.IVF_CELLS,
    metric: str = "squared_l2",
    id_col: str = "id",
    vec_col: str = "embedding",
    seed: int = 42,
    iterations: int = 10,
    groups: int | None = None,
) -> CellIndex:
    """Cells around k-means centres, for searches that probe a few cells.

    Centres are trained on ``SAMPLE_ROWS`` rows per cell, drawn by a hash of the id, as
    far as they fit ``SAMPLE_BYTES``; every row is indexed.  With ``groups`` those are
    trained first and the cells of each group from a sample of its own rows, in tasks.
    """
    vectors = corpus.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).filter(F.col("vec").isNotNull())
    width = vectors.agg(F.max(F.size("vec"))).first()[0] or 1
    first = groups or cells
    most = max(first, min(SAMPLE_ROWS * first, SAMPLE_BYTES // (8 * width)))
    sample = vectors.orderBy(*_by_hash()).limit(most).select("vec").toPandas()
    if not len(sample):
        return build_index(corpus, k, metric, id_col, vec_col, cells=1)
    pivots = lloyd(stack(sample["vec"]), first, iterations, seed)
    if groups is None:
        return build_index(corpus, k, metric, id_col, vec_col, pivots=pivots)
    copies = first_per_group(vectors.select("*", *digest()), ["_h1", "_h2"], ["id"], k, "_copy")
    numbers = vectors.count()
    build = _Build(copies.drop("_h1", "_h2", "_copy"), k, metric, numbers, width, None)
    per_group = ceil(cells / groups)
    return build.grouped(pivots, None, lambda rows: _trained_members(rows, per_group, iterations, seed, width))


def lloyd(x: np.ndarray, cells: int, iterations: int, seed: int) -> np.ndarray:
    """k-means centres of a bounded sample: far-apart rows first, then means; no empty cell."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centres = x[[rng.integers(len(x))]]
    nearest = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < min(cells, len(x)) and nearest.max() > 0:
        chosen = x[rng.choice(len(x), p=nearest / nearest.sum())]
        centres = np.vstack([centres, chosen])
        nearest = np.minimum(nearest, ((x - chosen) ** 2).sum(1))
    for _ in range(iterations):
        of = _nearest_pivot(x, centres)[0]
        n = np.bincount(of, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _by_hash() -> list:
    return [F.xxhash64("id", F.lit(17)), "id"]


def _pick_pivots(different: DataFrame, wanted: int, width: int) -> np.ndarray:
    """Up to ``wanted`` of the ``different`` vectors, by a hash of the id, in ``LEVEL_BYTES``."""
    rows = different.orderBy(*_by_hash()).limit(max(1, min(wanted, LEVEL_BYTES // (8 * width))))
    return stack(rows.select("vec").toPandas()["vec"])


def _hash_members(rows: DataFrame, per_group: int) -> DataFrame:
    """``(node, sub, pivot)``: some vectors of each node, by a hash of the id."""
    one = first_per_group(rows.select("*", *digest()), ["node", "_h1", "_h2"], ["id"], 1, "_copy")
    picked = first_per_group(one, ["node"], _by_hash(), per_group, "_rank")
    return picked.select("node", (F.col("_rank") - 1).alias("sub"), F.col("vec").cast("array<double>").alias("pivot"))


def _trained_members(rows: DataFrame, per_group: int, iterations: int, seed: int, width: int) -> DataFrame:
    """``(node, sub, pivot)``: k-means centres of a bounded sample of each node."""
    most = max(per_group, min(SAMPLE_ROWS * per_group, SAMPLE_BYTES // (8 * width)))
    sample = first_per_group(rows, ["node"], _by_hash(), most, "_rank").select("node", F.col("vec").cast("array<double>").alias("vec"))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        centres = lloyd(stack(pdf["vec"]), per_group, iterations, seed)
        return pd.DataFrame({"node": pdf["node"].iloc[0], "sub": np.arange(len(centres)), "pivot": list(centres)})

    return sample.groupBy("node").applyInPandas(train, "node int, sub int, pivot array<double>")


def _pivot_distances(q: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (q * q).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2.0 * (q @ pivots.T)
    return np.sqrt(np.maximum(squares, 0.0))


def _nearest_pivot(x: np.ndarray, pivots: np.ndarray, tail: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each row, by all but the last ``tail`` values, and the whole distance to it, piecewise."""
    at, offset = np.zeros(len(x), np.int32), np.zeros(len(x))
    step, head = max(1, MATRIX_VALUES // len(pivots)), pivots.shape[1] - tail
    for start in range(0, len(x), step):
        part = slice(start, start + step)
        d = _pivot_distances(x[part, :head], pivots[:, :head])
        at[part], offset[part] = d.argmin(1), d.min(1)
        if tail:
            offset[part] = np.sqrt(((x[part] - pivots[at[part]]) ** 2).sum(1))
    return at, offset


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def assign(rows: DataFrame, pivots: np.ndarray, name: str, tail: int = 0) -> DataFrame:
    """Adds the nearest of the pivots and the distance to it, ``offset``."""
    if not pivots.shape[1]:
        return rows.withColumns({name: F.lit(0), "offset": F.lit(float("inf"))})
    shared = rows.sparkSession.sparkContext.broadcast(pivots)  # one level, LEVEL_BYTES at most

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                pdf[name], pdf["offset"] = _nearest_pivot(stack(pdf["vec"]), shared.value, tail)
                yield pdf

    return rows.mapInPandas(nearest, f"id {_type(rows, 'id')}, vec {_type(rows, 'vec')}, {name} int, offset double")


def _meet(rows: DataFrame, cells: DataFrame, visits: dict[int, int], spread: str, work, schema: str) -> DataFrame:
    """Cogroup rows with the cells of their node; a node with many rows meets them in several groups."""
    counts = rows.sparkSession.createDataFrame([(int(k), ceil(n / GROUP_ROWS)) for k, n in visits.items()], "node int, _salts int")
    counts = F.broadcast(counts)  # one row per node of the first level
    left = rows.join(counts, "node").withColumn("_salt", F.pmod(F.xxhash64(spread), F.col("_salts"))).drop("_salts")
    right = cells.join(counts, "node").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_salts").cast("bigint") - 1))
    ).drop("_salts")
    return left.groupBy("node", "_salt").cogroup(right.groupBy("node", "_salt")).applyInPandas(work, schema)


def _statistics(rows: DataFrame, key: str, k: int) -> DataFrame:
    """``(key, n, radius, reach)`` from the offsets of stored rows."""
    nearest = first_per_group(rows.select(key, "offset"), [key], ["offset"], k)
    reach = nearest.groupBy(key).agg(F.array_sort(F.collect_list("offset")).alias("reach"))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("offset").alias("radius")).join(reach, key)


def _level(spark: SparkSession, pivots: np.ndarray, statistics: DataFrame, k: int) -> Level:
    counts, radius = np.zeros(len(pivots), int), np.zeros(len(pivots))
    reach = np.full((len(pivots), k), np.inf)
    for i, n, far, near in statistics.collect():  # one row per centre of one level
        counts[i], radius[i], reach[i, : len(near)] = n, far, near
    return Level(pivots, counts, reach, radius)


@dataclass(frozen=True)
class _Build:
    """The steps from different rows ``(id, vec)`` to stored blocks."""

    rows: DataFrame
    k: int
    metric: str
    size: int
    width: int
    block_rows: int | None
    tail: int = 0

    def flat(self, pivots: np.ndarray) -> CellIndex:
        spark = self.rows.sparkSession
        assigned = assign(self.rows, pivots, "cell", self.tail)
        if not pivots.shape[1]:
            level = Level(pivots, np.array([self.size]), np.full((1, self.k), np.inf), np.array([np.inf]))
            return self._index(assigned, [(0, self.size)], level, None)
        assigned = durable(assigned, "knn-cells")
        level = _level(spark, pivots, _statistics(assigned, "cell", self.k), self.k)
        return self._index(assigned, list(enumerate(level.counts.tolist())), level, None)

    def grouped(self, pivots: np.ndarray, members: list[np.ndarray] | None, choose) -> CellIndex:
        """Two levels: rows go to a group, then to one of its cells."""
        spark = self.rows.sparkSession
        near = durable(assign(self.rows, pivots, "node", self.tail), "knn-nodes")
        level = _level(spark, pivots, _statistics(near, "node", self.k), self.k)
        if members is None:
            chosen = choose(near)
        else:
            full = [own if len(own) else pivots[n : n + 1] for n, own in enumerate(members)]
            given = [(n, s, list(map(float, p))) for n, own in enumerate(full) for s, p in enumerate(own)]
            chosen = spark.createDataFrame(given, "node int, sub int, pivot array<double>")
        chosen = durable(chosen, "knn-centres")
        ordered = Window.orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        sizes = chosen.groupBy("node").agg(F.count(F.lit(1)).alias("subs"))  # one row per node
        starts = sizes.select("node", F.coalesce(F.sum("subs").over(ordered), F.lit(0)).alias("start"))
        centres = durable(
            chosen.join(F.broadcast(starts), "node").select("node", (F.col("start") + F.col("sub")).cast("int").alias("cell"), "pivot"),
            "knn-centres",
        )
        visits = {i: n for i, n in enumerate(level.counts.tolist()) if n}
        id_type, vec_type, tail = _type(self.rows, "id"), _type(self.rows, "vec"), self.tail

        def nearest(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values("cell")
            out = rows[["id", "vec"]].copy()
            if not len(rows) or not len(own):
                return out.iloc[:0].assign(cell=np.zeros(0, np.int32), offset=np.zeros(0))
            at, out["offset"] = _nearest_pivot(stack(rows["vec"]), stack(own["pivot"]), tail)
            out["cell"] = own["cell"].to_numpy()[at]
            return out[["id", "vec", "cell", "offset"]]

        assigned = durable(
            _meet(near.drop("offset"), centres, visits, "id", nearest, f"id {id_type}, vec {vec_type}, cell int, offset double"),
            "knn-cells",
        )
        numbers = _statistics(assigned, "cell", self.k)
        cells = durable(centres.join(numbers, "cell").select("node", "cell", "pivot", "n", "reach", "radius"), "knn-cell-table")
        return self._index(assigned, cells.select("cell", "n"), level, cells)

    def _index(self, assigned: DataFrame, counts, level: Level, cells: DataFrame | None) -> CellIndex:
        spark = assigned.sparkSession
        index = CellIndex(
            spark, (), spark.createDataFrame([], "cell int, block int, n int"), level, cells, self.metric, self.k,
            _type(assigned, "id"), "double" in _type(assigned, "vec"), self.width, self.tail,
        )
        return _with_blocks(index, assigned, counts, 0, self.size, self.width, self.block_rows)


def _with_blocks(
    index: CellIndex, assigned: DataFrame, counts, first: int, size: int, width: int, block_rows: int | None
) -> CellIndex:
    """Write ``assigned(id, vec, cell)`` as blocks numbered from ``first``; ``counts`` are rows per cell."""
    spark = index.spark
    if block_rows is None:
        block_rows = max(1, BLOCK_BYTES // (8 * width))
        # Few rows still keep all cores busy.
        block_rows = max(256, min(block_rows, ceil(size / (2 * spark.sparkContext.defaultParallelism))))
    if not isinstance(counts, DataFrame):
        counts = spark.createDataFrame(counts, "cell int, n bigint")
    cuts = counts.select("cell", F.greatest(F.ceil(F.col("n") / block_rows), F.lit(1)).cast("int").alias("cuts"))
    if index.cells is None:
        order = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # one row per cell of a level
        starts = cuts.withColumn("start", F.coalesce(F.sum("cuts").over(order), F.lit(0)).cast("int"))
    else:
        # Cells of a table: numbered by ranges, no task sees them all.
        starts = _running(cuts)
    starts = durable(starts.withColumn("start", F.col("start") + first), "knn-cuts")
    total = starts.agg(F.sum("cuts")).first()[0] or 0
    buckets = int(max(1, min(max(total, 1), max(2 * spark.sparkContext.defaultParallelism, ceil(size * width * 8 / BUCKET_BYTES)))))
    spread = F.xxhash64("id", "vec")
    if index.tail:
        assigned = assigned.withColumn("_head", head_digest("vec", index.tail))
        # At most eight per block; their rows are dealt one by one.
        hot = assigned.groupBy("_head").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block_rows / 8)
        assigned = assigned.join(F.broadcast(hot.select("_head", F.lit(True).alias("_hot"))), "_head", "left")
        spread = F.when(F.col("_hot"), spread).otherwise(F.col("_head"))
    placed = assigned.join(F.broadcast(starts) if index.cells is None else starts, "cell").select(
        "id", "vec", "cell", (F.col("start") + F.pmod(spread, F.col("cuts"))).cast("int").alias("block")
    )
    kind = np.dtype(index.kind)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        values = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
        ids = table["id"].combine_chunks()
        return pa.table({
            "block": table["block"][:1], "cell": table["cell"][:1],
            "ids": pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), ids),
            "vecs": pa.array([values.astype(kind).tobytes()], pa.binary()),
        })

    packed = placed.repartition(buckets, "block").groupBy("block").applyInArrow(pack, index.schema)
    path = scratch_path(spark, "knn-blocks")
    write_blocks(packed, path, buckets)
    part = Part(path, buckets)
    stored = spark.read.schema(index.schema).parquet(path)
    layout = durable(stored.select("cell", "block", F.size("ids").alias("n")), "knn-layout")
    layout = layout if not index.parts else index.layout.union(layout)
    return replace(index, parts=(*index.parts, part), layout=layout)


def _running(cuts: DataFrame) -> DataFrame:
    """Adds ``start``, the sum of ``cuts`` of smaller cells, by ranges of 4,096 cells."""
    ranged = cuts.withColumn("_range", F.floor(F.col("cell") / 4096))
    order = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_range").agg(F.sum("cuts").alias("_sum"))
    before = sums.select("_range", F.coalesce(F.sum("_sum").over(order), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(before), "_range").select(
        "cell", "cuts", (F.col("_before") + F.coalesce(F.sum("cuts").over(inside), F.lit(0))).cast("int").alias("start")
    )


def write_blocks(packed: DataFrame, path: str, buckets: int) -> None:
    """Bucketed files; the table's name is needed only while they are written."""
    name = f"oddline_{uuid4().hex}"
    packed.write.format("parquet").bucketBy(buckets, "block").sortBy("block").option("path", path).saveAsTable(name)
    packed.sparkSession.sql(f"DROP TABLE {name}")  # of a table with a path the files stay


def extend(index: CellIndex, corpus: DataFrame, id_col: str = "id", vec_col: str = "embedding") -> CellIndex:
    """The index with more rows; blocks written before are neither read nor moved.

    New rows go to the cells there are and form blocks of their own.  Counts, reach and
    radius of the cells they touch are renewed from the new rows and the old numbers.
    Ids must be new.  Of equal vectors among the new rows the ``copies`` smallest ids are kept.
    """
    k, spark = index.copies, index.spark
    vectors = corpus.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).filter(F.col("vec").isNotNull())
    kept = first_per_group(vectors.select("*", *digest()), ["_h1", "_h2"], ["id"], k, "_copy").drop("_h1", "_h2", "_copy")
    numbers = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    size, width = numbers["n"], numbers["d"] or 1
    if not size:
        return index
    last = index.layout.agg(F.max("block")).first()[0]
    first = 0 if last is None else last + 1
    if index.cells is not None:
        raise ValueError("an index of two levels is built anew")
    assigned = assign(kept, index.pivots, "cell", index.tail)
    old = index.level
    if not old.bounded:
        level = replace(old, counts=old.counts + size)
        return _with_blocks(replace(index, level=level), assigned, [(0, size)], first, size, width, None)
    assigned = durable(assigned, "knn-cells")
    new = _level(spark, index.pivots, _statistics(assigned, "cell", k), k)
    level = Level(
        old.pivots, old.counts + new.counts, np.sort(np.hstack([old.reach, new.reach]), axis=1)[:, :k],
        np.maximum(old.radius, new.radius),
    )
    counts = [(i, n) for i, n in enumerate(new.counts.tolist()) if n]
    return _with_blocks(replace(index, level=level), assigned, counts, first, size, width, None)


def replace_parts(index: CellIndex, parts: tuple[Part, ...]) -> CellIndex:
    """The same cells with only the blocks of ``parts``, to be searched without bounds."""
    blocks = index.spark.read.schema(index.schema).parquet(*[p.path for p in parts])
    layout = durable(blocks.select(F.lit(0).alias("cell"), "block", F.size("ids").alias("n")), "knn-layout")
    size = layout.agg(F.sum("n")).first()[0] or 0
    level = Level(np.zeros((1, 0)), np.array([size]), np.full((1, index.copies), np.inf), np.array([np.inf]))
    return replace(index, parts=parts, layout=layout, level=level, cells=None)


# --- routing ---------------------------------------------------------------------


def _slack(q: np.ndarray, pivots: np.ndarray) -> float:
    """More than the rounding error of a distance to a pivot."""
    scale = float((q * q).sum(1).max(initial=0.0) + (pivots * pivots).sum(1).max())
    return 1e-6 * np.sqrt(scale) + 1e-9


def cells_to_visit(
    q: np.ndarray, level: Level, k: int, metric: str, probes: int | None, within: float | np.ndarray | None = None
) -> list[np.ndarray]:
    """Positions of the cells each query has to visit: the ``probes`` nearest, those that can
    hold a row at most ``within`` away (of all queries, or of each), or all that bounds for ``k`` rows leave."""
    pivots, full, reach, radius = level.pivots, level.counts > 0, level.reach[:, :k], level.radius
    d = _pivot_distances(q, pivots)
    d[:, ~full] = np.inf
    if probes is not None:  # nearest cells by L2, also for the inner product
        wanted = min(probes, int(full.sum()))
        return list(np.argsort(d, axis=1, kind="stable")[:, :wanted].astype(np.int32))
    slack = _slack(q, pivots)
    if within is not None:
        return [np.flatnonzero(row).astype(np.int32) for row in (d - radius[None, :] <= np.reshape(within, (-1, 1)) + slack) & full[None, :]]
    if metric == "inner_product":
        # Cost = minus the product; it changes by at most |q| per unit of distance.
        base = -(q @ pivots.T)
        base[:, ~full] = np.inf
        step = np.sqrt((q * q).sum(1))[:, None]
    else:
        base, step = d, np.ones((len(q), 1))
    worst = (base[:, :, None] + step[:, :, None] * reach[None, :, :]).reshape(len(q), -1)
    bound = np.partition(worst, reach.shape[1] - 1, axis=1)[:, reach.shape[1] - 1 :][:, :1]
    best = base - step * radius[None, :]
    visited = (best <= bound + slack * (1.0 + step)) & full[None, :]
    return [np.flatnonzero(row).astype(np.int32) for row in visited]


def route(queries: DataFrame, index: CellIndex, k: int, probes: int | None, within: float | None = None) -> DataFrame:
    """Adds ``blocks`` to ``queries(vec_key, vec, ...)``: the blocks each query has to be compared with."""
    if index.cells is not None:
        return _route_grouped(queries, index, k, probes, within)
    of_cell = index.blocks_of_cells()
    if not index.level.bounded:
        every = of_cell.get(0, np.zeros(0, np.int32)).tolist()
        return queries.withColumn("blocks", F.array(*[F.lit(b) for b in every]).cast("array<int>"))
    return _visiting(queries, index, k, probes, within, of_cell, "blocks")


def _visiting(
    queries: DataFrame, index: CellIndex, k: int, probes: int | None, within: float | None, of_cell, name: str
) -> DataFrame:
    """Adds what the first level leaves: blocks of cells by ``of_cell``, or nodes."""
    shared = queries.sparkSession.sparkContext.broadcast((index.level, of_cell, index.metric))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        level, table, metric = shared.value
        step = max(1, MATRIX_VALUES // max(level.reach.size, 1))
        for pdf in batches:
            found: list[np.ndarray] = []
            for start in range(0, len(pdf), step):
                q = stack(pdf["vec"].iloc[start : start + step])
                found += cells_to_visit(q, level, k, metric, probes, within)
            if table is not None:
                found = [np.concatenate([table[int(c)] for c in own if int(c) in table] or [np.zeros(0, np.int32)]) for own in found]
            if len(pdf):
                yield pdf.assign(**{name: found})

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInPandas(visit, f"{types}, {name} array<int>")


def _route_grouped(
    queries: DataFrame, index: CellIndex, k: int, probes: int | None, within: float | None
) -> DataFrame:
    """Level by level: queries go to groups, and there to cells.

    Exact: what a group's own cells bound is at least what all rows bound, so nothing
    near is missed.  Probing: the ``probes`` nearest groups, of their cells the
    ``probes`` nearest.
    """
    to_nodes = durable(_visiting(queries.select("vec_key", "vec"), index, k, probes, within, None, "nodes"), "knn-to-nodes")
    asked = to_nodes.select(F.explode("nodes").alias("node"), "vec_key", "vec")
    visits = {r["node"]: r["count"] for r in asked.groupBy("node").count().collect()}  # one row per node
    metric, key_type = index.metric, _type(queries, "vec_key")

    def choose(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(own):
            return pd.DataFrame({"vec_key": rows["vec_key"].iloc[:0], "cell": np.zeros(0, np.int32), "away": np.zeros(0)})
        own = own.sort_values("cell")
        pad = max(k, *(len(r) for r in own["reach"]))
        reach = np.array([np.r_[r, np.full(pad - len(r), np.inf)] for r in own["reach"]])
        level = Level(stack(own["pivot"]), own["n"].to_numpy(), reach, own["radius"].to_numpy())
        cells, parts = own["cell"].to_numpy(), []
        step = max(1, MATRIX_VALUES // level.reach.size)
        for start in range(0, len(rows), step):
            part = rows.iloc[start : start + step]
            q = stack(part["vec"])
            found = cells_to_visit(q, level, k, metric, probes, within)
            at, of = np.repeat(np.arange(len(q)), [len(f) for f in found]), np.concatenate(found)
            away = _pivot_distances(q, level.pivots)[at, of]
            parts.append(pd.DataFrame({"vec_key": part["vec_key"].to_numpy()[at], "cell": cells[of], "away": away}))
        return pd.concat(parts, ignore_index=True)

    near = _meet(asked, index.cells, visits, "vec_key", choose, f"vec_key {key_type}, cell int, away double")
    if probes is not None:
        near = first_per_group(near, ["vec_key"], ["away", "cell"], probes, "_rank").drop("_rank")
    blocks = near.join(index.layout.select("cell", "block"), "cell").groupBy("vec_key").agg(
        F.array_sort(F.collect_list("block")).alias("blocks")
    )
    return queries.join(blocks, "vec_key")


# --- stored ----------------------------------------------------------------------


LEVEL_SCHEMA = "cell int, pivot array<double>, n long, reach array<double>, radius double"


def save_index(index: CellIndex, path: str) -> None:
    """Blocks as they are, their layout, and one row of numbers per cell of the first level."""
    spark = index.spark
    for i, part in enumerate(index.parts):
        write_blocks(
            spark.read.schema(index.schema).parquet(part.path).repartition(part.buckets, "block"),
            f"{path}/blocks/part={i}", part.buckets,
        )
    index.layout.write.parquet(f"{path}/layout")
    level = index.level
    rows = [
        (i, p.tolist(), int(n), r.tolist(), float(far))
        for i, (p, n, r, far) in enumerate(zip(level.pivots, level.counts, level.reach, level.radius))
    ]
    spark.createDataFrame(rows, LEVEL_SCHEMA).coalesce(1).write.parquet(f"{path}/level")
    if index.cells is not None:
        index.cells.write.parquet(f"{path}/cells")
    facts = [(
        index.metric, index.copies, index.id_type, index.double, index.width, index.cells is not None,
        [p.buckets for p in index.parts], index.tail,
    )]
    spark.createDataFrame(facts, FACTS_SCHEMA).coalesce(1).write.parquet(f"{path}/facts")


FACTS_SCHEMA = "metric string, copies int, id_type string, double boolean, width int, grouped boolean, buckets array<int>, tail int"
CELL_SCHEMA = "node int, cell int, pivot array<double>, n bigint, reach array<double>, radius double"


def load_index(spark: SparkSession, path: str) -> CellIndex:
    """A stored index; no row is assigned anew."""
    facts = spark.read.schema(FACTS_SCHEMA).parquet(f"{path}/facts").first()
    rows = spark.read.schema(LEVEL_SCHEMA).parquet(f"{path}/level").orderBy("cell").collect()
    level = Level(*(np.array([r[c] for r in rows]) for c in ("pivot", "n", "reach", "radius")))
    return CellIndex(
        spark,
        tuple(Part(f"{path}/blocks/part={i}", b) for i, b in enumerate(facts["buckets"])),
        spark.read.schema("cell int, block int, n int").parquet(f"{path}/layout"),
        level,
        spark.read.schema(CELL_SCHEMA).parquet(f"{path}/cells") if facts["grouped"] else None,
        facts["metric"], facts["copies"], facts["id_type"], facts["double"], facts["width"], facts["tail"] or 0,
    )


def as_euclidean(index: CellIndex) -> CellIndex:
    return replace(index, metric="euclidean")
