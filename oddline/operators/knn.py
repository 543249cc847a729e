"""k-nearest-neighbour joins over a stored corpus, exact and cell-pruned.

The corpus lies in packed blocks (:mod:`oddline.operators.cells`).  A query visits a
cell only if the cell can hold one of its k nearest rows (exact), or if the cell is
among the nearest ones (approximate).  The blocks are read where they are stored:
queries whose vectors fit ``SENT_BYTES`` are sent to the tasks that read blocks; a
corpus that fits is sent to the tasks that read queries; else queries are shuffled to
the blocks' buckets.  In no case is a vector of the corpus or a pair of rows shuffled,
and each block gives only the k best per query.

Equal vectors are handled before any distance is computed: on the query side
they are searched once, on the corpus side only the first k ids of a group of
copies can be among the k nearest, because ties are ordered by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from oddline import fixed_values as fv
from oddline.operators.cells import (  # noqa: F401  (the index is a part of the search's interface)
    BLOCK_BYTES, MATRIX_VALUES, METRICS, CellIndex, as_euclidean, assign, build_index, cells_to_visit, digest, extend,
    head_digest, kmeans_index, load_index, replace_parts, route, save_index, stack, unpacked,
)
from oddline.operators.heads import (
    KERNEL_VALUES, TIE_DECIMALS, HeldHeads, heads_of, nearest_by_head, nearest_in_block as _nearest_in_block,
)
from oddline.operators.skew import first_per_group, salted_lookup
from oddline.session import durable

SENT_BYTES = 64 * 2**20  # vectors and block lists of the queries that tasks hold whole
HELD_ROWS = 8_192  # of those, queries that a task compares with a block at once
WAVES = 16  # tasks that the queries of one block are spread over at most


@dataclass(frozen=True)
class Neighbors:
    """Neighbours per distinct query vector, and who has that vector."""

    rows: DataFrame  # (vec_key, rank, neighbor_id, distance)
    members: DataFrame  # (query_id, vec_key)
    groups: DataFrame  # (vec_key, n)
    unique: bool

    def expand(self, per_vector: DataFrame) -> DataFrame:
        """Give every query the columns computed for its vector."""
        if self.unique:
            return per_vector.withColumnRenamed("vec_key", "query_id")
        return salted_lookup(self.members, per_vector, ["vec_key"], "inner", ["query_id"]).drop(
            "vec_key"
        )

    def long(self) -> DataFrame:
        """(query_id, rank, neighbor_id, distance)."""
        if self.unique:
            return self.rows.withColumnRenamed("vec_key", "query_id")
        packed = self.rows.groupBy("vec_key").agg(
            F.collect_list(F.struct("rank", "neighbor_id", "distance")).alias("nn")
        )
        return self.expand(packed).select("query_id", F.inline("nn"))


# --- one block ---------------------------------------------------------------------


class _Best:
    """The k best rows of each of ``n`` queries over the blocks seen so far."""

    def __init__(self, n: int, k: int, metric: str):
        self.k, self.metric, self.rows = k, metric, None
        self.worst = np.full(n, -np.inf if metric == "inner_product" else np.inf)

    def add(self, at: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray) -> None:
        found = _nearest_in_block(at, q, ids, c, self.k, self.metric, self.worst[at])
        self.rows = _best(found if self.rows is None else pd.concat([self.rows, found], ignore_index=True), self.k, self.metric)
        key, distance = self.rows["vec_key"].to_numpy(), self.rows["distance"].to_numpy()
        ends = np.flatnonzero(np.r_[key[1:] != key[:-1], True]) if len(key) else np.zeros(0, int)
        full = ends[np.diff(np.r_[-1, ends]) == self.k]
        self.worst[key[full]] = distance[full]


# --- search ------------------------------------------------------------------------


def knn(
    queries: DataFrame,
    index: CellIndex,
    k: int = fv.K_NEIGHBORS,
    id_col: str = "query_id",
    vec_col: str = "embedding",
    probes: int | None = None,
    sent_bytes: int = SENT_BYTES,
    block_queries: int | None = None,
) -> Neighbors:
    """The ``k`` nearest corpus rows of every query.

    Query ids must be unique; ``queries`` should be a stored table, as queries
    with equal vectors are looked up in it again.  Exact unless ``probes`` limits the
    search to that many nearest cells.  A corpus of fewer than ``k`` rows gives what it
    has; ``k=0`` means the default.  ``sent_bytes`` and ``block_queries`` (queries that meet
    a block at once) change the way, not the result.
    """
    k = k or fv.K_NEIGHBORS
    if k > index.copies:
        raise ValueError(f"the index was built for k <= {index.copies}")
    queries = queries.select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("vec")).filter(
        F.col("vec").isNotNull()
    )
    grouped = queries.groupBy(*digest()).agg(
        F.min("query_id").alias("vec_key"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("n")
    )
    corpus_fits = index.size * 8 * index.width <= sent_bytes
    by_heads = index.tail > 0 and index.cells is None and index.level.bounded and probes is None
    by_heads = by_heads and not corpus_fits and index.metric != "inner_product"
    if by_heads:
        routed = durable(grouped, "knn-grouped")
        size = _sizes(routed, F.lit(0))
        by_heads = (size["bytes"] or 0) > sent_bytes
    if not by_heads:
        routed = durable(route(grouped, index, k, probes), "knn-routed")
        size = _sizes(routed, F.size("blocks"))
    unique = (size["most"] or 0) <= 1
    members = None
    if not unique:
        # Looked up by a 128-bit digest: the vectors themselves stay where they are.
        members = salted_lookup(
            queries.select("query_id", *digest()), routed.select("vec_key", "_h1", "_h2"),
            ["_h1", "_h2"], "inner", ["query_id"],
        ).drop("_h1", "_h2")
    if (size["bytes"] or 0) <= sent_bytes:
        found = _sent(routed, index, k)
    elif corpus_fits:
        found = _corpus_sent(routed, index, k)
    elif by_heads:
        found = _search_by_heads(routed, index, k, block_queries or max(1, BLOCK_BYTES // (8 * size["width"])))
    else:
        metric = index.metric
        found = search_blocks(
            routed, index, lambda keys, q, ids, c: [_nearest_in_block(keys, q, ids, c, k, metric)],
            block_queries or max(1, BLOCK_BYTES // (8 * size["width"])),
        )
    sign = -1 if index.metric == "inner_product" else 1
    ranked = first_per_group(
        found,
        ["vec_key"],
        [F.round(F.col("distance") * sign, TIE_DECIMALS), "neighbor_id"],
        k,
    )
    # Stored, so that whatever reads the neighbours twice searches once.
    rows = durable(ranked.select("vec_key", "rank", "neighbor_id", "distance"), "neighbors")
    return Neighbors(rows, members, routed.select("vec_key", "n"), unique)


def _sizes(routed: DataFrame, blocks):
    return routed.agg(
        F.count(F.lit(1)).alias("rows"), F.max("n").alias("most"), F.max(F.size("vec")).alias("width"),
        F.sum(8 * F.size("vec") + 4 * blocks).alias("bytes"),
    ).first()


def _found_schema(routed: DataFrame, index: CellIndex) -> str:
    return f"vec_key {routed.schema['vec_key'].dataType.simpleString()}, neighbor_id {index.id_type}, distance double"


def _sent(routed: DataFrame, index: CellIndex, k: int) -> DataFrame:
    """Search where every task that reads blocks holds the queries, ``SENT_BYTES`` at most."""
    held = routed.select("vec_key", "vec", "blocks").toPandas()
    lists = [np.asarray(b, np.int32) for b in held["blocks"]]
    block = np.concatenate(lists) if lists else np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(lists), dtype=np.int32), [len(b) for b in lists])
    order = np.argsort(block, kind="stable")
    block, row = block[order], row[order]
    named, starts = np.unique(block, return_index=True)
    asked = dict(zip(named.tolist(), np.split(row, starts[1:]))) if len(named) else {}
    vectors = np.stack(held["vec"].to_numpy()) if len(held) else np.zeros((0, 1))
    shared = index.spark.sparkContext.broadcast((held["vec_key"].to_numpy(), vectors, asked))
    metric, kind = index.metric, index.kind

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, q, wanted = shared.value
        starts = range(0, len(q), HELD_ROWS)
        pieces = [_Best(min(HELD_ROWS, len(q) - start), k, metric) for start in starts]
        for batch in batches:
            for number, ids, c in unpacked(batch, kind):
                rows = wanted.get(number)
                if rows is None:
                    continue
                for start, best, own in zip(starts, pieces, np.split(rows, np.searchsorted(rows, starts[1:]))):
                    if len(own):
                        best.add(own - start, q[own].astype(np.float64), ids, c)
        for start, best in zip(starts, pieces):
            if best.rows is not None:
                found = best.rows.assign(vec_key=keys[start + best.rows["vec_key"].to_numpy()])
                yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    blocks = index.blocks.select("block", "ids", "vecs")
    if len(named) <= 1000:  # else nearly every file has one that is asked for
        blocks = blocks.filter(F.col("block").isin(named.tolist()))
    return blocks.mapInArrow(search, _found_schema(routed, index))


def _best(found: pd.DataFrame, k: int, metric: str) -> pd.DataFrame:
    """The ``k`` best rows of each query; ties go by id."""
    at = found["vec_key"].to_numpy()
    cost = np.round(found["distance"].to_numpy() * (-1 if metric == "inner_product" else 1), TIE_DECIMALS)
    ids = found["neighbor_id"].to_numpy()
    by_id = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[by_id] = np.arange(len(ids))
    order = np.lexsort((rank, cost, at))
    sorted_at = at[order]
    first = np.searchsorted(sorted_at, sorted_at)
    return found.iloc[order[np.arange(len(order)) - first < k]].reset_index(drop=True)


def _corpus_sent(routed: DataFrame, index: CellIndex, k: int) -> DataFrame:
    """Search where the tasks that read queries hold the corpus, ``SENT_BYTES`` at most."""
    metric, shared = index.metric, index.sent()

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            keys, q, best = pdf["vec_key"].to_numpy(), stack(pdf["vec"]), _Best(len(pdf), k, metric)
            at = np.repeat(np.arange(len(pdf)), [len(b) for b in pdf["blocks"]])
            asked = np.concatenate(pdf["blocks"].to_list())
            for number, ids, c in shared.value:
                rows = at[asked == number]
                if len(rows):
                    best.add(rows, q[rows], ids, c)
            if best.rows is not None:
                yield best.rows.assign(vec_key=keys[best.rows["vec_key"].to_numpy()])

    return routed.select("vec_key", "vec", "blocks").mapInPandas(search, _found_schema(routed, index))


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def fits(index: CellIndex, sent_bytes: int = SENT_BYTES) -> bool:
    """Whether a task can hold the whole corpus, by its size in double precision, and its cells."""
    return index.cells is None and index.size * 8 * index.width <= sent_bytes


def neighbor_columns(
    rows: DataFrame, index: CellIndex, k: int, vec_col: str = "embedding", probes: int | None = None
) -> DataFrame:
    """Adds ``nearest_neighbors`` and ``distances`` to ``rows`` without moving a row; null for no vector.

    For a corpus that :func:`fits`; every task holds it.  The plan has no exchange and no
    stored step, so it also runs on a stream.  Equal vectors of a batch are searched once.
    """
    if k > index.copies:
        raise ValueError(f"the index was built for k <= {index.copies}")
    if not fits(index):
        raise ValueError("the corpus is too large to be sent: use knn")
    metric, level, shared = index.metric, index.level, index.sent()
    table = index.blocks_of_cells() if level.bounded else None

    id_type = to_arrow_type(DataType.fromDDL(index.id_type))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(vec_col))
            has = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            ids, away = np.full(len(column), None, object), np.full(len(column), None, object)
            if len(has):
                values = column.take(pa.array(has)).flatten().to_numpy(zero_copy_only=False).reshape(len(has), -1)
                q, inverse = np.unique(values.astype(np.float64), axis=0, return_inverse=True)
                names, distances = _search_all(q, shared.value, level, table, k, metric, probes)
                ids[has], away[has] = names[inverse.ravel()], distances[inverse.ravel()]
            added = [pa.array(ids.tolist(), pa.list_(id_type)), pa.array(away.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *added], [*batch.schema.names, "nearest_neighbors", "distances"]
            )

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(search, f"{types}, nearest_neighbors array<{index.id_type}>, distances array<double>")


def _search_all(q: np.ndarray, blocks, level, table, k: int, metric: str, probes: int | None):
    """Ids and distances of the ``k`` best rows of every query, as arrays of arrays."""
    asked = None
    if table is not None:
        step = max(1, MATRIX_VALUES // max(level.reach.size, 1))
        visits = [c for start in range(0, len(q), step) for c in cells_to_visit(q[start : start + step], level, k, metric, probes)]
        pairs = [(b, i) for i, own in enumerate(visits) for c in own for b in table.get(int(c), ())]
        asked = {}
        for b, i in pairs:
            asked.setdefault(b, []).append(i)
    nearest = _Best(len(q), k, metric)
    for number, ids, c in blocks:
        rows = np.arange(len(q)) if asked is None else np.array(asked.get(number, []), int)
        if len(rows):
            nearest.add(rows, q[rows], ids, c)
    best = nearest.rows
    names, distances = np.empty(len(q), object), np.empty(len(q), object)
    at = np.zeros(0, int) if best is None else best["vec_key"].to_numpy()
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange(1, len(q)))
    ids = np.zeros(0, object) if best is None else best["neighbor_id"].to_numpy()
    away = np.zeros(0) if best is None else best["distance"].to_numpy()
    for i, (n, d) in enumerate(zip(np.split(ids[order], cuts), np.split(away[order], cuts))):
        names[i], distances[i] = n, d
    return names, distances


def search_blocks(routed: DataFrame, index: CellIndex, kernel, block_queries: int) -> DataFrame:
    """Compare queries with their blocks; they are shuffled to the blocks' buckets, and blocks stay where they are.

    ``kernel(keys, vectors, ids, block_vectors)`` gives pieces of rows ``vec_key, neighbor_id, distance``,
    which are kept in Arrow's form only.

    The queries of a block are cut into groups of ``block_queries``; the groups of a
    block asked by very many run in up to ``WAVES`` tasks, each reading it once.
    """
    asked = routed.select(F.explode("blocks").alias("block"), "vec_key", "vec")

    def search(q: pa.Table, ids: np.ndarray, vectors: np.ndarray) -> list[pd.DataFrame]:
        return kernel(q["vec_key"].to_numpy(), _matrix(q["vec"], len(q)), ids, vectors)

    return _meet_blocks(
        asked, F.lit(1), "vec_key", index, search, lambda q: q["vec_key"][:0], _found_schema(routed, index), block_queries
    )


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).astype(np.float64)


def _meet_blocks(
    asked: DataFrame, weight, spread: str, index: CellIndex, work, no_keys, schema: str, block_queries: int
) -> DataFrame:
    """``work`` on the rows of ``asked(block, ...)``, each worth ``weight`` queries, and the block they ask for."""
    spark, kind = index.spark, index.kind
    counted = durable(
        asked.groupBy("block").agg(F.ceil(F.sum(weight) / block_queries).cast("int").alias("_groups")), "knn-asked"
    )  # one row per block
    most = counted.agg(F.max("_groups")).first()[0] or 1
    waves = min(WAVES, most)
    cut = asked.join(counted, "block").withColumn("_group", F.pmod(F.xxhash64(spread), F.col("_groups"))).drop("_groups")

    def search(q: pa.Table, c: pa.Table) -> pa.Table:
        none = pa.table({"vec_key": no_keys(q), "neighbor_id": c["ids"].combine_chunks().flatten()[:0], "distance": pa.array([], pa.float64())})
        if not len(q) or not len(c):
            return none
        _, ids, vectors = next(unpacked(c.combine_chunks().to_batches()[0], kind))
        pieces = work(q, ids, vectors)
        return pa.concat_tables([none, *(pa.Table.from_pandas(p, none.schema, preserve_index=False) for p in pieces)])

    names, results = [], []
    for part in index.parts:
        names.append(f"oddline_{uuid4().hex}")
        spark.sql(
            f"CREATE TABLE {names[-1]} ({index.schema}) USING parquet CLUSTERED BY (block) SORTED BY (block) "
            f"INTO {part.buckets} BUCKETS LOCATION '{part.path}'"
        )
        stored = spark.read.table(names[-1]).select("block", "ids", "vecs")
        for wave in range(waves):
            left = cut.filter(F.pmod("_group", F.lit(waves)) == wave)
            # A block is repeated for the groups of this wave by the task that reads it.
            groups = F.sequence(F.lit(wave), F.col("_groups") - 1, F.lit(waves))
            right = stored.join(counted.filter(F.col("_groups") > wave), "block").select(
                "block", "ids", "vecs", F.explode(groups.cast("array<bigint>")).alias("_group")
            )
            results.append(left.groupBy("block", "_group").cogroup(right.groupBy("block", "_group")).applyInArrow(search, schema))
    try:
        # Both sides lie by block, whatever the group: no exchange of the blocks.
        with _setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
            return durable(reduce(DataFrame.union, results), "knn-found")
    finally:
        for name in names:
            spark.sql(f"DROP TABLE {name}")  # the files stay


# --- search by heads ---------------------------------------------------------------


def _search_by_heads(routed: DataFrame, index: CellIndex, k: int, block_queries: int) -> DataFrame:
    """Search of an index whose rows share all but ``index.tail`` values, in two rounds.

    First every query meets one block, then the others that can hold a row nearer than the k-th found
    there.  Queries of one head travel, and meet the heads of a block, as one.  Where tasks can hold the
    heads of all blocks, queries ask the block of the nearest head, then those of heads the k-th distance
    leaves; else a block of the cell of their head, then those of the cells it leaves.
    """
    metric, tail = index.metric, index.tail
    held = _held_heads(index, k)
    if held is not None:
        placed = durable(_placed(routed, index, held), "knn-placed")
    else:
        keyed = routed.select(F.col("vec_key").alias("id"), "vec")
        placed = durable(
            assign(keyed, index.pivots, "cell", tail).select(
                F.col("id").alias("vec_key"), "vec", "cell", head_digest("vec", tail).alias("head")
            ),
            "knn-placed",
        )
    of_cell = index.blocks_of_cells()
    key_type, schema = routed.schema["vec_key"].dataType.simpleString(), _found_schema(routed, index)

    def search(q: pa.Table, ids: np.ndarray, vectors: np.ndarray) -> list[pd.DataFrame]:
        n = q["keys"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        flat = {c: q[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("keys", "tails", "worst")}
        asking = np.hstack([np.repeat(_matrix(q["head"], len(q)), n, axis=0), flat["tails"].reshape(-1, tail)])
        return [nearest_by_head(flat["keys"], asking, ids, vectors, k, metric, tail, flat["worst"])]

    def meet(queries: DataFrame, first: bool) -> DataFrame:
        units = durable(_units(queries, index, of_cell, held, key_type, first), "knn-units")
        no_keys = lambda q: q["keys"].combine_chunks().flatten()[:0]
        return _meet_blocks(units, F.size("keys"), "keys", index, search, no_keys, schema, block_queries)

    near = meet(placed.withColumn("worst", F.lit(float("inf"))), True)
    ranked = first_per_group(near, ["vec_key"], [F.round("distance", TIE_DECIMALS), "neighbor_id"], k)
    worst = ranked.groupBy("vec_key").agg(F.when(F.count(F.lit(1)) == k, F.max("distance")).alias("worst"))
    bounded = placed.join(worst, "vec_key", "left").withColumn("worst", F.coalesce("worst", F.lit(float("inf"))))
    return near.union(meet(bounded, False))


def _held_heads(index: CellIndex, k: int, sent_bytes: int = SENT_BYTES):
    """The heads of all blocks as a broadcast; None where they exceed ``sent_bytes``."""
    tail, kind = index.tail, index.kind

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(heads_of(c, tail)[0]) for _, _, c in unpacked(batch, kind)], pa.int64())})

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, _, c in unpacked(batch, kind):
                heads, of = heads_of(c, tail)
                order = np.argsort(of, kind="stable")
                starts = np.searchsorted(of[order], np.arange(len(heads)))
                tails = c[order, c.shape[1] - tail :]
                spans = [f.reduceat(tails, starts, axis=0).ravel().tobytes() for f in (np.minimum, np.maximum)]
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([block], pa.int32()), "rows": pa.array([len(c)], pa.int32()),
                    "heads": pa.array([heads.tobytes()], pa.binary()),
                    "low": pa.array([spans[0]], pa.binary()), "high": pa.array([spans[1]], pa.binary()),
                })

    blocks = index.blocks.select("block", "ids", "vecs")
    many = blocks.mapInArrow(count, "n bigint").agg(F.sum("n")).first()[0] or 0
    if not many or many * 8 * index.width > sent_bytes:
        return None
    found = blocks.mapInArrow(describe, "block int, rows int, heads binary, low binary, high binary").toArrow()
    width = {"heads": index.width - tail, "low": tail, "high": tail}
    parts = {c: [np.frombuffer(b, np.float64).reshape(-1, w) for b in found[c].to_pylist()] for c, w in width.items()}
    sizes = [len(h) for h in parts["low"]]
    block, rows = (np.repeat(found[c].to_numpy(), sizes) for c in ("block", "rows"))
    held = HeldHeads.of(*(np.concatenate(parts[c]) for c in ("heads", "low", "high")), block, rows < k)
    return index.spark.sparkContext.broadcast(held)


def _by_head(queries: DataFrame, index: CellIndex) -> DataFrame:
    """Rows of one head together; by ranges, so that a head with very many queries is dealt to several tasks."""
    tasks = max(2 * index.spark.sparkContext.defaultParallelism, index.size * 8 * index.width // BLOCK_BYTES)
    return queries.repartitionByRange(tasks, "head", "vec_key").sortWithinPartitions("head")


def _placed(routed: DataFrame, index: CellIndex, held) -> DataFrame:
    """``(vec_key, vec, head, block)``: the block each query meets first."""
    tail = index.tail
    keyed = routed.select("vec_key", "vec", head_digest("vec", tail).alias("head"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1).astype(np.float64)
                block = pa.array(held.value.nearest(x, tail), pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, block], [*batch.schema.names, "first"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema)
    return _by_head(keyed, index).mapInArrow(place, f"{types}, first int")


def _units(queries: DataFrame, index: CellIndex, of_cell: dict[int, np.ndarray], held, key_type: str, first: bool) -> DataFrame:
    """``(block, head, keys, tails, worst)`` of ``queries(vec_key, vec, cell, head, worst)``: what queries of one head ask of a block.

    ``first``: the block of the query's own cell where its head is or would be, else the others that ``worst`` leaves.
    With ``held`` heads ``queries`` have the block they meet first in place of the cell.
    """
    tail = index.tail
    # Those placed by held heads are stored by head.
    ordered = queries if first and held is not None else _by_head(queries, index)
    shared = index.spark.sparkContext.broadcast((index.level, of_cell, index.metric))
    step = max(256, MATRIX_VALUES // (4 * sum(map(len, of_cell.values()))))

    def lists(offsets: np.ndarray, values) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, table, metric = shared.value
        none = np.zeros(0, np.int32)
        for start, batch in ((s, b) for b in batches for s in range(0, b.num_rows, step)):
            part = batch.slice(start, step)
            x = part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1).astype(np.float64)
            worst, of = part.column("worst").to_numpy(zero_copy_only=False), heads_of(x, tail)[1]
            if held is not None:
                own = part.column("first").to_numpy(zero_copy_only=False)
                at, block = np.arange(len(x)), own
                if not first:
                    at, block = held.value.within(x, tail, worst, metric)
                    at, block = at[block != own[at]], block[block != own[at]]
            else:
                cell, digests = (part.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "head"))
                mine = [table.get(int(c), none) for c in cell]
                blocks = [b[d % len(b) :][:1] if len(b) else b for b, d in zip(mine, digests)]
                if not first:
                    cells = cells_to_visit(x, level, 1, metric, None, worst if metric == "euclidean" else np.sqrt(worst))
                    every = [np.concatenate([table.get(int(c), none) for c in some] or [none]) for some in cells]
                    blocks = [np.setdiff1d(b, done) for b, done in zip(every, blocks)]
                at, block = np.repeat(np.arange(len(x)), [len(b) for b in blocks]), np.concatenate(blocks)
            if not len(at):
                continue
            order = np.lexsort((at, block, of[at]))
            at, block = at[order], block[order]
            new = np.r_[True, (np.diff(of[at]) != 0) | (np.diff(block) != 0)]
            starts = np.flatnonzero(new)
            ends = np.r_[starts, len(at)]
            head = x[at[starts], : x.shape[1] - tail]
            columns = {
                "block": pa.array(block[starts], pa.int32()),
                "head": lists(np.arange(len(starts) + 1) * head.shape[1], pa.array(head.ravel())),
                "keys": lists(ends, part.column("vec_key").take(pa.array(at))),
                "tails": lists(ends * tail, pa.array(x[at, x.shape[1] - tail :].ravel())),
                "worst": lists(ends, pa.array(worst[at])),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return ordered.mapInArrow(
        pack, f"block int, head array<double>, keys array<{key_type}>, tails array<double>, worst array<double>"
    )
