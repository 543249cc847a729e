"""Best-fit packing with certified bin counts.

Partitions pack their documents by best-fit decreasing.  Dual-feasible functions
give a lower bound for each; partitions above their bound exchange the documents
of bins that are not full and pack again.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from oddline.llm.bpe import default_vocabulary, vocabulary
from oddline.llm.common import columns, slices, text_bytes
from oddline.session import durable

CAPACITY = 2048
END = 0
BATCH_BYTES = 4 << 20
GROUP_ITEMS = 1 << 16  # documents packed in one task
FAN_IN = 8  # open groups that exchange documents


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins; ``counts[s]`` items have size ``s``.

    The largest value of three families: the plain sum, Martello and Toth's
    thresholds, and the rounding functions u(k), all in whole numbers.
    """
    size = np.flatnonzero(counts)
    n = counts[size].astype(object)  # exact
    if not len(size):
        return 0
    best = -(-int((size * n).sum()) // capacity)
    whole, number = np.zeros(capacity + 2, dtype=np.int64), np.zeros(capacity + 2, dtype=np.int64)
    for s, k in zip(size.tolist(), n.tolist()):
        whole[s + 1] += s * k
        number[s + 1] += k
    whole, number = np.cumsum(whole), np.cumsum(number)  # of sizes below the index
    for e in range(1, capacity // 2 + 1):
        large = int(number[capacity + 1] - number[capacity - e + 1])
        middle = int(whole[capacity - e + 1] - whole[e])
        best = max(best, large + -(-middle // capacity))
    for k in range(1, 65):
        even = (k + 1) * size % capacity == 0
        exact = int((size[even] * n[even]).sum())
        rounded = int(((k + 1) * size[~even] // capacity * n[~even]).sum())
        best = max(best, -(-(exact * k + rounded * capacity) // (capacity * k)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every item, and the fill of every bin."""
    order = np.argsort(-sizes, kind="stable")
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, fill = 0, []  # a bit per room that some bin has left
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    for i in order.tolist():
        s = int(sizes[i])
        fitting = open_rooms >> s
        if fitting:
            left = s + (fitting & -fitting).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                open_rooms &= ~(1 << left)
        else:
            b, left = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += s
        if left > s:
            room[left - s].append(b)
            open_rooms |= 1 << (left - s)
    return bins, offsets, np.array(fill, dtype=np.int64)


def _pieces(path: str, capacity: int, keep_ids: bool):
    def run(batches):
        bpe = vocabulary(path)
        for batch in slices(batches, BATCH_BYTES):
            rows = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
            for doc, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text"))):
                ids = np.array([*bpe.encode(text.decode("utf-8")), END], dtype=np.uint32)
                first = (len(ids) - 1) % capacity + 1
                for piece, start in enumerate([0, *range(first, len(ids), capacity)]):
                    own = ids[start : first if not piece else start + capacity].tobytes()
                    rows["doc_id"].append(doc)
                    rows["piece"].append(piece)
                    rows["start"].append(start)
                    rows["length"].append(len(own) // 4)
                    rows["ids_crc32"].append(zlib.crc32(own))
                    rows["ids"].append(own if keep_ids else None)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(rows.items(), kinds)})

    return run


def _pack_group(capacity: int):
    def run(table):
        uid, sizes = table["uid"].to_numpy(), table["length"].to_numpy()
        order = np.argsort(uid)
        uid, sizes = uid[order], sizes[order]
        bins, offsets, fill = best_fit_decreasing(sizes, capacity)
        bound = lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        size = len(uid)
        return pa.table(
            {
                "uid": uid, "length": sizes, "group": np.repeat(table["group"].to_numpy()[:1], size), "bin": bins,
                "offset": offsets, "fill": fill[bins], "bins": np.full(size, len(fill)), "bound": np.full(size, bound),
            }
        )

    return run


def pack_items(items: DataFrame, capacity: int, group_items: int = GROUP_ITEMS) -> DataFrame:
    """``uid, sequence_id, offset`` for ``(uid, length)`` rows of at most ``capacity``.

    Partitions that reach their lower bound are proved best and closed, full bins
    are closed too; the rest exchanges its documents among an eighth as many
    partitions, or as many as hold ``group_items`` each if that is more.  It ends when
    all are proved, when one partition is left, when an exchange saves no bin, or, among
    as many partitions as before, less than one in each.
    """
    placed, waiting, level, before = None, items, 0, None
    groups = max(1, -(-items.count() // group_items))
    while True:
        dealt = waiting.withColumn("group", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(groups)))
        packed = durable(
            dealt.select("group", "uid", "length").groupBy("group").applyInArrow(
                _pack_group(capacity),
                "uid long, length long, group long, bin long, offset long, fill long, bins long, bound long",
            ),
            "packed",
        )
        each = packed.groupBy("group").agg(F.max("bins").alias("bins"), F.max("bound").alias("bound"))
        used = each.agg(F.sum("bins").alias("n")).first()["n"] or 0
        if before is not None and used >= before:
            return placed  # the exchange saved nothing; the packing before it stands
        numbered = packed.withColumn(
            "sequence_id", F.lit(level << 56) + F.col("group") * F.lit(1 << 24) + F.col("bin")
        )
        loose = (F.col("bins") > F.col("bound")) & (F.col("fill") < capacity)
        kept = numbered.filter(~loose).select("uid", "sequence_id", "offset")
        rest = numbered.filter(loose)
        settled = kept if level == 0 else closed.union(kept)
        placed = settled.union(rest.select("uid", "sequence_id", "offset"))
        loosely, saved = rest.agg(
            F.count_distinct("group", "bin").alias("bins"), F.count(F.lit(1)).alias("items")
        ).first(), None if before is None else before - used
        before = loosely["bins"]
        if groups == 1 or before == 0:
            return placed
        closed, waiting, level = settled, rest.select("uid", "length"), level + 1
        fewer = max(1, groups // FAN_IN, -(-loosely["items"] // group_items))
        if fewer == groups and saved is not None and saved < groups:
            return placed
        groups = fewer


def pack(
    docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False,
    group_items: int = GROUP_ITEMS,
) -> DataFrame:
    """Tokenise documents, end each with id 0, and pack them into sequences of ``capacity``.

    Takes ``doc_id`` and ``text`` (null: empty, so only the end id).  A longer
    document is cut so that all pieces but the first are full.  Returns per piece
    ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, and with
    ``keep_ids`` the ids as little-endian 32-bit numbers.  Repeated rows are packed
    as documents of their own.
    """
    cut = columns(docs, "doc_id", "text").mapInArrow(
        _pieces(path or default_vocabulary(), capacity, keep_ids),
        "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary",
    )
    stored = durable(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    full = stored.filter(F.col("length") == capacity).select(
        "*", (F.lit(1 << 62) + F.col("uid")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    part = stored.filter(F.col("length") < capacity)
    placed = part.join(pack_items(part.select("uid", "length"), capacity, group_items), "uid")
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if keep_ids else [])]
    return full.select(*out).union(placed.select(*out))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the packed sequences themselves, from pieces with ids."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("hex"))))
    joined = F.unhex(F.concat_ws("", F.transform(ordered, lambda p: p["hex"])))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents packed."""
    return pack(docs)


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
