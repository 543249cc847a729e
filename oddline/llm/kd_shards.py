"""Shards by a k-d tree over document metadata, cut at distributed weighted medians."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from oddline.llm.common import columns, hot_lookup, ranked
from oddline.session import durable

DIMENSIONS = ("lang", "source")  # and "size", which may be asked for
CODE_BITS = 30
BINS = 1024
SLACK = 0.05  # of a shard's bytes: how far a cut may move so that equal texts stay together


@dataclass
class Node:
    """A box of the tree: ``number``, its first shard and how many it will hold."""

    number: int
    first: int
    shards: int


def _coordinates(docs: DataFrame) -> DataFrame:
    """Narrow rows with whole-number coordinates; equal texts get equal ones.

    The metadata of a group of equal texts is that of its first source and
    language, so a cut can leave the group whole.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = durable(
        columns(docs, "doc_id", "text", "lang", "source").select(
            "doc_id",
            F.monotonically_increasing_id().alias("_row"),
            (F.octet_length(text) + 8).cast("bigint").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("_text"),
            "lang", "source",
        ),
        "metadata",
    )
    key = ["_text", "size", "text_crc32"]
    groups = durable(
        narrow.groupBy(*key).agg(
            F.min("lang").alias("_l"), F.min("source").alias("_s"), F.count(F.lit(1)).alias("_rows")
        ),
        "groups",
    )
    total = groups.agg(F.sum("_rows")).first()[0] or 0
    found = hot_lookup(narrow.drop("lang", "source"), groups, key, "_rows", total, ["_row"])

    def code(name: str) -> Column:
        return F.shiftright(F.crc32(F.coalesce(name, F.lit("")).cast("binary")), 32 - CODE_BITS)

    return durable(
        found.select(
            "doc_id", "_row", "size", "text_crc32",
            F.floor(F.log2("size") * float(1 << CODE_BITS - 6)).alias("_size"),
            code("_l").alias("_lang"), code("_s").alias("_source"),
            F.shiftrightunsigned("_text", 31).alias("_group"),
            F.shiftrightunsigned(F.xxhash64("doc_id", "_row"), 31).alias("_own"),
        ),
        "coordinates",
    )


def _key(dimension: Column, axes: list[str]) -> Column:
    """A coordinate and the text's hash in one number; equal texts share it."""
    value = F.coalesce(*[F.when(dimension == i, F.col(d)) for i, d in enumerate(axes)])
    return F.shiftleft(value, 33).bitwiseOR(F.col("_group"))


def _plan(spark, rows: list[tuple], names: list[str]) -> DataFrame:
    schema = StructType([StructField(n, LongType()) for n in names])
    return F.broadcast(spark.createDataFrame(rows, schema))  # one row per node, of at most one per shard


def _weighted_cut(rows: DataFrame, targets: dict[int, float]) -> dict[int, tuple[int, int, int, int, int]]:
    """Where the sum of ``size`` in order of ``_k`` reaches each node's target.

    Counts bytes in 1,024 bins per node and goes on in the bin of the target
    until it holds one key only.  Returns per node the key, the bytes before it,
    its own bytes, and the neighbour keys' bounds.
    """
    spark, open_, done = rows.sparkSession, {}, {}
    ends = rows.groupBy("node").agg(F.min("_k").alias("a"), F.max("_k").alias("b"), F.sum("size").alias("w"))
    for r in ends.collect():
        if r["node"] in targets:
            open_[r["node"]] = (r["a"], r["b"], 0, r["w"])
    while open_:
        for n in [n for n, (a, b, _, _) in open_.items() if a == b]:
            a, _, base, w = open_.pop(n)
            done[n] = (a, base, w)
        if not open_:
            break
        ranges = _plan(spark, [(n, a, (b - a) // BINS + 1) for n, (a, b, _, _) in open_.items()], ["node", "_a", "_w"])
        last = _plan(spark, [(n, b) for n, (_, b, _, _) in open_.items()], ["node", "_b"])
        within = rows.join(ranges, "node").join(last, "node").filter("_k BETWEEN _a AND _b")
        bins = (
            within.groupBy("node", F.floor((F.col("_k") - F.col("_a")) / F.col("_w")).alias("bin"))
            .agg(F.sum("size").alias("w"), F.min("_k").alias("a"), F.max("_k").alias("b"))
            .collect()
        )
        for n in list(open_):
            base = open_[n][2]
            own = sorted((r for r in bins if r["node"] == n), key=lambda r: r["a"])
            for r in own:
                if base + r["w"] >= targets[n] or r is own[-1]:
                    open_[n] = (r["a"], r["b"], base, r["w"])
                    break
                base += r["w"]
    return done


def kd_shards(
    docs: DataFrame, shards: int | None = None, target_bytes: int | None = None,
    dimensions: tuple[str, ...] = DIMENSIONS,
) -> DataFrame:
    """Deal documents into ``shards`` parts of nearly equal bytes (or parts of ``target_bytes``).

    Takes ``doc_id, text, lang, source``.  A document's size is its UTF-8 bytes
    plus 8.  Every node is cut on its widest dimension (as a share of the whole
    width, ties in the order given; within one value by text hash) where the bytes on the left
    reach their part of the node's; with a number of shards that is no power of
    two, children hold unequal numbers.  Equal texts stay on one side unless that
    moves a cut by more than a twentieth of a shard; then the group is cut, too.
    Returns ``doc_id, size, text_crc32, shard, slot``; slots have no gaps.  Nulls
    have a coordinate of their own; rows repeated with one id are dealt like others.
    """
    spark = docs.sparkSession
    points, axes = _coordinates(docs), [f"_{d}" for d in dimensions]
    total = points.agg(F.sum("size")).first()[0] or 0
    shards = shards or max(1, -(-total // target_bytes))
    slack = SLACK * total / shards
    nodes = [Node(1, 0, shards)]
    leaves: list[Node] = []
    current, whole = points.withColumn("node", F.lit(1).cast("bigint")), None
    while nodes:
        leaves += [n for n in nodes if n.shards == 1]
        nodes = [n for n in nodes if n.shards > 1]
        if not nodes:
            break
        facts = {
            r["node"]: r
            for r in current.groupBy("node").agg(
                F.sum("size").alias("bytes"),
                *[F.min(d).alias(f"low{d}") for d in axes],
                *[F.max(d).alias(f"high{d}") for d in axes],
            ).collect()
        }
        if whole is None and facts:
            whole = [facts[1][f"high{d}"] - facts[1][f"low{d}"] for d in axes]
        widest, targets = {}, {}
        for n in nodes:
            if n.number in facts:
                f = facts[n.number]
                widths = [
                    (f[f"high{d}"] - f[f"low{d}"]) / w if w else 0.0 for d, w in zip(axes, whole)
                ]
                widest[n.number] = widths.index(max(widths))
                targets[n.number] = f["bytes"] * (n.shards // 2) / n.shards
        keyed = current.join(_plan(spark, list(widest.items()), ["node", "_dim"]), "node").withColumn(
            "_k", _key(F.col("_dim"), axes)
        )
        cuts = _weighted_cut(keyed.select("node", "_k", "size"), targets)
        # Rows up to (key, own) go left.  A key goes to the nearer side as a whole, or is cut.
        plan, shared = {}, {}
        for n, (key, base, weight) in cuts.items():
            over, under = base + weight - targets[n], targets[n] - base
            if min(over, under) <= slack:
                plan[n] = (key, 1 << 40) if over <= under else (key, -1)
            else:
                shared[n] = (key, targets[n] - base)
        if shared:
            hot = keyed.join(_plan(spark, [(n, k) for n, (k, _) in shared.items()], ["node", "_key"]), "node")
            inner = hot.filter("_k = _key").select("node", F.col("_own").alias("_k"), "size")
            for n, (own, base, weight) in _weighted_cut(inner, {n: t for n, (_, t) in shared.items()}).items():
                over, under = base + weight - shared[n][1], shared[n][1] - base
                plan[n] = (shared[n][0], own if over <= under else own - 1)
        moves = _plan(
            spark, [(n, widest[n], *plan[n]) for n in plan], ["node", "_dim", "_cut", "_cut_own"]
        )
        key = _key(F.col("_dim"), axes)
        left = (key < F.col("_cut")) | ((key == F.col("_cut")) & (F.col("_own") <= F.col("_cut_own")))
        current = durable(
            current.join(moves, "node", "left")
            .withColumn(
                "node",
                F.when(F.col("_cut").isNull(), F.col("node"))
                .when(left, F.col("node") * 2).otherwise(F.col("node") * 2 + 1),
            )
            .drop("_dim", "_cut", "_cut_own"),
            "nodes",
        )
        nodes = [
            child
            for n in nodes
            for child in (
                Node(2 * n.number, n.first, n.shards // 2),
                Node(2 * n.number + 1, n.first + n.shards // 2, n.shards - n.shards // 2),
            )
        ]
    names = _plan(spark, [(n.number, n.first) for n in leaves], ["node", "_shard"])
    dealt = current.join(names, "node").select(
        "doc_id", "size", "text_crc32", F.col("_shard").cast("int").alias("shard"), "_row"
    )
    numbered = durable(ranked(dealt, [F.col("shard"), F.col("doc_id"), F.col("_row")], "_rank"), "numbered")
    first = numbered.groupBy("shard").agg(F.min("_rank").alias("_first"))  # one row per shard
    return numbered.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_rank") - F.col("_first")).alias("slot")
    )


def op2_kd_shards(spark, sf_dir: str) -> DataFrame:
    dealt = kd_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
