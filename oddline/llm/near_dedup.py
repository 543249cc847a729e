"""Exact Jaccard join on word shingles by signature trees.

A document with too many shingles that no other has cannot be similar to any and
leaves at once.  Which of the rest can be similar is found by the root level: the
hash space of shingles is cut into more parts than two similar sets may differ in,
so one part must be equal in both.  Documents that share such a part form
clusters, and every cluster is searched by a signature tree.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from oddline.llm.bpe import _blocks, _bundle, cut, unpack_lists
from oddline.llm.common import columns, components, hot_lookup, keep_rows, mix, partitions, slices, text_bytes
from oddline.session import durable

BATCH_BYTES = 4 << 20  # text per step inside a task
BLOCK_DOCS = 1024  # documents of one cluster in one task
BLOCK_SHINGLES = 1 << 20
LEAF = 8  # documents of a leaf, nodes of a parent
MOST_BITS = 1 << 16  # of a bitmap
PAIRS_AT_ONCE = 4096
U64 = np.uint64


@dataclass(frozen=True)
class Rule:
    """Two sets of ``words``-word shingles link if 100 * common >= percent * union."""

    words: int
    percent: int

    def linked(self, common: int, a: int, b: int) -> bool:
        return 100 * common >= self.percent * (a + b - common)

    def least_common(self, total):
        """The fewest common elements of linked sets with ``total`` elements together."""
        return -(-self.percent * total // (100 + self.percent))


# --- sets ------------------------------------------------------------------------


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text."""
    split = [t.lower().split() for t in texts]  # bytes: A-Z and ASCII white space only
    lengths = np.array([len(s) for s in split], dtype=np.int64)
    coded = pa.array([w for s in split for w in s], pa.binary()).dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=U64)
    one = hashes[coded.indices.to_numpy()] if len(hashes) else hashes
    ends = np.cumsum(lengths)
    rolled = np.zeros(max(len(one) - words + 1, 0), dtype=U64)
    for i in range(words):
        rolled = mix(rolled ^ one[i : i + len(rolled)]) + U64(i + 1)
    out = []
    for n, end in zip(lengths.tolist(), ends.tolist()):
        if n >= words:
            out.append(np.unique(rolled[end - n : end - words + 1]))
        elif n:
            short = np.array([n], dtype=U64)
            for w in one[end - n : end]:
                short = mix(short ^ w) + U64(words + 1)
            out.append(short)
        else:
            out.append(np.zeros(0, dtype=U64))
    return out


def set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


# --- documents that share nothing ------------------------------------------------


def _six_bytes(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return wide.view(U64).ravel()


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def _ask(rule: Rule, buckets: int):
    """Per block and bucket one row with shingle hashes, a share of each document's."""
    share = int(1024 * min(1.0, 2.5 * (100 - rule.percent) / 100))

    def run(batches):
        for block, batch in _blocks(batches):
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            check = xxhash.xxh3_64_intdigest(ids.tobytes()) >> 1
            sets = [s[(s & U64(1023)) < share] for s in shingle_sets(text_bytes(batch.column("text")), rule.words)]
            doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            every = np.concatenate(sets)
            bucket = ((every >> U64(40)) % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            every, doc, bucket = every[order], doc[order], bucket[order]
            starts = _starts(bucket)
            for a, b in zip(starts, np.r_[starts[1:], len(bucket)]):
                counts = np.bincount(doc[a:b], minlength=len(sets)).astype(np.int32)
                yield pa.RecordBatch.from_pydict(
                    {"bucket": [int(bucket[a])], "block": [block], "check": [check],
                     "hashes": pa.array([_six_bytes(every[a:b])], pa.binary()),
                     "counts": pa.array([zstandard.compress(counts.tobytes(), 1)], pa.binary())}
                )

    return run


def _unshared(table: pa.Table) -> pa.Table:
    """How many of the hashes of every document no other document has."""
    parts = [_from_six(h) for h in table["hashes"].to_pylist()]
    every = np.concatenate(parts)
    order = np.argsort(every)
    new = np.r_[True, every[order][1:] != every[order][:-1]]
    single = np.empty(len(every), dtype=bool)
    single[order] = new & np.r_[new[1:], True]
    out, at = [], 0
    for packed in table["counts"].to_pylist():
        counts = np.frombuffer(zstandard.decompress(packed), np.int32)
        n = int(counts.sum())
        doc = np.repeat(np.arange(len(counts)), counts)
        own = np.bincount(doc[single[at : at + n]], minlength=len(counts)).astype(np.int32)
        out.append(zstandard.compress(own.tobytes(), 1))
        at += n
    return pa.table({"block": table["block"], "check": table["check"], "counts": pa.array(out, pa.binary())})


def _keep(rule: Rule):
    """Size and key of every document's set, and the text of those that may be linked.

    Of linked sets A and B, A has at most (100 - percent) percent elements that B
    has not.  Counts that belong to another split of the input rule nobody out.
    """

    def run(left, right):
        out = {"doc_id": [], "n_shingles": [], "set_key": [], "text": []}
        answers = list(zip(right["check"].to_pylist(), right["counts"].to_pylist()))
        for row in left.to_pylist():
            ids, nulls = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["nulls"], bool)
            check, unshared = xxhash.xxh3_64_intdigest(row["docs"]) >> 1, np.zeros(len(ids), np.int64)
            for c, packed in answers:
                if c == check:
                    unshared += np.frombuffer(zstandard.decompress(packed), np.int32)
            lengths, body = unpack_lists(row["texts"])
            texts = cut(body, lengths)
            for i, null, n, text, s in zip(ids.tolist(), nulls, unshared.tolist(), texts, shingle_sets(texts, rule.words)):
                may = len(s) and not null and 100 * n <= (100 - rule.percent) * len(s)
                out["doc_id"].append(None if null else i)
                out["n_shingles"].append(len(s))
                out["set_key"].append(set_key(s))
                out["text"].append(text.decode("utf-8") if may else None)
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.string()]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})

    return run


def set_facts(docs: DataFrame, rule: Rule) -> DataFrame:
    """``doc_id, n_shingles, set_key, text`` with the text of possibly linked documents only."""
    buckets = 4 * partitions(docs)
    asked = docs.mapInArrow(_ask(rule, buckets), "bucket long, block long, check long, hashes binary, counts binary")
    counted = asked.groupBy("bucket").applyInArrow(_unshared, "block long, check long, counts binary")
    bundles = docs.mapInArrow(_bundle, "block long, docs binary, nulls binary, texts binary")
    return bundles.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(
        _keep(rule), "doc_id long, n_shingles long, set_key binary, text string"
    )


# --- root level ------------------------------------------------------------------


@lru_cache(maxsize=16)
def _first_sizes(percent: int, most: int) -> np.ndarray:
    first = [1]
    while first[-1] <= most:
        first.append(first[-1] * 100 // percent + 1)
    return np.array(first)


def size_class(n: int, percent: int) -> int:
    """Classes such that the sizes of linked sets lie in the same or in adjacent ones."""
    return int(np.searchsorted(_first_sizes(percent, 1 << max(n, 1).bit_length()), n, "right")) - 1


@lru_cache(maxsize=4096)
def _parts(level: int, rule: Rule) -> tuple[int, int]:
    """Number of parts for sets of the classes ``level - 1`` and ``level``, and how many may be empty."""
    first, n = [1], 0
    while len(first) < level + 2:
        first.append(first[-1] * 100 // rule.percent + 1)
    least, most = first[max(level - 1, 0)], first[level + 1] - 1
    differ = (100 - rule.percent) * 2 * most // (100 + rule.percent)
    spare = 1
    for _ in range(8):  # grows to a fixed point
        n = differ + 1 + spare
        expected = n * np.exp(-least / n)
        spare = int(np.ceil(expected + 6 * np.sqrt(expected))) + 1
    return differ + 1 + spare, spare


def signatures(s: np.ndarray, rule: Rule) -> np.ndarray:
    """64-bit signatures of a set; linked sets share at least one.

    Linked sets A and B differ in at most ``d`` elements, so of ``d + 1 + e`` parts
    at least ``1 + e`` are equal.  If A has at most ``e`` empty parts, one of those
    is not empty.  A set with more empty parts carries one more signature, that of
    all such sets; so also two of them meet.
    """
    level, scrambled, out = size_class(len(s), rule.percent), mix(s), []
    top = s >> U64(32)
    for k in (level, level + 1):
        n, spare = _parts(k, rule)
        part = (top * U64(n)) >> U64(32)  # ascending, as s is
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        content = np.add.reduceat(scrambled, starts)
        salt = U64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        out.append(mix(mix(content ^ salt) + part[starts]))
        if n - len(starts) > spare:
            out.append(mix(np.array([k], dtype=U64) ^ salt))
    return np.concatenate(out)


def _packed_signatures(rule: Rule, buckets: int):
    """Per batch and bucket one row with all its (signature, document) pairs."""

    def run(batches):
        for batch in slices(batches, BATCH_BYTES):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            found = [
                (signatures(s, rule), i)
                for s, i in zip(shingle_sets(text_bytes(batch.column("text")), rule.words), ids)
                if len(s)
            ]
            if not found:
                continue
            sig = np.concatenate([s for s, _ in found])
            doc = np.repeat(np.array([i for _, i in found], dtype=np.int64), [len(s) for s, _ in found])
            bucket = (sig >> U64(40)) % U64(buckets)
            order = np.argsort(bucket, kind="stable")  # documents stay together within a bucket
            sig, doc, bucket = sig[order], doc[order], bucket[order]
            starts = _starts(bucket)
            ends = np.r_[starts[1:], len(sig)]
            rows = {"bucket": [], "sig": [], "doc": [], "count": []}
            for a, b in zip(starts, ends):
                first = _starts(doc[a:b])
                # 48 bits of a signature and the bucket: a chance hit costs a comparison, no more.
                rows["bucket"].append(int(bucket[a]))
                rows["sig"].append(_six_bytes(sig[a:b]))
                rows["doc"].append(doc[a:b][first].tobytes())
                rows["count"].append(np.diff(np.r_[first, b - a]).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_pydict(
                rows,
                pa.schema([("bucket", pa.int64()), ("sig", pa.binary()), ("doc", pa.binary()), ("count", pa.binary())]),
            )

    return run


def _meet(table: pa.Table) -> pa.Table:
    """Tie the documents that share a signature to the smallest of them."""
    sigs, docs = [], []
    for s, d, c in zip(table["sig"].to_pylist(), table["doc"].to_pylist(), table["count"].to_pylist()):
        sigs.append(_from_six(s))
        docs.append(np.repeat(np.frombuffer(d, np.int64), np.frombuffer(c, np.int32)))
    sig, doc = np.concatenate(sigs), np.concatenate(docs)
    order = np.lexsort((doc, sig))
    sig, doc = sig[order], doc[order]
    starts = _starts(sig)
    lowest = np.repeat(doc[starts], np.diff(np.r_[starts, len(sig)]))
    pairs = np.unique(np.stack([lowest, doc])[:, lowest != doc], axis=1)
    return pa.table({"a": pairs[0], "b": pairs[1]})


# --- signature tree --------------------------------------------------------------


class Links:
    """Union-find over the documents of one task."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j

    def roots(self) -> np.ndarray:
        while True:
            above = self.up[self.up]
            if (above == self.up).all():
                return above
            self.up = above


class SignatureTree:
    """Levels of nodes over sorted documents; level 0 are the documents.

    A node holds the OR of the bitmaps below it, the range of sizes, and ``slack``,
    the most elements that share bits inside one document.  Two documents below the
    nodes X and Y have at most slack + popcount(X & Y) common elements.
    """

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray):
        slack = sizes - np.bitwise_count(bitmaps).sum(axis=1, dtype=np.int64)
        self.levels = [(bitmaps, sizes, sizes, slack)]
        while len(bitmaps) > 1:
            starts = np.arange(0, len(bitmaps), LEAF)
            _, low, high, slack = self.levels[-1]
            bitmaps = np.bitwise_or.reduceat(bitmaps, starts, axis=0)
            self.levels.append(
                (
                    bitmaps,
                    np.minimum.reduceat(low, starts),
                    np.maximum.reduceat(high, starts),
                    np.maximum.reduceat(slack, starts),
                )
            )

    def possible(self, level: int, i: np.ndarray, j: np.ndarray, rule: Rule) -> np.ndarray:
        """Which node pairs may hold a linked pair."""
        bits, low, high, slack = self.levels[level]
        shared = np.bitwise_count(bits[i] & bits[j]).sum(axis=1, dtype=np.int64)
        most = np.minimum(np.minimum(high[i], slack[i] + shared), np.minimum(high[j], slack[j] + shared))
        return most >= rule.least_common(low[i] + low[j])

    def size_fits(self, level: int, i: np.ndarray, j: np.ndarray, rule: Rule) -> np.ndarray:
        _, low, high, _ = self.levels[level]
        return (100 * high[i] >= rule.percent * low[j]) & (100 * high[j] >= rule.percent * low[i])


def linked_pairs(sets: list[np.ndarray], side: np.ndarray, cross: bool, rule: Rule, keep_all: bool = False):
    """Linked pairs found by the dual traversal of a signature tree.

    ``cross``: only pairs of different sides.  Pairs whose documents are linked
    through others already are skipped, which leaves the components as they are;
    ``keep_all`` finds every link.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0])))
    sets, side, sizes = [sets[i] for i in order], side[order], sizes[order]
    every = np.concatenate(sets)
    known, code = np.unique(every, return_inverse=True)
    bits = 64
    while bits < min(len(known), MOST_BITS):
        bits *= 2
    exact = len(known) <= bits  # every element has a bit of its own
    bitmaps = np.zeros((len(sets), bits // 64), dtype=U64)
    row = np.repeat(np.arange(len(sets)), sizes)
    code = code % bits
    np.bitwise_or.at(bitmaps, (row, code // 64), U64(1) << (code % 64).astype(U64))
    tree, links, out = SignatureTree(bitmaps, sizes), Links(len(sets)), []

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        keep = i < j
        if cross:
            keep &= side[i] != side[j]
        if not keep_all:
            roots = links.roots()
            keep &= roots[i] != roots[j]
        i, j = i[keep], j[keep]
        fits = tree.possible(0, i, j, rule) if len(i) else keep[:0]
        for a, b in zip(i[fits].tolist(), j[fits].tolist()):
            if not keep_all and links.root(a) == links.root(b):
                continue
            if exact:
                common = int(np.bitwise_count(bitmaps[a] & bitmaps[b]).sum())
            else:
                common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if rule.linked(common, len(sets[a]), len(sets[b])):
                links.join(a, b)
                out.append((order[a], order[b]))

    # Depth first, a bounded number of node pairs at a time.
    stack = [(len(tree.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        if level == 0:
            compare(i, j)
            continue
        fits = (i == j) | tree.size_fits(level, i, j, rule)
        i, j = i[fits], j[fits]
        if len(i):
            fits = (i == j) | tree.possible(level, i, j, rule)
            i, j = i[fits], j[fits]
        below = len(tree.levels[level - 1][1])
        step = np.arange(LEAF)
        ci = (i[:, None, None] * LEAF + step[None, :, None] + 0 * step[None, None, :]).ravel()
        cj = (j[:, None, None] * LEAF + 0 * step[None, :, None] + step[None, None, :]).ravel()
        keep = (ci < below) & (cj < below) & (ci <= cj)
        ci, cj = ci[keep], cj[keep]
        for at in range(0, len(ci), PAIRS_AT_ONCE):
            stack.append((level - 1, ci[at : at + PAIRS_AT_ONCE], cj[at : at + PAIRS_AT_ONCE]))
    return out


def _search(rule: Rule, keep_all: bool):
    def run(key, table):
        group = np.array(table["cluster"].to_pylist())
        ids, side = np.array(table["doc_id"].to_pylist()), np.array(table["side"].to_pylist())
        cross = key[1].as_py()
        order = np.argsort(group, kind="stable")
        sets = shingle_sets(text_bytes(table["text"].combine_chunks()), rule.words)
        starts = _starts(group[order])
        a, b = [], []
        for at, to in zip(starts, np.r_[starts[1:], len(order)]):
            own = order[at:to]
            for i, j in linked_pairs([sets[x] for x in own], side[own], cross, rule, keep_all):
                a.append(ids[own[i]])
                b.append(ids[own[j]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def links_between(facts: DataFrame, rule: Rule, keep_all: bool = False) -> DataFrame:
    """``(a, b)``: verified links between documents with different shingle sets.

    ``facts`` is the result of :func:`set_facts`, stored.  Of equal sets only the
    smallest document takes part.
    """
    possible = facts.filter("text IS NOT NULL")
    heads = possible.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"))
    held = possible.join(heads, ["doc_id", "set_key"], "left_semi").dropDuplicates(["doc_id", "set_key"])
    # An id may be that of several texts; each takes part, told apart by its set.
    docs = durable(held.select("doc_id", F.xxhash64("set_key").alias("_set"), "n_shingles", "text"), "possible")
    buckets = 4 * partitions(facts)
    packed = docs.select("doc_id", "text").mapInArrow(
        _packed_signatures(rule, buckets), "bucket long, sig binary, doc binary, count binary"
    )
    met = durable(packed.groupBy("bucket").applyInArrow(_meet, "a long, b long").distinct(), "met")
    clusters = components(met).withColumnRenamed("node", "doc_id")
    members = durable(
        clusters.join(docs.select("doc_id", "_set", F.col("n_shingles").alias("n")), "doc_id"), "members"
    )
    # A large cluster is cut by size class and hash into blocks; blocks of one or of
    # adjacent classes are compared, so every link is met once.
    sized = members.groupBy("component").agg(F.count(F.lit(1)).alias("_docs"), F.sum("n").alias("_shingles"))
    large = sized.filter((F.col("_docs") > BLOCK_DOCS) | (F.col("_shingles") > BLOCK_SHINGLES))
    classed = members.withColumn("_class", F.floor(F.log("n") / float(-np.log(rule.percent / 100)) + 1e-9))
    cut = (
        classed.join(large, "component", "left_semi")
        .groupBy("component", "_class")
        .agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("_blocks"),
             F.count(F.lit(1)).alias("_rows"))
    )
    cut = durable(cut, "blocks")
    blocks = cut.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)))
    one = blocks.select("component", F.col("_class").alias("c1"), F.col("_block").alias("b1"))
    two = blocks.select(
        "component", F.col("_class").alias("c2"), F.col("_block").alias("b2"),
        F.explode(F.array(F.col("_class"), F.col("_class") - 1, F.col("_class") - 2)).alias("c1"),
    )
    pairs = one.join(two, ["component", "c1"]).filter((F.col("c1") < F.col("c2")) | (F.col("b1") <= F.col("b2")))
    task = F.xxhash64("component", "c1", "b1", "c2", "b2")
    same = (F.col("c1") == F.col("c2")) & (F.col("b1") == F.col("b2"))
    sides = pairs.select("component", F.col("c1").alias("_class"), F.col("b1").alias("_block"),
                         task.alias("task"), (~same).alias("cross"), F.lit(0).alias("side")).union(
        pairs.filter(~same).select("component", F.col("c2").alias("_class"), F.col("b2").alias("_block"),
                                   task.alias("task"), (~same).alias("cross"), F.lit(1).alias("side")))
    total = cut.agg(F.sum("_rows")).first()[0] or 0
    dealt = hot_lookup(classed, cut, ["component", "_class"], "_rows", total, ["doc_id"]).withColumn(
        "_block", F.pmod(F.xxhash64("doc_id", "_set"), F.col("_blocks"))
    )
    wide = dealt.join(sides, ["component", "_class", "_block"]).select("doc_id", "_set", "component", "task", "cross", "side")
    small = members.join(large, "component", "left_anti").select(
        "doc_id", "_set", "component", F.pmod(F.xxhash64("component"), F.lit(16 * buckets)).alias("task"),
        F.lit(False).alias("cross"), F.lit(0).alias("side"),
    )
    placed = durable(small.union(wide).withColumnRenamed("component", "cluster"), "placed")
    with_text = placed.join(docs.select("doc_id", "_set", "text"), ["doc_id", "_set"]).drop("_set")
    return with_text.groupBy("task", "cross").applyInArrow(_search(rule, keep_all), "a long, b long")


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents linked by shingle similarity.

    Takes ``doc_id`` (unique) and ``text``; returns ``doc_id, n_shingles,
    component_id``.  Two documents link when 100 * common >= percent * union of
    their distinct shingles; the component is the smallest ``doc_id`` reachable.
    A text with fewer than ``words`` words is one shingle; one without words (also
    null) has none and stands alone.  Rows repeated with one id are one document
    each and share a component; rows without id are left alone (component null).
    Shingles are compared by 64-bit hashes.
    """
    rule = Rule(words, percent)
    facts = durable(set_facts(columns(docs, "doc_id", "text"), rule), "facts")
    links = durable(links_between(facts, rule), "links")
    # Documents with equal sets belong together whatever links they have.
    filled = facts.drop("text").filter("n_shingles > 0 AND doc_id IS NOT NULL")
    same = durable(
        filled.groupBy("set_key").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_rows")), "equal"
    )
    linked = components(links).select(F.col("node").alias("_first"), F.col("component").alias("_linked"))
    heads = same.join(linked, "_first", "left").select(
        "set_key", "_rows", F.coalesce("_linked", "_first").alias("component_id")
    )
    total = same.agg(F.sum("_rows")).first()[0] or 0
    found = hot_lookup(filled, heads, ["set_key"], "_rows", total, ["doc_id"])
    alone = facts.filter("n_shingles = 0 OR doc_id IS NULL").withColumn("component_id", F.col("doc_id"))
    return found.select("doc_id", "n_shingles", "component_id").union(
        alone.select("doc_id", "n_shingles", "component_id")
    )


def near_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of every component (five words, 0.8) the smallest document stays."""
    found = near_dedup(docs)
    return keep_rows(docs, found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))))


def op7_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=90)
