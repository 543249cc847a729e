"""A hidden Markov language model, trained by Baum-Welch and scored by the scaled forward recursion.

Latent states emit words; a word's emission is its add-one unigram probability times
a ratio per state, which Baum-Welch learns from the expected counts of that word.
Words are spread by hash over buckets, and every round each bucket adds up the counts
of its words and sends their ratios back to the blocks that hold them, so what is
gathered grows with the vocabulary and no task or driver holds it all.  A class, the
hash of a word's last four bytes, gives the ratio that rare words start from.  All
emissions of a state add up to 1, so the model is a proper distribution over texts.
"""

from __future__ import annotations

import gc
import zlib
from dataclasses import dataclass, replace
from uuid import uuid4

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from oddline.llm.bpe import cut, pack_lists, unpack_lists
from oddline.llm.common import columns, mix, partitions, slices, text_bytes
from oddline.session import remove, scratch_path

STATES = 6
CLASSES = 1 << 14
UNKNOWN, END = CLASSES, CLASSES + 1  # classes of their own
SUFFIX = 4
ROUNDS = 6
PRIOR = 10.0  # tokens without preference for a state, added to every class
WORD_PRIOR = 10.0  # tokens with the preference of its class, added to every word
STAY = 0.9  # at the start
NOISE = 1.5
SEED = 7
BLOCK_BYTES = 12 << 20
CHUNK = 1 << 10  # classes summed together
CELLS = CLASSES + 2
PIECE = 1 << 10  # positions of a document walked in one go; results do not depend on it


# --- blocks of coded documents ---------------------------------------------------


def _code(buckets: int):
    """Per block one row with its documents as word numbers, and one per bucket with its distinct words."""

    def run(batches):
        start = TaskContext.get().partitionId() << 32
        for i, batch in enumerate(slices(batches, BLOCK_BYTES)):
            split = [t.lower().split() for t in text_bytes(batch.column("text"))]
            lengths = np.array([len(s) for s in split], dtype=np.int64)
            held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            coded = pa.array([w for s in split for w in s], pa.binary()).dictionary_encode()
            words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            hashes = np.array([zlib.crc32(w) for w in words], dtype=np.int64)
            bucket = hashes % buckets
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(order), dtype=np.int32)
            place[order] = np.arange(len(order))
            codes = place[codes] if len(codes) else codes.astype(np.int32)
            learnt = np.bincount(codes[~np.repeat(held, lengths)], minlength=len(words))
            words = [words[j] for j in order]
            suffix = np.array([zlib.crc32(w[-SUFFIX:]) for w in words], dtype=np.uint64)
            classes = (mix(suffix) % np.uint64(CLASSES)).astype(np.uint16)
            ids = batch.column("doc_id")
            row = {
                "block": [start + i], "bucket": [-1], "start": [0], "trained": [int((~held).sum())],
                "docs": [ids.fill_null(0).to_numpy(zero_copy_only=False).tobytes()],
                "nulls": [ids.is_null().to_numpy(zero_copy_only=False).tobytes()],
                "held": [held.tobytes()], "codes": [pack_lists(lengths, codes.tobytes())],
                "classes": [zstandard.compress(classes.tobytes(), 1)], "words": [None], "counts": [None],
            }
            yield pa.RecordBatch.from_pydict(row, SCHEMA)
            sorted_bucket = bucket[order]
            starts = np.flatnonzero(np.r_[True, sorted_bucket[1:] != sorted_bucket[:-1]]) if len(words) else []
            for a, b in zip(starts, np.r_[starts[1:], len(words)].astype(int) if len(words) else []):
                own = words[a:b]
                row |= {
                    "bucket": [int(sorted_bucket[a])], "start": [int(a)], "trained": [0], "docs": [None],
                    "nulls": [None], "held": [None], "codes": [None],
                    "classes": [classes[a:b].tobytes()],
                    "words": [pack_lists(np.array([len(w) for w in own]), b"".join(own))],
                    "counts": [zstandard.compress(learnt[a:b].astype(np.int64).tobytes(), 1)],
                }
                yield pa.RecordBatch.from_pydict(row, SCHEMA)

    return run


_LONGS, _BYTES = ("block", "bucket", "start", "trained"), ("docs", "nulls", "held", "codes", "classes", "words", "counts")
SCHEMA = pa.schema([*[(n, pa.int64()) for n in _LONGS], *[(n, pa.binary()) for n in _BYTES]])
_DDL = ", ".join([*[f"{n} long" for n in _LONGS], *[f"{n} binary" for n in _BYTES]])


def _count(table: pa.Table) -> pa.Table:
    """Corpus counts of one bucket's words: for every block its own, and sums per class."""
    words, own, classes, sizes = [], [], [], []
    for packed, counts, kinds in zip(*(table[c].to_pylist() for c in ("words", "counts", "classes"))):
        lengths, body = unpack_lists(packed)
        words += cut(body, lengths)
        own.append(np.frombuffer(zstandard.decompress(counts), np.int64))
        classes.append(np.frombuffer(kinds, np.uint16))
        sizes.append(len(lengths))
    coded = pa.array(words, pa.binary()).dictionary_encode()
    codes = coded.indices.to_numpy()
    total = np.bincount(codes, np.concatenate(own).astype(np.float64)).astype(np.int64)
    kind = np.zeros(len(total), dtype=np.int64)
    kind[codes] = np.concatenate(classes)
    known = total > 0
    mass = np.bincount(kind[known], total[known] + 1.0, CLASSES)
    used = np.flatnonzero(mass)
    each = [zstandard.compress(c.tobytes(), 1) for c in np.split(total[codes], np.cumsum(sizes)[:-1])]
    n = len(each)
    return pa.table(
        {
            "block": table["block"].combine_chunks(),
            "start": table["start"].combine_chunks(),
            "bucket": table["bucket"].combine_chunks(),
            "counts": pa.array(each, pa.binary()),
            # The number of each own word among the bucket's.
            "index": pa.array([zstandard.compress(c.tobytes(), 1) for c in np.split(codes, np.cumsum(sizes)[:-1])], pa.binary()),
            # The bucket's words and sums stand in the first row only.
            "total": pa.array([zstandard.compress(total.tobytes(), 1), *[None] * (n - 1)], pa.binary()),
            "kinds": pa.array([zstandard.compress(kind.astype(np.uint16).tobytes(), 1), *[None] * (n - 1)], pa.binary()),
            "tokens": pa.array([int(total.sum()), *[0] * (n - 1)], pa.int64()),
            "types": pa.array([int(known.sum()), *[0] * (n - 1)], pa.int64()),
            "mass": pa.array([list(zip(used.tolist(), mass[used].tolist())), *[[]] * (n - 1)],
                             pa.list_(pa.struct([("class", pa.int64()), ("n", pa.float64())]))),
        }
    )


COUNTED = (
    "block long, start long, bucket long, counts binary, index binary, total binary, kinds binary, tokens long, types long,"
    " mass array<struct<class:long,n:double>>"
)


def squeezed(x: np.ndarray) -> bytes:
    """Non-negative numbers rounded to 9 bits, byte by byte."""
    bits = ((np.ascontiguousarray(x, np.float32).view(np.uint32) + np.uint32(0x8000)) >> np.uint32(16)).astype(np.uint16)
    return zstandard.compress(np.ascontiguousarray(bits.ravel().view(np.uint8).reshape(-1, 2).T).tobytes(), 1)


def stretched(packed: bytes, columns: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(2, -1)
    bits = np.ascontiguousarray(planes.T).view(np.uint16).ravel().astype(np.uint32)
    return (bits << np.uint32(16)).view(np.float32).reshape(-1, columns)


def _bucketed(df: DataFrame, by: str, parts: int) -> DataFrame:
    """``df`` in files bucketed by a column: no later grouping by it moves these rows again.

    The table's name is given up at once; of a table with a path the files stay.
    """
    spark, name = df.sparkSession, f"oddline_{uuid4().hex}"
    df.write.format("parquet").bucketBy(parts, by).sortBy(by).option("path", scratch_path(spark, by)).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def _free(spark) -> None:
    """Shuffle files go when the driver collects its garbage; a round's would else stay through the next ones."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


# --- the model -------------------------------------------------------------------


@dataclass
class Model:
    """Start and transition probabilities, and per state and class the emission relative to the unigram's.

    ``norm`` is what the stored ratios of words are to be divided by; without it words have those of their class.
    """

    start: np.ndarray
    move: np.ndarray
    ratio: np.ndarray  # (classes, states)
    tokens: int
    types: int
    ends: int
    norm: np.ndarray | None = None

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1.0) / (self.tokens + self.types + 1.0))


class Ragged:
    """Documents of unequal length in pieces, the longest first, walked one position at a time.

    Documents of more than ``PIECE`` positions are cut, so that the number of steps is
    bounded.  What a piece does to any vector of states that enters it is a matrix
    (``transfers``); the product of those before it gives what enters it (``entering``),
    and of those behind it what comes back at its end (``leaving``), so sums are exact.
    """

    def __init__(self, classes: np.ndarray, lengths: np.ndarray, piece: int | None = None):
        piece = piece or PIECE
        self.documents, cuts = len(lengths), -(-lengths // piece)
        document = np.repeat(np.arange(len(lengths)), cuts)
        number = np.arange(len(document)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        sizes = np.minimum(lengths[document] - number * piece, piece)
        starts = (np.cumsum(lengths) - lengths)[document] + number * piece
        order = np.argsort(-sizes, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.source, self.starts, self.sizes, number = classes, starts[order], sizes[order], number[order]
        self.before = rank[order - 1]  # the piece in front, where there is one
        steps = int(self.sizes[0]) if len(order) else 0
        self.active = np.searchsorted(-self.sizes, -np.arange(steps), "left")  # sizes > t
        self.offset = np.r_[0, np.cumsum(self.active)]
        place = np.arange(self.offset[-1]) - np.repeat(self.offset[:-1], self.active)
        self.document = document[order][place]
        self.classes = classes[self.starts[place] + np.repeat(np.arange(steps), self.active)]
        # Pieces of cut documents, and the second, third, ... pieces of all documents.
        self.cut = np.flatnonzero(cuts[document[order]] > 1)
        self.slot = np.zeros(len(order), dtype=np.int64)
        self.slot[self.cut] = np.arange(len(self.cut))
        later = np.argsort(number, kind="stable")
        self.waves = np.split(later, np.flatnonzero(np.diff(number[later])) + 1)[1:]

    def at(self, t: int) -> slice:
        return slice(self.offset[t], self.offset[t + 1])

    def transfers(self, ratio: np.ndarray, move: np.ndarray) -> np.ndarray:
        """Per piece of a cut document the matrix from first to last state, up to a factor."""
        k, sizes, starts = len(ratio), self.sizes[self.cut], self.starts[self.cut]
        found = np.repeat(np.eye(k, dtype=ratio.dtype)[:, :, None], len(sizes), axis=2)
        for t in range(int(sizes[0]) if len(sizes) else 0):
            n = np.searchsorted(-sizes, -t, "left")
            v = found[:, :, :n]
            if t:
                v = (move @ v.reshape(k, k * n)).reshape(k, k, n)
            v = v * np.take(ratio, self.source[starts[:n] + t], axis=1)[:, None]
            v /= np.add.reduce(v.reshape(k * k, n))
            found[:, :, :n] = v
        return found

    def entering(self, start: np.ndarray, move: np.ndarray, found: np.ndarray):
        """The states' shares that enter every piece, and those at the end of pieces that others follow."""
        enter = np.repeat(start[:, None], len(self.sizes), axis=1)
        ends = np.ones_like(enter)
        for own in self.waves:
            before = self.before[own]
            end = np.einsum("ijn,jn->in", found[:, :, self.slot[before]], enter[:, before])
            ends[:, before] = end / end.sum(axis=0)
            enter[:, own] = move @ ends[:, before]
        return enter, ends

    def leaving(self, ends: np.ndarray, move: np.ndarray, found: np.ndarray) -> np.ndarray:
        """The backward values at the end of every piece; 1 at the end of a document."""
        leave = np.ones_like(ends)
        for own in reversed(self.waves):
            before = self.before[own]
            back = move.T @ np.einsum("ijn,in->jn", found[:, :, self.slot[own]], leave[:, own])
            leave[:, before] = back / (back * ends[:, before]).sum(axis=0)
        return leave


def forward(model: Model, r: Ragged, keep: bool = False):
    """Log10 of the likelihood ratio of every document; with ``keep`` what ``expected`` needs, too.

    States are rows and pieces columns, so that every step is a few operations on
    long rows.  Kept values are in single precision; they are scaled at every position.
    """
    kind = np.float32 if keep else np.float64
    ratio, move = np.ascontiguousarray(model.ratio.T, kind), np.ascontiguousarray(model.move.T, kind)
    found = r.transfers(ratio, move)
    a, ends = r.entering(model.start.astype(kind), move, found)
    emissions = np.take(ratio, r.classes, axis=1) if keep else None
    values, scales = np.empty_like(emissions) if keep else None, np.empty(len(r.classes), kind)
    for t in range(len(r.active)):
        own = r.at(t)
        e = emissions[:, own] if keep else np.take(ratio, r.classes[own], axis=1)
        a = np.multiply(e, move @ a[:, : r.active[t]] if t else a, out=values[:, own] if keep else e)
        a /= np.add.reduce(a, 0, None, scales[own])
    logs = np.bincount(r.document, np.log10(scales, dtype=np.float64), r.documents)
    return (logs, values, emissions, scales, r.leaving(ends, move, found), ends) if keep else logs


def expected(model: Model, r: Ragged):
    """Expected starts, moves and emissions (forward-backward), and the log10 likelihood ratio."""
    logs, alpha, emissions, scales, leave, ends = forward(model, r, keep=True)
    k = len(model.start)
    move = model.move.astype(np.float32)
    moves, emitted = np.zeros((k, k)), np.empty((len(model.ratio), k))
    back = np.empty((k, 0), np.float32)
    for t in range(len(r.active) - 1, -1, -1):
        own, n, on = r.at(t), r.active[t], back.shape[1]  # on: pieces that go on after this position
        g, b = alpha[:, own], move @ back
        moves += g[:, :on] @ back.T
        if on < n:
            b = np.concatenate([b, leave[:, on:n]], axis=1)
        g *= b  # from here on the state's share at this position
        b /= scales[own]
        back = np.multiply(b, emissions[:, own], out=b)
    for own in r.waves:  # moves from one piece to the next
        moves += ends[:, r.before[own]] @ back[:, own].T
    for s in range(k):
        emitted[:, s] = np.bincount(r.classes, alpha[s], len(emitted))
    first = np.zeros(k)
    if len(r.active):
        heads = np.ones(r.active[0], dtype=bool)
        for own in r.waves:
            heads[own] = False
        first = alpha[:, r.at(0)][:, heads].sum(axis=1, dtype=float)
    return first, moves * model.move, emitted, logs.sum()


def _documents(row: dict, keep: np.ndarray | None, classes: np.ndarray, end: int = END):
    """Class sequences of a block's documents, each closed by the end."""
    lengths, body = unpack_lists(row["codes"])
    codes = np.frombuffer(body, np.int32)
    ends = np.cumsum(lengths + 1) - 1
    out = np.full(len(codes) + len(lengths), end, dtype=np.int64)
    word = np.ones(len(out), dtype=bool)
    word[ends] = False
    out[word] = classes[codes]
    if keep is not None:
        out, lengths = out[np.repeat(keep, lengths + 1)], lengths[keep]
    return out, lengths + 1


def _block_ratios(model: Model, kinds: np.ndarray, stored: list) -> np.ndarray:
    """Per state the ratios of a block's words, of the unknown word and of the end."""
    own = model.ratio[kinds]
    if model.norm is not None and stored:
        own = np.concatenate([stretched(x, len(model.start)) for x in stored]) / model.norm
    return np.concatenate([own, model.ratio[[UNKNOWN, END]]])


def _expect_words(sent):
    """Of one block the expected counts of its words, bucket by bucket, and in a row without bucket the rest."""

    def run(left, right):
        model, rows = sent.value, []
        answers = zip(*(right[c].to_pylist() for c in ("start", "bucket", "ratios")))
        answers = sorted(answers, key=lambda x: x[0])
        for row in left.to_pylist():
            kinds = np.frombuffer(zstandard.decompress(row["classes"]), np.uint16)
            n = len(kinds)
            classes, lengths = _documents(row, ~np.frombuffer(row["held"], bool), np.arange(n), n + 1)
            if not len(lengths):
                continue
            ratio = _block_ratios(model, kinds, [x for _, _, x in answers])
            first, moves, emitted, logs = expected(replace(model, ratio=ratio), Ragged(classes, lengths))
            head = np.concatenate([first, moves.ravel(), [logs], emitted[n + 1]])
            rows.append((row["block"], -1, 0, head.tobytes(), None))
            for (a, bucket, _), b in zip(answers, [*[x[0] for x in answers[1:]], n]):
                rows.append((row["block"], bucket, a, squeezed(emitted[a:b]), kinds[a:b].tobytes()))
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(SUMS)})

    return run


SUMS = [("block", pa.int64()), ("bucket", pa.int64()), ("start", pa.int64()), ("sums", pa.binary()), ("classes", pa.binary())]


def _profile(states: int):
    """A task's sums per class, from those of its words."""

    def run(batches):
        emitted, head = np.zeros((CELLS, states)), None
        for batch in batches:
            for bucket, sums, kinds in zip(*(batch.column(c).to_pylist() for c in ("bucket", "sums", "classes"))):
                if bucket < 0:
                    head = np.frombuffer(sums, np.float64) + (0 if head is None else head)
                else:
                    own, kinds = stretched(sums, states), np.frombuffer(kinds, np.uint16)
                    for s in range(states):
                        emitted[:, s] += np.bincount(kinds, own[:, s], CELLS)
        parts = [(i, emitted[i : i + CHUNK]) for i in range(0, CELLS, CHUNK) if emitted[i : i + CHUNK].any()]
        parts += [] if head is None else [(-1, head)]
        yield pa.RecordBatch.from_pydict(
            {"chunk": pa.array([i for i, _ in parts], pa.int64()), "sums": pa.array([x.tobytes() for _, x in parts], pa.binary())}
        )

    return run


def _renew(sent):
    """New ratios of one bucket's words for every block that holds them; before division by the norm."""

    def run(left, right):
        raw, weight, n = sent.value
        packed = next(i for i, x in enumerate(left["total"].to_pylist()) if x is not None)
        total = np.frombuffer(zstandard.decompress(left["total"][packed].as_py()), np.int64)
        kinds = np.frombuffer(zstandard.decompress(left["kinds"][packed].as_py()), np.uint16)
        index = {
            x[:2]: np.frombuffer(zstandard.decompress(x[2]), np.int32)
            for x in zip(*(left[c].to_pylist() for c in ("block", "start", "index")))
        }
        sums = np.zeros((len(total), len(weight)))
        for block, start, own in zip(*(right[c].to_pylist() for c in ("block", "start", "sums"))):
            sums[index[block, start]] += stretched(own, len(weight))  # a block's words differ
        ratio = (sums / weight + WORD_PRIOR * raw[kinds]) / (sums.sum(axis=1, keepdims=True) + WORD_PRIOR)
        ratio = stretched(squeezed(ratio), len(weight))
        known = total > 0
        norm = ((total[known, None] + 1.0) * ratio[known]).sum(axis=0) / n
        return pa.table(
            {
                "block": pa.array([b for b, _ in index], pa.int64()), "bucket": left["bucket"].combine_chunks(),
                "start": pa.array([a for _, a in index], pa.int64()),
                "ratios": pa.array([squeezed(ratio[i]) for i in index.values()], pa.binary()),
                "norm": pa.array([norm.tolist(), *[[]] * (len(index) - 1)], pa.list_(pa.float64())),
            }
        )

    return run


def _expect(sent):
    def run(batches):
        model, total = sent.value, None
        for batch in batches:
            for row in batch.to_pylist():
                kinds = np.frombuffer(zstandard.decompress(row["classes"]), np.uint16).astype(np.int64)
                classes, lengths = _documents(row, ~np.frombuffer(row["held"], bool), kinds)
                if not len(lengths):
                    continue
                found = expected(model, Ragged(classes, lengths))
                total = found if total is None else [x + y for x, y in zip(total, found)]
        if total is not None:
            first, moves, emitted, logs = total
            head = np.concatenate([first, moves.ravel(), [logs]])
            parts = [(-1, head), *[(i, emitted[i : i + CHUNK].ravel()) for i in range(0, CELLS, CHUNK)]]
            yield pa.RecordBatch.from_pydict(
                {"chunk": pa.array([i for i, _ in parts], pa.int64()),
                 "sums": pa.array([x.astype(np.float64).tobytes() for _, x in parts], pa.binary())}
            )

    return run


def _add(table: pa.Table) -> pa.Table:
    rows = [np.frombuffer(x, np.float64) for x in table["sums"].to_pylist()]
    return pa.table({"chunk": table["chunk"].combine_chunks()[:1], "sums": pa.array([np.sum(rows, axis=0).tobytes()], pa.binary())})


def _begin(share: np.ndarray, tokens: int, types: int, ends: int, states: int) -> Model:
    rng = np.random.default_rng(SEED)
    ratio = np.exp(NOISE * rng.standard_normal((CELLS, states)))
    ratio[END] = 1.0
    ratio /= (share[:, None] * ratio).sum(axis=0)
    if not ends:  # nothing to learn from: the plain unigram
        ratio[:] = 1.0
    move = np.full((states, states), (1 - STAY) / max(states - 1, 1))
    np.fill_diagonal(move, STAY if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, ratio, tokens, types, ends)


def _class_ratios(emitted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ratios of the classes, not yet adding up to 1, and the share of every state."""
    weight = (emitted.sum(axis=0) + 1) / (emitted.sum() + emitted.shape[1])
    return (emitted + PRIOR * weight) / (emitted.sum(axis=1, keepdims=True) + PRIOR) / weight, weight


def _moved(model: Model, first: np.ndarray, moves: np.ndarray, ratio: np.ndarray, norm: np.ndarray | None = None) -> Model:
    states = len(first)
    return replace(
        model, start=(first + 1) / (first.sum() + states), move=(moves + 1) / (moves.sum(axis=1, keepdims=True) + states),
        ratio=ratio, norm=norm,
    )


def _gathered(sums: DataFrame) -> dict[int, np.ndarray]:
    added = sums.groupBy("chunk").applyInArrow(_add, "chunk long, sums binary")
    return {r["chunk"]: np.frombuffer(r["sums"], np.float64) for r in added.collect()}


def train(blocks: DataFrame, share: np.ndarray, tokens: int, types: int, ends: int,
          states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """Baum-Welch over all training documents by classes only; also the log10 likelihood ratio before each round.

    ``share`` is the unigram probability of every class.  Each round tasks add up
    expected counts, which are summed per range of classes; the sums, one number per
    class and state, reach the driver.
    """
    spark, model, history = blocks.sparkSession, _begin(share, tokens, types, ends, states), []
    for _ in range(rounds if ends else 0):
        summed = _gathered(blocks.select("held", "codes", "classes").mapInArrow(
            _expect(spark.sparkContext.broadcast(model)), "chunk long, sums binary"
        ))
        head = summed.pop(-1)
        emitted = np.concatenate([summed[i] for i in sorted(summed)]).reshape(CELLS, states)
        first, moves = head[:states], head[states:-1].reshape(states, states)
        history.append(float(head[-1]))
        ratio, _ = _class_ratios(emitted)
        model = _moved(model, first, moves, ratio / (share[:, None] * ratio).sum(axis=0))
    return model, history


def train_words(blocks: DataFrame, counted: DataFrame, share: np.ndarray, tokens: int, types: int, ends: int,
                states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, DataFrame, list[float]]:
    """Baum-Welch with a ratio for every distinct word; also these, per block and bucket, and the history as in ``train``.

    Each round a block gives the expected counts of its words to their buckets, and
    a bucket gives the new ratios back; where both tables are bucketed (``_bucketed``),
    nothing else is shuffled.  The driver gets one number per class and
    state (the prior of rare words) and one per state (the norm).
    """
    spark, model, history = blocks.sparkSession, _begin(share, tokens, types, ends, states), []
    ratios, paths = counted.select("block", "bucket", "start", F.lit(None).cast("binary").alias("ratios")), []

    def stored(df: DataFrame, label: str) -> DataFrame:
        paths.append(scratch_path(spark, label))
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    def old(used: list[str]) -> None:
        for path in used:
            remove(spark, path)
            paths.remove(path)
        _free(spark)

    own = blocks.select("block", "held", "codes", "classes")
    for _ in range(rounds if ends else 0):
        sums = stored(
            own.groupBy("block").cogroup(ratios.select("block", "bucket", "start", "ratios").groupBy("block")).applyInArrow(
                _expect_words(spark.sparkContext.broadcast(model)), "block long, bucket long, start long, sums binary, classes binary"
            ),
            "sums",
        )
        old(paths[:-1])  # the ratios are used up
        summed = _gathered(sums.select("bucket", "sums", "classes").mapInArrow(_profile(states), "chunk long, sums binary"))
        head = summed.pop(-1)
        emitted = np.zeros((CELLS, states))
        for i, x in summed.items():
            emitted[i : i + CHUNK] = x.reshape(-1, states)
        emitted[END] = head[-states:]
        history.append(float(head[-states - 1]))
        raw, weight = _class_ratios(emitted)
        ratios = stored(
            counted.select("block", "bucket", "start", "index", "total", "kinds").groupBy("bucket").cogroup(
                sums.filter("bucket >= 0").select("block", "bucket", "start", "sums").groupBy("bucket")
            ).applyInArrow(
                _renew(spark.sparkContext.broadcast((raw, weight, tokens + types + 1.0))),
                "block long, bucket long, start long, ratios binary, norm array<double>",
            ),
            "ratios",
        )
        norm = np.array(ratios.agg(*[F.sum(F.get("norm", F.lit(i))) for i in range(states)]).first(), dtype=float)
        norm = np.nan_to_num(norm) + (share[[UNKNOWN, END], None] * raw[[UNKNOWN, END]]).sum(axis=0)
        first, moves = head[:states], head[states : -states - 1].reshape(states, states)
        model = _moved(model, first, moves, raw / norm, norm)  # every state's emissions add up to 1
        old(paths[:-1])
    return model, ratios.select("block", "start", "ratios"), history


def _score(sent):
    def run(left, right):
        model, out = sent.value, []
        answers = sorted(zip(*(right[c].to_pylist() for c in ("start", "counts", "ratios"))), key=lambda x: x[0])
        parts = [np.frombuffer(zstandard.decompress(c), np.int64) for _, c, _ in answers if c is not None]
        counts = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        for row in left.to_pylist():
            kinds = np.frombuffer(zstandard.decompress(row["classes"]), np.uint16).astype(np.int64)
            ratio = _block_ratios(model, kinds, [x for _, _, x in answers if x is not None])
            places, end = np.arange(len(kinds)), len(kinds) + 1
            places[counts == 0] = len(kinds)
            classes, lengths = _documents(row, None, places, end)
            word = classes != end
            n, body = unpack_lists(row["codes"])
            codes = np.frombuffer(body, np.int32)
            base = np.full(len(classes), model.unigram(np.array(float(model.ends))))
            known = np.full(len(classes), int(model.ends > 0))
            base[word], known[word] = model.unigram(counts)[codes], (counts > 0)[codes]
            starts = np.cumsum(lengths) - lengths
            base = np.add.reduceat(base, starts)
            docs, nulls = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["nulls"], bool)
            out.append(
                pa.table(
                    {
                        "doc_id": pa.array(docs, mask=nulls), "held_out": np.frombuffer(row["held"], bool),
                        "n_tokens": lengths, "n_known": np.add.reduceat(known, starts),
                        "train_tokens": np.full(len(docs), model.tokens), "base_score": base,
                        "score": base + forward(replace(model, ratio=ratio), Ragged(classes, lengths)),
                    }
                )
            )
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], t) for c, t in SCORES})

    return run


SCORES = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
          ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]


def score_documents(docs: DataFrame, held: Column, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Train on the documents not ``held`` out and score all.

    Takes ``doc_id`` and ``text`` (null: empty).  Tokens are the words split at
    ASCII white space after lower-casing A-Z, then one end.  Returns ``doc_id,
    held_out, n_tokens, n_known, train_tokens, base_score, score``: log10
    probabilities under the add-one unigram (one unknown type) and under the hidden
    Markov model.  Words not seen in training count as the one unknown word.  With
    no training documents both are 0.  Repeated rows are scored and learned each.
    """
    held = F.coalesce(held, F.lit(False))
    docs = docs.select(docs["doc_id"], docs["text"], held.alias("held"))
    spark, parts, path = docs.sparkSession, partitions(docs), scratch_path(docs.sparkSession, "coded")
    docs.mapInArrow(_code(4 * parts), _DDL).write.parquet(path)
    coded = spark.read.schema(_DDL).parquet(path)
    blocks = coded.filter("bucket < 0").select("block", "trained", "docs", "nulls", "held", "codes", "classes")
    blocks = _bucketed(blocks.repartition(parts, "block"), "block", parts)
    words = coded.filter("bucket >= 0").select("bucket", "block", "start", "words", "counts", "classes")
    counted = _bucketed(words.groupBy("bucket").applyInArrow(_count, COUNTED), "bucket", parts)
    remove(spark, path)
    _free(spark)
    ends = blocks.agg(F.sum("trained")).first()[0] or 0
    sums = counted.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
    tokens, types = (sums["n"] or 0) + ends, (sums["v"] or 0) + (ends > 0)
    share = np.zeros(CELLS)
    masses = counted.select(F.explode("mass").alias("m")).groupBy("m.class").agg(F.sum("m.n").alias("n"))
    for r in masses.collect():  # one number per class
        share[r["class"]] = r["n"]
    share[UNKNOWN], share[END] = 1.0, ends + 1.0 if ends else 0.0
    share /= tokens + types + 1.0
    model, ratios, _ = train_words(blocks, counted, share, tokens, types, ends, states, rounds)
    sent = spark.sparkContext.broadcast(model)
    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    answers = counted.select("block", "start", "counts", F.lit(None).cast("binary").alias("ratios")).union(
        ratios.select("block", "start", F.lit(None).cast("binary").alias("counts"), "ratios")
    )
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(sent), ddl)


def op1_hmm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
