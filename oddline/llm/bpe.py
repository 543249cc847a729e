"""Byte-level BPE by a table of distinct words.

The words of all texts are split off in tasks, every distinct word is encoded
once, and its ids come back to the block of documents it was asked from, where
they are put in place by word position.  Decoding joins ids with the id-to-piece table.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from oddline.llm.common import columns, partitions, slices, text_bytes

# Fixed value: the published splitting pattern of this kind of vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_BYTES = 8 << 20  # text of the documents that ask for words together
STEP_WORDS = 1 << 17  # words or ids handled as objects or in wide arrays at once
SEED = 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself if printable, else from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """A tokenizers file of a byte-level BPE whose ids follow the order of merges."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        letters = _byte_letters()
        added = {t["content"]: t["id"] for t in data["added_tokens"]}
        ranks = {
            bytes(letters[c] for c in piece): i for piece, i in data["model"]["vocab"].items() if piece not in added
        }
        self.special = {k.encode(): v for k, v in added.items()}
        self.pieces = [b""] * (max([*ranks.values(), *added.values()]) + 1)
        for piece, i in [*ranks.items(), *self.special.items()]:
            self.pieces[i] = piece
        self._allowed = set(added)
        self._encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self._split = regex.compile(PATTERN)
        self._cut = regex.compile("(" + "|".join(regex.escape(s) for s in added) + ")") if added else None

    def encode(self, text: str) -> list[int]:
        """Ids of a text; the string of a special token is that token."""
        if any(s in text for s in self._allowed):
            return self._encoding.encode(text, allowed_special=self._allowed)
        return self._encoding.encode_ordinary(text)

    def words(self, text: str) -> list[str]:
        """The words that are encoded apart from each other; together they are the text."""
        if any(s in text for s in self._allowed):
            out = []
            for i, part in enumerate(self._cut.split(text)):
                out += [part] if i % 2 else self._split.findall(part)
            return out
        return self._split.findall(text)

    def encode_word(self, word: bytes) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        return self._encoding.encode_ordinary(word.decode("utf-8"))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> ByteBPE:
    return ByteBPE(path)


# --- rows that hold many values --------------------------------------------------


def pack_lists(lengths: np.ndarray, body: bytes) -> bytes:
    head = np.asarray(lengths, dtype=np.uint32).tobytes()
    return zstandard.compress(np.uint32(len(lengths)).tobytes() + head + body, 1)


def unpack_lists(packed: bytes) -> tuple[np.ndarray, bytes]:
    plain = zstandard.decompress(packed)
    n = int(np.frombuffer(plain, np.uint32, 1)[0])
    return np.frombuffer(plain, np.uint32, n, 4).astype(np.int64), plain[4 + 4 * n :]


def cut(body: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths)
    return [body[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist())]


def _blocks(batches):
    """Documents in blocks with a number of their own."""
    start = TaskContext.get().partitionId() << 32
    for i, batch in enumerate(slices(batches, BLOCK_BYTES)):
        yield start + i, batch


class BlockWords:
    """The distinct words of a block, in buckets, and the word at every position."""

    def __init__(self, texts: list[bytes], bpe: ByteBPE, buckets: int):
        lengths, parts, some = [], [], []
        for i, text in enumerate(texts):
            own = bpe.words(text.decode("utf-8"))
            lengths.append(len(own))
            some += own
            if len(some) >= STEP_WORDS or i == len(texts) - 1:  # few words at a time as objects
                parts.append(pa.array(some, pa.string()))
                some = []
        self.lengths = np.array(lengths, dtype=np.int64)
        coded = pa.chunked_array(parts, pa.string()).dictionary_encode().combine_chunks()
        if isinstance(coded, pa.ChunkedArray):  # no rows
            coded = pa.array([], pa.string()).dictionary_encode()
        self.codes = coded.indices.to_numpy()
        self.words = coded.dictionary.cast(pa.binary()).to_pylist()
        hashes = np.array([xxhash.xxh3_64_intdigest(w, SEED) for w in self.words], dtype=np.uint64)
        # Order by bucket and hash: the same words come in the same order wherever they are split.
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((hashes, bucket))
        starts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else order
        self.parts = {int(bucket[own[0]]): own for own in np.split(order, starts[1:]) if len(own)}

    def packed(self, bucket: int) -> bytes:
        own = [self.words[i] for i in self.parts[bucket]]
        return pack_lists(np.array([len(w) for w in own]), b"".join(own))


def _ask(path: str, buckets: int):
    def run(batches):
        bpe = vocabulary(path)
        for block, batch in _blocks(batches):
            found = BlockWords(text_bytes(batch.column("text")), bpe, buckets)
            for bucket in found.parts:
                yield pa.RecordBatch.from_pydict(
                    {"bucket": [bucket], "block": [block], "words": pa.array([found.packed(bucket)], pa.binary())}
                )

    return run


def _answer(path: str):
    """Encode the distinct words of one bucket, each once."""

    def run(table):
        bpe, known, answers = vocabulary(path), {}, []
        for packed in table["words"].to_pylist():
            lengths, body = unpack_lists(packed)
            ids = []
            for word in cut(body, lengths):
                if word not in known:
                    known[word] = bpe.encode_word(word)
                ids.append(known[word])
            flat = np.array([i for w in ids for i in w], dtype=np.uint32)
            answers.append(pack_lists(np.array([len(w) for w in ids]), flat.tobytes()))
        check = [xxhash.xxh3_64_intdigest(unpack_lists(p)[1]) >> 1 for p in table["words"].to_pylist()]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "check": check,
                         "ids": pa.array(answers, pa.binary())})

    return run


def _bundle(batches):
    for block, batch in _blocks(batches):
        texts = text_bytes(batch.column("text"))
        ids = batch.column("doc_id")
        yield pa.RecordBatch.from_pydict(
            {
                "block": [block],
                "docs": pa.array([ids.fill_null(0).to_numpy(zero_copy_only=False).tobytes()], pa.binary()),
                "nulls": pa.array([ids.is_null().to_numpy(zero_copy_only=False).tobytes()], pa.binary()),
                "texts": pa.array([pack_lists(np.array([len(t) for t in texts]), b"".join(texts))], pa.binary()),
            }
        )


def _place(path: str, buckets: int):
    """Put the ids of the words at their positions."""

    def run(left, right):
        bpe = vocabulary(path)
        docs, out = [], []
        answers = dict(zip(zip(right["block"].to_pylist(), right["bucket"].to_pylist()),
                           zip(right["check"].to_pylist(), right["ids"].to_pylist())))
        for row in left.to_pylist():
            ids, nulls = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["nulls"], bool)
            lengths, body = unpack_lists(row["texts"])
            found = BlockWords(cut(body, lengths), bpe, buckets)
            sizes, parts = np.zeros(len(found.words), dtype=np.int64), []
            for bucket, own in found.parts.items():
                check, packed = answers.get((row["block"], bucket), (None, None))
                if check == xxhash.xxh3_64_intdigest(b"".join(found.words[i] for i in own)) >> 1:
                    count, flat = unpack_lists(packed)
                else:  # the input was split in another way this time
                    again = [bpe.encode_word(found.words[i]) for i in own]
                    count = np.array([len(w) for w in again])
                    flat = np.array([i for w in again for i in w], dtype=np.uint32).tobytes()
                sizes[own] = count
                parts.append((own, count, np.frombuffer(flat, np.uint32)))
            starts, at = np.zeros(len(sizes), dtype=np.int64), 0
            for own, count, flat in parts:
                starts[own] = at + np.cumsum(count) - count
                at += len(flat)
            table = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.uint32)
            docs += [None if null else int(i) for i, null in zip(ids, nulls)]
            ends = np.cumsum(found.lengths)
            for own in np.split(np.arange(len(ends)), np.flatnonzero(np.diff(ends // STEP_WORDS)) + 1):
                if not len(own):
                    continue
                codes = found.codes[ends[own[0]] - found.lengths[own[0]] : ends[own[-1]]]
                size = sizes[codes]
                upto = np.r_[0, np.cumsum(size)]
                within = np.arange(upto[-1]) - np.repeat(upto[:-1] - starts[codes], size)
                flat = table[within]
                bounds = upto[np.r_[0, np.cumsum(found.lengths[own])]]
                out += [flat[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            del found, table, parts
        pa.default_memory_pool().release_unused()
        return pa.table({"doc_id": pa.array(docs, pa.int64()), "ids": pa.array(out, pa.binary())})

    return run


def encode(docs: DataFrame, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """``doc_id, ids`` of every row; ``ids`` are little-endian unsigned 32-bit numbers.

    Takes ``doc_id`` and ``text``.  A null text is empty and has no ids; an empty
    table gives an empty result; repeated rows are all encoded.  Texts move once,
    compressed; of the words only one copy per block of documents moves.
    """
    path = path or default_vocabulary()
    docs = columns(docs, "doc_id", "text")
    buckets = buckets or 4 * partitions(docs)
    asked = docs.mapInArrow(_ask(path, buckets), "bucket long, block long, words binary")
    answered = asked.groupBy("bucket").applyInArrow(
        _answer(path), "block long, bucket long, check long, ids binary"
    )
    bundles = docs.mapInArrow(_bundle, "block long, docs binary, nulls binary, texts binary")
    return (
        bundles.groupBy("block")
        .cogroup(answered.groupBy("block"))
        .applyInArrow(_place(path, buckets), "doc_id long, ids binary")
    )


def _join_pieces(path: str):
    def run(batches):
        pieces = pa.array(vocabulary(path).pieces, pa.binary())
        sizes = np.diff(np.frombuffer(pieces.buffers()[1], np.int32, len(pieces) + 1)).astype(np.int64)
        for batch in batches:
            texts = []
            for ids in batch.column("ids").to_pylist():
                n = np.frombuffer(ids or b"", np.uint32)
                joined = pieces.take(pa.array(n))
                body = joined.buffers()[2]
                texts.append(body.to_pybytes()[: int(sizes[n].sum())].decode("utf-8", "replace") if body else "")
            yield batch.append_column("decoded", pa.array(texts, pa.string()))
            pa.default_memory_pool().release_unused()

    return run


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds ``decoded``: the pieces of ``ids`` put together; bytes that are no UTF-8 become U+FFFD."""
    path = path or default_vocabulary()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(_join_pieces(path), f"{fields}, decoded string")


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    found = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
