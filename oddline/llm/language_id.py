"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary.
The probability of a word is the sum over all its segmentations into pieces
(forward algorithm); pieces never cross words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from oddline.llm.common import columns, keep_rows, slices
from oddline.session import durable

UNKNOWN = "und"
SAMPLE_ROWS = 10_000  # labelled training rows at most, about; the classifier is fitted on these
ROUNDS = 3
SMOOTHING = 0.1  # expected counts added to every piece
BATCH_BYTES = 4 << 20
STEP_WORDS = 1 << 17  # words handled as objects at once
LONGEST_TRAINED = 32  # letters; longer words are scored, but not learned from
CELLS = 1 << 17  # words times letters computed at once
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
START = "▁"
SLOTS = 20
U64 = np.uint64
BASE, SPREAD = U64(0x100000001B3), U64(0x9E3779B97F4A7C15)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary; finds all pieces that start at one place of many words at once."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) for i in range(n)]
        self.byte = np.zeros(256, dtype=np.int64)
        for i in range(n):
            if model.is_byte(i):
                self.byte[int(model.id_to_piece(i)[3:5], 16)] = i + 1
        self.size = n + 1  # id 0 is no piece
        # Tables addressed by hash; the rare pieces that collide go to the next one.
        self.tables = []
        self.longest = 1
        for i in range(n):
            piece = model.id_to_piece(i)
            if special[i] or not piece:
                continue
            self.longest = max(self.longest, len(piece))
            h = U64(0)
            with np.errstate(over="ignore"):
                for c in piece:
                    h = h * BASE + U64(ord(c) + 1)
                slot = int((h * SPREAD) >> U64(64 - SLOTS))
            level = 0
            while level < len(self.tables) and self.tables[level][1][slot]:
                level += 1
            if level == len(self.tables):
                self.tables.append((np.zeros(1 << SLOTS, dtype=U64), np.zeros(1 << SLOTS, dtype=np.int64)))
            self.tables[level][0][slot], self.tables[level][1][slot] = h, i + 1

    def find(self, h: np.ndarray) -> np.ndarray:
        slot = ((h * SPREAD) >> U64(64 - SLOTS)).astype(np.int64)
        out = np.zeros(len(h), dtype=np.int64)
        for key, ids in self.tables:
            out += np.where(key[slot] == h, ids[slot], 0)  # a hash stands in one table only
        return out

    def lattice(self, words: list[str]):
        """``(start, length, ids)`` of all pieces of words of equal length, and extra rows for foreign letters.

        A letter that is no piece is written in bytes: its id counts on from
        ``size`` and stands for the pieces of its bytes.
        """
        width = len(words[0])
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, width)
        codes = letters.astype(U64) + U64(1)
        found, extra = [], {}
        for i in range(width):
            h = np.zeros(len(words), dtype=U64)
            for length in range(1, min(self.longest, width - i) + 1):
                h = h * BASE + codes[:, i + length - 1]
                ids = self.find(h)
                if length == 1:
                    for at in np.flatnonzero(ids == 0).tolist():
                        ids[at] = extra.setdefault(int(letters[at, i]), self.size + len(extra))
                elif not ids.any():
                    continue
                found.append((i, length, ids))
        return found, [self.byte[np.frombuffer(chr(c).encode("utf-8", "replace"), np.uint8)] for c in extra]


@lru_cache(maxsize=4)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def _table(probability: np.ndarray, extra: list[np.ndarray]) -> np.ndarray:
    """Probabilities by id: none for "no piece", the product of its bytes for a foreign letter."""
    return np.vstack(
        [np.zeros_like(probability[:1]), probability[1:], *[probability[ids].prod(axis=0)[None] for ids in extra]]
    )


def _by_length(words: list[str]):
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    bounds = np.flatnonzero(np.diff(lengths[order])) + 1
    for own in np.split(order, bounds):
        step = max(1, CELLS // max(int(lengths[own[0]]), 1))
        for at in range(0, len(own), step):
            yield own[at : at + step]


def log_likelihoods(words: list[str], probability: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Natural log of every word's probability, one column per language."""
    marked = [START + w for w in words]
    out = np.zeros((len(words), probability.shape[1]))
    if not words:
        return out
    for own in _by_length(marked):
        group = [marked[i] for i in own]
        width = len(group[0])
        found, extra = pieces.lattice(group)
        table = _table(probability, extra)
        alpha = np.zeros((width + 1, len(group), probability.shape[1]))
        alpha[0], scale, at = 1.0, np.zeros(alpha.shape[1:]), -1
        for i, length, ids in found:
            if i != at:
                at = i
                if i and i % 8 == 0:  # keeps long words from underflow
                    scale += np.log(alpha[i])
                    alpha[i + 1 : i + pieces.longest] /= alpha[i]
                    alpha[i] = 1.0
            alpha[i + length] += alpha[i] * table[ids]
        out[own] = np.log(alpha[width]) + scale
    return out


def expected_counts(words: list[str], n: np.ndarray, probability: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Expected number of uses of every piece in ``n`` copies of each word (forward-backward)."""
    counts = np.zeros(pieces.size)
    marked = [START + w for w in words]
    for own in _by_length(marked):
        group = [marked[i] for i in own]
        width, weight = len(group[0]), n[own].astype(float)
        found, extra = pieces.lattice(group)
        table = _table(probability[:, None], extra)[:, 0]
        alpha = np.zeros((width + 1, len(group)))
        beta = np.zeros_like(alpha)
        alpha[0] = beta[width] = 1.0
        for i, length, ids in found:
            alpha[i + length] += alpha[i] * table[ids]
        for i, length, ids in reversed(found):
            beta[i] += table[ids] * beta[i + length]
        ok = alpha[width] > 0
        per = np.where(ok, weight / np.where(ok, alpha[width], 1.0), 0.0)
        for i, length, ids in found:
            use = alpha[i] * table[ids] * beta[i + length] * per
            counts += np.bincount(np.minimum(ids, pieces.size), use, pieces.size + 1)[: pieces.size]
            for k, row in enumerate(extra):
                amount = use[ids == pieces.size + k].sum()
                if amount:
                    np.add.at(counts, row, amount)
    counts[0] = 0.0
    return counts


def words_of(texts: pa.Array) -> tuple[pa.ChunkedArray, np.ndarray]:
    """Lower-cased words of all texts, and how many each has."""
    parts, some, lengths = [], [], []
    for text in texts:
        found = WORD.findall(text.as_py().lower()) if text.is_valid else []
        lengths.append(len(found))
        some += found
        if len(some) >= STEP_WORDS:
            parts.append(pa.array(some, pa.string()))
            some = []
    parts.append(pa.array(some, pa.string()))
    return pa.chunked_array(parts), np.array(lengths, dtype=np.int64)


def _word_counts(batches):
    for batch in slices(batches, BATCH_BYTES):
        words, lengths = words_of(batch.column("text"))
        langs = batch.column("lang").take(pa.array(np.repeat(np.arange(len(lengths)), lengths)))
        table = pa.table({"lang": langs, "word": words})
        counted = table.group_by(["lang", "word"]).aggregate([([], "count_all")])
        yield from counted.rename_columns(["lang", "word", "n"]).select(["lang", "word", "n"]).to_batches()


def _expect(path: str, langs: list[str], probability):
    def run(batches):
        pieces, table = pieces_of(path), probability.value
        for batch in batches:
            lang = np.array(batch.column("lang").to_pylist(), dtype=object)
            words = np.array(batch.column("word").to_pylist(), dtype=object)
            n = batch.column("n").to_numpy(zero_copy_only=False)
            for k, name in enumerate(langs):
                own = lang == name
                if own.any():
                    counts = expected_counts(words[own].tolist(), n[own], table[:, k], pieces)
                    used = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_pydict(
                        {"lang": pa.array(np.full(len(used), k)), "piece": pa.array(used), "n": pa.array(counts[used])}
                    )

    return run


class LanguageModel:
    """Languages, their log shares, and one column of piece probabilities each."""

    def __init__(self, langs: list[str], prior: np.ndarray, probability: np.ndarray, path: str):
        self.langs, self.prior, self.probability, self.path = langs, prior, probability, path


def fit(labelled: DataFrame, path: str | None = None, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> LanguageModel:
    """Learn piece probabilities from ``doc_id, text, lang`` by expectation maximisation.

    At most about ``sample_rows`` rows, drawn by hash of ``doc_id``, are used.
    What reaches the driver is one number per piece and language.
    """
    path = path or default_vocabulary()
    spark = labelled.sparkSession
    labelled = columns(labelled, "doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL")
    shares = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs, pieces = sorted(shares), pieces_of(path)
    total = sum(shares.values())
    probability = np.full((pieces.size, len(langs)), 1.0 / pieces.size)
    prior = np.log([(shares[k] + 1) / (total + len(langs)) for k in langs]) if langs else np.zeros(0)
    if langs:
        place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30))
        sample = labelled.filter(place < int((1 << 30) * min(1.0, sample_rows / total)))
        counted = sample.select("text", "lang").mapInArrow(_word_counts, "lang string, word string, n long")
        words = durable(
            counted.filter(F.length("word") <= LONGEST_TRAINED).groupBy("lang", "word").agg(F.sum("n").alias("n")),
            "words",
        )
        for _ in range(rounds):
            sent = spark.sparkContext.broadcast(probability)  # pieces times languages
            found = words.mapInArrow(_expect(path, langs, sent), "lang long, piece long, n double")
            summed = found.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
            counts = np.full(probability.shape, SMOOTHING)
            counts[summed["piece"].to_numpy(int), summed["lang"].to_numpy(int)] += summed["n"].to_numpy(float)
            counts[0] = 0.0
            probability = counts / counts.sum(axis=0)
    return LanguageModel(langs, prior, probability, path)


def _predict(langs: list[str], path: str, sent):
    def run(batches):
        prior, probability = sent.value
        pieces = pieces_of(path)
        for batch in slices(batches, BATCH_BYTES):
            words, lengths = words_of(batch.column("text"))
            total = np.tile(prior, (len(lengths), 1))
            if len(words) and langs:
                coded = words.dictionary_encode().combine_chunks()
                logs = log_likelihoods(coded.dictionary.to_pylist(), probability, pieces)
                filled = np.flatnonzero(lengths)
                starts = (np.cumsum(lengths) - lengths)[filled]
                total[filled] += np.add.reduceat(logs[coded.indices.to_numpy()], starts, axis=0)
            known = (lengths > 0) & bool(langs)
            if langs:
                best = total.argmax(axis=1)
                share = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            names = [langs[best[i]] if ok else UNKNOWN for i, ok in enumerate(known)]
            score = [float(share[i]) if ok else 0.0 for i, ok in enumerate(known)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "lang_pred": pa.array(names, pa.string()),
                    "score": pa.array(score, pa.float64()),
                }
            )

    return run


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row; ``score`` is the language's share of the probability.

    Only ``text`` decides.  A null text, or one without letters, is ``und`` with
    score 0; so is every text if nothing was learned.  Ties go to the first
    language by name.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.prior, model.probability))
    return columns(docs, "doc_id", "text").mapInArrow(
        _predict(model.langs, model.path, sent), "doc_id long, lang_pred string, score double"
    )


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def training(docs: DataFrame) -> DataFrame:
    return docs.filter(~F.coalesce(held_out(), F.lit(False)))


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a recognisable language go."""
    found = predict(docs, fit(training(docs)))
    return keep_rows(docs, found.filter(F.col("lang_pred") != UNKNOWN))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs, fit(training(docs)))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
