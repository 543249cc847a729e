import collections
import math
import zlib
from functools import lru_cache

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from oddline.llm import hmm, language_id as li
from tests.llm.conftest import rows


# --- language identification -----------------------------------------------------


def brute_word(word, table, pieces, known):
    @lru_cache(None)
    def of(i):
        if i == len(word):
            return 1.0
        total = 0.0
        for j in range(i + 1, len(word) + 1):
            if word[i:j] in known:
                total += table[known[word[i:j]]] * of(j)
        if word[i] not in known:
            total += math.prod(table[pieces.byte[b]] for b in word[i].encode()) * of(i + 1)
        return total

    return of(0)


@pytest.fixture(scope="module")
def pieces():
    return li.pieces_of(li.default_vocabulary())


@pytest.fixture(scope="module")
def known(pieces):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=li.default_vocabulary())
    return {
        m.id_to_piece(i): i + 1 for i in range(m.get_piece_size())
        if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))
    }


def test_all_segmentations_are_summed(pieces, known):
    words = ["the", "straße", "internationalisation", "日本語", "a", "ḁbc", "x" * 40]
    table = np.random.default_rng(0).dirichlet(np.ones(pieces.size), 2).T
    found = li.log_likelihoods(words, table, pieces)
    for w, row in zip(words, found):
        for k in range(2):
            assert row[k] == pytest.approx(math.log(brute_word("▁" + w, table[:, k].tolist(), pieces, known)))
    assert np.isfinite(li.log_likelihoods(["q" * 20000], table, pieces)).all()


def test_expectation_counts_letters(pieces):
    words, n = ["hello", "straße", "ḁ"], np.array([2, 1, 3])
    table = np.full(pieces.size, 1.0 / pieces.size)
    counts = li.expected_counts(words, n, table, pieces)
    one = li.log_likelihoods(words, table[:, None], pieces)[:, 0]
    bumped = table.copy()
    used = np.flatnonzero(counts)
    i = int(used[len(used) // 2])  # the derivative of the log likelihood is the expected count
    bumped[i] *= 1 + 1e-6
    gain = (n * (li.log_likelihoods(words, bumped[:, None], pieces)[:, 0] - one)).sum() / 1e-6
    assert counts[i] == pytest.approx(gain, rel=1e-3)


def test_language_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = li.op3_language_id(spark, sf).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.98
    assert found.filter("score < 0 OR score > 1").count() == 0


def test_language_odd(spark, odd, no_rows):
    docs = odd.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").when(F.col("doc_id") % 5 == 0, "fr"))
    model = li.fit(docs)
    found = {r.doc_id: r for r in li.predict(docs, model).collect()}
    assert len(found) == len(rows())
    for i, text, *_ in rows():
        letters = any(c.isalpha() for c in text or "")
        assert (found[i].lang_pred == "und") == (not letters)
    changed = odd.withColumns({"lang": F.lit("xx"), "source": F.lit("q")})
    assert {r.doc_id: r.lang_pred for r in li.predict(changed, model).collect()} == {i: r.lang_pred for i, r in found.items()}
    assert li.predict(no_rows, model).collect() == []
    nothing = li.fit(no_rows)
    assert {(r.lang_pred, r.score) for r in li.predict(odd, nothing).collect()} == {("und", 0.0)}


# --- language model --------------------------------------------------------------


def test_forward_against_all_paths():
    rng = np.random.default_rng(1)
    model = hmm.Model(rng.dirichlet([1, 1]), rng.dirichlet([1, 1], 2), rng.random((hmm.CELLS, 2)) + 0.1, 1, 1, 1)
    lengths = np.array([3, 1, 5])
    classes = rng.integers(0, hmm.CELLS, lengths.sum())
    found = hmm.forward(model, hmm.Ragged(classes, lengths))
    moves = np.zeros((2, 2))
    emitted = np.zeros((hmm.CELLS, 2))
    first = np.zeros(2)
    for n, (start, size) in enumerate(zip(np.cumsum(lengths) - lengths, lengths)):
        seq, total, mine = classes[start : start + size], 0.0, []
        for path in np.ndindex(*[2] * size):
            p = model.start[path[0]] * model.ratio[seq[0], path[0]]
            for t in range(1, size):
                p *= model.move[path[t - 1], path[t]] * model.ratio[seq[t], path[t]]
            total += p
            mine.append((path, p))
        assert found[n] == pytest.approx(math.log10(total))
        for path, p in mine:
            first[path[0]] += p / total
            for t in range(size):
                emitted[seq[t], path[t]] += p / total
                if t:
                    moves[path[t - 1], path[t]] += p / total
    got = hmm.expected(model, hmm.Ragged(classes, lengths))
    for a, b in zip(got[:3], (first, moves, emitted)):
        np.testing.assert_allclose(a, b, rtol=1e-4, atol=1e-6)


def test_pieces_change_nothing():
    rng = np.random.default_rng(2)
    model = hmm.Model(rng.dirichlet([1, 1, 1]), rng.dirichlet([1, 1, 1], 3), rng.random((50, 3)) + 0.1, 1, 1, 1)
    lengths = np.array([1, 40, 7, 8, 9, 5000, 16, 2])
    classes = rng.integers(0, 50, lengths.sum())
    whole, cut = (hmm.Ragged(classes, lengths, p) for p in (10_000, 8))
    assert len(cut.active) == 8
    np.testing.assert_allclose(hmm.forward(model, cut), hmm.forward(model, whole), rtol=1e-9)
    for a, b in zip(hmm.expected(model, cut), hmm.expected(model, whole)):
        np.testing.assert_allclose(a, b, rtol=1e-4, atol=1e-4)
    none = hmm.expected(model, hmm.Ragged(classes[:0], lengths[:0]))
    assert all(not np.any(x) for x in none)


def brute_base(data, held):
    tokens = {i: (t or "").encode().lower().split() + [b""] for i, t, *_ in data}
    c = collections.Counter(w for i, ws in tokens.items() if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return {
        i: (held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        for i, ws in tokens.items()
    }


def check_base(found, wanted):
    assert set(found) == set(wanted)
    for i, (held, n, known, total, base) in wanted.items():
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base)
        assert math.isfinite(r.score) and r.score <= 0


def test_language_model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = {r.doc_id: r for r in hmm.op1_hmm(spark, sf).collect()}
    data = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check_base(found, brute_base(data, lambda i: zlib.crc32(str(i).encode()) % 7 == 2))
    held = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_words_with_one_ending_are_told_apart(spark):
    """Two kinds of documents whose words all end alike, so that they share one class."""
    rng = np.random.default_rng(3)
    data = [(i, " ".join(f"{'ab'[i % 2]}{n}-same" for n in rng.integers(0, 40, 60))) for i in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    found = hmm.score_documents(docs, F.col("doc_id") % 7 == 2).filter("held_out").collect()
    gain = sum(r.score - r.base_score for r in found) / sum(r.n_tokens for r in found)
    assert gain > 0.2  # half the words are ruled out: at most log10(2)


def test_word_emissions_of_a_state_add_up(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.lit(False).alias("held"))
    coded = docs.mapInArrow(hmm._code(4), hmm._DDL).cache()
    blocks = coded.filter("bucket < 0")
    counted = coded.filter("bucket >= 0").groupBy("bucket").applyInArrow(hmm._count, hmm.COUNTED).cache()
    share = np.full(hmm.CELLS, 0.0)
    sums = counted.agg(F.sum("tokens"), F.sum("types")).first()
    ends = docs.count()
    tokens, types = sums[0] + ends, sums[1] + 1
    share[hmm.UNKNOWN], share[hmm.END] = 1 / (tokens + types + 1), (ends + 1) / (tokens + types + 1)
    for r in counted.select(F.explode("mass").alias("m")).select("m.*").collect():
        share[r["class"]] += r["n"] / (tokens + types + 1)
    model, ratios, history = hmm.train_words(blocks, counted, share, tokens, types, ends, rounds=3)
    assert len(history) == 3 and history == sorted(history)
    counts = {(r.block, r.start): np.frombuffer(zstandard.decompress(r.counts), np.int64) for r in counted.collect()}
    rows = {(r.block, r.start): hmm.stretched(r.ratios, hmm.STATES) for r in ratios.collect()}
    assert counts.keys() == rows.keys()
    assert len({b for b, _ in counts}) == 1  # each word once
    total = sum(((counts[k][:, None] + 1.0) * rows[k]).sum(axis=0) for k in rows) / (tokens + types + 1) / model.norm
    total = total + (share[[hmm.UNKNOWN, hmm.END], None] * model.ratio[[hmm.UNKNOWN, hmm.END]]).sum(axis=0)
    np.testing.assert_allclose(total, 1.0, rtol=1e-5)


def test_language_model_odd(odd, no_rows):
    found = {r.doc_id: r for r in hmm.score_documents(odd, F.col("doc_id") % 3 == 0, rounds=2).collect()}
    check_base(found, brute_base(rows(), lambda i: i % 3 == 0))
    none = hmm.score_documents(odd, F.lit(True)).collect()
    assert {(r.base_score, round(r.score, 9) + 0.0, r.n_known, r.train_tokens) for r in none} == {(0.0, 0.0, 0, 0)}
    assert hmm.score_documents(no_rows, F.lit(True)).collect() == []


def test_training_rounds_gain(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.lit(False).alias("held"))
    coded = docs.mapInArrow(hmm._code(4), hmm._DDL).filter("bucket < 0").cache()
    share = np.full(hmm.CELLS, 1.0 / hmm.CELLS)
    _, history = hmm.train(coded, share, 10**6, 10**4, 200, rounds=4)
    assert history == sorted(history)
    coded.unpersist()
