import collections
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from oddline.llm import exact_dedup, near_dedup as nd
from oddline.llm.common import components
from tests.llm.conftest import rows

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_exact(data):
    groups = collections.defaultdict(list)
    for i, t, *_ in data:
        groups[(t or "").translate(UP)].append(i)
    return {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


@pytest.mark.parametrize("fan_in", [2, 8])
def test_exact(odd, fan_in):
    found = {r[0]: tuple(r)[1:] for r in exact_dedup.exact_dedup(odd, fan_in=fan_in).collect()}
    assert found == brute_exact(rows())


def test_exact_smallest_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(5, "a"), (5, "a"), (2, "A"), (None, "a"), (None, None)], "doc_id long, text string")
    found = exact_dedup.exact_dedup(docs).collect()
    assert sorted((r.keep_id, r.group_size) for r in found if r.group_size == 4) == [(5, 4)] * 4
    assert sum(r.kept for r in found) == 2
    kept = exact_dedup.exact_stage(spark, docs, "").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(5, "a"), (None, "a"), (None, None)], key=str)
    assert {r.keep_id for r in exact_dedup.exact_dedup(docs.filter("doc_id > 0"), "smallest").collect()} == {2}


def test_empty(no_rows):
    assert exact_dedup.exact_dedup(no_rows).collect() == []
    assert nd.near_dedup(no_rows).collect() == []


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_near(data, k, percent):
    sets = {i: shingles(t, k) for i, t, *_ in data}
    ids, up = sorted(sets), {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def as_map(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_near_odd(odd, k, percent):
    assert as_map(nd.near_dedup(odd, k, percent)) == brute_near(rows(), k, percent)


def chain(n=60, seed=1):
    """Texts that drift: neighbours are similar, the ends are not; plus exact copies."""
    rng, words, out = np.random.default_rng(seed), [f"w{i}" for i in range(150)], []
    for i in range(n):
        out.append((i, " ".join(words), None, None, None))
        if rng.random() < 0.7:
            words = list(words)
            words[int(rng.integers(len(words)))] = f"n{i}"
        if rng.random() < 0.1:
            words = [f"z{i}_{j}" for j in range(int(rng.integers(2, 150)))]
    return out


@pytest.mark.parametrize("block", [4, 1024])
def test_near_clusters_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK_DOCS", block)
    docs = spark.createDataFrame(chain(), "doc_id long, text string, a string, b string, c string")
    assert as_map(nd.near_dedup(docs, 3, 90)) == brute_near(chain(), 3, 90)


def test_every_link_is_found(spark):
    data = chain(seed=4)
    docs = spark.createDataFrame([r[:2] for r in data], "doc_id long, text string")
    rule = nd.Rule(3, 90)
    facts = nd.set_facts(docs, rule).cache()
    found = {(min(r), max(r)) for r in nd.links_between(facts, rule, keep_all=True).collect()}
    facts.unpersist()
    first = {}
    for i, t in docs.collect():
        first.setdefault(frozenset(shingles(t, 3)), i)
    ids = sorted(first.items(), key=lambda x: x[1])
    wanted = {
        (i, j) for s, i in ids for t, j in ids
        if i < j and 100 * len(s & t) >= 90 * len(s | t)
    }
    assert found == wanted


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.sampled_from([80, 90]), st.integers(0, 2**32))
def test_linked_sets_share_a_signature(common, a, b, percent, seed):
    rule = nd.Rule(3, percent)
    values = np.unique(np.random.default_rng(seed).integers(0, 2**63, common + a + b, dtype=np.uint64))
    one, two = values[: common + a], np.concatenate([values[:common], values[common + a :]])
    if rule.linked(common, len(one), len(two)):
        s, t = (set(nd.signatures(np.sort(x), rule).tolist()) for x in (one, two))
        assert s & t


def test_size_classes():
    for percent in (80, 90):
        for n in range(1, 400):
            for m in range(n, n * 100 // percent + 1):
                assert nd.size_class(m, percent) - nd.size_class(n, percent) in (0, 1)


@pytest.mark.parametrize("order", [1, -1])
def test_texts_of_one_id_keep_their_links(spark, order):
    """Two texts share the id 5; each has a near copy, and both copies find it."""
    a, b = (" ".join(f"{s}{i}" for i in range(60)) for s in "ab")
    data = [(5, a), (5, b), (9, a + " more"), (10, b + " more"), (11, "alone")][::order]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    found = {(r.doc_id, r.component_id) for r in nd.near_dedup(docs).collect()}
    assert found == {(5, 5), (9, 5), (10, 5), (11, 11)}
    kept = nd.near_stage(spark, docs, "").collect()
    assert {(r.doc_id, r.text) for r in kept} == {(5, a), (5, b), (11, "alone")}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}


def test_planted_copies_on_the_tables(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    data = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    assert as_map(nd.op7_ngram_jaccard_join(spark, sf)) == brute_near(data, 3, 90)
