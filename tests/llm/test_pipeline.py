import numpy as np

import corpus_pipeline
from oddline.llm import language_id, packing
from tests.llm.test_dedup import brute_exact, brute_near


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    left = {r.doc_id: r.text for r in docs if any(c.isalpha() for c in r.text or "")}
    exact = brute_exact(list(left.items()))
    left = {i: t for i, t in left.items() if exact[i][2]}
    near = brute_near(list(left.items()), 5, 80)
    left = {i for i in left if near[i][1] == i}
    found = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in found} == left
    part = [r.length for r in found if r.length < 2048]
    bound = packing.lower_bound(np.bincount(part, minlength=2049), 2048) + len(found) - len(part)
    assert len({r.sequence_id for r in found}) <= bound + 1


def test_stages_keep_the_columns(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, "")
        assert kept.columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "best_fit_packing"]


def test_rejected_languages_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(50)
    junk = spark.createDataFrame([(10**9, None), (10**9 + 1, "123 ---")], "doc_id long, text string")
    both = docs.unionByName(junk, allowMissingColumns=True)
    kept = {r.doc_id for r in language_id.language_stage(spark, both, sf).collect()}
    assert kept == {r.doc_id for r in docs.collect()}
