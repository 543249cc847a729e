"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from oddline.llm import (
    bpe, exact_dedup, fill_middle, hmm, kd_shards, language_id, licenses, line_dedup, near_dedup, packing, vector_codes,
    warc, winnowing,
)


def queries() -> dict:
    functions = [
        hmm.op1_hmm,
        kd_shards.op2_kd_shards,
        language_id.op3_language_id,
        packing.op4_best_fit_packing,
        warc.op5_warc,
        licenses.op6_license_scan,
        near_dedup.op7_ngram_jaccard_join,
        bpe.op8_bpe,
        winnowing.op9_winnowing,
        exact_dedup.op10_exact_dedup,
        line_dedup.op11_line_dedup,
        vector_codes.op12_vector_codes,
        fill_middle.op13_fill_middle,
    ]
    return {f.__name__: f for f in functions}


def oracle_sql() -> dict[str, str]:
    return {**warc.SQL, **licenses.SQL, **exact_dedup.SQL, **line_dedup.SQL, **vector_codes.SQL, **fill_middle.SQL}
