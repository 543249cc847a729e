import collections
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from oddline.llm import bpe, kd_shards, licenses, packing, warc, winnowing as w
from tests.llm.conftest import rows
from workload import check


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def ids(library):
    return {i: library.encode(t or "", add_special_tokens=False).ids for i, t, *_ in rows()}


# --- BPE -------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_words_encode_as_the_text_does(library, text):
    own = bpe.vocabulary(bpe.default_vocabulary())
    wanted = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == wanted
    assert [i for x in own.words(text) for i in own.encode_word(x.encode())] == wanted


def test_every_code_point(library):
    own = bpe.vocabulary(bpe.default_vocabulary())
    texts = [f"a{chr(c)} {chr(c)}{chr(c)}1" for c in range(0, 0x30000) if not 0xD800 <= c < 0xE000]
    for text, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert [i for x in own.words(text) for i in own.encode_word(x.encode())] == e.ids


def test_bpe_round_trip(odd, ids, no_rows):
    found = bpe.decode(bpe.encode(odd, buckets=5)).collect()
    assert {r.doc_id: np.frombuffer(r.ids, np.uint32).tolist() for r in found} == ids
    assert {r.doc_id: r.decoded for r in found} == {i: t or "" for i, t, *_ in rows()}
    assert bpe.decode(bpe.encode(no_rows)).collect() == []


def test_words_without_answer_are_encoded_in_place(ids):
    """A block whose answers are missing, or belong to other words, still gets its ids."""
    texts = [(t or "").encode() for _, t, *_ in rows()]
    number = np.array([i for i, *_ in rows()])
    left = pa.table({
        "block": [3], "docs": [number.tobytes()], "nulls": [np.zeros(len(number), bool).tobytes()],
        "texts": [bpe.pack_lists(np.array([len(t) for t in texts]), b"".join(texts))],
    })
    own = bpe.vocabulary(bpe.default_vocabulary())
    wrong = bpe.BlockWords([b"other words"], own, 2)
    asked = pa.table({"bucket": [0, 1], "block": [3, 3], "words": [wrong.packed(min(wrong.parts)), wrong.packed(max(wrong.parts))]})
    for right in (bpe._answer(bpe.default_vocabulary())(asked), bpe._answer(bpe.default_vocabulary())(asked).slice(0, 0)):
        found = bpe._place(bpe.default_vocabulary(), 2)(left, right)
        got = dict(zip(found["doc_id"].to_pylist(), found["ids"].to_pylist()))
        assert {i: np.frombuffer(v, np.uint32).tolist() for i, v in got.items()} == ids


def test_bpe_bad_bytes(spark):
    table = spark.createDataFrame([(np.array([187], np.uint32).tobytes(),), (None,)], "ids binary")
    assert [r.decoded for r in bpe.decode(table).collect()] == [bytes(bpe.vocabulary(bpe.default_vocabulary()).pieces[187]).decode("utf-8", "replace"), ""]


# --- packing ---------------------------------------------------------------------


def brute_fewest(sizes, capacity):
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[i] <= capacity:
                go(i + 1, [*bins[:b], bins[b] + sizes[i], *bins[b + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_bound_and_best_fit(sizes):
    fewest = brute_fewest(sorted(sizes, reverse=True), 20)
    bound = packing.lower_bound(np.bincount(sizes, minlength=21), 20)
    bins, offsets, fill = packing.best_fit_decreasing(np.array(sizes), 20)
    assert bound <= fewest <= len(fill) and fill.max() <= 20
    for b in range(len(fill)):
        own = sorted((o, s) for o, s, x in zip(offsets, sizes, bins) if x == b)
        assert [o for o, _ in own] == np.r_[0, np.cumsum([s for _, s in own])][:-1].tolist()


def check_packed(found, ids, capacity):
    by = collections.defaultdict(list)
    lines = collections.defaultdict(list)
    for r in found:
        by[r.doc_id].append(r)
        lines[r.sequence_id].append(r)
    assert set(by) == set(ids)
    for i, own in by.items():
        whole = np.array([*ids[i], 0], np.uint32)
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == np.r_[0, np.cumsum([r.length for r in own])][:-1].tolist()
        assert sum(r.length for r in own) == len(whole) and all(r.length == capacity for r in own[1:])
        assert all(zlib.crc32(whole[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    for own in lines.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.r_[0, np.cumsum([r.length for r in own])][:-1].tolist()
        assert sum(r.length for r in own) <= capacity
    return len(lines)


@pytest.mark.parametrize("group_items", [4, 1 << 16])
def test_packing(odd, ids, group_items):
    packed = packing.pack(odd, capacity=64, keep_ids=True, group_items=group_items)
    stored = packed.cache()
    found = stored.collect()
    used = check_packed(found, ids, 64)
    assert used <= -(-sum(len(v) + 1 for v in ids.values()) // 64) + 2
    sequences = {r.sequence_id: np.frombuffer(r.ids, np.uint32) for r in packing.sequences(stored).collect()}
    for r in found:
        assert sequences[r.sequence_id][r.offset : r.offset + r.length].tobytes() == bytes(r.ids)
    stored.unpersist()


def test_packing_tables(spark, sf, library, no_rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    ids = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids for r in docs}
    found = packing.op4_best_fit_packing(spark, sf).collect()
    part = [r.length for r in found if r.length < 2048]
    bound = packing.lower_bound(np.bincount(part, minlength=2049), 2048) + len(found) - len(part)
    assert check_packed(found, ids, 2048) <= bound + 1
    assert packing.pack(no_rows).collect() == []


# --- shards ----------------------------------------------------------------------


def check_shards(found, data, shards):
    texts = {i: (t or "").encode() for i, t, *_ in data}
    assert sorted(r.doc_id for r in found) == sorted(texts)
    by = collections.defaultdict(list)
    for r in found:
        assert (r["size"], r.text_crc32) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id]))
        by[r.shard].append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    assert set(by) <= set(range(shards))
    total, most = sum(r["size"] for r in found), max(r["size"] for r in found)
    for own in by.values():
        assert sum(r["size"] for r in own) <= total / shards * 1.1 + most
    return by


def test_shards(spark, sf, odd, no_rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(check_shards(kd_shards.op2_kd_shards(spark, sf).collect(), docs, 24)) == 24
    check_shards(kd_shards.kd_shards(odd, 3, dimensions=("size", "lang", "source")).collect(), rows(), 3)
    assert kd_shards.kd_shards(no_rows, 4).collect() == []


def test_hot_group_is_cut_and_small_groups_stay(spark):
    data = [(i, "same text " * 20, "en", "s") for i in range(300)]
    data += [(1000 + i, f"text {i // 2} " * 20, "fr", f"s{i % 7}") for i in range(600)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    by = check_shards(kd_shards.kd_shards(docs, target_bytes=20_000).collect(), data, 9)
    sizes = [sum(r["size"] for r in own) for own in by.values()]
    assert min(sizes) > 0.9 * max(sizes)
    shard = {r.doc_id: s for s, own in by.items() for r in own}
    assert sum(shard[1000 + i] == shard[1001 + i] for i in range(0, 600, 2)) == 300


# --- licences --------------------------------------------------------------------


def test_licenses(spark, no_rows):
    s = licenses.SENTENCES
    mit = ". ".join(x.upper() for x in s[7:11]) + "."
    texts = {
        1: None, 2: "", 3: "Prose. Released under the MIT License.\nMore prose.", 4: mit,
        5: ". ".join([s[10], s[9], s[8], s[7]]) + ".",  # wrong order
        6: "First line\nThis work is licensed under the GNU General Public License, version 3.\nlast",
        7: mit.replace(" to ", "\n to "), 8: ". ".join([s[17], "x", s[18], s[19], "y", s[20]]),
        9: "Permission to read. Licensed software! " * 2000 + "Licensed under CC BY-NC 4.0.",
    }
    found = {r.doc_id: r.licenses for r in licenses.license_scan(
        spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert found == {
        1: [], 2: [], 3: ["MIT"], 4: ["MIT"], 5: [], 6: ["GPL-3.0-only"], 7: ["MIT"],
        8: ["BSD-2-Clause", "BSD-3-Clause"], 9: ["CC-BY-NC-4.0"],
    }
    assert licenses.license_scan(no_rows).collect() == []


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
BSD_2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_3 = BSD_2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
PRINTED = {
    "Apache-2.0 (short notice)": "Licensed under the Apache License, Version 2.0.", "Apache-2.0 (notice)": APACHE,
    "MIT (short notice)": "Released under the MIT License.", "MIT (text)": MIT,
    "GPL-3.0-only (short notice)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later (notice)": GPL, "CC-BY-NC-4.0 (short notice)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 (short notice)": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-2-Clause (text)": BSD_2, "BSD-3-Clause (text)": BSD_3, "ISC (text)": ISC,
}


def test_every_rule_finds_its_text_as_printed(spark):
    assert list(PRINTED) == [f"{name} ({kind})" for name, kind, _ in licenses.RULES]
    texts = [f"Copyright 2024 A. Author\n\n{t}\nimport os\n" for t in PRINTED.values()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.rules for r in licenses.license_scan(docs).collect()}
    for i, rule in enumerate(PRINTED):
        extra = ["BSD-2-Clause (text)"] if rule == "BSD-3-Clause (text)" else []
        assert found[i] == [*extra, rule], (i, rule)


def test_gpl_notice_with_other_signs(spark):
    texts = [
        GPL.replace("software:", "software;"), GPL.replace("software:", "software,"), GPL.replace("WARRANTY;", "WARRANTY,"),
        GPL.replace("software:", "software,").replace("WARRANTY;", "WARRANTY,"), GPL.replace("either version 3", "either version 2"),
        GPL.split("See the")[0],
    ]
    texts += ["".join(f"# {line}\n" for line in t.splitlines()) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.rules for r in licenses.license_scan(docs).collect()}
    assert found == {i: ["GPL-3.0-or-later (notice)"] if i % 6 < 4 else [] for i in range(12)}


def test_license_hint_lets_every_sentence_through():
    import re

    assert all(re.search(licenses.HINT, s) for s in licenses.SENTENCES + licenses.SPLIT_SENTENCES)


def test_license_rules_use_their_sentences():
    assert {n for _, _, r in licenses.RULES for n in r} <= set(range(len(licenses.SENTENCES)))


@pytest.mark.parametrize("name", ["op5_warc", "op6_license_scan", "op10_exact_dedup"])
def test_sql(spark, sf, name):
    from oddline.llm import registry

    ours = check.spark_rows(registry.queries()[name](spark, sf))
    assert check.difference(ours, check.duck_rows(check.connect(sf), registry.oracle_sql()[name])) is None


# --- winnowing -------------------------------------------------------------------


def brute_selected(hashes, width):
    out = set()
    for i in range(max(len(hashes) - width + 1, 1) if hashes else 0):
        part = hashes[i : i + width]
        out.add(i + max(j for j, h in enumerate(part) if h == min(part)))
    return sorted(out)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 6, 7, 60, 130, 131, 132, 400])
def test_windows(spark, n):
    import pyspark.sql.functions as F

    words = [f"w{(i * i) % 11}" for i in range(n)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    grams = spark.createDataFrame([(i, *words[i : i + 3]) for i in range(n - 2)] or [(0, *(words + [None] * 3)[:3])],
                                  "i int, a string, b string, c string")
    hashes = [r[0] for r in grams.orderBy("i").select(F.shiftright(F.xxhash64("a", "b", "c"), 31)).collect()]
    found = w.fingerprints(docs).first().fingerprint
    places = [r.place for r in found]
    if n == 0:
        assert found == []
    elif n < 3:
        assert places == [0]
    else:
        assert places == brute_selected(hashes, 4)
        assert [r.hash for r in found] == [hashes[p] for p in places]


@pytest.mark.parametrize("n,more", [(60, 4), (131, 4), (132, 1), (132, 3), (135, 3), (140, 5), (300, 4)])
def test_near_copies_are_alike_at_every_length(spark, n, more):
    pairs = []
    for seed in range(40):
        words = [f"w{seed}x{i}" for i in range(n + more)]
        pairs += [(2 * seed + 1, " ".join(words[:n])), (2 * seed, " ".join(words))]  # the next goes by descending id
    found = w.compare_edited(spark.createDataFrame(pairs, "doc_id long, text string")).filter("doc_id % 2 = 1")
    near = [r.near_next for r in found.collect()]
    assert sum(near) / len(near) > 0.85 and min(near) > 0.6


@pytest.mark.parametrize("n", [20, 130, 135, 400])
def test_there_is_one_width(spark, n):
    """The gaps between selected places are those of one window at every length."""
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "doc_id long, text string")
    places = [r.place for r in w.fingerprints(docs).first().fingerprint]
    assert max(np.diff([-1, *places, n - 2])) <= 4 and len(places) > n / 4


def hashes_in(fingerprint):
    """The hashes that a printed fingerprint holds."""
    longs = [int(fingerprint[i : i + 16], 16) for i in range(0, len(fingerprint), 16)]
    return {x >> 31 for x in longs}


def brute_likeness(a, b):
    a, b = hashes_in(a), hashes_in(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check_likeness(found):
    """``near_*`` are those of the fingerprints returned."""
    order = sorted(found, reverse=True)
    for i, n in zip(order, order[1:] + order[:1]):
        assert found[i].near_edited == brute_likeness(found[i].fingerprint, found[i].edited_fingerprint)
        assert found[i].near_next == brute_likeness(found[i].fingerprint, found[n].fingerprint)


def test_likeness_on_the_tables(spark, sf):
    check_likeness({r.doc_id: r for r in w.op9_winnowing(spark, sf).collect()})


def test_edited(odd, no_rows):
    texts = {i: t or "" for i, t, *_ in rows()}
    order = sorted(texts, reverse=True)
    found = {r.doc_id: r for r in w.compare_edited(odd).collect()}
    assert set(found) == set(texts)
    for i, n in zip(order, order[1:] + order[:1]):
        t, m = texts[i], len(texts[i]) // 3
        edited = t[: len(t) - m] + texts[n][:m]
        r = found[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == r.edited_fingerprint) or edited != t
    check_likeness(found)
    prints = collections.defaultdict(set)
    for i, t in texts.items():
        prints[t].add(found[i].fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert w.compare_edited(no_rows).collect() == []


# --- archives --------------------------------------------------------------------


def test_archives(spark):
    pages = [(5, "http://a/", "<p>x</p>"), (7, "http://b/ c\r\n", "<p>x</p>"), (1, None, None), (2, "u", ""), (9, "u", "é\r\n\r\nWARC/1.0" * 3),
             (10, "u", "y" * 300_000), (11, "u", "y" * 300_000)]
    found = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in found.items()} == {
        5: ("revisit", 7), 7: ("response", None), 1: ("revisit", 2), 2: ("response", None), 9: ("response", None),
        10: ("revisit", 11), 11: ("response", None),
    }
    for i, _, html in pages:
        body = (html or "").encode()
        import base64

        assert found[i].payload_bytes == len(body)
        assert found[i].payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        if found[i].record_type == "response":
            assert found[i].payload == (html or "")
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_small_payloads_stay_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    assert {r.page_id: r.refers_to for r in warc.round_trip(pages, min_bytes=3).collect()} == {1: None, 2: None, 3: 4, 4: None}


def test_members_are_independent_and_streams_are_followed():
    import gzip

    record = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    for data in (gzip.compress(record * 3), gzip.compress(record) * 3, gzip.compress(record[:40]) + gzip.compress(record[40:] + record * 2)):
        assert [b for _, b in warc.records_of(warc.inflated(data))] == [b"abcde"] * 3
    with pytest.raises(ValueError):
        list(warc.records_of(warc.inflated(gzip.compress(record * 3)[:-20])))
    with pytest.raises(ValueError):
        list(warc.records_of([record[:-15]]))
