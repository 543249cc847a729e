import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddline.llm import fill_middle as fim, line_dedup as ld, registry, vector_codes as vc
from tests.llm.conftest import SCHEMA, rows
from tests.llm.test_dedup import UP
from workload import check


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- lines -----------------------------------------------------------------------


def brute_lines(data, least=10):
    """What stays of each row; ``data`` lists (doc_id, text)."""
    last = float("inf")  # no id comes last
    number = lambda i: last if i is None else i
    holders = collections.defaultdict(set)
    for i, text in data:
        for line in (text or "").split("\n"):
            holders[line.strip(" \t\n\x0b\x0c\r").translate(UP)].add(number(i))
    out = []
    for i, text in data:
        lines = (text or "").split("\n")
        keys = [x.strip(" \t\n\x0b\x0c\r").translate(UP) for x in lines]
        stay = [x for x, k in zip(lines, keys) if len(k) < least or min(holders[k]) == number(i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def found_lines(docs, **options):
    found = ld.line_dedup(docs, **options).select("doc_id", "n_lines", "n_dropped", "kept_text")
    return sorted(map(tuple, found.collect()), key=str)


LINES = [
    (7, "a shared line of text\nown line number seven\n\na shared line of text"),
    (3, "  A SHARED line of text\t\r\nown line number three\nshort"),
    (9, "short\na shared line of text"),
    (4, None), (5, ""), (6, "\n\n"),
    (8, "ünïcödé 🙂🙂\nünïcödé 🙂🙂"), (2, "ÜNÏCÖDÉ 🙂🙂"), (12, "ünïcödé 🙂🙂"),
    (10, "\xa0a shared line of text"),
    (None, "a shared line of text\nonly without id"), (None, "only without id\nsomething else here"),
    (11, "line twice with id\nx"), (11, "y\nline twice with id"),
    (13, "repeated row of text\nz"), (13, "repeated row of text\nz"), (14, "repeated row of text"),
    (20, "\n".join(f"line number {i % 150} of many" for i in range(400))),
    (21, "\n".join(f"line number {i} of many" for i in range(0, 700, 3))),
]


def test_lines_against_brute_force(spark):
    docs = spark.createDataFrame(LINES, "doc_id long, text string").repartition(4)
    assert found_lines(docs) == brute_lines(LINES)
    assert found_lines(docs, min_chars=1) == brute_lines(LINES, 1)


def test_lines_odd(odd, no_rows):
    assert found_lines(odd) == brute_lines([r[:2] for r in rows()])
    assert found_lines(no_rows) == []


def test_a_hot_line_is_cut_and_stays_once(spark):
    """A line of most documents has a sub-key per partition's share, and one document keeps it."""
    data = [(i, f"the very common line\nown text of {i % 97}\nthe very common line") for i in range(400, 0, -1)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(7)
    cut = ld.salted(ld.hashed_lines(docs))
    assert cut.filter("_salts > 1").select("_h1").distinct().count() == 1
    assert cut.select("_h1", "_salt").distinct().count() > 97 + 1
    assert found_lines(docs) == brute_lines(data)


def test_ranges_are_sorted_once(spark, sf):
    plan = ld.repeated_lines
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    dealt = ld.salted(ld.hashed_lines(docs)).repartitionByRange(*ld.HASH, "_salt")
    from pyspark.sql import Window

    streamed = Window.partitionBy(*ld.HASH, "_salt").orderBy("doc_id", "pos")
    text = dealt.withColumn("first", F.first("doc_id").over(streamed))._jdf.queryExecution().executedPlan().toString()
    assert text.count("rangepartitioning") == 1 and "hashpartitioning" not in text
    assert plan(docs).columns == ["doc_id", "_text", "pos"]


def test_bitmaps_leave_out_full_words(spark):
    data = [(1, "first of all the lines"), (2, "\n".join(["x"] * 200 + ["first of all the lines"] + ["y"] * 200))]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    keep = [r.keep for r in ld.keep_bitmaps(docs).collect()]
    assert [[(w.word, w.bits) for w in k] for k in keep] == [[(3, ~(1 << 8))]]
    assert found_lines(docs) == brute_lines(data)


# --- vector codes ------------------------------------------------------------------


def brute_codes(data, parts=8, entries=16, rounds=6):
    """``data``: (vec_id, vector, label); plain integers, every distance."""
    kept = [(i, v, l) for i, v, l in data if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return [], []
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    whole = [(i, [int(np.floor(np.float64(np.float32(x)) * 4096)) for x in v], l) for i, v, l in kept]
    whole = [(i, v + [0] * (parts * width - len(v)), l) for i, v, l in whole]
    start = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    book = [[cut(v, p) for _, v, _ in start] for p in range(parts)]

    def best(v, p):
        d = [sum((a - b) ** 2 for a, b in zip(cut(v, p), c)) for c in book[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        new = []
        for p in range(parts):
            of = [best(v, p)[0] for _, v, _ in whole]
            groups = [[cut(v, p) for (_, v, _), e in zip(whole, of) if e == j] for j in range(len(start))]
            new.append([[sum(x) // len(g) for x in zip(*g)] if g else book[p][j] for j, g in enumerate(groups)])
        book = new
    out = [(i, [best(v, p)[0] for p in range(parts)], sum(best(v, p)[1] for p in range(parts)), l) for i, v, l in whole]
    return out, book


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n, width, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(5, width))
    return [(int(i * 3 % n), (middle[i % 5] + rng.normal(size=width) * 0.2).tolist(), [None, 1, 2][i % 3]) for i in range(n)]


@pytest.mark.parametrize("data", [
    vectors(300, 16),
    [*vectors(40, 10), (100, None, 1), (101, [1.0, None], 1), (102, [float("nan")] * 10, 2), (103, [float("inf")] * 10, None),
     (None, [0.5] * 10, 1), (None, [0.25] * 10, 1), (7, [0.5] * 10, 3), (7, [0.5] * 10, 3), (104, [], 1), (105, [1.0, -1.0], 1)],
    vectors(9, 8),
    [(i, [float(i % 2)] * 8, 1) for i in range(60)],
])
def test_codes_against_brute_force(spark, data):
    table = spark.createDataFrame(data, VECTORS).withColumns({c: F.lit(1) for c in ("ints", "far", "error", "v", "_n", "_label")})
    found = vc.compress(table.repartition(5))
    wanted, book = brute_codes(data)
    assert found.entries.tolist() == book
    got = [(r.vec_id, r.codes, r.error, r.label) for r in found.rows.collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    total = collections.Counter()
    for _, _, error, label in wanted:
        total[label] += error
    assert all(r.label_error == total[r.label] for r in vc.with_label_error(found.rows).collect())


def test_codes_of_nothing(spark):
    for data in ([], [(1, None, 1)]):
        found = vc.compress(spark.createDataFrame(data, VECTORS))
        assert vc.with_label_error(found.rows).collect() == []
        assert vc.codebooks_sha256(found.entries) == sha("")


def test_components_have_a_largest_size(spark):
    data = [(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1), (3, [0.0] * 8, 1)]
    found = vc.compress(spark.createDataFrame(data, VECTORS), rounds=1)
    assert found.entries.min() == -(2**26) and found.entries.max() == 2**26
    assert {r.error for r in found.rows.collect()} == {0}


@pytest.mark.parametrize("seed", range(4))
def test_pivots_prune_and_lose_nothing(seed):
    """Bounds leave distances out, and the answer is that of all distances."""
    rng = np.random.default_rng(seed)
    entries = rng.integers(-3000, 3000, (8, 16, 8))
    values = entries[np.arange(8)[None], rng.integers(0, 16, (500, 8))] + rng.integers(-60, 60, (500, 8, 8))
    entries[:, 9] = entries[:, 3]  # ties
    fixed = entries[:, ::5]
    entry_far = vc._distances(entries.transpose(1, 0, 2), fixed).transpose(1, 0, 2)
    index, squared, computed = vc.nearest(values, vc._distances(values, fixed), entries, entry_far)
    every = ((values[:, :, None] - entries[None]) ** 2).sum(3)
    assert (index == every.argmin(2)).all() and (squared == every.min(2)).all()
    assert computed < 0.4 * every.size


# --- fill in the middle --------------------------------------------------------------


def brute_middle(i, text):
    text = text or ""
    h = [int(sha(f"1:{'' if i is None else i}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


MIDDLE = [
    *[(i, "Two words, one 🙂 sign; $1 \\2 and\r\nanother line\n") for i in range(60)],
    *[(i, "<P" * (i % 4) + "<S" + ">" * (i % 2) + " x<") for i in range(60, 100)],
    (100, "has <M> inside"), (101, "<P>"), (None, "no id at all"), (None, None), (102, None), (103, ""), (1, "same id again"),
    (104, "ab 1" * 200_000), (105, "z" * 300_000), (106, "\n" * 50_000), (107, "é" * 30_000),
]


def test_middle_against_brute_force(spark):
    docs = spark.createDataFrame(MIDDLE, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "form", "output", "_one")})
    both = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    found = both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back").collect()
    wanted = [(i, *brute_middle(i, t), t or "") for i, t in MIDDLE]
    assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_middle_odd(odd, no_rows):
    found = {r.doc_id: tuple(r)[1:] for r in fim.fill_in_middle(odd).collect()}
    assert found == {i: brute_middle(i, t) for i, t, *_ in rows()}
    assert fim.fill_in_middle(no_rows).collect() == []
    assert fim.fill_in_middle(odd, plain_percent=0, spm_percent=100).filter("form = 'psm'").count() == 0


# --- the queries and their SQL ---------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_vector_codes", "op13_fill_middle"])
def test_new_sql(spark, sf, name):
    ours = check.spark_rows(registry.queries()[name](spark, sf))
    assert check.difference(ours, check.duck_rows(check.connect(sf), registry.oracle_sql()[name])) is None


def test_no_document_has_a_line_twice(spark):
    """Line by line over documents with the columns of the table."""
    docs = spark.createDataFrame([(i, "one line that all of them hold", None, None, None) for i in range(50)], SCHEMA)
    assert ld.line_dedup(docs).agg(F.sum("n_dropped")).first()[0] == 49
