import numpy as np
import pandas as pd
import pytest

from oddline.operators import knn as search
from oddline.operators.cells import load_index, save_index
from oddline.operators.heads import HeldHeads, heads_of, nearest_by_head
from tests.test_knn import brute, found, frame


def repeated_heads(n, seed=0, heads=40):
    """Rows of few heads, one of them a third of all, whose two last values differ, with copies."""
    rng = np.random.default_rng(seed)
    of = rng.integers(0, heads, n)
    of[: n // 3] = 0
    x = np.hstack([rng.normal(size=(heads, 6)).round(1)[of], rng.normal(size=(n, 2)).round(2)])
    x[n // 3 : n // 3 + 20] = x[n // 3]
    return x


@pytest.mark.parametrize("metric", ["squared_l2", "euclidean"])
@pytest.mark.parametrize("heads", [1, 3, 40, 2000])
def test_block_by_heads(metric, heads):
    c, q = repeated_heads(700, 1, heads), repeated_heads(300, 2, heads)
    q[:50] = c[100:150]
    ids = np.arange(len(c))[::-1].copy()
    best = brute(q, c[::-1], 5, metric)
    rows = nearest_by_head(np.arange(len(q)), q, ids, c, 5, metric, 2).sort_values("vec_key", kind="stable")
    assert (rows["neighbor_id"].to_numpy().reshape(-1, 5) == best).all()
    kth = rows["distance"].to_numpy().reshape(-1, 5)[:, 4]
    again = nearest_by_head(np.arange(len(q)), q, ids, c, 5, metric, 2, kth).sort_values("vec_key", kind="stable")
    assert (again["neighbor_id"].to_numpy().reshape(-1, 5) == best).all()
    some = np.where(np.arange(len(q)) % 3 > 0, kth, np.inf)
    mixed = nearest_by_head(np.arange(len(q)), q, ids, c, 5, metric, 2, some).sort_values("vec_key", kind="stable")
    assert (mixed["neighbor_id"].to_numpy().reshape(-1, 5) == best).all()
    few = nearest_by_head(np.arange(len(q)), q, ids, c, 5, metric, 2, kth * 0.5)
    assert len(few) < len(rows)


def test_fewer_rows_than_neighbours_in_a_block():
    c = repeated_heads(9, 3, 2)[:4]
    rows = nearest_by_head(np.array(["a", "b"]), c[:2], np.array(["w", "x", "y", "z"], object), c, 6, "euclidean", 2)
    assert rows.groupby("vec_key").size().to_dict() == {"a": 4, "b": 4}


@pytest.mark.parametrize("metric", ["squared_l2", "euclidean"])
def test_search_by_heads_is_exact(spark, folder, metric):
    """Rows that differ in their last values only are searched by their heads, with the same result."""
    x = repeated_heads(400)
    data = frame(spark, x)
    index = search.build_index(data, 5, metric, cells=5, block_rows=80, tail=2)
    save_index(index, folder)
    stored = load_index(spark, folder)
    assert stored.tail == 2
    assert (found(search.knn(data, stored, 5, "id", sent_bytes=0), 5) == brute(x, x, 5, metric)).all()


def test_queries_of_a_head_meet_a_block_as_one(spark, monkeypatch):
    """What is shuffled and compared are heads: far fewer than rows."""
    x = repeated_heads(400, heads=10)
    data = frame(spark, x)
    index = search.build_index(data, 5, "euclidean", cells=4, block_rows=200, tail=2)
    units = []
    made = search._units
    monkeypatch.setattr(search, "_units", lambda *a: units.append(made(*a)) or units[-1])
    assert (found(search.knn(data, index, 5, "id", sent_bytes=0), 5) == brute(x, x, 5, "euclidean")).all()
    assert all(u.count() < 200 for u in units) and len(units) == 2


def test_rows_of_a_head_share_a_block(spark):
    x = repeated_heads(900)[300:]
    index = search.build_index(frame(spark, x), 5, "euclidean", cells=3, block_rows=200, tail=2)
    of_head = {}
    for row in index.blocks.collect():
        for vector in np.frombuffer(row.vecs, index.kind).reshape(-1, 8):
            of_head.setdefault(tuple(vector[:6]), set()).add(row.block)
    few = pd.Series([tuple(v[:6]) for v in x]).value_counts()
    assert all(len(of_head[h]) == 1 for h in few[few < 25].index)


@pytest.mark.parametrize("held", [True, False])
def test_search_by_heads_where_tasks_hold_the_heads_or_not(spark, monkeypatch, held):
    x = repeated_heads(500, 4)
    c = repeated_heads(600, 5, heads=70)
    c[:7] = c[0]
    data, index = frame(spark, x), search.build_index(frame(spark, c), 5, "euclidean", cells=6, block_rows=60, tail=2)
    assert search._held_heads(index, 5, sent_bytes=100) is None
    if not held:
        monkeypatch.setattr(search, "_held_heads", lambda *a: None)
    assert (found(search.knn(data, index, 5, "id", sent_bytes=0), 5) == brute(x, c, 5, "euclidean")).all()


def test_second_round_asks_only_blocks_with_heads_that_are_near(spark, monkeypatch):
    """Rows lie close around their heads, cells hold many heads: nearly no query has to leave its first block."""
    rng = np.random.default_rng(6)
    x = np.hstack([rng.normal(size=(100, 6))[rng.integers(0, 100, 1500)], rng.normal(size=(1500, 2)) / 10])
    data = frame(spark, x)
    index = search.build_index(data, 5, "euclidean", cells=10, block_rows=300, tail=2)
    asked = []
    made = search._units

    def counted(*args):
        asked.append(made(*args))
        return asked[-1]

    monkeypatch.setattr(search, "_units", counted)
    assert (found(search.knn(data, index, 5, "id", sent_bytes=0), 5) == brute(x, x, 5, "euclidean")).all()
    rows = [units.selectExpr("sum(size(keys))").first()[0] or 0 for units in asked]
    assert rows[0] == 1500 and rows[1] < 300


def test_held_heads_leave_no_block_out():
    rng = np.random.default_rng(7)
    c, q = repeated_heads(900, 8, 200) + 50, repeated_heads(200, 9, 200) + 50
    block = rng.integers(0, 20, len(c))
    parts = []
    for b in range(20):
        heads, of = heads_of(c[block == b], 2)
        tails = [c[block == b][of == i, 6:] for i in range(len(heads))]
        parts += [(h, t.min(0), t.max(0), b, False) for h, t in zip(heads, tails)]
    held = HeldHeads.of(*(np.array(p) for p in zip(*parts)))
    away = np.sqrt(((q[:, None] - c[None]) ** 2).sum(2))
    worst = np.sort(away, axis=1)[:, 4]
    worst[::20] = np.inf
    row, of = held.within(q, 2, worst, "euclidean")
    at, hit = np.nonzero(away <= worst[:, None])
    assert set(zip(at, block[hit])) <= set(zip(row, of))
    assert len(row) < 20 * len(q) / 2
