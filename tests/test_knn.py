import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oddline.operators import knn as search
from oddline.operators.cells import extend, load_index, lloyd, route, save_index
from oddline.operators.knn import _nearest_in_block, build_index, kmeans_index, knn


def frame(spark, x, ids=None):
    ids = list(range(len(x))) if ids is None else ids
    return spark.createDataFrame(
        pd.DataFrame({"id": ids, "embedding": [list(map(float, v)) for v in x]})
    )


def brute(q, c, k, metric="squared_l2"):
    """Positions of the k best rows, ties by position."""
    if metric == "inner_product":
        cost = -(q @ c.T)
    else:
        cost = ((q[:, None, :] - c[None, :, :]) ** 2).sum(-1)
        if metric == "euclidean":
            cost = np.sqrt(cost)
    return np.argsort(np.round(cost, 9), axis=1, kind="stable")[:, :k]


def found(neighbors, k):
    out = neighbors.long().toPandas().sort_values(["query_id", "rank"])
    return out["neighbor_id"].to_numpy().reshape(-1, k)


def clustered(n, seed=0, hot=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 6)) * 10
    x = np.round(centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 6)) * 0.5, 1)
    x[:hot] = x[0]
    return x


@pytest.mark.parametrize("metric", ["squared_l2", "euclidean", "inner_product"])
def test_exact_with_cells_blocks_and_copies(spark, metric):
    x = clustered(900, hot=300)  # a third of all rows are copies of one vector
    data = frame(spark, x)
    index = build_index(data, 5, metric, cells=15, block_rows=50)
    assert len(index.pivots) > 5 and index.layout.count() > 15
    for way in ({}, {"sent_bytes": 60_000}, {"sent_bytes": 0}, {"sent_bytes": 0, "block_queries": 7}):
        result = knn(data, index, 5, "id", **way)
        assert not result.unique
        assert (found(result, 5) == brute(x, x, 5, metric)).all(), way


def test_queries_held_by_a_task_are_compared_piece_by_piece(spark, monkeypatch):
    monkeypatch.setattr(search, "HELD_ROWS", 70)
    x = clustered(500, seed=6)
    for data in (frame(spark, x), frame(spark, x).withColumn("embedding", F.col("embedding").cast("array<float>"))):
        exact = np.array([r[0] for r in data.sort("id").select("embedding").collect()])
        index = build_index(data, 4, cells=9, block_rows=40)
        assert (found(knn(data, index, 4, "id"), 4) == brute(exact, exact, 4)).all()


def test_copies_are_searched_once_and_kept_k_times(spark):
    x = clustered(600, hot=200)
    index = build_index(frame(spark, x), 4, cells=1)
    assert index.layout.agg({"n": "sum"}).first()[0] <= 400 + 4
    result = knn(frame(spark, x), index, 4, "id")
    assert result.rows.count() == 4 * len(np.unique(x, axis=0))
    assert result.groups.agg({"n": "sum"}).first()[0] == 600


def test_cells_are_skipped_when_they_cannot_help(spark):
    x = clustered(900, seed=3)
    index = build_index(frame(spark, x), 3, cells=40)
    queries = frame(spark, x[:100]).selectExpr("id AS vec_key", "embedding AS vec")
    visited = route(queries, index, 3, None).selectExpr("avg(size(blocks))").first()[0]
    assert visited < 20


def test_text_ids_and_small_corpus(spark):
    c = np.eye(3)
    corpus = frame(spark, c, ["b", "a", "c"])
    result = knn(frame(spark, np.zeros((2, 3)), ["q1", "q2"]), build_index(corpus, 5), 5, "id")
    rows = result.long().orderBy("query_id", "rank").collect()
    assert [r.neighbor_id for r in rows] == ["a", "b", "c"] * 2  # ties by id, fewer than k
    assert [r.distance for r in rows] == [1.0] * 6


def test_k_is_checked(spark):
    data = frame(spark, np.eye(3))
    with pytest.raises(ValueError):
        knn(data, build_index(data, 2), 3, "id")
    with pytest.raises(ValueError):
        build_index(data, 2, "manhattan")


def test_probing(spark):
    x = clustered(800, seed=5)
    data = frame(spark, x)
    index = kmeans_index(data, 5, cells=10)
    exact = brute(x, x, 5)
    assert (found(knn(data, index, 5, "id", probes=10), 5) == exact).all()
    some = knn(data, index, 5, "id", probes=3).long().toPandas().groupby("query_id")["neighbor_id"]
    hits = sum(len(set(ids) & set(exact[q])) for q, ids in some)
    assert hits >= 0.9 * exact.size


@pytest.mark.parametrize("metric", ["squared_l2", "inner_product"])
def test_two_levels_are_exact(spark, metric):
    x = clustered(900, seed=7, hot=100)
    data = frame(spark, x)
    index = build_index(data, 4, metric, cells=36, groups=6)
    assert len(index.pivots) == 6 and index.cells.count() > 12
    assert (found(knn(data, index, 4, "id"), 4) == brute(x, x, 4, metric)).all()


def test_two_levels_of_trained_cells(spark):
    """Probing six of about 64 cells finds nearly all of what all cells hold."""
    x = clustered(1500, seed=11)
    data = frame(spark, x)
    index = kmeans_index(data, 5, cells=64, groups=8)
    exact = brute(x, x, 5)
    assert (found(knn(data, index, 5, "id"), 5) == exact).all()
    some = knn(data, index, 5, "id", probes=6).long().toPandas().groupby("query_id")["neighbor_id"]
    assert sum(len(set(ids) & set(exact[q])) for q, ids in some) >= 0.9 * exact.size


def test_given_centres_on_two_levels(spark):
    """A query meets only the nearest cells of the nearest groups."""
    c = np.array([[0.0, 0.0], [0.0, 1.0], [10.0, 0.0], [10.0, 1.0]])
    data = frame(spark, c)
    index = build_index(data, 4, pivots=np.array([[0.0, 0.5], [10.0, 0.5]]), members=[c[:2], c[2:]])
    rows = knn(data, index, 4, "id", probes=1).long().collect()
    assert sorted((r.query_id, r.neighbor_id) for r in rows) == [(i, i) for i in range(4)]
    assert len(knn(data, index, 4, "id", probes=2).long().collect()) == 8


def test_the_corpus_is_not_shuffled(spark, monkeypatch):
    """No way of searching has an exchange between the stored blocks and the search."""
    plans = []
    real = search.durable

    def noted(df, label="stage"):
        if label in ("neighbors", "knn-found"):
            with search._setting(spark, "spark.sql.adaptive.enabled", "false"):
                plans.append(df._jdf.queryExecution().sparkPlan().toString() and
                             spark._jsparkSession.sessionState().executePlan(df._jdf.logicalPlan(), df._jdf.queryExecution().mode()).executedPlan().toString())
        return real(df, label)

    monkeypatch.setattr(search, "durable", noted)
    x = clustered(400, seed=2)
    data = frame(spark, x)
    index = build_index(data, 3, cells=6)
    for way in ({}, {"sent_bytes": 0}):
        knn(data, index, 3, "id", **way)
    for plan in plans:
        lines = plan.splitlines()
        for at, line in enumerate(lines):
            if "vecs" in line and "FileScan" in line:
                depth = len(line) - len(line.lstrip(" :+-"))
                for above in reversed(lines[:at]):
                    inside = len(above) - len(above.lstrip(" :+-"))
                    if inside < depth:
                        depth = inside
                        if any(w in above for w in ("MapInArrow", "FlatMapCoGroups")):
                            break
                        assert "Exchange" not in above, plan
    assert any("Bucketed: true" in p for p in plans)


def test_extended_and_stored(spark, folder):
    """New rows become blocks of their own; the index searches as one built of all rows."""
    x = clustered(700, seed=4)
    for cells in (1, 9):
        index = extend(build_index(frame(spark, x[:500]), 3, cells=cells), frame(spark, x[500:], list(range(500, 700))))
        assert len(index.parts) == 2 and extend(index, frame(spark, x[:1]).limit(0)) is index
        save_index(index, f"{folder}/{cells}")
        for way in ({}, {"sent_bytes": 0}):
            result = knn(frame(spark, x), load_index(spark, f"{folder}/{cells}"), 3, "id", **way)
            assert (found(result, 3) == brute(x, x, 3)).all()


def test_empty_corpus_and_queries(spark):
    none = frame(spark, np.eye(3)).limit(0)
    data = frame(spark, np.eye(3))
    assert knn(data, build_index(none, 2), 2, "id").long().collect() == []
    assert knn(none, build_index(data, 2), 2, "id").long().collect() == []


def test_centres_are_far_apart_and_few():
    x = np.repeat(np.eye(4) * 9, 5, axis=0)
    assert sorted(map(tuple, lloyd(x, 4, 5, 1))) == sorted(map(tuple, np.eye(4) * 9))
    assert len(lloyd(x, 40, 5, 1)) == 4


def test_block_kernel_far_from_origin_and_with_ties():
    rng = np.random.default_rng(1)
    far = rng.normal(size=(1500, 8)) + 1e4
    ties = rng.integers(0, 2, size=(1500, 8)).astype(float)
    for x in (far, ties):
        for metric in ("squared_l2", "euclidean", "inner_product"):
            out = _nearest_in_block(np.arange(200), x[:200], np.arange(1500), x, 6, metric)
            if metric == "inner_product" and x is far:
                continue  # products near 8e8 have no nine decimals to compare
            assert (out["neighbor_id"].to_numpy().reshape(-1, 6) == brute(x[:200], x, 6, metric)).all()


@pytest.mark.parametrize("large", [False, True])
def test_all_similar_pairs(spark, monkeypatch, large):
    """Every pair above the threshold, once; copies and multiples are one class, zeros have none."""
    from oddline.operators import similarity

    x = clustered(300, seed=6, hot=60)
    x[100] = 2 * x[101]
    x[7] = 0
    if large:
        monkeypatch.setattr(similarity, "fits", lambda index: False)
    found = similarity.similar_pairs(frame(spark, x), 0.99, cells=8)
    of = {r.id: r.class_id for r in found.members.collect()}
    assert 7 not in of and of[101] == 100 and {of[i] for i in range(60) if i != 7} == {0}
    unit = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
    heads = sorted(set(of.values()))
    close = np.round(unit @ unit.T, 9) >= 0.99
    want = [(a, b) for i, a in enumerate(heads) for b in heads[i + 1 :] if close[a, b]]
    assert sorted((r.left_id, r.right_id) for r in found.pairs.collect()) == want and len(want) > 100


@pytest.mark.parametrize("large", [False, True])
def test_similar_pairs_are_neither_stored_nor_shuffled(spark, monkeypatch, large):
    """Their number grows with the square of the rows; what is stored and dealt are vectors and counts."""
    from oddline.operators import similarity

    if large:
        monkeypatch.setattr(similarity, "fits", lambda index: False)
    x = clustered(400, seed=9, hot=30)
    stored = []
    write = similarity.durable
    monkeypatch.setattr(similarity, "durable", lambda df, label: stored.append(write(df, label)) or stored[-1])
    monkeypatch.setattr(search, "durable", lambda df, label: stored.append(write(df, label)) or stored[-1])
    found = similarity.similar_pairs(frame(spark, x), 0.9, cells=5)
    pairs = found.pairs.select("left_id", "left_rows", "right_id", "right_rows")
    n = pairs.count()
    assert n > 5000 and max(df.count() for df in stored) <= 400
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    head = plan[: plan.index("MapIn")]
    assert "Exchange" not in head and "Join" not in head
    counts = {r.class_id: r["count"] for r in found.members.groupBy("class_id").count().collect()}
    assert all(counts[r.left_id] == r.left_rows and counts[r.right_id] == r.right_rows for r in pairs.collect())


def test_columns_are_added_without_touching_the_others(spark):
    """Nulls in numbers and vectors, times and texts stay; a row without vector gets null lists."""
    from datetime import datetime

    rows = [(1, [0.0, 1.0], None, "a", datetime(2024, 1, 1, 5)), (2, None, 7, None, None), (3, [0.0, 1.0], 2**60 + 1, "c", None)]
    data = spark.createDataFrame(rows, "seq long, embedding array<double>, number long, text string, ts timestamp")
    index = build_index(frame(spark, np.eye(2), ["x", "y"]), 2)
    found = {r.seq: r for r in search.neighbor_columns(data, index, 2).collect()}
    assert {tuple(r)[2:5] for r in found.values()} == {r[2:] for r in rows}
    assert found[1].nearest_neighbors == ["y", "x"] and found[3].distances == [0.0, 2.0]
    assert found[2].nearest_neighbors is None and found[2].distances is None


def test_similar_pairs_of_a_block_come_in_bounded_pieces():
    from oddline.operators import similarity

    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 6)) + 10  # every pair is similar
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    ids = np.arange(len(x))
    pieces = list(similarity._similar_in_block(ids, x, ids, x, 0.5))
    assert max(len(p) for p in pieces) <= 65_536
    pairs = pd.concat(pieces)
    assert len(pairs) == len(pairs.drop_duplicates(["vec_key", "neighbor_id"])) == 1200 * 1199 // 2
    left, right = pairs["vec_key"].to_numpy(), pairs["neighbor_id"].to_numpy()
    assert (left < right).all() and np.allclose(pairs["distance"], (x[left] * x[right]).sum(1))
