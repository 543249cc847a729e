"""Window operators against a plain loop over the rows in arrival order."""

from collections import defaultdict
from datetime import datetime, timedelta
from statistics import fmean, pstdev

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddline.operators import windows
from oddline.functions.vectors import temporal_features

START = datetime(2024, 1, 1)


def make_rows(n, keys=3, seed=0):
    """Key k0 has most rows; some rows arrive hours late, some share a score."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        key = "k0" if rng.random() < 0.7 else f"k{rng.integers(1, keys)}"
        late = timedelta(hours=float(rng.choice([0, 0, 0, 3, 80])))
        out.append((i, key, START + timedelta(minutes=i) - late, round(float(rng.random()), 3)))
    return out


def expected(rows, size=100, weight=0.3, decay=0.95):
    seen = defaultdict(list)
    out = {}
    for seq, key, ts, score in rows:
        past = seen[key][-size:]
        scores = [s for _, s in past]
        mean, std = (fmean(scores), pstdev(scores)) if scores else (0.0, 0.0)
        latest = max((t for t, _ in past), default=ts)
        recency = 1.0 if not past else max(decay ** ((latest - ts).total_seconds() / 3600), 0.1)
        adjusted = score
        if len(scores) > 10 and std > 0:
            adjusted = score * min(max(1 + (score - mean) / std * weight, 0.5), 2.0)
        seen[key].append((ts, score))
        window = [s for _, s in seen[key][-size:]]
        recent, older = window[-10:], window[:-10]
        burst = len(older) >= 5 and fmean(recent) > 1.3 * fmean(older)
        out[seq] = (mean, std, len(scores), recency, min(adjusted * recency, 1.0), burst, window)
    return out


@pytest.fixture(scope="module")
def rows():
    return make_rows(900)


@pytest.fixture(scope="module")
def data(spark, rows):
    return spark.createDataFrame(rows, "seq long, source string, ts timestamp, score double")


@pytest.mark.parametrize("chunk_rows", [10_000, 130, 40])
@pytest.mark.parametrize("keyed", [True, False])
def test_adjusted_scores(spark, rows, data, chunk_rows, keyed):
    key = ["source"] if keyed else []
    plain = rows if keyed else [(s, "all", t, x) for s, _, t, x in rows]
    want = expected(plain)
    got = windows.adjust_scores(data, key, ["seq"], chunk_rows=chunk_rows).collect()
    assert len(got) == len(rows)
    for r in got:
        mean, std, count, recency, adjusted, _, _ = want[r.seq]
        assert r.window_stats["count"] == count
        assert r.window_stats["mean"] == pytest.approx(mean, abs=1e-12)
        assert r.window_stats["std"] == pytest.approx(std, abs=1e-12)
        assert r.temporal_weight == pytest.approx(recency, abs=1e-12)
        assert r.time_adjusted_score == pytest.approx(adjusted, abs=1e-9)


@pytest.mark.parametrize("chunk_rows", [10_000, 90])
def test_bursts_and_series(rows, data, chunk_rows):
    want = expected(rows)
    flags = windows.burst_flags(data, ["source"], ["seq"], factor=1.3, chunk_rows=chunk_rows)
    got = {r.seq: r.is_burst for r in flags.collect()}
    assert got == {seq: w[5] for seq, w in want.items()}
    assert any(got.values())
    series = windows.time_series(data, ["source"], ["seq"], chunk_rows=chunk_rows).collect()
    assert len(series) == len(rows)
    assert all([x.score for x in r.series] == want[r.seq][6] for r in series)


def test_halo_reaches_over_chunks_smaller_than_the_window(spark, data):
    chunked = windows.with_history(data, [], ["seq"], 100, chunk_rows=30)
    sizes = chunked.groupBy("_chunk").agg(F.count("*").alias("n"), F.count_if("_halo").alias("halo"))
    assert sizes.count() > 10
    assert sizes.agg(F.max("halo")).first()[0] >= 100
    assert windows.without_history(chunked).count() == data.count()


def test_newer_row_weighs_more_than_one(spark):
    data = spark.createDataFrame(
        [(1, START, 0.5), (2, START + timedelta(hours=1), 0.5)], "seq long, ts timestamp, score double"
    )
    got = windows.adjust_scores(data, [], ["seq"]).orderBy("seq").collect()
    assert got[0].temporal_weight == 1.0
    assert got[1].temporal_weight == pytest.approx(0.95**-1)


def test_missing_time_takes_processing_time(spark):
    data = spark.createDataFrame(
        [(1, START, START, 0.5), (2, None, START - timedelta(hours=2), 0.5)],
        "seq long, ts timestamp, now timestamp, score double",
    )
    got = windows.adjust_scores(data, [], ["seq"], processing_time="now").orderBy("seq").collect()
    assert got[1].temporal_weight == pytest.approx(0.95**2)
    assert got[1].ts is None


def test_temporal_features(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 15, 6, 30),)], "ts timestamp")
    full, short = df.select(temporal_features(F.col("ts")), temporal_features(F.col("ts"), 3)).first()
    assert full[:5] == pytest.approx([6 / 24, 30 / 60, 0.0, 15 / 31, 1 / 12])
    assert full[5:9] == pytest.approx([1.0, 0.0, 0.0, 1.0], abs=1e-12)
    assert full[9:] == [0.0] * 7 and len(short) == 3
