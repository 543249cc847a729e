import weakref

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oddline.operators import windows
from oddline.streaming import jobs, keyed
from tests.test_streaming import SCHEMA, run
from tests.test_windows import expected, make_rows


def add(spark, rows, path, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_windows_per_key_over_epochs_and_a_restart(spark, folder):
    rows = make_rows(700, seed=4)
    for i in range(3):
        add(spark, rows[i * 200 : (i + 1) * 200][::-1], folder + "/in")  # order within a batch does not count

    def start():
        with keyed.keyed_state(spark):
            stream = jobs.read_files(spark, folder + "/in", SCHEMA, max_files=1)
            return jobs.write_append(keyed.keyed_windows(stream, ["source"]), folder + "/out", folder + "/ckpt")

    run(start())
    add(spark, rows[600:], folder + "/in")
    run(start())
    got = spark.read.parquet(folder + "/out").collect()
    want = expected(rows)
    assert len(got) == 700 and {r.seq for r in got} == set(range(700))
    for r in got:
        assert r.time_adjusted_score == pytest.approx(want[r.seq][4], abs=1e-9)


def test_one_window_over_everything_with_missing_scores(spark, folder):
    """No key, some scores null: as the batch plan has it."""
    rows = [(s, k, t, None if s % 5 == 0 else x) for s, k, t, x in make_rows(300, seed=8)]
    for i in range(3):
        add(spark, rows[i * 100 : (i + 1) * 100], folder + "/in")
    with keyed.keyed_state(spark):
        stream = jobs.read_files(spark, folder + "/in", SCHEMA, max_files=1)
        query = jobs.write_append(keyed.keyed_windows(stream, []), folder + "/out", folder + "/ckpt")
    run(query)
    columns = ["seq", "window_stats", "temporal_weight", "time_adjusted_score", "is_burst"]
    chunked = windows.with_history(spark.createDataFrame(rows, SCHEMA), [], ["seq"], 100)
    batch = windows.add_burst(windows.add_temporal_context(chunked, ["seq"]), ["seq"])
    want = {r.seq: r for r in windows.without_history(batch).select(columns).collect()}
    for r in spark.read.parquet(folder + "/out").select(columns).collect():
        w = want[r.seq]
        assert r.is_burst == w.is_burst
        assert tuple(r.window_stats) == pytest.approx(tuple(w.window_stats), abs=1e-9)
        assert r.temporal_weight == pytest.approx(w.temporal_weight, abs=1e-9)
        assert r.time_adjusted_score == pytest.approx(w.time_adjusted_score, abs=1e-9)  # 1 for a missing score


def test_window_columns_do_not_depend_on_cuts():
    rng = np.random.default_rng(1)
    score, ts = rng.random(500), np.sort(rng.integers(0, 10**12, 500))
    whole = keyed.window_columns(score, ts, np.zeros(0), np.zeros(0, np.int64))
    parts, before = [], (np.zeros(0), np.zeros(0, np.int64))
    for a in range(0, 500, 70):
        s, t = score[a : a + 70], ts[a : a + 70]
        parts.append(keyed.window_columns(s, t, *before))
        before = np.r_[before[0], s][-100:], np.r_[before[1], t][-100:]
    for name, values in whole.items():
        assert np.allclose(values.astype(float), np.concatenate([p[name] for p in parts]).astype(float))


def test_rows_of_a_key_wait_on_disk(monkeypatch):
    """Frames are let go as they come and given out again one by one, with the windows of the whole order."""
    monkeypatch.setattr(keyed, "WAITING_BYTES", 10_000, raising=False)
    rng = np.random.default_rng(2)
    seq, score = rng.permutation(2000), rng.random(2000)
    ts = pd.Series(pd.to_datetime(1_700_000_000 + seq, unit="s"))
    alive, most = [], []

    def frames():
        for start in range(0, 2000, 100):
            part = slice(start, start + 100)
            pdf = pd.DataFrame({"seq": seq[part], "score": score[part], "ts": ts[part].to_numpy(), "text": [f"row {i}" * 20 for i in seq[part]]})
            alive.append(weakref.ref(pdf))
            yield pdf
            del pdf
            most.append(sum(r() is not None for r in alive))

    class State:
        rows = []

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = rows

    windows_of = keyed._ScoreWindows("seq", "score", "ts", 100, 0.3)
    windows_of.last = State()
    got = list(windows_of.handleInputRows(("a",), frames(), None))
    assert max(most) <= 2 and [len(g) for g in got] == [100] * 20
    whole = pd.concat(got).sort_values("seq")
    at = np.argsort(seq)
    want = keyed.window_columns(score[at], ts.to_numpy("datetime64[us]").astype(np.int64)[at], np.zeros(0), np.zeros(0, np.int64))
    assert (whole["text"] == [f"row {i}" * 20 for i in range(2000)]).all()
    for name in ("temporal_weight", "time_adjusted_score", "is_burst"):
        assert (whole[name].to_numpy() == want[name]).all()
    assert [s for s, _ in windows_of.last.rows] == score[at][-100:].tolist()


TREND = "ts timestamp, is_anomaly boolean"


def test_trend_closes_buckets_and_keeps_late_rows(spark, folder):
    from datetime import datetime, timedelta

    day = datetime(2024, 5, 1)
    hours = [[0, 1, 2, 5], [3, 6, 9], [13, 1, 2, 14], [30], [0]]
    for batch in hours:
        add(spark, [(day + timedelta(hours=h), h % 2 == 1) for h in batch], folder + "/in", TREND)

    def start():
        with keyed.keyed_state(spark):
            stream = jobs.read_files(spark, folder + "/in", TREND, max_files=1)
            return jobs.write_append(keyed.event_time_trend(stream, "4 hours"), folder + "/out", folder + "/ckpt")

    run(start())
    add(spark, [(day + timedelta(hours=5), None)], folder + "/in", TREND)
    run(start())
    stored = spark.read.parquet(folder + "/out")
    found = {r.bucket_start: r for r in keyed.trend_of_epochs(stored).collect()}
    every = [h for batch in [*hours, [5]] for h in batch]
    for at, r in found.items():
        first = int((at - day).total_seconds() // 3600)
        own = [h for h in every if first <= h < first + 4]
        assert r.total == len(own)
        assert r.anomalies == sum(h % 2 for h in own) - (first == 4)  # the null of the second 5 counts as none
        assert r.is_closed == (first < 28)
    assert sum(r.total for r in found.values()) == len(every)
    # 3 came when 5 had been seen and the watermark was at 4, 1 and 2 after 9, 0 and the second 5 after 30.
    assert {int((at - day).total_seconds() // 3600): r.late for at, r in found.items() if r.late} == {0: 4, 4: 1}
    assert stored.filter("kind = 'closed'").groupBy("bucket_start").count().agg(F.max("count")).first()[0] == 1


def test_a_corpus_too_large_for_a_task(spark, folder, monkeypatch):
    """Searched by the batch plan, over three micro-batches and a restart: the rows of the one plan."""
    from oddline.plans import distance_detector as distance
    from oddline.operators.encode import TokenHashEncoder

    options = distance.DetectorOptions(encoder=TokenHashEncoder(16))
    lines = [(i, f"2024-01-15 10:{i % 60:02d}:00 INFO user {i % 7} read file {i % 13}", f"s{i % 2}") for i in range(150)]
    schema = "seq long, raw_text string, source string"
    model = distance.fit(spark.createDataFrame(lines[:100], schema).drop("source"), options)

    def start(out):
        with keyed.keyed_state(spark):
            stream = jobs.read_files(spark, folder + "/in", schema, max_files=1)
            return keyed.write_detected(stream, model, ["source"], f"{folder}/{out}", f"{folder}/{out}-ckpt", F.col("source"))

    add(spark, lines[:50], folder + "/in", schema)
    add(spark, lines[50:100], folder + "/in", schema)
    monkeypatch.setattr(keyed, "fits", lambda index: False)
    run(start("large"))
    add(spark, lines[100:], folder + "/in", schema)
    run(start("large"))
    run(start("large"))  # nothing new
    monkeypatch.undo()
    run(start("small"))
    columns = ["seq", "source", "log_id", "nearest_neighbors", "score", "is_anomaly", "window_stats", "time_adjusted_score", "is_burst"]
    large, small = (spark.read.parquet(f"{folder}/{out}").select(columns).orderBy("seq").collect() for out in ("large", "small"))
    assert large == small and [r.seq for r in large] == list(range(150))


def test_tables_that_are_folders_of_files(spark, sf, folder):
    """A stream of a table reads it as one file and as a folder of part files."""
    from workload import queries

    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    e.repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    streamed = queries.stream_hybrid_scores(spark, folder)
    assert streamed.count() == e.count() > 0
    assert streamed.exceptAll(queries.hybrid_distance_scores(spark, sf)).isEmpty()
    assert queries.stream_hybrid_scores(spark, sf).count() == e.count()
