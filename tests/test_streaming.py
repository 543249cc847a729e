from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from oddline.operators import windows
from oddline.streaming import jobs
from tests.test_windows import expected, make_rows

SCHEMA = "seq long, source string, ts timestamp, score double"


@pytest.fixture
def files(spark, folder):
    """The rows as six files in arrival order."""
    rows = make_rows(600, seed=4)
    for i in range(6):
        part = spark.createDataFrame(rows[i * 100 : (i + 1) * 100], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(folder + "/in")
    return rows


def run(query):
    query.awaitTermination()
    assert query.exception() is None


@pytest.mark.parametrize("chunk_rows", [10_000, 50])
def test_windows_go_on_across_batches_and_restarts(spark, folder, files, chunk_rows):
    want = expected(files)

    def start():
        stream = jobs.read_files(spark, folder + "/in", SCHEMA, max_files=2)
        return jobs.window_stream(
            stream, ["source"], ["seq"], folder + "/out", folder + "/state", folder + "/ckpt",
            chunk_rows=chunk_rows,
        )

    run(start())
    late = make_rows(700, seed=4)[600:]
    spark.createDataFrame(late, SCHEMA).coalesce(1).write.mode("append").parquet(folder + "/in")
    want = expected(files + late)
    run(start())  # a new query with the same checkpoint goes on
    got = jobs.read_epochs(spark, folder + "/out").collect()
    assert len(got) == 700 and {r.seq for r in got} == set(range(700))
    for r in got:
        assert r.time_adjusted_score == pytest.approx(want[r.seq][4], abs=1e-9)
    state = spark.read.parquet(folder + "/state").filter("epoch = 3").groupBy("source").count()
    assert state.agg(F.max("count")).first()[0] == 100


def test_window_state_of_touched_keys_is_merged_and_old_states_go(spark, folder, monkeypatch):
    """One source per file, in turn; the state of all is written every second epoch."""
    monkeypatch.setattr(jobs, "FULL_STATE", 2)
    rows = make_rows(700, seed=9)
    names = sorted({r[1] for r in rows})
    turns = [[r for r in rows if r[1] == names[i % len(names)] and r[0] % 3 == i // len(names)] for i in range(3 * len(names))]
    arrived, number = [], 0
    for turn in turns:
        again = [(number + i, *r[1:]) for i, r in enumerate(turn)]
        number += len(turn)
        arrived += again
        spark.createDataFrame(again, SCHEMA).coalesce(1).write.mode("append").parquet(folder + "/in")
    stream = jobs.read_files(spark, folder + "/in", SCHEMA, max_files=1)
    run(jobs.window_stream(
        stream, ["source"], ["seq"], folder + "/out", folder + "/state", folder + "/ckpt", window_size=100
    ))
    want = expected(arrived)
    got = jobs.read_epochs(spark, folder + "/out").collect()
    assert len(got) == len(arrived)
    for r in got:
        assert r.time_adjusted_score == pytest.approx(want[r.seq][4], abs=1e-9)
    kept = {r.epoch for r in spark.read.parquet(folder + "/state").select("epoch").distinct().collect()}
    last_full = (len(turns) - 1) // 2 * 2
    assert min(kept) >= last_full - 2 and max(kept) == len(turns) - 1


def test_trend_keeps_late_rows_and_open_buckets(spark, folder):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(hours=i), i % 3 == 0) for i in range(24)]
    schema = "seq long, ts timestamp, is_anomaly boolean"
    for part in (rows[12:], rows[:12]):  # the early hours arrive last
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder + "/in")
    stream = jobs.read_files(spark, folder + "/in", schema, max_files=1)
    run(jobs.trend_stream(stream, folder + "/counts", folder + "/ckpt"))
    got = sorted((r.bucket_start.hour, r.total, r.anomalies) for r in jobs.running_trend(spark, folder + "/counts").collect())
    assert [g[0] for g in got] == [0, 4, 8, 12, 16, 20]
    assert all(g[1] == 4 for g in got) and sum(g[2] for g in got) == 8


def test_parse_text_stream_and_alerts(spark, folder):
    spark.createDataFrame(
        [("2024-01-15 10:00:00 ERROR disk full",), ("INFO fine",)], "value string"
    ).coalesce(1).write.text(folder + "/in")
    lines = jobs.read_files(spark, folder + "/in", "value string", "text")
    parsed = jobs.parse_stream(lines.withColumnRenamed("value", "raw_text"), source="s")
    flagged = parsed.select("log_id", (F.col("log_level") == "ERROR").alias("is_anomaly"))
    run(jobs.alert_stream(flagged, folder + "/alerts", folder + "/rates", folder + "/ckpt"))
    assert jobs.read_epochs(spark, folder + "/alerts").count() == 1
    assert jobs.running_rate(spark, folder + "/rates").first().asDict() == {
        "total": 2, "anomalies": 1, "rate": 0.5,
    }
