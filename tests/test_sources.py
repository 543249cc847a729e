import json
import os

import pytest
from pyspark.sql import functions as F

from oddline.functions.severity import metadata_features
from oddline.operators.skew import salted_lookup
from oddline.session import durable, shared_dir
from oddline.sources import corpus as store, logs as files, siem


def write(path, data):
    with open(path, "wb") as f:
        f.write(data)


def test_log_file(spark, folder):
    path = os.path.join(folder, "app.log")
    write(path, b"  first line \n\n \t \nse\xffcond \xc3\xa9\n")
    rows = files.read_log_file(spark, path).collect()
    assert [(r.raw_text, r.source) for r in rows] == [("first line", "app.log"), ("second é", "app.log")]
    assert files.read_log_file(spark, path, source="x").first().source == "x"


def test_csv_and_json(spark, folder):
    csv = os.path.join(folder, "t.csv")
    write(csv, b'description,risk_score\n"a, ""quoted""\nline",5\nplain,\n')
    rows = files.read_table(spark, csv).orderBy(F.length("description")).collect()
    assert [r.description for r in rows] == ["plain", 'a, "quoted"\nline']
    assert [r.risk_score for r in rows] == [None, 5]
    lines = os.path.join(folder, "lines.json")
    write(lines, b'{"a": 1}\n{"a": 2}\n')
    whole = os.path.join(folder, "whole.json")
    write(whole, json.dumps([{"a": 1}, {"a": 2}, {"a": 3}], indent=1).encode())
    assert files.read_table(spark, lines).count() == 2
    assert files.read_table(spark, whole).count() == 3
    assert files.read_json(spark, whole, "a int").agg(F.sum("a")).first()[0] == 6
    assert files.read_json(spark, lines, "a int").agg(F.sum("a")).first()[0] == 3


def test_missing_column_names_the_others(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    with pytest.raises(ValueError, match="'b'"):
        files.require_column(df, "c")
    assert files.optional_columns(df, ["b", "c"]) == ["b"]


def test_csv_sink_round_trip(spark, folder):
    df = spark.createDataFrame([('say "hi", ok', 0.5, True)], "t string, anomaly_score double, p boolean")
    files.write_csv(df, folder + "/out")
    assert files.read_csv(spark, folder + "/out").first() == df.first()


def test_row_numbers_are_stored(spark):
    df = files.with_seq(spark.range(100).repartition(4).drop("id").withColumn("x", F.lit(1)))
    assert df.select("seq").distinct().count() == 100
    assert files.with_seq(df) is df


def test_records(spark, folder):
    rows = [
        {"event_id": f"e{i}", "event_type": "t", "severity": s, "source": "s",
         "description": "d" * 300, "raw_log": "CEF", "advanced_metadata": m}
        for i, (s, m) in enumerate(
            [("high", {"risk_score": 80.0}), ("High", None), (None, {"risk_score": None}), ("low", {})]
        )
    ]
    write(folder + "/r.json", "\n".join(json.dumps(r) for r in rows).encode())
    labelled = siem.label_records(siem.load_records(spark, folder + "/r.json")).orderBy("event_id")
    got = labelled.collect()
    assert [r.is_anomaly for r in got] == [True, False, False, False]
    assert [r.risk_score for r in got] == [80.0, 50.0, 50.0, 50.0]
    assert len(siem.record_metadata(labelled).first().description) == 200
    t = siem.totals(labelled).first()
    assert (t.total_records, t.anomaly_count, t.normal_count, t.avg_risk_score) == (4, 1, 3, 57.5)
    assert siem.value_counts(labelled, "severity").count() == 3
    assert [r.event_id for r in siem.load_records(spark, folder + "/r.json", 2).collect()] == ["e0", "e1"]
    normal, odd = siem.split_normal_anomaly(labelled)
    assert (normal.count(), odd.count()) == (3, 1)


def test_metadata_features_default(spark):
    df = spark.createDataFrame([("critical",), ("CRITICAL",), (None,)], "severity string")
    assert [r[0] for r in df.select(metadata_features(df)).collect()] == [[0.5, 0.8], [0.5, 0.0], [0.5, 0.0]]


def test_corpus_last_entry_wins(spark, folder):
    first = spark.createDataFrame(
        [(1, "a", [1.0], {"cleaned_text": "old"}, None), (2, "b", [2.0], None, None)],
        "seq long, id string, embedding array<double>, metadata map<string,string>, ts timestamp",
    )
    second = spark.createDataFrame([(3, "a", [3.0])], "seq long, id string, embedding array<double>")
    both = store.append_entries(first, second)
    assert both.count() == 3
    a = store.lookup(both, "a").first()
    assert a.embedding == [3.0] and a.metadata == {"cleaned_text": "old"}
    assert store.lookup(both, "zz").count() == 0
    store.save_corpus(both, folder + "/c", {"k": 5})
    loaded, settings = store.load_corpus(spark, folder + "/c")
    assert loaded.count() == 3 and settings == {"k": "5"}
    s = store.corpus_stats(loaded).first()
    assert (s.total_vectors, s.embedding_dim, s.has_metadata, s.has_timestamps) == (3, 1, True, False)
    assert store.corpus_stats(both.filter("false")).first().total_vectors == 0


def test_json_keeps_or_rejects_every_record(spark, folder):
    def put(name, text):
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)

    os.makedirs(folder + "/mixed")
    put("mixed/a.json", '[\n{"a": 1},\n{"a": 2}\n]\n')
    put("mixed/b.json", '{"a": 3}\n\n{"a": 4}\n')
    for schema in ("a int", None):
        assert sorted(r.a for r in files.read_json(spark, folder + "/mixed", schema).collect()) == [1, 2, 3, 4]
    put("broken.json", 'oops\n{"a": 3}\n{"a": 4}\n')
    put("cut.json", '{"a": 3}\n{"a": \n')
    for name in ("broken.json", "cut.json"):
        with pytest.raises(Exception):
            files.read_json(spark, f"{folder}/{name}", "a int").collect()


def test_a_corpus_can_be_saved_where_it_came_from(spark, folder):
    one = spark.sql("SELECT 1L AS seq, 'a' AS id, array(1F) AS embedding, map('k', 'v') AS metadata, NULL AS ts")
    store.save_corpus(one, folder + "/c")
    loaded, _ = store.load_corpus(spark, folder + "/c")
    store.save_corpus(store.append_entries(loaded, one.withColumn("seq", F.lit(2).cast("long"))), folder + "/c")
    assert store.load_corpus(spark, folder + "/c")[0].count() == 2


def test_hot_keys_are_split_and_nothing_is_lost(spark):
    left = spark.range(3000).selectExpr("id", "IF(id < 1500, 'hot', concat('k', id % 50)) AS k")
    right = spark.sql("SELECT 'hot' AS k, 1 AS v UNION ALL SELECT 'k1', 2 UNION ALL SELECT 'unused', 3")
    out = salted_lookup(left, right, ["k"], "left", hot_rows=100)
    assert out.count() == 3000
    assert out.filter("k = 'hot' AND v = 1").count() == 1500
    assert out.filter("v = 2").count() == 30
    assert salted_lookup(left, right, ["k"], "inner", hot_rows=100).count() == 1530


def test_scratch_is_the_configured_folder(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_dir(spark) == configured.rstrip("/")
    stored = durable(spark.range(5))
    assert stored.count() == 5 and stored.inputFiles()[0].split(":", 1)[1].lstrip("/").startswith(
        shared_dir(spark).split(":", 1)[-1].lstrip("/")
    )


def test_json_documents_keep_their_lines_in_order(spark, folder):
    """Documents over many lines and files of one record, some with blank lines; types are inferred over all."""
    os.makedirs(folder + "/many")
    for i in range(60):
        with open(f"{folder}/many/{i}.json", "w") as out:
            if i % 3:
                out.write(json.dumps({"a": i, "b": "x\ny"}) + "\n\n")
            else:
                out.write(json.dumps([{"a": i, "c": [1, 2]}, {"a": -i}], indent=2))
    rows = files.read_json(spark, folder + "/many")
    assert set(rows.columns) == {"a", "b", "c"} and rows.count() == 80
    assert rows.agg(F.sum("a"), F.sum(F.aggregate("c", F.lit(0).cast("bigint"), lambda x, y: x + y))).first()[:] == (
        sum(i for i in range(60) if i % 3), 60
    )


def test_tasks_do_not_grow_with_a_table_of_few_splits(spark, folder, monkeypatch):
    monkeypatch.setattr(files, "SPREAD_ROWS", 100)
    spark.range(3000).coalesce(1).write.parquet(folder + "/one")
    dealt = files.spread(spark.read.parquet(folder + "/one"))
    sizes = [len(p) for p in dealt.rdd.glom().collect()]
    assert len(sizes) == 30 and max(sizes) <= 110 and sum(sizes) == 3000
