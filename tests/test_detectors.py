from dataclasses import replace
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddline.functions.text import CleanOptions
from oddline.operators import baseline, history
from oddline.operators.encode import ModelEncoder, TokenHashEncoder, encode_with_metadata
from oddline.plans import distance_detector as distance, hybrid_detector as hybrid
from oddline.plans.table_scoring import score_file, score_table

ENCODER = TokenHashEncoder(32)
DISTANCE = distance.DetectorOptions(encoder=ENCODER)
HYBRID = hybrid.HybridOptions(encoder=ENCODER, trees=20, sample=32)
def now():
    return F.lit(datetime(2024, 1, 15, 12))


@pytest.fixture(scope="module")
def normal(spark):
    verbs = ["opened", "closed", "saved", "read"]
    rows = [
        (i, f"2024-01-15 10:{i % 60:02d}:00 INFO user {verbs[i % 4]} file {i % 13} on node {i % 5}")
        for i in range(120)
    ]
    return spark.createDataFrame(rows, "seq long, raw_text string").cache()


@pytest.fixture(scope="module")
def queries(spark):
    rows = [
        (1, "2024-01-15 11:00:00 INFO user saved file 3 on node 2"),
        (2, "kernel panic: memory corrupted, login disabled, everything fails"),
        (3, ""),
    ]
    return spark.createDataFrame(rows, "seq long, raw_text string")


@pytest.fixture(scope="module")
def model(normal):
    return distance.fit(normal, DISTANCE)


def test_distance_detector(queries, model):
    rows = distance.detect(queries, model, processing_time=now()).orderBy("seq").collect()
    assert [r.anomaly_score.is_anomaly for r in rows] == [False, True, True]
    assert rows[0].explanation is None
    odd = rows[1]
    assert odd.anomaly_score.score == odd.temporal_context.score
    assert len(odd.anomaly_score.nearest_neighbors) == 5
    assert [s.rank for s in odd.explanation.similar_logs] == [1, 2, 3]
    assert all(s.text.startswith("user ") for s in odd.explanation.similar_logs)
    assert any("authentication" in a for a in odd.explanation.recommendations)
    # No time in the line: the processing time is one hour newer than the first row's.
    assert odd.temporal_context.weight == pytest.approx(0.95**-1)


def test_baseline_ignores_copies(spark, model):
    same = spark.createDataFrame([(i, "same text") for i in range(20)], "seq long, raw_text string")
    with pytest.raises(ValueError):
        distance.fit(same, DISTANCE)
    assert 0 < model.baseline.threshold < 2


@pytest.mark.parametrize("sent", [True, False])
def test_more_copies_than_neighbours_of_every_text(spark, folder, monkeypatch, sent):
    """No row has a distance left, so there is no threshold: scores go by the fixed distance."""
    if not sent:
        for place in (baseline, distance):
            monkeypatch.setattr(place, "fits", lambda index: False)
    lines = spark.createDataFrame([(i, f"text number {i % 3}") for i in range(24)], "seq long, raw_text string")
    fitted = distance.fit(lines, DISTANCE)
    assert fitted.baseline == baseline.Baseline()
    distance.save(fitted, folder)
    new = spark.createDataFrame([(1, "text number 2"), (2, "all else")], "seq long, raw_text string")
    found = distance.detect(new, distance.load(spark, folder, DISTANCE), processing_time=now()).orderBy("seq").collect()
    assert [tuple(r.anomaly_score)[:3] for r in found] == [(0.0, False, 0.0), (1.0, True, 1.0)]


def test_distance_model_round_trip(spark, folder, queries, model):
    distance.save(model, folder)
    loaded = distance.load(spark, folder, DISTANCE)
    assert loaded.baseline == model.baseline and loaded.options == model.options

    def scores(m):
        rows = distance.detect(queries, m, processing_time=now()).orderBy("seq").collect()
        return [r.anomaly_score for r in rows]

    assert scores(loaded) == scores(model)
    unfitted = distance.load(spark, folder, DISTANCE, with_baseline=False)
    assert unfitted.baseline.threshold is None
    odd = scores(unfitted)[1]
    assert odd.is_anomaly


def test_second_fit_appends(spark, normal, model):
    more = spark.createDataFrame(
        [(1000 + i, f"worker {i % 7} finished job {i % 11}") for i in range(40)], "seq long, raw_text string"
    )
    grown = distance.fit(more, DISTANCE, previous=model)
    assert grown.corpus.count() == 160
    newest = distance.fit(more, DISTANCE, previous=model, refit_on_all=False)
    assert newest.corpus.count() == 160
    assert newest.baseline.threshold != grown.baseline.threshold


def test_cell_probing_detector(queries, normal):
    options = distance.DetectorOptions(encoder=ENCODER, index_type="IVF", cells=6, probes=6)
    fitted = distance.fit(normal, options)
    flat = distance.fit(normal, DISTANCE)
    assert fitted.baseline.threshold == pytest.approx(flat.baseline.threshold)
    rows = distance.detect(queries, fitted, processing_time=now()).orderBy("seq").collect()
    assert [r.anomaly_score.is_anomaly for r in rows] == [False, True, True]


def test_model_encoder_encodes_each_text_once(spark):
    def make():
        def predict(texts):
            return np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

        return predict

    df = spark.createDataFrame([(1, "ab"), (2, "abcd"), (3, "ab")], "i long, t string")
    out = encode_with_metadata(df, "t", ModelEncoder(make, 2, normalize=False, name="lengths"))
    rows = out.orderBy("i").collect()
    assert [r.embedding for r in rows] == [[2.0, 1.0], [4.0, 1.0], [2.0, 1.0]]
    assert (rows[0].model_name, rows[0].embedding_dim) == ("lengths", 2)


def test_model_encoder_makes_each_text_once(spark):
    made = spark.sparkContext.accumulator(0)

    def make():
        return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

    @F.udf("string")
    def text(i):
        made.add(1)
        return "ab" * (i % 2 + 1)

    df = spark.range(4).select("id", text("id").alias("t"))
    rows = ModelEncoder(make, 2, normalize=False).encode(df, "t").orderBy("id").collect()
    assert [r.embedding[0] for r in rows] == [2.0, 4.0, 2.0, 4.0]
    assert made.value == 4


@pytest.fixture(scope="module")
def hybrid_model(normal):
    with_meta = normal.withColumns(
        {"severity": F.lit("info"), "risk_score": (F.col("seq") % 10).cast("double")}
    )
    return hybrid.fit(with_meta, HYBRID)


def test_hybrid_detector(spark, folder, queries, hybrid_model):
    logs = queries.withColumns(
        {
            "severity": F.when(F.col("seq") == 3, "high").otherwise("info"),
            "risk_score": F.lit(5.0),
        }
    )
    rows = hybrid.detect(logs, hybrid_model).orderBy("seq").collect()
    assert rows[2].is_anomaly  # by severity
    assert rows[1].is_anomaly and rows[1].distance_score > 2
    assert rows[1].score > rows[0].score
    assert len(rows[0].neighbors) == 3
    assert rows[1].explanation.similar_logs[0].text == "N/A"
    hybrid.save(hybrid_model, folder)
    again = hybrid.detect(logs, hybrid.load(spark, folder, HYBRID)).orderBy("seq").collect()
    assert [(r.score, r.is_anomaly) for r in again] == [(r.score, r.is_anomaly) for r in rows]
    view = history.detection_response(hybrid.detect(logs, hybrid_model)).orderBy("seq").collect()
    assert view[1].confidence == 0.5 and view[1].explanation.summary == rows[1].explanation.summary


def test_hybrid_neighbours_skip_the_nearest(spark):
    rows = spark.createDataFrame(
        [(i, f"r{i}", [float(i), 0.0], [0.0, 0.0]) for i in (0, 1, 3, 7)],
        "seq long, id string, embedding array<double>, meta array<double>",
    )
    options = hybrid.HybridOptions(k=2, semantic_weight=1.0)
    model = hybrid.fit_vectors(rows, options, with_forest=False)
    # Means of the two nearest others: 2, 1.5, 2.5, 5
    assert model.mean == pytest.approx(2.75)
    scored = hybrid.score_vectors(rows.withColumn("severity_flag", F.lit(False)), model)
    got = {r.seq: r.mean_distance for r in scored.collect()}
    assert got == pytest.approx({0: 2.0, 1: 1.5, 3: 2.5, 7: 5.0})


def test_table_scoring(spark, folder, hybrid_model):
    table = spark.createDataFrame(
        [("user saved file 1 on node 1", "info", 5.0, 0), (None, "critical", 90.0, 1),
         ("user read file 2 on node 2", "low", 1.0, 0)],
        "description string, severity string, risk_score double, label int",
    )
    table.write.option("header", True).csv(folder + "/in.csv")
    scored = score_file(spark, folder + "/in.csv", hybrid_model, folder + "/out", label_col="label")
    m = scored.metrics().first()
    assert m.n == 3 and m.tp == 1 and m.fn == 0
    assert scored.top(1).first().anomaly_score >= 0
    back = spark.read.option("header", True).csv(folder + "/out")
    assert back.count() == 3 and {"anomaly_score", "is_anomaly_pred"} <= set(back.columns)
    with pytest.raises(ValueError):
        score_table(table, hybrid_model, text_col="nope")
    plain = score_table(table.select("description"), hybrid_model)
    assert plain.metrics() is None and plain.rows.count() == 3


def test_history_views_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "seq long, is_anomaly boolean")
    assert history.anomaly_rate(empty).first().asDict() == {"total": 0, "anomalies": 0, "rate": 0.0}
    assert history.status(None, empty, False).first().vector_db_size == 0


def test_text_search(spark, model):
    texts = spark.createDataFrame([("q", "user saved file 3 on node 2")], "query_id string, text string")
    rows = distance.search_texts(texts, model, k=2).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2]
    assert rows[0].metadata["source"] == "training"
    assert rows[0].min_distance == rows[0].distance <= rows[0].max_distance == rows[1].distance
    assert rows[0].mean_distance == pytest.approx((rows[0].distance + rows[1].distance) / 2)


def test_stored_cells_are_used_again(spark, folder, normal):
    options = distance.DetectorOptions(encoder=ENCODER, index_type="IVF", cells=6, probes=2)
    fitted = distance.fit(normal, options)
    distance.save(fitted, folder)
    loaded = distance.load(spark, folder, options)
    assert (loaded.index.pivots == fitted.index.pivots).all()
    assert (loaded.index.counts == fitted.index.counts).all()


def test_grown_model_saved_to_its_own_folder(spark, folder, normal, model):
    distance.save(model, folder)
    more = spark.createDataFrame(
        [(i, f"worker {i % 7} finished job {i % 11}") for i in range(40)], "seq long, raw_text string"
    )
    grown = distance.fit(more, DISTANCE, previous=distance.load(spark, folder, DISTANCE))
    distance.save(grown, folder)
    loaded = distance.load(spark, folder, DISTANCE)
    assert loaded.corpus.count() == 160 == loaded.corpus.select("seq").distinct().count()
    assert loaded.baseline == grown.baseline


def test_model_with_another_encoder_or_cleaning_is_refused(spark, folder, model, hybrid_model):
    distance.save(model, folder + "/d")
    hybrid.save(hybrid_model, folder + "/h")
    for change in ({"encoder": TokenHashEncoder(16)}, {"clean": CleanOptions(lowercase=False)}):
        with pytest.raises(ValueError):
            distance.load(spark, folder + "/d", replace(DISTANCE, **change))
        with pytest.raises(ValueError):
            hybrid.load(spark, folder + "/h", replace(HYBRID, **change))
    with pytest.raises(FileNotFoundError):
        distance.load(spark, folder + "/none", DISTANCE)


def test_hybrid_with_probed_cells_and_without_forest(spark, folder, queries, normal):
    rows = hybrid.encode_records(normal, HYBRID).selectExpr(
        "seq", "log_id AS id", "embedding", "meta", "severity_flag"
    )
    flat = hybrid.fit_vectors(rows, HYBRID, with_forest=False)
    probed = hybrid.fit_vectors(rows, replace(HYBRID, index_type="IVF", cells=4, probes=4), with_forest=False)
    hybrid.save(probed, folder)
    loaded = hybrid.load(spark, folder, HYBRID)
    assert loaded.forest is None and loaded.probes == 4

    def scores(m):
        return [r.distance_score for r in hybrid.score_vectors(rows, m).orderBy("seq").collect()]

    assert scores(loaded) == pytest.approx(scores(flat))


@pytest.mark.parametrize("metric", ["L2", "IP"])
def test_a_grown_model_is_the_model_of_all_rows(spark, folder, metric):
    """Copies, ties and rows nearer than any before; stored and read in between."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(240, 5)) + 2, 1)
    x[40:80] = x[40]
    x[150:170] = x[41]
    table = spark.createDataFrame(
        [(i, f"r{i:03d}", list(map(float, v))) for i, v in enumerate(x)], "seq long, id string, embedding array<float>"
    )
    options = distance.DetectorOptions(metric=metric)
    model = distance.fit_entries(table.filter("seq < 100"), options)
    distance.save(model, folder + "/m")
    for low, high in ((100, 160), (160, 240)):
        model = distance.fit_entries(table.filter(f"seq >= {low} AND seq < {high}"), options, distance.load(spark, folder + "/m"))
        distance.save(model, folder + "/m")
    whole = distance.fit_entries(table, options)
    assert len(model.index.parts) == 3 and model.near.count() == 240
    for name in ("threshold", "mean", "std"):
        assert getattr(model.baseline, name) == pytest.approx(getattr(whole.baseline, name), abs=1e-9)
    queries = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(rng.normal(size=(30, 5)) + 2)], "seq long, embedding array<float>")
    a, b = (
        sorted((r.seq, r.nearest_neighbors, round(r.mean_distance, 9)) for r in distance.score_vectors(queries, m).collect())
        for m in (model, whole)
    )
    assert a == b


def test_scores_do_not_depend_on_the_way_of_searching(spark, monkeypatch):
    """A corpus too large for a task is searched by a join, with the same baseline and scores."""
    from oddline.operators import baseline
    from oddline.plans import distance_detector

    rows = [(i, f"r{i}", [float(i % 7), float(i % 11), 1.0]) for i in range(90)]
    table = spark.createDataFrame(rows, "seq long, id string, embedding array<double>")

    def scores():
        model = distance.fit_entries(table, distance.DetectorOptions())
        found = distance.score_vectors(table.select("seq", "embedding"), model).collect()
        return model.baseline, sorted((r.seq, r.nearest_neighbors, round(r.score, 9)) for r in found)

    first, one = scores()
    for module in (baseline, distance_detector):
        monkeypatch.setattr(module, "fits", lambda index: False)
    second, two = scores()
    assert one == two and first.threshold == pytest.approx(second.threshold, abs=1e-9)
