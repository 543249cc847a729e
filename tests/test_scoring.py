import pytest
from pyspark.sql import functions as F

from oddline.functions import explain, scoring
from oddline.functions.vectors import cosine, l2_normalize
from oddline.operators.baseline import Baseline, anomalies_by_score, fit_from_distances
from oddline.operators.metrics import balanced_rates, confusion, quality


def scores(spark, means, baseline):
    df = spark.createDataFrame([(i, m) for i, m in enumerate(means)], "id long, mean_distance double")
    return baseline.add_scores(df).orderBy("id").collect()


def test_fitted(spark):
    rows = scores(spark, [0.1, 0.4, 0.41, 5.0, None], Baseline(0.4, 0.2, 0.1))
    assert [r.score for r in rows] == pytest.approx([0.125, 0.5, 0.5125, 1.0, 1.0])
    assert [r.is_anomaly for r in rows] == [False, False, True, True, True]
    assert [r.confidence for r in rows] == pytest.approx([1 / 3, 2 / 3, 0.7, 1.0, 1.0])


def test_unfitted_uses_the_fixed_distance(spark):
    rows = scores(spark, [0.25, 0.75], Baseline())
    assert [r.score for r in rows] == [0.5, 1.0]
    assert [r.is_anomaly for r in rows] == [False, True]
    assert [r.confidence for r in rows] == [0.5, 1.0]


def test_threshold_zero_counts_as_unset_for_the_flag_only(spark):
    rows = scores(spark, [0.0, 0.3, 0.6], Baseline(0.0, 0.0, 0.0))
    assert [r.score for r in rows] == [0.0, 1.0, 1.0]
    assert [r.is_anomaly for r in rows] == [False, False, True]


def test_small_deviation_is_floored(spark):
    rows = scores(spark, [0.21], Baseline(0.4, 0.2, 0.0))
    assert rows[0].confidence == pytest.approx(0.01 / 0.01 / 3)


def test_fit_from_distances(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "d double").cache()
    b = fit_from_distances(df, "d")
    assert b.threshold == 95.0 and b.mean == 50.0
    assert b.std == pytest.approx((sum((i - 50) ** 2 for i in range(101)) / 101) ** 0.5)


def test_anomalies_are_filtered_and_sorted(spark):
    df = spark.createDataFrame(
        [("a", 0.5, True, 0.9), ("b", 0.9, True, 0.5), ("c", 0.9, True, 0.4), ("d", 1.0, False, 1.0)],
        "log_id string, score double, is_anomaly boolean, confidence double",
    )
    assert [r.log_id for r in anomalies_by_score(df).collect()] == ["b", "a"]


def test_bands_at_their_edges(spark):
    values = [-0.1, 0.0, 0.29, 0.3, 0.6, 0.8, 0.99, 1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, s double")
    rows = df.orderBy("i").select(explain.severity_band(F.col("s")), explain.severity_text(F.col("s"))).collect()
    assert [r[0] for r in rows] == [
        "Critical", "Low", "Low", "Medium", "High", "Critical", "Critical", "Critical",
    ]
    assert rows[0][1] == rows[7][1] == "Extremely anomalous pattern detected."
    assert rows[6][1] != rows[7][1]


def test_hybrid_formulas(spark):
    df = spark.createDataFrame(
        [(1.5, 0.1, False), (9.0, -0.6, False), (2.1, 0.2, False), (-5.0, 0.9, True)],
        "z double, iso double, sev boolean",
    )
    rows = df.select(
        scoring.hybrid_score(F.col("z"), F.col("iso")),
        scoring.hybrid_flag(F.col("z"), F.col("iso"), F.col("sev")),
    ).collect()
    assert [r[0] for r in rows] == pytest.approx([0.45, 1.0, 0.5, 0.0])
    assert [r[1] for r in rows] == [False, True, True, True]


def test_explanation_parts(spark):
    df = spark.createDataFrame([(0.65, "Login TIMEOUT failure", [0.5, 0.7])], "s double, t string, d array<double>")
    none = F.array().cast("array<struct<rank:int,id:string,distance:double,text:string>>")
    parts = explain.explanation(F.col("s"), F.col("t"), F.col("d"), none)
    row = df.select(parts.alias("p"), explain.report(F.lit("x1"), F.col("s"), parts).alias("r")).first()
    assert row.p.details == [
        "Severity Level: High", "Anomaly Score: 65.00%", "Mean Distance to Neighbors: 0.6000",
    ]
    assert len(row.p.recommendations) == 6
    assert "Similar Logs" not in row.r and row.r.splitlines()[1] == "Log ID: x1"
    empty = df.select(explain.details(F.col("s"), F.array().cast("array<double>"))).first()[0]
    assert empty[2] == "No neighbors found"


def test_cosine_and_unit_length(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    a, z = F.col("a"), F.col("z")
    row = df.select(cosine(a, a), cosine(a, a, False), cosine(a, z, False), l2_normalize(a), l2_normalize(z)).first()
    assert row[0] == 25.0 and row[1] == pytest.approx(1.0) and row[2] == 0.0
    assert row[3] == pytest.approx([0.6, 0.8]) and row[4] == [0.0, 0.0]


def test_confusion_without_positives(spark):
    df = spark.createDataFrame([(0, False), (0, False)], "y int, p boolean")
    q = quality(confusion(df, F.col("y"), F.col("p"))).first()
    assert (q.tn, q.accuracy, q.precision, q.recall, q.f1) == (2, 1.0, 0.0, 0.0, 0.0)


def test_accuracy_counts_labelled_rows_only(spark):
    df = spark.createDataFrame([(1, True), (0, True), (None, True), (None, False)], "y int, p boolean")
    q = quality(confusion(df, F.col("y"), F.col("p"))).first()
    assert (q.n, q.unlabelled, q.accuracy) == (2, 2, 0.5)


def test_balanced_rates_use_the_first_rows_of_each_class(spark):
    rows = [(i, i % 2 == 0, i < 6) for i in range(20)]
    df = spark.createDataFrame(rows, "i long, odd boolean, flag boolean")
    r = balanced_rates(df, "odd", "flag", ["i"], per_class=5).first()
    assert (r.true_negatives, r.true_positives) == (2, 3)
    assert r.accuracy == pytest.approx(0.5)
