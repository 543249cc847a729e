"""Registered queries: each takes (session, folder) and runs over whole tables."""

from __future__ import annotations

from dataclasses import replace
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from oddline import fixed_values as fv
from oddline.functions import explain, scoring, severity as sev, text, vectors as vec
from oddline.operators import baseline as base, history as hist, metrics, similarity, windows
from oddline.operators.encode import encode_with_metadata
from oddline.operators.forest import fit_forest
from oddline.operators.knn import build_index, kmeans_index, knn
from oddline.plans import distance_detector as distance, hybrid_detector as hybrid
from oddline.plans.table_scoring import ScoredTable, score_table
from oddline.session import durable, scratch_path
from oddline.sources import corpus as store, logs as files, siem
from oddline.streaming import jobs, keyed
from workload import inputs

DETECTOR = distance.DetectorOptions(encoder=inputs.ENCODER)
HYBRID = hybrid.HybridOptions(
    semantic_weight=fv.TRAINING_SEMANTIC_WEIGHT, encoder=inputs.ENCODER
)


def six(column: str | Column, name: str | None = None) -> Column:
    out = F.round(column, 6)
    return out.alias(name or column)


def when_text(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


# --- parsing ---------------------------------------------------------------------


def _parsed_view(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        "seq",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts_text"),
        "log_level",
        "message",
        "cleaned_text",
        "log_id",
        F.col("metadata.original_length").cast("bigint").alias("original_length"),
        F.col("metadata.cleaned_length").cast("bigint").alias("cleaned_length"),
    )


def parse_event_logs(spark, sf):
    return _parsed_view(text.parse_logs(inputs.event_lines(spark, sf)))


def line_formats(spark, sf):
    return _parsed_view(text.parse_logs(inputs.mixed_lines(spark, sf)))


def level_counts(spark, sf):
    parsed = text.parse_logs(inputs.event_lines(spark, sf))
    return parsed.groupBy("source", "log_level").agg(F.count(F.lit(1)).alias("n"))


def clean_documents(spark, sf):
    d = inputs.documents(spark, sf)
    whole = text.clean_text(F.col("text"), inputs.WHOLE)
    return d.select(
        "doc_id",
        text.clean_text(F.col("text"), text.CleanOptions(max_length=fv.MAX_LOG_LENGTH)).alias("cleaned_text"),
        F.md5(whole).alias("whole_md5"),
        F.length(whole).cast("bigint").alias("whole_length"),
    )


def mask_paths(spark, sf):
    options = text.CleanOptions(
        max_length=None, mask_timestamps=False, mask_ips=False, mask_paths=True, lowercase=False
    )
    p = inputs.table(spark, sf, "pages")
    cleaned = text.clean_text(F.col("url"), options)
    return p.select("page_id", cleaned.alias("cleaned_url"))


def document_inputs(spark, sf):
    d = inputs.documents(spark, sf).join(inputs.table(spark, sf, "labels"), "doc_id", "left")
    d = d.withColumn("risk_score", F.when(F.col("toxic") == 1, 90.0)).withColumn(
        "severity", F.when(F.col("quality") == 0, "high").when(F.col("quality") == 1, "low")
    )
    files.require_column(d, "text")
    return d.select(
        "doc_id",
        F.md5(files.text_or_empty(F.col("text"))).alias("text_md5"),
        F.md5(files.text_or_empty(F.col("severity"))).alias("severity_md5"),
        six(sev.metadata_features(d)[0], "risk"),
        six(sev.metadata_features(d)[1], "severity_weight"),
        *files.optional_columns(d, ["severity", "no_such_column"]),
    )


# --- files -------------------------------------------------------------------------


def log_file_scan(spark, sf):
    path = scratch_path(spark, "lines")
    inputs.event_lines(spark, sf).select(
        F.concat(F.lit("  "), "raw_text", F.lit("\t")).alias("value")
    ).write.text(path)
    lines = files.read_log_file(spark, path, source="events.log")
    return text.parse_logs(lines).select("raw_text", "source", "log_level", "log_id")


def csv_scan(spark, sf):
    path = scratch_path(spark, "csv")
    files.write_csv(inputs.event_lines(spark, sf).drop("ts"), path)
    schema = "seq bigint, raw_text string, source string, event_type string, severity string, risk_score double"
    return files.read_csv(spark, path, schema)


def json_scan(spark, sf):
    path = scratch_path(spark, "json")
    siem_rows = inputs.siem_records(spark, sf)
    siem_rows.write.json(path)
    records = siem.load_records(spark, path)
    return siem.label_records(records).select("event_id", "severity", "risk_score", "is_anomaly")


# --- security events -----------------------------------------------------------------


def siem_labels(spark, sf):
    r = siem.label_records(inputs.siem_records(spark, sf))
    return r.select(
        "event_id", "severity", "risk_score", "is_anomaly",
        sev.severity_number(F.col("severity")).alias("severity_number"),
        sev.severity_weight(F.col("severity")).alias("severity_weight"),
    )


def siem_split(spark, sf):
    normal, odd = siem.split_normal_anomaly(siem.label_records(inputs.siem_records(spark, sf)))
    return normal.withColumn("part", F.lit("normal")).unionByName(
        odd.withColumn("part", F.lit("anomaly"))
    )


def siem_metadata(spark, sf):
    return siem.record_metadata(siem.label_records(inputs.siem_records(spark, sf)))


def siem_texts(spark, sf):
    r = inputs.siem_records(spark, sf)
    return siem.log_texts(r).select(F.lit("description").alias("kind"), F.col("description").alias("value")).unionByName(
        siem.raw_logs(r).select(F.lit("raw_log").alias("kind"), F.col("raw_log").alias("value"))
    )


def siem_totals(spark, sf):
    t = siem.totals(siem.label_records(inputs.siem_records(spark, sf)))
    return t.withColumn("avg_risk_score", F.round("avg_risk_score", 6))


def siem_value_counts(column, spark, sf):
    return siem.value_counts(inputs.siem_records(spark, sf), column)


# --- vectors -----------------------------------------------------------------------------


def hash_encode_documents(spark, sf):
    d = inputs.documents(spark, sf).select(
        "doc_id", text.clean_text(F.col("text"), inputs.WHOLE).alias("cleaned")
    )
    e = encode_with_metadata(d, "cleaned", inputs.ENCODER)
    return e.select(
        "doc_id", "model_name", "embedding_dim", F.posexplode_outer("embedding").alias("bucket", "weight")
    ).filter("weight > 0").withColumn("weight", F.round(F.col("weight").cast("double"), 6))


def model_encode_documents(spark, sf):
    """A model applied in batches to every different text: fixed random signs per word, 384 values."""
    d = inputs.documents(spark, sf).select(
        "doc_id", text.clean_text(F.col("text"), inputs.WHOLE).alias("cleaned")
    )
    e = encode_with_metadata(d, "cleaned", inputs.SIGN_MODEL)
    weighted = F.aggregate(
        F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x
    )
    return e.select(
        "doc_id", "model_name", "embedding_dim", F.size("embedding").alias("values"),
        F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first"),
        F.round(F.get("embedding", F.lit(383)).cast("double"), 5).alias("last"), F.round(weighted, 3).alias("weighted"),
    )


def knn_rows(metric, spark, sf):
    e = inputs.table(spark, sf, "embeddings")
    index = build_index(e, fv.K_NEIGHBORS + 1, metric, "vec_id")
    found = knn(e, index, fv.K_NEIGHBORS + 1, "vec_id").long()
    return found.select("query_id", "rank", "neighbor_id", six("distance"))


def knn_cells(probes, cells, spark, sf):
    e = inputs.table(spark, sf, "embeddings")
    index = kmeans_index(e, fv.K_NEIGHBORS, cells, id_col="vec_id")
    found = knn(e, index, fv.K_NEIGHBORS, "vec_id", probes=probes).long()
    return found.select("query_id", "rank", "neighbor_id", six("distance"))


def _label_means(spark, sf, label: Column | None = None) -> DataFrame:
    v = inputs.table(spark, sf, "embeddings")
    v = v if label is None else v.withColumn("label", label)
    return (
        v.select("label", F.posexplode_outer("embedding").alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("m"))
        .groupBy("label")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("pm"))
        .select("label", F.transform("pm", lambda p: p["m"]).alias("embedding"))
    )


def knn_label_cells(spark, sf):
    """Three of the cells around the mean vectors of the labels are probed."""
    e = inputs.table(spark, sf, "embeddings")
    means = _label_means(spark, sf).orderBy("label").collect()  # one per label
    index = build_index(e, fv.K_NEIGHBORS, id_col="vec_id", pivots=np.array([m["embedding"] for m in means]))
    found = knn(e, index, fv.K_NEIGHBORS, "vec_id", probes=3).long()
    return found.select("query_id", "rank", "neighbor_id", six("distance"))


def knn_two_levels(spark, sf):
    """Groups around the mean of two labels each, their cells around the mean of each: three groups, three cells."""
    e = inputs.table(spark, sf, "embeddings")
    means = [np.array(m["embedding"]) for m in _label_means(spark, sf).orderBy("label").collect()]  # one per label
    pairs = _label_means(spark, sf, F.col("label") % 5).orderBy("label").collect()
    index = build_index(
        e, fv.K_NEIGHBORS, id_col="vec_id", pivots=np.array([p["embedding"] for p in pairs]),
        members=[np.array(means[g::5]) for g in range(5)],
    )
    found = knn(e, index, fv.K_NEIGHBORS, "vec_id", probes=3).long()
    return found.select("query_id", "rank", "neighbor_id", six("distance"))


def neighborhood_stats(spark, sf):
    e = inputs.table(spark, sf, "embeddings")
    index = build_index(e, fv.K_NEIGHBORS, "squared_l2", "vec_id")
    stats = similarity.neighborhood_stats(knn(e, index, fv.K_NEIGHBORS, "vec_id"))
    return stats.select(
        "query_id", "num_neighbors",
        *[six(c) for c in ("mean_distance", "std_distance", "min_distance", "max_distance")],
    )


def text_search(spark, sf):
    """Benchmark passages against all documents, with the documents' metadata."""
    docs = inputs.documents(spark, sf).select(
        "doc_id", "source", text.clean_text(F.col("text"), inputs.WHOLE).alias("cleaned")
    )
    entries = durable(
        inputs.ENCODER.encode(docs, "cleaned").select(
            F.col("doc_id").alias("seq"), F.col("doc_id").alias("id"), "embedding",
            F.create_map(F.lit("source"), F.col("source")).alias("metadata"),
            F.lit(None).cast("timestamp").alias("ts"),
        )
    )
    passages = inputs.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), text.clean_text(F.col("text"), inputs.WHOLE).alias("cleaned")
    )
    model = distance.DistanceModel(
        entries, build_index(entries, fv.K_NEIGHBORS), base.Baseline(), DETECTOR
    )
    found = distance.search_texts(passages, model, text_col="cleaned")
    return found.select(
        "query_id", "rank", "neighbor_id", six("distance"), F.col("metadata")["source"].alias("source"),
        six("mean_distance"), six("min_distance"), six("max_distance"),
    )


def label_similarity(spark, sf):
    """Cosine of every vector with the mean vector of its own label."""
    v = inputs.table(spark, sf, "embeddings")
    means = _label_means(spark, sf).withColumnRenamed("label", "id")
    corpus = v.select(F.col("vec_id").alias("id"), "embedding")
    pairs = v.select(F.col("vec_id").alias("left_id"), F.col("label").alias("right_id"))
    out = similarity.pair_similarity(pairs, corpus, means, normalized=False)
    return out.select(F.col("left_id").alias("vec_id"), F.col("right_id").alias("label"), six("similarity"))


def similar_vectors(spark, sf):
    """All pairs of different vectors with a cosine of at least 0.3, and how many rows each has."""
    found = similarity.similar_pairs(inputs.table(spark, sf, "embeddings"), 0.3, "vec_id", cells=12)
    return found.pairs.select("left_id", "right_id", six("similarity"), "left_rows", "right_rows")


def neighbor_cosine(spark, sf):
    e = inputs.table(spark, sf, "embeddings")
    index = build_index(e, 2, "squared_l2", "vec_id")
    found = knn(e, index, 2, "vec_id").long()
    pairs = found.select(F.col("query_id").alias("left_id"), F.col("neighbor_id").alias("right_id"))
    rows = e.select(F.col("vec_id").alias("id"), vec.scale(F.col("embedding"), 3.0).alias("embedding"))
    out = similarity.pair_similarity(pairs, rows, rows, normalized=False)
    return out.select("left_id", "right_id", six("similarity"))


def normalized_vectors(spark, sf):
    e = inputs.table(spark, sf, "embeddings").withColumn(
        "unit", vec.l2_normalize(vec.scale(F.col("embedding"), 7.0))
    )
    return e.select("vec_id", F.posexplode_outer("unit").alias("pos", "x")).withColumn("x", F.round("x", 6))


def corpus_entries(spark, sf) -> DataFrame:
    """Two appends with repeated ids; the second brings no metadata."""
    v = inputs.table(spark, sf, "embeddings")
    name = F.concat(F.lit("id-"), (F.col("vec_id") % 90).cast("string"))
    first = v.filter("label < 6").select(
        F.col("vec_id").alias("seq"), name.alias("id"), "embedding",
        F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"),
        F.timestamp_seconds(F.col("vec_id") * 60).alias("ts"),
    )
    second = v.filter("label >= 6").select(
        (F.col("vec_id") + 1000000).alias("seq"), name.alias("id"), "embedding"
    )
    return store.append_entries(first, second)


def corpus_latest(spark, sf):
    return _entry_view(store.latest_entries(corpus_entries(spark, sf)))


def corpus_lookup(spark, sf):
    """The entries named by the labelled documents' numbers."""
    ids = inputs.table(spark, sf, "labels").select(F.concat(F.lit("id-"), F.col("doc_id").cast("string")).alias("id"))
    return _entry_view(store.lookup_many(corpus_entries(spark, sf), ids))


def _entry_view(latest: DataFrame) -> DataFrame:
    return latest.select(
        "id",
        F.round(vec.total(vec.as_double(F.col("embedding"))), 6).alias("embedding_sum"),
        F.col("metadata")["label"].alias("label"),
        when_text("ts").alias("ts_text"),
    )


def corpus_stats(spark, sf):
    return store.corpus_stats(corpus_entries(spark, sf))


# --- scoring ------------------------------------------------------------------------------------


def vector_model(spark, sf, percentile=fv.THRESHOLD_PERCENTILE) -> distance.DistanceModel:
    corpus = durable(inputs.vector_corpus(spark, sf), "vector-corpus")
    index = build_index(corpus, DETECTOR.k + 1)
    fitted = base.fit_baseline(corpus, index, percentile=percentile)
    return distance.DistanceModel(corpus, index, fitted, DETECTOR)


def baseline_distances(spark, sf):
    corpus = durable(inputs.vector_corpus(spark, sf), "vector-corpus")
    index = build_index(corpus, DETECTOR.k + 1)
    neighbors = knn(corpus, index, DETECTOR.k + 1, "seq")
    means = neighbors.expand(base.baseline_distances(neighbors))
    return means.select("query_id", six("mean_distance"))


def baseline_threshold(spark, sf):
    b = vector_model(spark, sf).baseline
    # One row of fitted numbers over the whole corpus.
    return spark.range(1).select(
        six(F.lit(b.threshold), "threshold"), six(F.lit(b.mean), "mean"), six(F.lit(b.std), "std")
    )


def anomaly_scores(spark, sf):
    model = vector_model(spark, sf)
    scored = distance.score_vectors(inputs.vectors(spark, sf), model)
    return scored.select(
        "seq", six("mean_distance"), six("score"), "is_anomaly", six("confidence"),
        F.concat_ws(",", "nearest_neighbors").alias("neighbors"),
    )


def unfitted_scores(spark, sf):
    """The scores of a model that was stored without its threshold."""
    model = vector_model(spark, sf)
    path = scratch_path(spark, "model")
    distance.save(model, path)
    loaded = distance.load(spark, path, DETECTOR, with_baseline=False)
    scored = distance.score_vectors(inputs.vectors(spark, sf), loaded)
    return scored.select("seq", six("score"), "is_anomaly", six("confidence"))


def reloaded_scores(spark, sf):
    model = vector_model(spark, sf)
    path = scratch_path(spark, "model")
    distance.save(model, path)
    loaded = distance.load(spark, path, DETECTOR)
    scored = distance.score_vectors(inputs.vectors(spark, sf), loaded)
    return scored.select("seq", six("score"), "is_anomaly", six("confidence"))


def grown_scores(spark, sf):
    """A model that grew: the first half of the corpus, stored, read, and the other half added."""
    corpus = durable(inputs.vector_corpus(spark, sf), "vector-corpus")
    middle = corpus.agg(F.max("seq")).first()[0] // 2
    half = distance.fit_entries(durable(corpus.filter(F.col("seq") <= middle)), DETECTOR)
    path = scratch_path(spark, "model")
    distance.save(half, path)
    model = distance.fit_entries(
        durable(corpus.filter(F.col("seq") > middle)), DETECTOR, distance.load(spark, path, DETECTOR)
    )
    scored = distance.score_vectors(inputs.vectors(spark, sf), model)
    return scored.select("seq", six("mean_distance"), six("score"), "is_anomaly", six("confidence"))


def anomaly_scores_ip(spark, sf):
    """The detector with products in place of distances."""
    options = replace(DETECTOR, metric="IP")
    model = distance.fit_entries(durable(inputs.vector_corpus(spark, sf), "vector-corpus"), options)
    scored = distance.score_vectors(inputs.vectors(spark, sf), model)
    return scored.select("seq", six("mean_distance"), six("score"), "is_anomaly", six("confidence"))


def sure_anomalies(spark, sf):
    model = vector_model(spark, sf)
    scored = distance.score_vectors(inputs.vectors(spark, sf), model)
    return base.anomalies_by_score(scored, 0.3, "seq").select("seq", six("score"), six("confidence"))


# --- time ----------------------------------------------------------------------------------------


def time_adjusted_scores(key, spark, sf):
    s = windows.adjust_scores(inputs.score_series(spark, sf), key, ["seq"])
    return s.select(
        "seq",
        *[F.round(f"window_stats.{c}", 6).alias(f"window_{c}") for c in ("mean", "std", "min", "max")],
        F.col("window_stats.count").alias("window_count"),
        six("temporal_weight"),
        six("time_adjusted_score"),
    )


def burst_flags(spark, sf):
    return windows.burst_flags(
        inputs.score_series(spark, sf), ["source"], ["seq"], factor=1.2
    ).select("seq", "source", "is_burst")


def score_windows(spark, sf):
    s = windows.time_series(inputs.score_series(spark, sf), ["source"], ["seq"])
    return s.select(
        "seq",
        F.size("series").alias("window_rows"),
        when_text(F.element_at("series", 1)["ts"]).alias("first_ts"),
        when_text(F.element_at("series", -1)["ts"]).alias("last_ts"),
        F.round(F.aggregate("series", F.lit(0.0), lambda a, x: a + x["score"]), 6).alias("score_sum"),
    )


def temporal_features(spark, sf):
    e = inputs.table(spark, sf, "events")
    features = vec.temporal_features(F.col("ts"))
    return e.select("event_id", F.posexplode_outer(features).alias("pos", "x")).withColumn(
        "x", F.round("x", 6)
    )


def augmented_vectors(spark, sf):
    """Every event with the vector its number comes round to."""
    v = inputs.table(spark, sf, "embeddings")
    e = inputs.table(spark, sf, "events").select(
        "event_id", (F.col("event_id") % v.count()).alias("vec_id"), "ts"
    )
    both = e.join(v, "vec_id").withColumn("augmented", vec.augment(F.col("embedding"), F.col("ts")))
    return both.select(
        "event_id",
        "vec_id",
        F.size("augmented").alias("dim"),
        F.round(vec.total(F.col("augmented")), 6).alias("total"),
        F.round(F.element_at("augmented", 65), 6).alias("hour_share"),
    )


# --- explanations -----------------------------------------------------------------------------------


def score_bands(spark, sf):
    score = F.col("value") / 100.0 - 0.05
    return inputs.table(spark, sf, "events").select(
        "event_id",
        explain.severity_band(score).alias("band"),
        explain.severity_text(score).alias("sentence"),
        scoring.display_band(score).alias("display"),
        scoring.alert_band(score).alias("alert"),
    )


def recommendations(spark, sf):
    d = inputs.documents(spark, sf)
    score = (F.col("doc_id") % 100) / 100.0
    return d.select("doc_id", F.concat_ws("|", explain.recommendations(score, F.col("text"))).alias("advice"))


def _explained_vectors(spark, sf) -> DataFrame:
    model = vector_model(spark, sf, percentile=40)
    scored = durable(distance.score_vectors(inputs.vectors(spark, sf), model), "scored-vectors")
    texts = inputs.documents(spark, sf).select(F.col("doc_id").alias("seq"), F.col("text").alias("cleaned_text"))
    return distance.add_explanations(
        scored.join(texts, "seq", "left"), model.corpus
    ).filter("is_anomaly")


def explanations(spark, sf):
    e = _explained_vectors(spark, sf)
    similar = F.transform(
        "explanation.similar_logs",
        lambda s: F.concat(s["rank"].cast("string"), F.lit(":"), s["id"], F.lit(":"), s["text"]),
    )
    return e.select(
        "seq",
        F.col("explanation.summary").alias("summary"),
        *[F.element_at("explanation.details", i).alias(f"detail_{i}") for i in (1, 2, 3)],
        F.concat_ws("|", similar).alias("similar"),
        F.concat_ws("|", "explanation.recommendations").alias("advice"),
    )


def reports(spark, sf):
    e = _explained_vectors(spark, sf)
    identity = F.format_string("v%07d", "seq")
    return e.select("seq", explain.report(identity, F.col("score"), F.col("explanation")).alias("report"))


# --- hybrid ---------------------------------------------------------------------------------------------


def _hybrid_rows(spark, sf) -> DataFrame:
    return _with_meta(inputs.vector_records(spark, sf))


def _with_meta(r: DataFrame) -> DataFrame:
    return durable(
        r.select(
            "seq", "id", "embedding", "label",
            sev.metadata_features(r).alias("meta"),
            sev.is_anomaly_severity(F.col("severity")).alias("severity_flag"),
        ),
        "hybrid-input",
    )


def _hybrid_model(spark, sf, with_forest=True) -> tuple[DataFrame, hybrid.HybridModel]:
    rows = _hybrid_rows(spark, sf)
    return rows, hybrid.fit_vectors(rows.filter("NOT severity_flag"), HYBRID, with_forest)


def hybrid_features(spark, sf):
    rows = _hybrid_rows(spark, sf)
    scaler = hybrid.fit_scaler(rows.filter("NOT severity_flag"))
    combined = hybrid.combine(rows, scaler, HYBRID.semantic_weight)
    return combined.select("seq", F.posexplode_outer("features").alias("pos", "x")).withColumn(
        "x", F.round("x", 6)
    )


def hybrid_distance_scores(spark, sf):
    rows, model = _hybrid_model(spark, sf, with_forest=False)
    scored = hybrid.score_vectors(rows, model)
    return scored.select("seq", six("mean_distance"), six("distance_score"))


def reloaded_hybrid_scores(spark, sf):
    """The distance scores of a hybrid model stored without a forest."""
    rows, model = _hybrid_model(spark, sf, with_forest=False)
    path = scratch_path(spark, "hybrid-model")
    hybrid.save(model, path)
    scored = hybrid.score_vectors(rows, hybrid.load(spark, path, HYBRID))
    return scored.select("seq", six("mean_distance"), six("distance_score"))


def stream_hybrid_scores(spark, sf):
    """The hybrid detector on a stream of vectors."""
    _, model = _hybrid_model(spark, sf, with_forest=False)
    stream = _table_stream(spark, sf, "embeddings")
    out = scratch_path(spark, "stream-hybrid")

    def score(batch: DataFrame) -> DataFrame:
        return hybrid.score_vectors(_with_meta(inputs.records_of(inputs.vectors_of(batch))), model)

    _finish(jobs.score_stream(stream, score, out, scratch_path(spark, "ckpt")))
    return jobs.read_epochs(spark, out).select("seq", six("mean_distance"), six("distance_score"))


def isolation_forest_counts(spark, sf):
    """What holds for every forest: full binary trees, and the flagged share."""
    rows = _hybrid_rows(spark, sf).select(F.col("seq").alias("id"), F.col("embedding").alias("features"))
    forest = fit_forest(rows)
    trees = forest.trees.groupBy("tree").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("feature") < 0).alias("leaves")
    )
    full = trees.agg(
        F.count(F.lit(1)).alias("trees"),
        F.count_if(F.col("nodes") != 2 * F.col("leaves") - 1).alias("broken_trees"),
        F.count_if(F.col("leaves") > forest.sample).alias("oversized_trees"),
    )
    flags = rows.select((forest.decision(F.col("features")) < 0).alias("odd"))
    flagged = flags.agg(F.count(F.lit(1)).alias("scored"), F.count_if("odd").alias("flagged"))
    return full.withColumn("_all", F.lit(1)).join(flagged.withColumn("_all", F.lit(1)), "_all").drop("_all")


def isolation_forest(spark, sf):
    rows = _hybrid_rows(spark, sf).select(F.col("seq").alias("id"), F.col("embedding").alias("features"))
    forest = fit_forest(rows)
    decided = rows.select("id", forest.decision(F.col("features")).alias("decision"))
    return decided.select("id", six("decision"), (F.col("decision") < 0).alias("is_outlier"))


def hybrid_detect(spark, sf):
    rows, model = _hybrid_model(spark, sf)
    scored = hybrid.score_vectors(rows, model)
    return scored.select("seq", six("score"), "is_anomaly", six("distance_score"), six("iso_score"))


def hybrid_log_detect(spark, sf):
    """Train on the lines of normal severity, save, load, detect all lines."""
    lines = inputs.event_lines(spark, sf)
    normal = lines.filter(~sev.is_anomaly_severity(F.col("severity")))
    path = scratch_path(spark, "hybrid-model")
    hybrid.save(hybrid.fit(normal, HYBRID), path)
    found = hist.detection_response(hybrid.detect(lines, hybrid.load(spark, path, HYBRID)))
    return found.select(
        "seq", "log_id", six("score"), "is_anomaly", "confidence",
        F.size("neighbors").alias("neighbors"), F.col("explanation.summary").alias("summary"),
    )


def _score_documents(spark, sf) -> ScoredTable:
    """Custom-table scoring of all documents, trained on those labelled not toxic."""
    d = inputs.documents(spark, sf).join(inputs.table(spark, sf, "labels"), "doc_id", "left")
    d = d.select(
        F.col("doc_id").alias("seq"),
        F.col("text").alias("description"),
        F.when(F.col("toxic") == 1, 90.0).alias("risk_score"),
        F.col("toxic").alias("label"),
    )
    options = hybrid.HybridOptions(
        semantic_weight=HYBRID.semantic_weight, encoder=inputs.ENCODER, clean=inputs.WHOLE
    )
    train = d.filter("label = 0").select("seq", F.col("description").alias("raw_text"), "risk_score")
    return score_table(d, hybrid.fit(train, options), label_col="label")


def _quality(m: DataFrame) -> DataFrame:
    return m.select("tp", "tn", "fp", "fn", "n", "unlabelled", *[six(c) for c in ("accuracy", "precision", "recall", "f1")])


def document_table_scores(spark, sf):
    """How well the flags of the scored table meet its labels."""
    return _quality(_score_documents(spark, sf).metrics())


def document_scores(spark, sf):
    """Score and flag of every row of the scored table."""
    return _score_documents(spark, sf).rows.select("seq", six("anomaly_score"), "is_anomaly_pred")


def _scored_documents(spark, sf) -> ScoredTable:
    """A scored table whose scores follow from the number of the document: for what is done
    with scores.  The scoring itself is in ``document_scores``."""
    d = inputs.documents(spark, sf).join(inputs.table(spark, sf, "labels"), "doc_id", "left")
    score = ((F.col("doc_id") * 37) % 1009) / 1009.0
    rows = d.select(
        F.col("doc_id").alias("seq"), F.col("text").alias("description"), "toxic",
        score.alias("anomaly_score"), (score > 0.7).alias("is_anomaly_pred"),
    )
    return ScoredTable(durable(rows, "scored-table"), "description", "toxic")


def scored_table_metrics(spark, sf):
    return _quality(_scored_documents(spark, sf).metrics())


def scored_table_top(spark, sf):
    return _scored_documents(spark, sf).top().withColumn("anomaly_score", F.round("anomaly_score", 6))


def scored_table_anomalies(spark, sf):
    return _scored_documents(spark, sf).anomalies().select("seq", six("anomaly_score"), F.md5("description").alias("text_md5"))


def scored_table_csv(spark, sf):
    """The scored table written as CSV and read back, whole texts with all their line ends."""
    path = scratch_path(spark, "scored-csv")
    _scored_documents(spark, sf).save(path)
    back = files.read_csv(spark, path, "description string, toxic int, anomaly_score double, is_anomaly_pred boolean")
    return back.select(F.md5("description").alias("text_md5"), "toxic", six("anomaly_score"), "is_anomaly_pred")


def hybrid_scores_given_forest(spark, sf):
    """Hybrid score and flag where distance and forest decision are columns of the events."""
    r = siem.label_records(inputs.siem_records(spark, sf))
    z = scoring.hybrid_z(F.col("risk_score") / 10.0, F.lit(4.0), F.lit(2.5))
    forest = (F.col("event_id") % 41) / 40.0 - 0.3
    return r.select(
        "event_id", six(scoring.hybrid_score(z, forest), "score"),
        scoring.hybrid_flag(z, forest, F.col("is_anomaly")).alias("flag"),
    )


def json_folder_scan(spark, sf):
    """A folder with JSON-lines files and files that are one document each."""
    path = scratch_path(spark, "mixed-json")
    rows = inputs.siem_records(spark, sf).select("event_id", "severity")
    rows.filter("event_id % 3 <> 0").write.json(path)
    # Documents of 1,000 records each, so that their number grows with the table.
    listed = rows.filter("event_id % 3 = 0").groupBy(F.floor(F.col("event_id") / 3000).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("event_id", "severity"))).alias("all")
    )
    pretty = F.concat(F.lit("[\n"), F.concat_ws(",\n", F.transform("all", lambda r: F.to_json(r))), F.lit("\n]"))
    listed.select(pretty.alias("value")).write.mode("append").option("maxRecordsPerFile", 1).text(path)
    return files.read_json(spark, path, "event_id bigint, severity string")


# --- evaluation -----------------------------------------------------------------------------------------


def label_quality(spark, sf):
    counts = metrics.confusion(inputs.table(spark, sf, "labels"), F.col("toxic"), 1 - F.col("quality"))
    q = metrics.quality(counts)
    return q.select("tp", "tn", "fp", "fn", "n", *[six(c) for c in ("accuracy", "precision", "recall", "f1")])


def quality_by_source(spark, sf):
    joined = inputs.table(spark, sf, "labels").join(
        inputs.documents(spark, sf).select("doc_id", "source"), "doc_id"
    )
    counts = metrics.confusion(joined, F.col("toxic"), 1 - F.col("quality"), ["source"])
    return metrics.quality(counts).select("source", "tp", "tn", "fp", "fn", "n", six("f1"))


def _flagged_events(spark, sf) -> DataFrame:
    r = siem.label_records(inputs.siem_records(spark, sf))
    return r.withColumn("flag", F.col("risk_score") > 40)


def detection_rates(spark, sf):
    rates = metrics.detection_rates(_flagged_events(spark, sf), "is_anomaly", "flag")
    return rates.withColumn("rate", F.round("rate", 6))


def first_of_class_rates(spark, sf):
    rates = metrics.balanced_rates(_flagged_events(spark, sf), "is_anomaly", "flag", ["event_id"])
    return rates.select("true_negatives", "true_positives", six("tnr"), six("tpr"), six("accuracy"))


# --- history ----------------------------------------------------------------------------------------------


def history(spark, sf) -> DataFrame:
    """Detections made from the events: the value is the score."""
    lines = text.parse_logs(inputs.event_lines(spark, sf))
    score = F.least(F.col("risk_score") / 100.0, F.lit(1.0))
    odd = score > 0.5
    none = F.array().cast("array<string>")
    parts = explain.explanation(
        score, F.col("cleaned_text"), F.array(score), F.array().cast(distance.NO_SIMILAR)
    )
    return lines.select(
        "seq", "log_id", F.col("cleaned_text").alias("cleaned_log"), score.alias("score"),
        odd.alias("is_anomaly"), none.alias("neighbors"), "ts", "event_type",
        F.when(odd & (F.col("seq") % 3 != 0), parts).alias("explanation"),
    )


def history_status(spark, sf):
    return hist.status(inputs.vector_corpus(spark, sf), history(spark, sf), True)


def history_rate(spark, sf):
    return hist.anomaly_rate(history(spark, sf)).withColumn("rate", F.round("rate", 6))


def recent_history(spark, sf):
    return hist.recent(history(spark, sf)).select("seq", "log_id", six("score"), "is_anomaly")


def recent_alerts(spark, sf):
    return hist.alert_view(hist.recent_alerts(history(spark, sf)))


def all_alerts(spark, sf):
    view = hist.alert_view(hist.anomalies_newest_first(history(spark, sf)))
    return view.select("seq", "short_id", "severity", "summary")


def detection_responses(spark, sf):
    r = hist.detection_response(history(spark, sf))
    return r.select(
        "seq", "log_id", "cleaned_log", six("score"), "is_anomaly", "confidence",
        F.col("explanation.summary").alias("summary"),
    )


def anomaly_trend(spark, sf):
    t = hist.trend(history(spark, sf))
    return t.select(when_text("bucket_start").alias("bucket_start"), "total", "anomalies")


def alerts_by_category(spark, sf):
    return hist.by_category(history(spark, sf), "event_type").withColumn("share", F.round("share", 6))


def appended_history(spark, sf):
    path = scratch_path(spark, "history")
    rows = history(spark, sf).select("seq", "log_id", "score", "is_anomaly")
    files.append_rows(rows.filter("is_anomaly"), path)
    files.append_rows(rows.filter("NOT is_anomaly"), path)
    return spark.read.parquet(path).withColumn("score", F.round("score", 6))


# --- whole detector ------------------------------------------------------------------------------------------


def detect_event_logs(spark, sf):
    """Flagship: fit on the lines of normal severity, detect all lines."""
    lines = inputs.event_lines(spark, sf)
    normal = lines.filter(~sev.is_anomaly_severity(F.col("severity")))
    model = distance.fit(normal.select("seq", "raw_text"), DETECTOR)
    found = distance.detect(lines.select("seq", "raw_text", "source"), model, ["source"])
    return found.select(
        "seq",
        "log_id",
        six("anomaly_score.score", "score"),
        six("temporal_context.original_score", "original_score"),
        six("temporal_context.weight", "weight"),
        "anomaly_score.is_anomaly",
        six("anomaly_score.confidence", "confidence"),
        F.col("explanation.summary").alias("summary"),
    )


def detected_responses(spark, sf):
    """The flat view of the detector's nested results."""
    lines = inputs.event_lines(spark, sf)
    normal = lines.filter(~sev.is_anomaly_severity(F.col("severity")))
    model = distance.fit(normal.select("seq", "raw_text"), DETECTOR)
    r = hist.detection_response(distance.detect(lines.select("seq", "raw_text", "source"), model, ["source"]))
    return r.select(
        "seq", "log_id", six("score"), "is_anomaly", six("confidence"),
        F.size("neighbors").alias("neighbors"), F.col("explanation.summary").alias("summary"),
    )


# --- streams ----------------------------------------------------------------------------------------------------


def _table_stream(spark, sf, name: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of files: a pattern matches both."""
    return jobs.read_files(spark, f"{sf}/{name}.parque[t]", inputs.table(spark, sf, name).schema)


def _event_stream(spark, sf) -> DataFrame:
    return _table_stream(spark, sf, "events")


def _finish(query) -> None:
    query.awaitTermination()


def stream_parse(spark, sf):
    parsed = jobs.parse_stream(inputs.lines_of(_event_stream(spark, sf)))
    out = scratch_path(spark, "stream-parse")
    _finish(jobs.write_append(_parsed_view(parsed), out, scratch_path(spark, "ckpt")))
    return spark.read.parquet(out)


def stream_scores(spark, sf):
    lines = inputs.event_lines(spark, sf)
    normal = lines.filter(~sev.is_anomaly_severity(F.col("severity")))
    model = distance.fit(normal.select("seq", "raw_text"), DETECTOR)
    stream = inputs.lines_of(_event_stream(spark, sf)).select("seq", "raw_text")
    out = scratch_path(spark, "stream-scores")

    def score(batch: DataFrame) -> DataFrame:
        stored = distance.encode_queries(batch, DETECTOR).select("seq", "embedding")
        return distance.score_vectors(stored, model)

    _finish(jobs.score_stream(stream, score, out, scratch_path(spark, "ckpt")))
    return jobs.read_epochs(spark, out).select("seq", six("score"), "is_anomaly", six("confidence"))


class _Arriving:
    """Rows in arrival order as parts of equally many files; a micro-batch reads one part."""

    def __init__(self, spark, rows: DataFrame, parts: int = 3):
        numbers = rows.agg(F.max("seq").alias("last"), F.count(F.lit(1)).alias("n")).first()
        self.files = max(1, numbers["n"] // (parts * 250_000))
        self.path, self.spark, self.schema = scratch_path(spark, "arriving"), spark, rows.schema
        part = F.least(F.floor(F.col("seq") * parts / ((numbers["last"] or 0) + 1)), F.lit(parts - 1))
        self.rows = durable(rows.withColumn("_part", part), "arriving-rows")

    def add(self, *parts: int) -> None:
        for part in parts:
            rows = self.rows.filter(F.col("_part") == part).drop("_part")
            rows.repartition(self.files, "seq").write.mode("append").parquet(self.path)

    def stream(self) -> DataFrame:
        return jobs.read_files(self.spark, self.path, self.schema, max_files=self.files)


def _event_model(spark, lines: DataFrame) -> distance.DistanceModel:
    normal = lines.filter(~sev.is_anomaly_severity(F.col("severity")))
    return distance.fit(normal.select("seq", "raw_text"), DETECTOR)


def _detected(found: DataFrame) -> DataFrame:
    return found.select(
        "seq", "log_id", six("time_adjusted_score", "score"), six("score", "original_score"),
        six("temporal_weight", "weight"), "is_anomaly", six("confidence"),
    )


def stream_windows(spark, sf):
    """Score windows over three micro-batches; their state is kept by the job."""
    arriving = _Arriving(spark, inputs.score_series(spark, sf))
    arriving.add(0, 1, 2)
    out = scratch_path(spark, "stream-windows")
    _finish(
        jobs.window_stream(
            arriving.stream(), ["source"], ["seq"], out, scratch_path(spark, "state"), scratch_path(spark, "ckpt")
        )
    )
    return jobs.read_epochs(spark, out).select(
        "seq", six("temporal_weight"), six("time_adjusted_score"), "is_burst"
    )


def stream_trend(spark, sf):
    """Counts per bucket and epoch, added up; three micro-batches."""
    arriving = _Arriving(spark, inputs.score_series(spark, sf))
    arriving.add(0, 1, 2)
    out = scratch_path(spark, "stream-trend")
    _finish(jobs.trend_stream(arriving.stream(), out, scratch_path(spark, "ckpt")))
    return jobs.running_trend(spark, out).withColumn("bucket_start", when_text("bucket_start"))


def stream_detect(spark, sf):
    """The detector on a stream of three micro-batches: the windows go on."""
    lines = inputs.event_lines(spark, sf)
    arriving = _Arriving(spark, lines.select("seq", "raw_text", "source"))
    arriving.add(0, 1, 2)
    out = scratch_path(spark, "stream-detect")
    _finish(
        jobs.detect_stream(
            arriving.stream(), _event_model(spark, lines), ["source"], out, scratch_path(spark, "state"),
            scratch_path(spark, "ckpt"), source=F.col("source"),
        )
    )
    return _detected(jobs.read_epochs(spark, out))


def _two_runs(arriving: _Arriving, start) -> None:
    """Two micro-batches, a stop, and a third one by a new query from the checkpoint."""
    arriving.add(0, 1)
    _finish(start())
    arriving.add(2)
    _finish(start())


def stream_keyed_detect(spark, sf):
    """The same detector as a streaming plan with a state per key, stopped and started again."""
    lines = inputs.event_lines(spark, sf)
    arriving = _Arriving(spark, lines.select("seq", "raw_text", "source"))
    model, out, kept = _event_model(spark, lines), scratch_path(spark, "stream-keyed"), scratch_path(spark, "ckpt")

    def start():
        with keyed.keyed_state(spark):
            return keyed.write_detected(arriving.stream(), model, ["source"], out, kept, F.col("source"))

    _two_runs(arriving, start)
    return _detected(spark.read.parquet(out))


def stream_keyed_windows(spark, sf):
    """Score windows with a state per key over three micro-batches and a restart."""
    arriving = _Arriving(spark, inputs.score_series(spark, sf))
    out, kept = scratch_path(spark, "stream-keyed"), scratch_path(spark, "ckpt")

    def start():
        with keyed.keyed_state(spark):
            return jobs.write_append(keyed.keyed_windows(arriving.stream(), ["source"]), out, kept)

    _two_runs(arriving, start)
    return spark.read.parquet(out).select("seq", six("temporal_weight"), six("time_adjusted_score"), "is_burst")


def stream_event_trend(spark, sf):
    """Event-time buckets with a watermark; rows behind it are counted as late and not lost."""
    arriving = _Arriving(spark, inputs.score_series(spark, sf))
    out, kept = scratch_path(spark, "stream-trend"), scratch_path(spark, "ckpt")

    def start():
        with keyed.keyed_state(spark):
            return jobs.write_append(keyed.event_time_trend(arriving.stream()), out, kept)

    _two_runs(arriving, start)
    found = keyed.trend_of_epochs(spark.read.parquet(out))
    return found.select(when_text("bucket_start").alias("bucket_start"), "total", "anomalies")


def stream_alert_rate(spark, sf):
    stream = inputs.series_of(_event_stream(spark, sf))
    out, rates = scratch_path(spark, "alerts"), scratch_path(spark, "rates")
    _finish(jobs.alert_stream(stream, out, rates, scratch_path(spark, "ckpt")))
    alerts = jobs.read_epochs(spark, out).agg(F.count(F.lit(1)).alias("stored_alerts"))
    totals = jobs.running_rate(spark, rates).withColumn("rate", F.round("rate", 6))
    one = F.lit(1).alias("_all")  # one row each
    return totals.select("*", one).join(alerts.select("*", one), "_all").drop("_all")


def registry():
    named = [
        parse_event_logs, line_formats, level_counts, clean_documents, mask_paths, document_inputs,
        log_file_scan, csv_scan, json_scan,
        siem_labels, siem_split, siem_metadata, siem_texts, siem_totals,
        hash_encode_documents, model_encode_documents, knn_label_cells, knn_two_levels, neighborhood_stats, text_search, label_similarity,
        similar_vectors, neighbor_cosine, normalized_vectors, corpus_latest, corpus_lookup, corpus_stats,
        baseline_distances, baseline_threshold, anomaly_scores, unfitted_scores, reloaded_scores,
        grown_scores, anomaly_scores_ip, sure_anomalies, burst_flags, score_windows, temporal_features, augmented_vectors,
        score_bands, recommendations, explanations, reports,
        hybrid_features, hybrid_distance_scores, isolation_forest, hybrid_detect,
        hybrid_log_detect, document_table_scores, document_scores, reloaded_hybrid_scores, isolation_forest_counts,
        scored_table_metrics, scored_table_top, scored_table_anomalies, scored_table_csv,
        hybrid_scores_given_forest, json_folder_scan,
        label_quality, quality_by_source, detection_rates, first_of_class_rates,
        history_status, history_rate, recent_history, recent_alerts, all_alerts,
        detection_responses, anomaly_trend, alerts_by_category, appended_history,
        detect_event_logs, detected_responses, stream_hybrid_scores,
        stream_parse, stream_scores, stream_windows, stream_trend, stream_alert_rate, stream_detect, stream_keyed_detect,
        stream_keyed_windows, stream_event_trend,
    ]
    out = {f.__name__: f for f in named}
    out["siem_stats_by_type"] = partial(siem_value_counts, "event_type")
    out["siem_stats_by_severity"] = partial(siem_value_counts, "severity")
    out["knn_l2"] = partial(knn_rows, "squared_l2")
    out["knn_ip"] = partial(knn_rows, "inner_product")
    out["knn_euclid"] = partial(knn_rows, "euclidean")
    out["knn_ivf"] = partial(knn_cells, 8, 20)
    out["knn_ivf_all_cells"] = partial(knn_cells, 20, 20)
    out["time_adjusted_scores"] = partial(time_adjusted_scores, ["source"])
    out["time_adjusted_scores_global"] = partial(time_adjusted_scores, [])
    return {name: partial(in_utc, query) for name, query in out.items()}


def in_utc(query, spark, sf) -> DataFrame:
    """Times of the tables have no zone; read and print them as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return query(spark, sf)
