"""Engine inputs derived from the test tables with Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from oddline.operators.encode import ModelEncoder, TokenHashEncoder
from oddline.functions.text import CleanOptions
from oddline.sources.logs import spread

DIM = 64
ENCODER = TokenHashEncoder(DIM)
SIGNS = 384  # three MD5 digests of a word


def sign_model():
    """A model as a caller would plug one in: a word is a vector of signs, a text their sum."""
    import hashlib

    known: dict[str, np.ndarray] = {}

    def signs(word: str) -> np.ndarray:
        if word not in known:
            if len(known) >= 100_000:
                known.clear()
            digits = b"".join(hashlib.md5(f"{i}:{word}".encode()).digest() for i in range(3))
            known[word] = 2.0 * np.unpackbits(np.frombuffer(digits, np.uint8)) - 1.0
        return known[word]

    def predict(texts: np.ndarray) -> np.ndarray:
        out = np.zeros((len(texts), SIGNS), np.float64)
        for row, text in zip(out, texts):
            for word in (text or "").split(" "):
                if word:
                    row += signs(word)
        return out.astype(np.float32)

    return predict


SIGN_MODEL = ModelEncoder(sign_model, SIGNS, name="word-signs")
WHOLE = CleanOptions(max_length=None)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def pick(column: Column, cases: dict[str, str], default: str | None = None) -> Column:
    out = F.lit(default)
    for key, value in cases.items():
        out = F.when(column == key, value).otherwise(out)
    return out


def event_severity() -> Column:
    return pick(
        F.col("event_type"),
        {"view": "info", "click": "low", "signup": "medium", "purchase": "high", "error": "critical"},
    )


def event_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines_of(spread(table(spark, sf, "events")))


def lines_of(events: DataFrame) -> DataFrame:
    """One log line per event, with its service, severity and risk."""
    service = F.concat(F.lit("svc-"), (F.col("user_id") % 7).cast("string"))
    level = pick(F.col("event_type"), {"error": "ERROR", "purchase": "WARN"}, "INFO")
    return events.select(
        F.col("event_id").alias("seq"),
        F.concat(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(" "), level,
            F.lit(" ["), service, F.lit("] "), F.col("event_type"),
            F.lit(" by user "), F.col("user_id").cast("string"), F.lit(" props "), F.col("props"),
        ).alias("raw_text"),
        service.alias("source"),
        "event_type",
        event_severity().alias("severity"),
        F.least("value", F.lit(100.0)).alias("risk_score"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def mixed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Event lines in seven forms: Apache, epoch, milliseconds, syslog, a time that is
    none before one that is, hexadecimal values with UUIDs, and no time."""
    e = spread(table(spark, sf, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    n, digest = F.col("event_id").cast("string"), F.md5(F.col("event_id").cast("string"))
    uuid = F.concat_ws(
        "-", *[F.substring(digest, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    )
    apache = F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss")
    forms = [
        F.concat(apache, F.lit(" INFO page "), n, F.lit(" served")),
        F.concat(F.unix_seconds("ts").cast("string"), F.lit(" ERROR job "), n),
        F.concat(F.lit("at "), F.unix_millis("ts").cast("string"), F.lit(" warn: job "), n),
        F.concat(F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" host kernel: [1.5] from 10.0.0."), n),
        F.concat(F.lit("2024-13-45T10:00:00Z "), apache, F.lit(" Critical state "), n),
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" debug at 0x"), F.lower(F.hex("event_id")),
                 F.lit(" for "), uuid),
        F.concat(F.lit("[WARNING] disk /dev/sd"), n, F.lit(" at 85%")),
    ]
    line = F.element_at(F.array(*forms), (F.col("event_id") % 7 + 1).cast("int"))
    return e.select(F.col("event_id").alias("seq"), line.alias("raw_text"))


def siem_records(spark: SparkSession, sf: str) -> DataFrame:
    """Security-event records with the nested risk."""
    e = table(spark, sf, "events")
    text = F.concat(F.col("event_type"), F.lit(" by user "), F.col("user_id").cast("string"),
                    F.lit(" with "), F.col("props"))
    return e.select(
        "event_id",
        "event_type",
        event_severity().alias("severity"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 7).cast("string")).alias("source"),
        text.alias("description"),
        F.concat(F.lit("CEF:0|shop|web|1|"), F.col("event_id").cast("string"), F.lit("|"),
                 F.col("event_type"), F.lit("|5|suser="), F.col("user_id").cast("string")).alias("raw_log"),
        F.when(
            F.col("event_type") != "signup",
            F.struct(F.least("value", F.lit(100.0)).alias("risk_score")),
        ).alias("advanced_metadata"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors with a text id; ``seq`` is the number of the vector."""
    return vectors_of(table(spark, sf, "embeddings"))


def vectors_of(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(
        F.col("vec_id").alias("seq"),
        F.format_string("v%07d", "vec_id").alias("id"),
        "embedding",
        "label",
    )


def vector_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of labels 0 to 7 are the normal ones; texts come from the documents."""
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), "text")
    joined = vectors(spark, sf).filter("label < 8").join(texts, "seq", "left")
    return joined.select(
        "seq", "id", "embedding",
        F.when(
            F.col("text").isNotNull(), F.create_map(F.lit("cleaned_text"), F.col("text"))
        ).alias("metadata"),
        F.lit(None).cast("timestamp").alias("ts"),
    )


def vector_records(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors with severity and risk by label, as hybrid detector input."""
    return records_of(vectors(spark, sf))


def records_of(rows: DataFrame) -> DataFrame:
    severities = ["info", "info", "low", "low", "medium", "medium", "info", "low", "high", "critical"]
    severity = F.element_at(F.array(*[F.lit(s) for s in severities]), F.col("label") + 1)
    return rows.select(
        "seq", "id", "embedding", "label",
        severity.alias("severity"),
        ((F.col("seq") * 37) % 101).cast("double").alias("risk_score"),
    )


def score_series(spark: SparkSession, sf: str) -> DataFrame:
    return series_of(table(spark, sf, "events"))


def series_of(events: DataFrame) -> DataFrame:
    """Scores in arrival order, per service; every seventh event arrives late."""
    late = F.when(F.col("event_id") % 7 == 0, F.expr("INTERVAL 5 HOURS")).otherwise(
        F.expr("INTERVAL 0 HOURS")
    )
    return events.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 7).cast("string")).alias("source"),
        (F.col("ts").cast("timestamp") - late).alias("ts"),
        # 193: means of such scores are no short decimals, so that rounding them
        # for a comparison meets no halves.
        F.least(F.col("value") / 193.0, F.lit(1.0)).alias("score"),
        (F.col("value") > 60).alias("is_anomaly"),
    )
