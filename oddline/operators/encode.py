"""Text to vectors as a batch job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from oddline import fixed_values as fv
from oddline.functions.vectors import l2_normalize
from oddline.operators.skew import salted_lookup
from oddline.session import durable


@dataclass(frozen=True)
class TokenHashEncoder:
    """Counts of lower-case words in ``dim`` hash buckets, scaled to unit length.

    Lexical, not semantic: texts are near each other if they share words.  It
    needs no model files and shuffles nothing.  Words are hashed in the plan; the
    buckets of an Arrow batch are counted at once, so the cost follows the words.
    """

    dim: int = fv.EMBEDDING_DIM
    normalize: bool = True
    name: str = "token-hash"

    def encode(self, df: DataFrame, text_col: str, out: str = "embedding") -> DataFrame:
        words = F.filter(F.split(F.lower(F.col(text_col)), r"\s+"), lambda w: w != "")
        number = lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint")
        buckets = F.transform(words, lambda w: F.pmod(number(w), F.lit(self.dim).cast("bigint")))
        dim, normalize = self.dim, self.normalize

        @F.pandas_udf("array<float>")
        def count(numbers: pd.Series) -> pd.Series:
            rows = [() if b is None else b for b in numbers]
            sizes = [len(b) for b in rows]
            flat = np.concatenate([np.asarray(b, dtype=np.int64) for b in rows]) if rows else np.zeros(0, np.int64)
            at = np.repeat(np.arange(len(rows)) * dim, sizes)
            found = np.bincount(at + flat, minlength=len(rows) * dim).reshape(len(rows), dim).astype(np.float64)
            if normalize:
                length = np.sqrt((found * found).sum(axis=1, keepdims=True))
                found = np.divide(found, length, out=np.zeros_like(found), where=length > 0)
            return pd.Series(list(found.astype(np.float32)))

        return df.withColumn(out, count(buckets))


@dataclass(frozen=True)
class ModelEncoder:
    """A caller's model, loaded once per executor process and fed Arrow batches.

    ``make_predict`` returns a function from an array of texts to a matrix, as
    ``pyspark.ml.functions.predict_batch_udf`` expects.  Each distinct text is
    encoded once; the vectors are joined back with hot texts split.
    """

    make_predict: Callable = field(repr=False)
    dim: int = fv.EMBEDDING_DIM
    batch_size: int = fv.ENCODER_BATCH
    normalize: bool = True
    name: str = "model"

    def encode(self, df: DataFrame, text_col: str, out: str = "embedding") -> DataFrame:
        from pyspark.ml.functions import predict_batch_udf

        predict = predict_batch_udf(
            self.make_predict, return_type=ArrayType(FloatType()), batch_size=self.batch_size
        )
        digest = F.sha2(text_col, 256).alias("_digest")  # a narrow key to look up by
        # Stored: keys are counted, texts made distinct and rows joined, so a text would be made three times.
        df = durable(df.withColumn("_digest", digest), "texts")
        texts = df.select(text_col).distinct()
        vectors = texts.withColumn("_v", predict(F.col(text_col)))
        vector = l2_normalize(F.col("_v")) if self.normalize else F.col("_v")
        vectors = vectors.select(digest, vector.cast("array<float>").alias(out))
        return salted_lookup(df, vectors, ["_digest"]).drop("_digest")


def encode_with_metadata(df: DataFrame, text_col: str, encoder, out: str = "embedding") -> DataFrame:
    """Vectors plus the name and the dimension of the encoder."""
    return encoder.encode(df, text_col, out).withColumns(
        {"model_name": F.lit(encoder.name), "embedding_dim": F.lit(encoder.dim)}
    )
