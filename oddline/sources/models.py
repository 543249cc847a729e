"""Folders of stored models: every save is a new version, readers take the newest.

The old version stays whole while a new one is written, also where the model being
saved was read from the same folder; the new one counts only once its number is
written, which is the last step.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession, functions as F


def new_version(path: str) -> str:
    """An unused folder for the parts of one version."""
    return f"{path}/version-{uuid.uuid4().hex}"


def publish(spark: SparkSession, path: str, version: str) -> None:
    """Make ``version`` the one that :func:`newest_version` finds."""
    number = _versions(spark, path).agg(F.coalesce(F.max("number") + 1, F.lit(0))).first()[0]
    rows = [(number, version.rsplit("/", 1)[1])]
    spark.createDataFrame(rows, "number long, folder string").coalesce(1).write.mode(
        "append"
    ).parquet(f"{path}/versions")


def newest_version(spark: SparkSession, path: str) -> str:
    newest = _versions(spark, path).agg(F.max_by("folder", "number")).first()[0]
    if newest is None:
        raise FileNotFoundError(f"no model in {path}")
    return f"{path}/{newest}"


def _versions(spark: SparkSession, path: str):
    try:
        return spark.read.schema("number long, folder string").parquet(f"{path}/versions")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "number long, folder string")


def write_settings(spark: SparkSession, path: str, settings: dict) -> None:
    rows = [(k, str(v)) for k, v in settings.items()]
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.parquet(path)


def read_settings(spark: SparkSession, path: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.read.parquet(path).collect()}


def text_settings(encoder: object, clean: object) -> dict[str, str]:
    """What texts went through before they were vectors; these must be alike at scoring."""
    return {"encoder": encoder_name(encoder), "cleaning": repr(clean)}


def encoder_name(encoder: object) -> str:
    return f"{encoder.name}, {encoder.dim} values"


def check_settings(stored: dict[str, str], given: dict[str, str], names: Iterable[str] = ("encoder", "cleaning")) -> None:
    """Raise where a model would be used with vectors of another making."""
    for name in names:
        if stored.get(name) != given[name]:
            raise ValueError(f"the model has {name} {stored.get(name)}, given is {given[name]}")
