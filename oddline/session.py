"""Session set-up and the shared folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_epoch_folder: ContextVar[str] = ContextVar("epoch_folder", default="oddline")


def local_session(cores: int | str = 8, name: str = "oddline", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster use the one you are given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    All executors must reach it.  Where the setting is absent, a session that runs
    on one machine gets a temporary folder, remembered in the session; on a cluster
    that is an error, since every executor would write to a disk of its own.
    """
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        path = spark.conf.get("spark.oddline.scratch", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors reach")
        path = tempfile.mkdtemp(prefix="oddline-")
        spark.conf.set("spark.oddline.scratch", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below :func:`shared_dir`."""
    return f"{shared_dir(spark)}/{_epoch_folder.get()}/{label}-{uuid.uuid4().hex}"


@contextmanager
def removed_afterwards(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`durable` stores inside are removed at the end.

    For work that is over when the block ends, such as one micro-batch; DataFrames
    built on those tables are of no use after it.
    """
    folder = f"oddline/epoch-{uuid.uuid4().hex}"
    token = _epoch_folder.set(folder)
    try:
        yield
    finally:
        _epoch_folder.reset(token)
        remove(spark, f"{shared_dir(spark)}/{folder}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that the library itself made, wherever it is stored."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table below ``path`` was written to its end."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def durable(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back.

    Used where one result feeds several branches: the lineage is cut, a lost
    executor re-reads files instead of recomputing, and later scans still prune
    columns and push filters down.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
