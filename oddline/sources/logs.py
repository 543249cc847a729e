"""Reading log files and custom tables, writing results."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, functions as F
from pyspark.sql.types import StructType

from oddline.functions.text import strip
from oddline.session import durable

SPREAD_ROWS = 250_000  # rows of one task, at most, where an input is dealt anew
BAD_BYTES = "�"


def raw_lines(value: Column) -> Column:
    """Undecodable bytes dropped, then trimmed."""
    return strip(F.replace(F.make_valid_utf8(value), F.lit(BAD_BYTES), F.lit("")))


def _file_name() -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


def read_log_file(spark: SparkSession, path: str | list[str], source: str | None = None) -> DataFrame:
    """``(raw_text, source)`` of all non-blank lines; ``source`` is the file name by default."""
    lines = spark.read.text(path)
    origin = F.lit(source) if source is not None else _file_name()
    return lines.select(raw_lines(F.col("value")).alias("raw_text"), origin.alias("source")).filter(
        F.col("raw_text") != ""
    )


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header; give a schema to avoid the extra pass that infers one."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).csv(path)


def _one_value(text: Column) -> Column:
    """Whether the text is one JSON value; the parser itself would not mind what follows it."""
    inside = [F.concat(F.lit(a), text, F.lit(b)) for a, b in (("[", "]"), ('{"x":', "}"))]
    return F.try_parse_json(inside[0]).isNotNull() & F.try_parse_json(inside[1]).isNotNull()


def read_json(
    spark: SparkSession, path: str, schema: StructType | str | None = None, whole: bool | None = None
) -> DataFrame:
    """JSON lines, or a whole document per file.

    ``whole=None`` decides for every file: one whose lines are all records is read
    by lines, any other as one document.  A file that is neither raises an error
    when it is read; no record is left out or made up.
    """
    reader = (spark.read if schema is None else spark.read.schema(schema)).option("mode", "FAILFAST")
    if whole is not None:
        return reader.option("multiLine", whole).json(path)
    return _parsed(reader, json_records(spark, path))


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """``value``: a JSON text per record line, and one per file that is a document.

    Which files are documents is a table that lines are joined with; no list of files
    reaches the driver.  A document's lines are put together in one row, as the
    document reader would have it in one row, too.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), "value",
    )
    record = _one_value(F.col("value"))
    filled = lines.filter(F.trim("value") != "")
    kinds = durable(filled.groupBy("file").agg(F.bool_and(record).alias("by_line")), "json-kinds")
    by_line = filled.join(kinds.filter("by_line"), "file", "left_semi").select("value")
    ordered = F.sort_array(F.collect_list(F.struct("block", "pos", "value")))
    whole = (
        lines.join(kinds.filter("NOT by_line"), "file", "left_semi")
        .groupBy("file")
        .agg(F.array_join(F.transform(ordered, lambda x: x["value"]), "\n").alias("value"))
    )
    # The parser would stop after the first value; what follows would be lost.
    broken = F.raise_error(F.concat(F.lit("neither JSON lines nor one document: "), "file"))
    return by_line.union(whole.select(F.when(_one_value(F.col("value")), F.col("value")).otherwise(broken)))


def _parsed(reader: DataFrameReader, records: DataFrame) -> DataFrame:
    """The JSON reader over a column of texts; a top-level array gives a row per element."""
    spark = records.sparkSession
    texts = getattr(records._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(reader._jreader.json(texts), spark)


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV by its suffix, everything else as JSON."""
    return read_csv(spark, path, schema) if path.endswith(".csv") else read_json(spark, path, schema)


def require_column(df: DataFrame, name: str) -> None:
    if name not in df.columns:
        raise ValueError(f"column {name!r} not found; available columns: {df.columns}")


def text_or_empty(column: Column) -> Column:
    """A null becomes the empty string, anything else its text."""
    return F.coalesce(column.cast("string"), F.lit(""))


def optional_columns(df: DataFrame, names: list[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def with_seq(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Number the rows uniquely if they are not numbered yet.

    The numbers depend on how the input is split, so they are stored at once.
    """
    if seq in df.columns:
        return df
    return durable(df.withColumn(seq, F.monotonically_increasing_id()), "numbered")


def spread(df: DataFrame) -> DataFrame:
    """Give every core work where the input has fewer splits than cores or than ``SPREAD_ROWS`` asks for.

    ``df`` should be a stored table: counting it reads no rows.  Narrow rows lie in few
    splits, so without a bound a task would grow with the input.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, ceil(df.count() / SPREAD_ROWS))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def write_csv(df: DataFrame, path: str) -> None:
    """Scored rows as CSV files with a header, one per partition."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Append to a results table."""
    df.write.mode("append").parquet(path)
