r"""Log-line parsing as column expressions.

One ``select`` turns a raw line into time stamp, level, message, cleaned text
and id.  No Python runs per row.  Java's classes are ASCII by default, so every
pattern carries ``(?U)``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from oddline import fixed_values as fv

_SPACE = r"[\s\x1c-\x1f]"
_LEVEL = r"(?iU)\b(" + "|".join(fv.LOG_LEVELS) + r")\b"


@dataclass(frozen=True)
class CleanOptions:
    """What :func:`clean_text` masks and keeps; ``max_length`` cuts, ``None`` keeps all."""

    max_length: int | None = None
    mask_timestamps: bool = True
    mask_ips: bool = True
    mask_paths: bool = False
    lowercase: bool = True


def strip(text: Column) -> Column:
    """Trim all Unicode white space (``trim`` would only drop blanks)."""
    return F.regexp_replace(text, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def _first(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, f"(?U){pattern}", 0)


def _without_first(text: Column, pattern: str, flags: str = "Us") -> Column:
    """Drop only the first match: a lazy prefix stops the pattern there."""
    return strip(F.regexp_replace(text, rf"(?{flags})\A(.*?)(?:{pattern})(.*)\z", "$1$2"))


def _if_found(match: Column, parsed: Column) -> Column:
    """Parse only real matches: a failed parse costs an exception inside."""
    return F.when(match != "", parsed)


def _iso_time(match: Column) -> Column:
    # Position 11 is "T" or any white space; zone and fraction are cut off.
    plain = F.concat(F.substring(match, 1, 10), F.lit(" "), F.substring(match, 12, 8))
    return _if_found(match, F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ss")))


def _apache_time(match: Column) -> Column:
    # 19 of the 20 characters are kept, so the second has one digit.
    return _if_found(
        match, F.try_to_timestamp(F.substring(match, 1, 19), F.lit("dd/MMM/yyyy:HH:mm:s"))
    )


def _epoch_time(match: Column) -> Column:
    number = _if_found(match, match.try_cast("bigint"))
    last_second = 253402300799  # 9999-12-31 23:59:59
    return F.when(number > 10**12, F.timestamp_millis(number)).when(
        number <= last_second, F.timestamp_seconds(number)
    )


# (pattern, parser) in the order in which they are tried; a syslog time has no
# year and never parses.
_TIME_PARSERS = (
    (fv.TIMESTAMP_ISO, _iso_time),
    (fv.TIMESTAMP_APACHE, _apache_time),
    (fv.TIMESTAMP_EPOCH, _epoch_time),
)


def extract_timestamp(text: Column) -> Column:
    """Time of the first pattern whose first match is a real time, else null."""
    return F.coalesce(*[parse(_first(text, pattern)) for pattern, parse in _TIME_PARSERS])


def _add_time(df: DataFrame, text: Column) -> DataFrame:
    """Add ``timestamp`` and ``_rest``, the text without the match that gave it.

    One projection per pattern, so that each expression runs once per row, and
    later patterns only where the earlier ones gave nothing.
    """
    times: list[Column] = []
    rest = text
    for i, (pattern, parse) in enumerate(_TIME_PARSERS):
        parsed = parse(_first(text, pattern))
        for earlier in times:
            parsed = F.when(earlier.isNull(), parsed)
        df = df.withColumn(f"_time_{i}", parsed)
        times.append(F.col(f"_time_{i}"))
    for time, (pattern, _) in reversed(list(zip(times, _TIME_PARSERS))):
        rest = F.when(time.isNotNull(), _without_first(text, pattern)).otherwise(rest)
    return df.withColumns({"timestamp": F.coalesce(*times), "_rest": rest}).drop(
        *[f"_time_{i}" for i in range(len(times))]
    )


def _add_level(df: DataFrame) -> DataFrame:
    """Add ``log_level`` and take it out of ``_rest``."""
    df = df.withColumn("_found", F.upper(F.regexp_extract("_rest", _LEVEL, 1)))
    found, rest = F.col("_found"), F.col("_rest")
    inner = "|".join(fv.LOG_LEVELS)
    return df.withColumns(
        {
            "log_level": F.when(found == "WARN", "WARNING").when(found != "", found),
            "_rest": F.when(
                found != "", _without_first(rest, rf"\b(?:{inner})\b", flags="Uis")
            ).otherwise(rest),
        }
    ).drop("_found")


def clean_text(text: Column, options: CleanOptions = CleanOptions()) -> Column:
    """Mask the volatile parts of the whole text and normalise the rest.

    The optional cut to ``max_length`` characters comes last.
    """
    masks: list[tuple[str, str]] = []
    if options.mask_timestamps:
        masks += [(p, "<TIMESTAMP>") for p in fv.TIMESTAMP_PATTERNS]
    if options.mask_ips:
        masks.append((fv.IP_PATTERN, "<IP>"))
    if options.mask_paths:
        masks.append((fv.PATH_PATTERN, "<PATH>"))
    masks += [
        (fv.HEX_PATTERN, "<HEX>"),
        (fv.UUID_PATTERN, "<UUID>"),
        (f"{_SPACE}+", " "),
        (fv.DROPPED_CHARACTERS, ""),
    ]
    out = text
    for pattern, replacement in masks:
        out = F.regexp_replace(out, f"(?U){pattern}", replacement)
    if options.lowercase:
        out = F.lower(out)
    if options.max_length is not None:
        out = F.substring(out, 1, options.max_length)
    return strip(out)


def timestamp_text(ts: Column) -> Column:
    """Fraction only when there is one; ``None`` for no time."""
    whole = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    fraction = F.when(F.unix_micros(ts) % 1000000 != 0, F.date_format(ts, ".SSSSSS"))
    return F.coalesce(F.concat(whole, F.coalesce(fraction, F.lit(""))), F.lit("None"))


def log_id(raw: Column, ts: Column) -> Column:
    """First 12 hexadecimal digits of the digest of line and time."""
    return F.substring(F.md5(F.concat(raw, timestamp_text(ts))), 1, 12)


def parse_logs(
    df: DataFrame,
    raw_col: str = "raw_text",
    source: str | Column | None = None,
    options: CleanOptions = CleanOptions(),
) -> DataFrame:
    """Add the parsed columns to ``df``.

    Adds ``timestamp, log_level, message, cleaned_text, metadata, log_id`` and,
    if ``source`` is given, ``source`` (a literal or a column).  A narrow
    projection: no shuffle, and unused parts are pruned by the optimizer.
    """
    raw = F.col(raw_col)
    if source is not None:
        df = df.withColumn("source", F.lit(source) if isinstance(source, str) else source)
    parsed = _add_level(_add_time(df, raw))
    return (
        parsed.withColumns(
            {"message": strip(F.col("_rest")), "cleaned_text": clean_text(F.col("_rest"), options)}
        )
        .withColumns(
            {
                "metadata": F.struct(
                    F.length(raw).alias("original_length"),
                    F.length("cleaned_text").alias("cleaned_length"),
                ),
                "log_id": log_id(raw, F.col("timestamp")),
            }
        )
        .drop("_rest")
    )
