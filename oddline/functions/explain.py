"""Readable explanations built from columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from oddline import fixed_values as fv


def _banded(score: Column, pick: Callable[[tuple], str], outside: str) -> Column:
    out = F.lit(outside)
    for band in reversed(fv.SCORE_BANDS):
        out = F.when(score < band[0], pick(band)).otherwise(out)
    return F.when(score < 0, outside).otherwise(out)


def severity_band(score: Column) -> Column:
    return _banded(score, lambda band: band[1], fv.OUT_OF_BAND[0])


def severity_text(score: Column) -> Column:
    return _banded(score, lambda band: band[2], fv.OUT_OF_BAND[1])


def percent(x: Column, pattern: str = "0.00") -> Column:
    return F.concat(_number(x * 100.0, pattern), F.lit("%"))


def _number(x: Column, pattern: str) -> Column:
    return F.call_function("format_number", x, F.lit(pattern))


def summary(score: Column) -> Column:
    return F.concat(
        severity_band(score), F.lit(" severity anomaly detected. "), severity_text(score)
    )


def details(score: Column, distances: Column) -> Column:
    """Three lines; ``distances`` is the array of all neighbour distances."""
    mean = F.try_divide(
        F.aggregate(distances, F.lit(0.0), lambda acc, d: acc + d), F.size(distances).cast("double")
    )
    return F.array(
        F.concat(F.lit("Severity Level: "), severity_band(score)),
        F.concat(F.lit("Anomaly Score: "), percent(score)),
        F.coalesce(
            F.concat(F.lit("Mean Distance to Neighbors: "), _number(mean, "0.0000")),
            F.lit(fv.NO_NEIGHBORS),
        ),
    )


def recommendations(score: Column, text: Column) -> Column:
    """Advice by band, then by words found in the text."""
    band = severity_band(score)

    def texts(items: tuple[str, ...]) -> Column:
        return F.array(*[F.lit(i) for i in items])

    by_band = (
        F.when(band.isin("Critical", "High"), texts(fv.URGENT_ADVICE))
        .when(band == "Medium", texts(fv.WATCH_ADVICE))
        .otherwise(texts(fv.CALM_ADVICE))
    )
    lowered = F.lower(F.coalesce(text, F.lit("")))
    by_word = []
    for words, advice in fv.KEYWORD_ADVICE:
        hit = F.lit(False)
        for word in words:
            hit = hit | lowered.contains(word)
        by_word.append(F.when(hit, F.array(F.lit(advice))).otherwise(F.array().cast("array<string>")))
    return F.concat(by_band, *by_word)


def explanation(score: Column, text: Column, distances: Column, similar: Column) -> Column:
    """Struct of all explanation parts."""
    return F.struct(
        summary(score).alias("summary"),
        details(score, distances).alias("details"),
        similar.alias("similar_logs"),
        recommendations(score, text).alias("recommendations"),
    )


def report(log_id: Column, score: Column, parts: Column) -> Column:
    """The explanation as a text of many lines."""
    similar = parts["similar_logs"]
    similar_lines = F.transform(
        similar,
        lambda s: F.concat(
            F.lit("  ["), s["rank"].cast("string"), F.lit("] "), s["id"],
            F.lit(" (dist: "), _number(s["distance"], "0.0000"), F.lit(")"),
        ),
    )
    no_lines = F.array().cast("array<string>")
    lines = F.concat(
        F.array(
            F.lit(fv.REPORT_HEAD),
            F.concat(F.lit("Log ID: "), log_id),
            F.concat(F.lit("Score: "), percent(score)),
            F.concat(F.lit("\n"), parts["summary"]),
            F.lit("\n--- Details ---"),
        ),
        F.transform(parts["details"], lambda d: F.concat(F.lit("  • "), d)),
        F.when(
            F.size(similar) > 0, F.concat(F.array(F.lit("\n--- Similar Logs ---")), similar_lines)
        ).otherwise(no_lines),
        F.array(F.lit("\n--- Recommendations ---")),
        F.transform(parts["recommendations"], lambda r: F.concat(F.lit("  → "), r)),
        F.array(F.lit(fv.REPORT_TAIL)),
    )
    return F.concat_ws("\n", lines)
