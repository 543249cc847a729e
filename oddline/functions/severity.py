"""Severity and risk columns of security-event records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from oddline import fixed_values as fv


def is_anomaly_severity(severity: Column) -> Column:
    """Case-sensitive membership; a missing severity is normal."""
    return F.coalesce(severity.isin(*fv.ANOMALY_SEVERITIES), F.lit(False))


def severity_weight(severity: Column) -> Column:
    """Weight in [0, 1]; missing counts as info, unknown names as 0."""
    out = F.lit(0.0)
    for name, weight in fv.SEVERITY_WEIGHT.items():
        out = F.when(severity == name, weight).otherwise(out)
    return out


def severity_number(severity: Column) -> Column:
    """Rank 0..5, null for an unknown name."""
    out = F.lit(None).cast("int")
    for name, number in fv.SEVERITY_NUMBER.items():
        out = F.when(severity == name, number).otherwise(out)
    return out


def risk_score(df: DataFrame, parent: str = "advanced_metadata", field: str = "risk_score") -> Column:
    """Nested risk with its default; with a fixed schema missing equals null."""
    default = F.lit(float(fv.DEFAULT_RISK))
    parent_type = df.schema[parent].dataType if parent in df.columns else None
    if not isinstance(parent_type, StructType) or field not in parent_type.names:
        return default
    return F.coalesce(F.col(f"{parent}.{field}").cast("double"), default)


def metadata_features(df: DataFrame, severity_col: str = "severity", risk_col: str = "risk_score") -> Column:
    """``[risk / 100, severity weight]``; absent columns take their defaults."""
    risk = F.lit(float(fv.DEFAULT_RISK))
    if risk_col in df.columns:
        risk = F.coalesce(F.col(risk_col).cast("double"), risk)
    severity = severity_weight(F.col(severity_col)) if severity_col in df.columns else F.lit(0.0)
    return F.array(risk / 100.0, severity)
