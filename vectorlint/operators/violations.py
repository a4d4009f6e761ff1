"""Shaping rule output into the fixed violation schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorlint.model import VIOLATION, VIOLATION_COLUMNS

_TYPES = {f.name: f.dataType for f in VIOLATION.fields}


def _c(v) -> Column:
    if v is None:
        return F.lit(None)
    if isinstance(v, Column):
        return v
    return F.expr(v)


def violations(df: DataFrame, error_type: str, *, fid="fid", part=None, message=None,
               other_fid=None, other_part=None, metric=None, metric2=None, attrs=None) -> DataFrame:
    """Project ``df`` rows onto the violation schema.  Each argument is a
    column name / SQL expression / Column, or None for NULL."""
    vals = {
        "fid": _c(fid), "part": _c(part), "error_type": F.lit(error_type),
        "message": _c(message) if message is not None else F.lit(None),
        "other_fid": _c(other_fid), "other_part": _c(other_part),
        "metric": _c(metric), "metric2": _c(metric2),
        "attrs": _c(attrs) if attrs is not None else F.lit(None),
    }
    return df.select(*[vals[c].cast(_TYPES[c]).alias(c) for c in VIOLATION_COLUMNS])


def dataset_violation(spark_df: DataFrame, error_type: str, condition: Column, message: str,
                      metric=None, attrs=None) -> DataFrame:
    """One dataset-level row (fid NULL) when ``condition`` holds over the
    aggregated one-row frame ``spark_df``."""
    return violations(spark_df.where(condition), error_type, fid=None, message=F.lit(message),
                      metric=metric, attrs=attrs)


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], VIOLATION)


def comparable(v: DataFrame, digits: int = 6) -> DataFrame:
    """The columns the oracle compares: formatted text and maps left out,
    metrics rounded."""
    return v.select("fid", "part", "error_type", "other_fid", "other_part",
                    F.round("metric", digits).alias("metric"), F.round("metric2", digits).alias("metric2"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
