"""Attribute, aggregate and CRS checks.

Grouped checks are hash aggregates with map-side partial aggregation, so a
value held by a third of all rows costs one partial row per partition.
Checks that flag every member of a group join the (small) per-key result
back on the key instead of windowing over the hot key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorlint.model import SRID_GEOGRAPHIC
from vectorlint.operators.violations import violations

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


# ----------------------------------------------------- suburb semantics ----

def duplicate_name(df: DataFrame, col: str = "suburb") -> DataFrame:
    """A1 DuplicateSuburbName: name used by more than one row (null names
    dropped); dataset-level rows with metric = count."""
    g = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n")).where("n > 1")
    return violations(g, "DuplicateSuburbName", fid=None, message=F.format_string("Suburb name repeated %d times", "n"),
                      metric="n", attrs=F.create_map(F.lit(col), F.col(col).cast("string")))


def missing_value(df: DataFrame, col: str = "postcode", error_type: str = "MissingPostcode") -> DataFrame:
    """A2: the column is null."""
    return violations(df.where(F.col(col).isNull()), error_type, message=F.lit(f"{col} is missing"))


# Date formats that are accepted besides ISO.
DATE_FORMATS = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy/M/d", "yyyyMMdd", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "M/d/yyyy",
                "d/M/yyyy H:mm", "d/M/yyyy H:mm:ss")


def invalid_date(df: DataFrame, col: str = "legalstartdate", error_type: str = "InvalidLegalStartDate") -> DataFrame:
    """A3: text that no usual date format reads (missing counts as bad): ISO
    date/time, day-first with / - or ., compact, and month names.
    ``try_to_timestamp`` so ANSI mode yields NULL instead of failing."""
    text = f"trim(CAST({col} AS STRING))"
    reads = ", ".join([f"try_to_timestamp({text})", *[f"try_to_timestamp({text}, '{f}')" for f in DATE_FORMATS]])
    bad = df.where(F.expr(f"coalesce({reads}) IS NULL"))
    return violations(bad, error_type, message=F.lit(f"Cannot parse {col}"))


def non_contiguous_parts(parts_df: DataFrame, key: str = "suburb") -> DataFrame:
    """A4 NonContiguousParts: more than one exploded part row per key."""
    g = parts_df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return violations(g, "NonContiguousParts", fid=None, message=F.lit("Suburb has multiple disconnected parts"),
                      metric="n", attrs=F.create_map(F.lit(key), F.col(key).cast("string")))


def many_to_one(df: DataFrame, key: str, other: str, error_type: str) -> DataFrame:
    """Distinct non-null ``other`` values per non-null ``key`` > 1."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(other).alias("n")).where("n > 1")
    return violations(g, error_type, fid=None, message=F.format_string(f"%d distinct {other} values", "n"),
                      metric="n", attrs=F.create_map(F.lit(key), F.col(key).cast("string")))


def suburb_multi_postcode(df: DataFrame) -> DataFrame:
    return many_to_one(df, "suburb", "postcode", "SuburbToMultiplePostcodes")


def postcode_multi_suburb(df: DataFrame) -> DataFrame:
    return many_to_one(df, "postcode", "suburb", "PostcodeToMultipleSuburbs")


# --------------------------------------------------- generic attributes ----

def attribute_not_null(df: DataFrame, fields: list[str], skip_missing: bool = True) -> DataFrame:
    """A8 AttributeNotNull: one row per (feature, field) that is null; an
    absent field is skipped, or gives one dataset-level row."""
    frames = []
    for f in fields:
        if f not in df.columns:
            if not skip_missing:
                frames.append(violations(df.limit(1), "AttributeNotNull", fid=None,
                                         message=F.lit(f"Field '{f}' not found"),
                                         attrs=F.create_map(F.lit("field"), F.lit(f))))
            continue
        frames.append(violations(df.where(F.col(f).isNull()), "AttributeNotNull",
                                 message=F.lit(f"Null in field '{f}'"), attrs=F.create_map(F.lit("field"), F.lit(f))))
    if not frames:
        return violations(df.limit(0), "AttributeNotNull")
    return reduce(DataFrame.unionByName, frames)


def attribute_in_domain(df: DataFrame, field: str, domain, skip_missing: bool = True) -> DataFrame:
    """A9 AttributeInDomain: value not in ``domain`` (a list, or a one-column
    DataFrame for big domains, joined with left_anti); null fails."""
    if field not in df.columns:
        return violations(df.limit(0 if skip_missing else 1), "AttributeInDomain", fid=None,
                          message=F.lit(f"Field '{field}' not found"))
    if isinstance(domain, DataFrame):
        d = domain.select(F.col(domain.columns[0]).alias("_v")).distinct()
        bad = df.join(d, df[field].eqNullSafe(d["_v"]), "left_anti")
    else:
        vals = list(domain)
        has_null = any(v is None for v in vals)
        vals = [v for v in vals if v is not None]
        cond = F.col(field).isin(vals) if vals else F.lit(False)
        cond = F.coalesce(cond, F.lit(has_null))
        bad = df.where(~cond)
    return violations(bad, "AttributeInDomain", message=F.format_string("Value '%s' not in domain", F.col(field).cast("string")),
                      attrs=F.create_map(F.lit("field"), F.lit(field)))


def unique_field(df: DataFrame, field: str, skip_missing: bool = True) -> DataFrame:
    """A10 UniqueField: every row whose value (null included) occurs more
    than once."""
    if field not in df.columns:
        return violations(df.limit(0 if skip_missing else 1), "UniqueField", fid=None,
                          message=F.lit(f"Field '{field}' not found"))
    counts = df.groupBy(F.col(field).alias("_v")).agg(F.count("*").alias("n")).where("n > 1")
    bad = df.join(counts, df[field].eqNullSafe(counts["_v"]))
    return violations(bad, "UniqueField", message=F.format_string("Duplicate value '%s'", F.col(field).cast("string")),
                      metric="n", attrs=F.create_map(F.lit("field"), F.lit(field)))


def null_counts(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """A11 (series): ``column, null_count`` for every column, one aggregate
    pass (``count_if``) and an ``unpivot``."""
    cols = [c for c in df.columns if c not in exclude]
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "null_count")


def null_values(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """A11 NullValues: one dataset-level row per column with nulls."""
    nc = null_counts(df, exclude).where("null_count > 0")
    return violations(nc, "NullValues", fid=None,
                      message=F.format_string("%d NULLs in column '%s'", "null_count", "column"),
                      metric="null_count", attrs=F.create_map(F.lit("column"), F.col("column")))


def negative_value(df: DataFrame, col: str = "floor_space", error_type: str = "NegativeFloorSpace") -> DataFrame:
    """Value < 0; an absent column gives no rows."""
    if col not in df.columns:
        return violations(df.limit(0), error_type)
    return violations(df.where(F.col(col) < 0), error_type, message=F.lit(f"{col} is negative"), metric=col)


def total_consistency(df: DataFrame, total_col: str = "total", exclude: tuple[str, ...] = ("fid", "srid")) -> DataFrame:
    """A13 TotalConsistency: the sum of all other numeric columns (nulls as
    0; geometry and ``exclude`` left out) exceeds the total."""
    if total_col not in df.columns:
        return violations(df.limit(0), "TotalConsistency")
    comps = [f.name for f in df.schema.fields
             if isinstance(f.dataType, NUMERIC) and f.name not in (total_col, *exclude)]
    s = reduce(lambda a, b: a + b, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in comps], F.lit(0.0))
    x = df.withColumn("_sum", s)
    return violations(x.where(F.col("_sum") > F.col(total_col)), "TotalConsistency",
                      message=F.lit("Sum of components exceeds total"), metric="_sum", metric2=total_col)


def conflict_block_uses(df: DataFrame, block_col: str = "block_id", use_col: str = "space_use",
                        threshold: int = 3) -> DataFrame:
    """A14 ConflictBlockUses: distinct uses per block > threshold; the
    violation id is the block id."""
    if block_col not in df.columns or use_col not in df.columns:
        return violations(df.limit(0), "ConflictBlockUses")
    g = df.where(F.col(block_col).isNotNull()).groupBy(block_col).agg(F.countDistinct(use_col).alias("n")).where(f"n > {threshold}")
    return violations(g, "ConflictBlockUses", fid=block_col,
                      message=F.format_string(f"%d distinct uses (> {threshold})", "n"), metric="n")


def slk_exceeds_true_distance(df: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Straight-line-kilometre span longer than the true-distance span."""
    x = df.withColumn("_slk", F.col("end_slk") - F.col("start_slk")).withColumn(
        "_true", F.col("end_true_dist") - F.col("start_true_dist"))
    return violations(x.where(F.col("_slk") > F.col("_true") + tol), "SlkExceedsTrueDistance",
                      message=F.lit("SLK span exceeds true distance span"), metric="_slk", metric2="_true")


# ------------------------------------------------------------------ CRS ----

def _srids(df: DataFrame, col: str = "srid") -> DataFrame:
    return df.select(F.col(col).alias("srid")).distinct()


def crs_not_projected(df: DataFrame, col: str = "srid") -> DataFrame:
    """A16 CRSNotProjected: one dataset row per CRS that is missing or
    geographic."""
    geo = [k for k, v in SRID_GEOGRAPHIC.items() if v]
    s = _srids(df, col).where(F.col("srid").isNull() | F.col("srid").isin(geo))
    return violations(s, "CRSNotProjected", fid=None, metric="srid",
                      message=F.lit("Data are not in a projected CRS. Reproject before area/length checks."))


def expected_crs(df: DataFrame, allowed=(4326, 7844), col: str = "srid") -> DataFrame:
    """A17 ExpectedCRS: CRS missing, or not in the allowed set."""
    s = _srids(df, col).where(F.col("srid").isNull() | ~F.col("srid").isin(list(allowed)))
    return violations(s, "ExpectedCRS", fid=None, metric="srid",
                      message=F.when(F.col("srid").isNull(), F.lit("CRS is missing (None).")).otherwise(
                          F.format_string("CRS EPSG:%d not in allowed set", "srid")))


def crs_missing(df: DataFrame, col: str = "srid") -> DataFrame:
    """A18 CRSCheck: CRS missing."""
    s = _srids(df, col).where(F.col("srid").isNull())
    return violations(s, "CRSCheck", fid=None, message=F.lit("CRS is missing (None)"))


def crs_audit(df: DataFrame, expected: int = 4283, col: str = "srid") -> DataFrame:
    """S20 (re-aimed): one dataset row per CRS that differs from the
    expected one."""
    s = _srids(df, col).where(~F.col("srid").eqNullSafe(F.lit(expected)))
    return violations(s, "UnexpectedCRS", fid=None, metric="srid", metric2=F.lit(float(expected)),
                      message=F.lit(f"CRS differs from EPSG:{expected}"))


# ------------------------------------------------------------- reports ----

def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram between the column's min and max (the
    maximum falls in the last bin): ``bin, lo, hi, n``.  The bounds are one
    aggregate used as a scalar subquery."""
    v = df.select(F.col(col).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    rng = v.agg(F.struct(F.min("v").alias("lo_"), F.max("v").alias("hi_"))).scalar()
    x = v.withColumn("lo_", rng["lo_"]).withColumn("hi_", rng["hi_"])
    b = F.expr(f"CASE WHEN hi_ = lo_ THEN 0 ELSE least(CAST(floor((v - lo_) / ((hi_ - lo_) / {bins})) AS INT), {bins - 1}) END")
    g = x.withColumn("bin", b).groupBy("bin", "lo_", "hi_").agg(F.count("*").alias("n"))
    return g.select("bin", F.expr(f"lo_ + bin * (hi_ - lo_) / {bins}").alias("lo"),
                    F.expr(f"lo_ + (bin + 1) * (hi_ - lo_) / {bins}").alias("hi"), "n")


def sample_rows(df: DataFrame, n: int = 10, seed: int = 42, key: str = "fid") -> DataFrame:
    """A seeded, repeatable sample of n rows (hash order, top-n)."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(n)
