"""Schema audit driven by a JSON rules document."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorlint.operators.violations import violations

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def schema_audit(df: DataFrame, rules_json: str) -> DataFrame:
    """Required fields that are missing and numeric fields of another type
    give dataset-level rows (decided from the schema on the driver);
    features whose geometry type is not allowed give one row each."""
    rules = json.loads(rules_json)
    spark = df.sparkSession
    types = {f.name: f.dataType for f in df.schema.fields}
    rows = [("MissingField", f) for f in rules.get("required_fields", []) if f not in types]
    rows += [("WrongFieldType", f) for f in rules.get("numeric_fields", [])
             if f in types and not isinstance(types[f], NUMERIC)]
    meta = spark.createDataFrame(rows, "error_type string, field string")
    out = []
    for et in ("MissingField", "WrongFieldType"):
        out.append(violations(meta.where(F.col("error_type") == et), et, fid=None,
                              message=F.format_string("field %s", "field"),
                              attrs=F.create_map(F.lit("field"), F.col("field"))))
    allowed = rules.get("allowed_geometry_types")
    if allowed:
        bad = df.where(F.col("geom").isNotNull() & ~F.col("geom.type").isin(allowed))
        out.append(violations(bad, "DisallowedGeometryType", message=F.lit("geometry type not allowed"),
                              attrs=F.create_map(F.lit("field"), F.lit(None).cast("string"))))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res
