"""Schemas shared by every job: geometry, violations, CRS table."""

from __future__ import annotations

from pyspark.sql import types as T

# A point, a ring (or a line) of points, a part made of rings, a geometry of
# parts.  Polygon: parts = [rings], ring 0 is the exterior, rings > 0 holes.
# LineString: one part with one ring (the line).  Point: one part, one ring,
# one point.  Multi* types simply carry several parts.  This is the GeoJSON
# coordinate nesting, so ingest is a projection, not a parse.
POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING = T.ArrayType(POINT)
PART = T.ArrayType(RING)
GEOMETRY = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("coords", T.ArrayType(PART)),
])
GEOMETRY_DDL = ("struct<type:string,coords:array<array<array<struct<x:double,y:double>>>>>")

POLYGONAL = ("Polygon", "MultiPolygon")
LINEAL = ("LineString", "MultiLineString")
PUNTAL = ("Point", "MultiPoint")

# One row per failed feature, part or pair.  fid NULL = dataset-level row.
VIOLATION = T.StructType([
    T.StructField("fid", T.LongType()),
    T.StructField("part", T.IntegerType()),
    T.StructField("error_type", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("other_fid", T.LongType()),
    T.StructField("other_part", T.IntegerType()),
    T.StructField("metric", T.DoubleType()),
    T.StructField("metric2", T.DoubleType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
])
VIOLATION_COLUMNS = [f.name for f in VIOLATION.fields]

# EPSG codes the engine knows and whether each is geographic
# (degrees) or projected (metres).
SRID_GEOGRAPHIC = {4326: True, 4283: True, 7844: True,
                   3107: False, 3111: False, 7899: False,
                   28355: False, 7855: False, 3857: False}

# Working (metric) CRS per dataset type.
WORK_SRID = {"suburb": 3107, "blocks": 3107, "floor": 3107, "building": 7855}
