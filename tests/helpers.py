"""Fixture values and builders shared by the test modules."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def poly(*rings, typ="Polygon"):
    """Geometry struct value from rings given as lists of (x, y)."""
    def ring(r):
        pts = [{"x": float(x), "y": float(y)} for x, y in r]
        if pts and pts[0] != pts[-1]:
            pts.append(pts[0])
        return pts
    return {"type": typ, "coords": [[ring(r) for r in rings]]}


def multi(*polys):
    return {"type": "MultiPolygon", "coords": [p["coords"][0] for p in polys]}


def features(spark, rows, extra_schema=""):
    """DataFrame(fid, geom[, ...]) from (fid, geom dict[, ...]) tuples."""
    from vectorlint.model import GEOMETRY_DDL
    schema = f"fid bigint, geom {GEOMETRY_DDL}" + (", " + extra_schema if extra_schema else "")
    return spark.createDataFrame(rows, schema).withColumn("srid", F.lit(7855))
