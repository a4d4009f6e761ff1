"""File sources and sinks on files written by the test."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from vectorlint.functions import geometry as G
from vectorlint.functions import projection as PR
from vectorlint.sources import ingest as IN


def _tmp():
    return tempfile.mkdtemp(prefix="vectorlint-io-")


FC = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::4283"}},
      "features": [
          {"type": "Feature", "properties": {"name": "holed", "n": 1},
           "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]],
                                                           [[1, 1], [1, 2], [2, 2], [2, 1], [1, 1]]]}},
          {"type": "Feature", "properties": {"name": "multi", "n": 2},
           "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]],
                                                                [[[5, 5], [7, 5], [7, 7], [5, 7], [5, 5]]]]}},
          {"type": "Feature", "properties": {"name": "empty", "n": 3}, "geometry": None}]}


def test_read_geojson_collection(spark):
    d = _tmp()
    with open(os.path.join(d, "a.geojson"), "w") as fh:
        json.dump(FC, fh)
    df = IN.read_geojson(spark, d, multiline=True, id_col="n")
    r = {x.name: x for x in df.select("name", "srid", F.expr(G.geom_area("geom")).alias("a"), "geom").collect()}
    assert r["holed"].a == 15 and r["multi"].a == 4.5 and r["holed"].srid == 4283
    assert r["empty"].geom is None


def test_csv_wkt_and_lonlat(spark):
    d = _tmp()
    with open(os.path.join(d, "a.csv"), "w") as fh:
        fh.write("id,name,the_geom\n1,a,\"POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))\"\n"
                 "2,b,\"MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 7 5, 7 7, 5 7, 5 5)))\"\n3,c,\n")
    df = IN.read_csv(spark, d, id_col="id")
    r = {x.fid: x.a for x in df.select("fid", F.expr(G.geom_area("geom")).alias("a")).collect()}
    assert r == {1: 15.0, 2: 4.5}
    d2 = _tmp()
    with open(os.path.join(d2, "p.csv"), "w") as fh:
        fh.write("id,Longitude,LAT\n1,144.9,-37.8\n2,x,1\n")
    p = IN.read_csv(spark, d2, id_col="id").collect()
    assert [(x.fid, x.geom.coords[0][0][0].x) for x in p] == [(1, 144.9)]


def test_gml_and_kml(spark):
    d = _tmp()
    with open(os.path.join(d, "a.gml"), "w") as fh:
        fh.write('<root><zone><name>z1</name><gml:Polygon xmlns:gml="http://www.opengis.net/gml" '
                 'srsName="urn:ogc:def:crs:EPSG::4283"><gml:posList>0 0 2 0 2 2 0 2 0 0</gml:posList>'
                 '</gml:Polygon></zone></root>')
    g = IN.read_gml(spark, d, "zone").collect()
    assert len(g) == 1 and g[0].srid == 4283
    d2 = _tmp()
    with open(os.path.join(d2, "a.kml"), "w") as fh:
        fh.write('<kml><Document><Placemark><name>p1</name><Point><coordinates>144.9,-37.8,0</coordinates></Point></Placemark>'
                 '<Placemark><name>p2</name><LineString><coordinates>144.9,-37.8 145.0,-37.9</coordinates></LineString>'
                 '</Placemark></Document></kml>')
    k = {x.name: x.geom for x in IN.read_kml(spark, d2).collect()}
    assert k["p1"].type == "Point" and k["p2"].type == "LineString" and len(k["p2"].coords[0][0]) == 2


def test_write_report_and_geojson_sink(spark):
    df = IN.parse_wkt(spark.createDataFrame([(1, "POLYGON ((0 0, 1 0, 1 1, 0 0))")], "fid long, w string"), "w")
    d = _tmp()
    IN.write_report(df.drop("w"), os.path.join(d, "csv"))
    IN.write_geojson_features(df.drop("w"), os.path.join(d, "gj"))
    back = IN.read_geojson(spark, os.path.join(d, "gj"))
    assert back.select(F.expr(G.geom_area("geom"))).first()[0] == 0.5


def test_projection_origins(spark):
    df = spark.createDataFrame([(135.0, -32.0, 147.0, 0.0)], "lon1 double, lat1 double, lon2 double, lat2 double")
    x1, y1 = PR.forward_sql(3107, "lon1", "lat1")
    x2, y2 = PR.forward_sql(7855, "lon2", "lat2")
    r = df.select(F.expr(x1), F.expr(y1), F.expr(x2), F.expr(y2)).first()
    assert abs(r[0] - 1000000) < 1e-6 and abs(r[1] - 2000000) < 1e-6
    assert abs(r[2] - 500000) < 1e-6 and abs(r[3] - 10000000) < 1e-6
    # one degree of latitude along MGA 55's central meridian ~ 110.6 km * 0.9996
    y = df.select(F.expr(PR.forward_sql(7855, "147D", "-1D")[1])).first()[0]
    assert abs((10000000 - y) - 110574.4 * 0.9996) < 5


def test_geometry_collections(spark):
    from pyspark.sql import functions as F
    from vectorlint.sources import ingest as IN
    texts = ['{"type":"GeometryCollection","geometries":[]}', '{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,2]}]}',
             'GEOMETRYCOLLECTION (POINT (1 2), multipolygon (((0 0, 4 0, 4 4, 0 0)), ((9 9, 10 9, 10 10, 9 9), (9.5 9.2, 9.6 9.2, 9.6 9.3, 9.5 9.2))), POLYGON ((1 1, 2 1, 2 2, 1 1)))',
             '{"geometry":{"type":"GeometryCollection","geometries":[{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}]}}', "GEOMETRYCOLLECTION EMPTY", None, "broken {"]
    df = spark.createDataFrame(list(enumerate(texts)), "fid bigint, t string")
    got = {r.fid: r.g for r in df.select("fid", F.coalesce(IN.geojson_geometry(F.col("t")), IN.wkt_geometry("t")).alias("g")).collect()}
    assert [got[i] and (got[i].type, [len(p) for p in got[i].coords]) for i in range(7)] == [None, ("Point", [1]), ("MultiPolygon", [1, 2, 1]), ("Polygon", [1]), None, None, None]


def test_latlon_fallback_on_lines(spark):
    """A line layer has a centre of its own: by length; points by count; without geometry the preview centre."""
    from pyspark.sql import functions as F
    from helpers import features
    from vectorlint.operators.violations import violations
    from vectorlint.plans.runners import latlon_fallback
    line = lambda *p: {"type": "LineString", "coords": [[[{"x": float(x), "y": float(y)} for x, y in p]]]}
    point = lambda x, y: {"type": "Point", "coords": [[[{"x": float(x), "y": float(y)}]]]}
    for geoms, want in (([line((0, 0), (30, 0)), line((100, 10), (110, 10))], (37.5, 2.5)), ([point(1, 2), point(3, 6)], (2.0, 4.0)), ([None], (144.9631, -37.8136))):
        f = features(spark, list(enumerate(geoms)))
        v = violations(spark.createDataFrame([(None,)], "fid bigint"), "X", fid="fid", message=F.lit("m"))
        r = latlon_fallback(v, f).first()
        assert (r.lon, r.lat) == want
