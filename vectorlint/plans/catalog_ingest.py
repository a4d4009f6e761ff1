"""Registered ingest / decoding queries (S-family).  Text and file inputs
are rendered from the blocks fixture inside each query (B7), so the work
grows with the tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from vectorlint.functions import geometry as G
from vectorlint.functions import projection as PR
from vectorlint.operators import spatial as S
from vectorlint.plans.catalog import B1_X, CENTROID_SQL, R6, _blocks, register, with_
from vectorlint.sources import ingest as IN

_AREA_SQL = with_(*B1_X) + """
SELECT f.fid, round(coalesce(sum(p.area), 0), 6) AS area
FROM b1_feat f LEFT JOIN b1_pa p ON p.fid = f.fid WHERE f.has_geom GROUP BY f.fid"""


def _area_out(df):
    return df.select("fid", F.round(F.expr(G.geom_area("geom")), R6).alias("area"))


@register("wkt_to_rings", _AREA_SQL)
def q_wkt_to_rings(spark, sf):
    """Blocks rendered as WKT text, decoded back; area per feature."""
    t = _blocks(spark, sf).where("geom IS NOT NULL").select("fid", IN.to_wkt("geom").alias("wkt"))
    return _area_out(IN.parse_wkt(t, "wkt"))


@register("geojson_text_to_rings", _AREA_SQL)
def q_geojson_text_to_rings(spark, sf):
    """Blocks rendered as GeoJSON Feature text, decoded back."""
    t = _blocks(spark, sf).where("geom IS NOT NULL").select(
        "fid", F.concat(F.lit('{"type":"Feature","geometry":'), IN.to_geojson("geom"), F.lit("}")).alias("txt"))
    return _area_out(t.withColumn("geom", IN.geojson_geometry(F.col("txt"))))


@register("swap_latlon", with_(*B1_X) + "\nSELECT fid, min(y) + 100 AS minx, min(x) AS miny FROM b1_v GROUP BY fid")
def q_swap_latlon(spark, sf):
    """WKT written with y + 100 second: most rows have |2nd number| > 90,
    so the axes are swapped."""
    b = _blocks(spark, sf).where("geom IS NOT NULL").withColumn("geom", F.expr(
        "named_struct('type', geom.type, 'coords', transform(geom.coords, p -> transform(p, r -> "
        "transform(r, q -> named_struct('x', q.x, 'y', q.y + 100D)))))"))
    t = b.select("fid", IN.to_wkt("geom").alias("wkt"))
    g = IN.swap_if_latlon(IN.parse_wkt(t, "wkt"), "wkt")
    bd = G.geom_bounds("geom")
    return g.select("fid", F.expr(bd["minx"]).alias("minx"), F.expr(bd["miny"]).alias("miny"))


@register("detect_lonlat", "SELECT 'Longitude' AS lon_col, 'LAT' AS lat_col, CAST(count(*) AS BIGINT) AS n, round(min(140 + p_partkey / 1000.0), 6) AS west, "
          "round(max(140 + p_partkey / 1000.0), 6) AS east, round(min(-38 + p_size / 100.0), 6) AS south, round(max(-38 + p_size / 100.0), 6) AS north FROM part")
def q_detect_lonlat(spark, sf):
    """Coordinate columns found by name (case-insensitive), and the extent of the points they give."""
    t = spark.read.parquet(f"{sf}/part.parquet").selectExpr(
        "p_partkey", "140 + p_partkey / 1000.0 AS Longitude", "-38 + p_size / 100.0 AS LAT", "p_name AS x_name")
    lon, lat = IN.detect_lonlat(t.columns)
    q = F.col("geom").getField("coords")[0][0][0]
    g = IN.from_lonlat(t, lon, lat).where("geom IS NOT NULL")
    return g.agg(F.count("*").alias("n"), F.round(F.min(q["x"]), R6).alias("west"), F.round(F.max(q["x"]), R6).alias("east"),
                 F.round(F.min(q["y"]), R6).alias("south"), F.round(F.max(q["y"]), R6).alias("north")).select(
        F.lit(lon).alias("lon_col"), F.lit(lat).alias("lat_col"), "*")


@register("points_from_lonlat", "SELECT p_partkey AS fid, round(140 + p_partkey / 1000.0, 6) AS x, round(-38 + p_size / 100.0, 6) AS y FROM part")
def q_points_from_lonlat(spark, sf):
    """Point geometry from the detected lon/lat columns."""
    t = spark.read.parquet(f"{sf}/part.parquet").selectExpr(
        "p_partkey AS fid", "140 + p_partkey / 1000.0 AS Longitude", "-38 + p_size / 100.0 AS LAT")
    lon, lat = IN.detect_lonlat(t.columns)
    g = IN.from_lonlat(t, lon, lat)
    return g.select("fid", F.round(F.col("geom").getField("coords")[0][0][0]["x"], R6).alias("x"),
                    F.round(F.col("geom").getField("coords")[0][0][0]["y"], R6).alias("y"))


@register("detect_geom_column", """
SELECT * FROM (VALUES ('the_geom', 0, 0), ('notes', 1, 3)) t(col_name, how, pos)""")
def q_detect_geom_column(spark, sf):
    """Name candidates first, then string columns holding WKT / JSON."""
    b = _blocks(spark, sf).select(
        "fid", "school_name", "p_type", F.when(F.col("geom").isNotNull(), IN.to_wkt("geom")).alias("the_geom"),
        F.when(F.col("fid") % 97 == 5, F.lit('{"note": 1}')).otherwise(F.lit("plain")).alias("notes"))
    return IN.geometry_candidates(b).where("column <> 'the_geom' OR how = 0").withColumnRenamed("column", "col_name")


@register("assign_crs", with_(*B1_X) + """
SELECT fid, CASE WHEN fid % 3 = 0 THEN 4283 WHEN fid % 3 = 1 THEN 7855 ELSE 4326 END AS srid FROM b1_feat""")
def q_assign_crs(spark, sf):
    """CRS from srsName / EPSG text, default 4326."""
    b = _blocks(spark, sf).select("fid", F.expr(
        "CASE WHEN fid % 3 = 0 THEN 'urn:ogc:def:crs:EPSG::4283' WHEN fid % 3 = 1 THEN 'EPSG:7855' END").alias("crs"))
    return b.select("fid", IN.srid_from_text(F.col("crs"), 4326).alias("srid"))


@register("drop_null_geom", with_(*B1_X) + "\nSELECT fid FROM b1_feat WHERE has_geom")
def q_drop_null_geom(spark, sf):
    """Rows whose geometry text does not decode are dropped."""
    t = _blocks(spark, sf).select("fid", F.when(F.col("geom").isNotNull(), IN.to_wkt("geom")).otherwise(F.lit("EMPTY??")).alias("wkt"))
    return IN.parse_wkt(t, "wkt").where("geom IS NOT NULL").select("fid")


@register("point_file_fallback", with_(*B1_X) + "\nSELECT fid, gtype FROM b1_feat WHERE has_geom")
def q_point_file_fallback(spark, sf):
    """A point layer whose text column carries polygons is re-derived."""
    b = _blocks(spark, sf).where("geom IS NOT NULL")
    cx, cy = G.centroid_xy("geom")
    t = b.select("fid", IN.to_wkt("geom").alias("shape_txt"), F.struct(
        F.lit("Point").alias("type"),
        F.array(F.array(F.array(F.struct(F.expr(cx).alias("x"), F.expr(cy).alias("y")))))).alias("geom"))
    return IN.point_file_fallback(t, ["shape_txt"]).select("fid", F.col("geom.type").alias("gtype"))


@register("geom_type_guard", with_(*B1_X) + """
SELECT bool_or(gtype IN ('Polygon', 'MultiPolygon')) AS ok, string_agg(DISTINCT gtype, ',' ORDER BY gtype) AS types FROM b1_feat WHERE has_geom""")
def q_geom_type_guard(spark, sf):
    """The building layer has polygons (types present listed)."""
    g = IN.dataset_guard(_blocks(spark, sf).where("geom IS NOT NULL"), "building")
    return g.select("ok", F.array_join("types", ",").alias("types"))


@register("coord_range_check", CENTROID_SQL.replace(
    "SELECT m.fid, round(m.mx / a.a, 6) AS cx, round(m.my / a.a, 6) AS cy FROM mom m JOIN ar a ON a.fid = m.fid WHERE a.a <> 0",
    "SELECT round(avg(CASE WHEN m.my / a.a BETWEEN -90 AND 90 THEN 1.0 ELSE 0.0 END), 6) AS lat_share, "
    "round(avg(CASE WHEN m.mx / a.a BETWEEN -180 AND 180 THEN 1.0 ELSE 0.0 END), 6) AS lon_share, false AS ok "
    "FROM mom m JOIN ar a ON a.fid = m.fid WHERE a.a <> 0"))
def q_coord_range_check(spark, sf):
    """Share of centroids inside lat/lon ranges (valid-area features)."""
    b = _blocks(spark, sf).where("geom IS NOT NULL").where(f"{G.geom_area('geom')} <> 0")
    c = IN.coord_range_check(b)
    return c.select(F.round("lat_share", R6).alias("lat_share"), F.round("lon_share", R6).alias("lon_share"), "ok")


@register("clean_geometry", with_(*B1_X) + """
SELECT r.fid, r.part, r.ring, (r.ring = 0 AND r.sa <> 0) AS ccw FROM b1_ra r""")
def q_clean_geometry(spark, sf):
    """After cleaning, exteriors are CCW and holes CW."""
    c = IN.clean_geometry(_blocks(spark, sf))
    r = S.parts(c).select("fid", "part", F.posexplode("rings").alias("ring", "pts"))
    return r.select("fid", "part", F.col("ring").cast("int").alias("ring"), (F.expr(G.ring_signed_area("pts")) > 0).alias("ccw"))


@register("explode_parts", with_(*B1_X) + "\nSELECT fid, part, CAST(count(*) AS INTEGER) AS npts FROM b1_v GROUP BY fid, part")
def q_explode_parts(spark, sf):
    """One row per part with its vertex count."""
    p = S.parts(_blocks(spark, sf))
    return p.select("fid", "part", F.expr("size(flatten(rings))").alias("npts"))


@register("representative_latlon")
def q_representative_latlon(spark, sf):
    """Centroid (or own point) per feature, rows without numbers dropped."""
    r = IN.representative_lonlat(_blocks(spark, sf))
    return r.select("fid", F.round("lon", R6).alias("lon"), F.round("lat", R6).alias("lat"))


def _sql_no_d(s: str) -> str:
    return re.sub(r"(\d)D\b", r"\1", s)


_LL = "(140 + x / 1000.0)", "(-38 + y / 1000.0)"


@register("reproject", with_(*B1_X) + "\nSELECT fid, part, ring, seq, " +
          ", ".join(f"round({_sql_no_d(e)}, 3) AS {n}" for n, e in zip(
              ("x3107", "y3107", "x7855", "y7855"),
              (*PR.forward_sql(3107, _LL[0], _LL[1]), *PR.forward_sql(7855, _LL[0], _LL[1])))) + " FROM b1_v")
def q_reproject(spark, sf):
    """Block vertices read as lon/lat degrees, projected to EPSG:3107
    (SA Lambert) and EPSG:7855 (MGA 55), millimetres."""
    p = S.parts(_blocks(spark, sf)).select("fid", "part", F.posexplode("rings").alias("ring", "pts"))
    v = p.select("fid", "part", F.col("ring").cast("int").alias("ring"), F.posexplode("pts").alias("seq", "q"))
    v = v.select("fid", "part", "ring", F.col("seq").cast("int").alias("seq"), F.col("q.x").alias("x"), F.col("q.y").alias("y"))
    a = PR.forward_sql(3107, *_LL)
    b = PR.forward_sql(7855, *_LL)
    return v.select("fid", "part", "ring", "seq", *[F.round(F.expr(e), 3).alias(n) for n, e in zip(
        ("x3107", "y3107", "x7855", "y7855"), (*a, *b))])


@register("schema_audit", """
SELECT 'MissingField' AS error_type, 'clue_small_area' AS field, CAST(NULL AS BIGINT) AS fid
UNION ALL SELECT 'WrongFieldType', 'space_use', NULL
UNION ALL SELECT 'DisallowedGeometryType', NULL, p_partkey FROM part WHERE p_partkey % 16 IN (7, 15)""")
def q_schema_audit(spark, sf):
    """A rules document checked against the floor layer's schema."""
    from vectorlint.plans.audit import schema_audit
    from vectorlint.sources.fixtures import floor_blocks
    doc = ('{"required_fields": ["block_id", "space_use", "total", "clue_small_area"], '
           '"numeric_fields": ["floor_space", "space_use"], "allowed_geometry_types": ["Polygon"]}')
    v = schema_audit(floor_blocks(spark, sf), doc)
    return v.select("error_type", F.col("attrs")["field"].alias("field"), "fid")


def _scratch(spark) -> str:
    from vectorlint.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/io-{uuid.uuid4().hex}"


@register("geojson_roundtrip", _AREA_SQL)
def q_geojson_roundtrip(spark, sf):
    """S21 + S1: blocks written as GeoJSONSeq (one Feature per line) into the
    shared scratch folder and read back."""
    path = _scratch(spark)
    IN.write_geojson_features(_blocks(spark, sf).where("geom IS NOT NULL").select("fid", "school_name", "geom"), path)
    return _area_out(IN.read_geojson(spark, path, id_col="fid"))


@register("csv_roundtrip", _AREA_SQL)
def q_csv_roundtrip(spark, sf):
    """S21 + S2: blocks written as CSV with a WKT column and read back."""
    path = _scratch(spark)
    b = _blocks(spark, sf).where("geom IS NOT NULL").select("fid", "school_name", IN.to_wkt("geom").alias("the_geom"))
    b.write.option("header", True).csv(path)
    return _area_out(IN.read_csv(spark, path, id_col="fid"))


@register("geometry_collections", with_(*B1_X) + """
SELECT f.fid, CASE WHEN f.fid % 3 = 2 THEN 'MultiLineString' ELSE 'MultiPolygon' END AS gtype,
       CASE WHEN f.fid % 3 = 2 THEN 2 ELSE (SELECT count(DISTINCT part) FROM b1_v v WHERE v.fid = f.fid) + 1 END AS n_parts,
       round(CASE WHEN f.fid % 3 = 2 THEN 0 ELSE a.area + 50 END, 6) AS area
FROM b1_feat f JOIN b1_fa a ON a.fid = f.fid WHERE f.has_geom""")
def q_geometry_collections(spark, sf):
    """Blocks inside nested geometry collections, as GeoJSON (fid % 3 = 0) and WKT
    (1) text; collections without polygons (2) keep their lines."""
    b = _blocks(spark, sf).where("geom IS NOT NULL").select("fid", IN.to_geojson("geom").alias("js"), IN.to_wkt("geom").alias("wkt"))
    tri = "[[[900,0],[910,0],[910,10],[900,0]]]"
    inner = '{"type":"GeometryCollection","geometries":[{"type":"LineString","coordinates":[[0,0],[1,1]]},{"type":"Polygon","coordinates":' + tri + "}]}"
    lines = '{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,2]},{"type":"MultiLineString","coordinates":[[[0,0],[1,1]],[[2,2],[3,4]]]}]}'
    js = F.concat(F.lit('{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,2]},'), "js", F.lit("," + inner + "]}"))
    wkt = F.concat(F.lit("GEOMETRYCOLLECTION (POINT (1 2), "), "wkt", F.lit(", GEOMETRYCOLLECTION (LINESTRING (0 0, 1 1), POLYGON ((900 0, 910 0, 910 10, 900 0))))"))
    b = b.select("fid", F.when(F.expr("fid % 3 = 0"), js).when(F.expr("fid % 3 = 2"), F.lit(lines)).alias("js"), F.when(F.expr("fid % 3 = 1"), wkt).alias("wkt"))
    c = IN.clean_geometry(b.select("fid", F.coalesce(IN.geojson_geometry(F.col("js")), IN.wkt_geometry("wkt")).alias("geom")))
    return c.select("fid", F.col("geom.type").alias("gtype"), F.expr("CAST(size(geom.coords) AS BIGINT)").alias("n_parts"), F.expr(f"round({G.geom_area('geom')}, 6)").alias("area"))
