"""Registered runner and report-shaping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectorlint.operators.names import close_pairs
from vectorlint.operators.violations import comparable
from vectorlint.plans import runners as RN
from vectorlint.plans.catalog import (B1_X, ORACLE, OVERLAP_BUILDING_SQL, R6, _blocks, register, vsel, with_)
from vectorlint.sources import fixtures as FX


def _sub(name: str) -> str:
    return f"SELECT * FROM ({ORACLE[name]})"


def _building_ctx(spark, sf):
    return RN.Context(_blocks(spark, sf), keep=["school_name", "p_type"], work_srid=7855)


_EXPECTED_CRS_V = with_(*B1_X) + f"\nSELECT DISTINCT {vsel(fid='NULL', et='ExpectedCRS', m='srid')} FROM b1_feat WHERE srid IS NULL OR srid NOT IN (4326, 7844)"
_OVERLAP_V = OVERLAP_BUILDING_SQL.split("\nSELECT fid, part, 'OverlappingBuildings'")[0] + f"""
SELECT {vsel(part='part', et='OverlappingBuildings', m='count(*)', m2='sum(area)')} FROM both_dirs GROUP BY fid, part"""

RUN_BUILDING_SQL = "\nUNION ALL\n".join([
    _sub("geometry_not_empty"), _sub("geometry_valid").replace("'GeometryValid'", "'GeometryValid'"), _sub("polygons_only"),
    _sub("duplicate_geometry"), f"SELECT * FROM ({_EXPECTED_CRS_V})", f"SELECT * FROM ({_OVERLAP_V})",
    _sub("holes_area_ratio"), _sub("holes_total_area"), _sub("minimum_area"), _sub("parts_self_overlap"), _sub("sliver_ratio")])


@register("run_building", RUN_BUILDING_SQL)
def q_run_building(spark, sf):
    """The 11 building checks on the blocks fixture."""
    return comparable(RN.run_building(_building_ctx(spark, sf)), R6)


@register("run_road", "\nUNION ALL\n".join([_sub("endpoint_isolated"), _sub("isolated_road"), _sub("endpoint_but_connected")]))
def q_run_road(spark, sf):
    """R2: N1 then N2 + N3 on the roads."""
    return comparable(RN.run_road(FX.roads(spark, sf)), R6)


_FLOOR_NULLS = ORACLE["null_values"].replace(
    "SELECT * FROM (", f"SELECT {vsel(fid='NULL', et='NullValues', m='null_count')} FROM (", 1).replace(
    ") t WHERE null_count > 0", ") t WHERE null_count > 0")

RUN_FLOOR_SQL = "\nUNION ALL\n".join([
    _sub("geometry_valid").replace("'GeometryValid'", "'GeometryValidity'"),
    _sub("overlap_floor"), f"SELECT * FROM ({_FLOOR_NULLS})", _sub("negative_floor_space"), _sub("total_consistency"),
    _sub("conflict_block_uses")])


@register("run_floor", RUN_FLOOR_SQL)
def q_run_floor(spark, sf):
    """The 7 floor-space checks."""
    ctx = RN.Context(FX.floor_blocks(spark, sf), keep=["block_id", "space_use"])
    return comparable(RN.run_floor(ctx), R6)


@register("run_blocks")
def q_run_blocks(spark, sf):
    """The 10 block checks (rows-only: triangulation runs in a pandas UDF)."""
    return comparable(RN.run_blocks(RN.Context(_blocks(spark, sf), keep=["school_name"])), R6)


@register("run_suburb")
def q_run_suburb(spark, sf):
    """The 17 suburb checks on the coverage with enclave squares (rows-only)."""
    ctx = RN.Context(FX.suburbs(spark, sf, "enclave"), keep=["suburb", "postcode", "state"], work_srid=3107)
    return comparable(RN.run_suburb(ctx), R6)


@register("rule_engine")
def q_rule_engine(spark, sf):
    """The preset building rule list through the rule engine."""
    eng = RN.RuleEngine(RN.default_building_rules(required_fields=("school_name",), unique_fields=("school_name",)))
    v = eng.run(_building_ctx(spark, sf))
    return v.select("fid", "part", "error_type", "rule", "category", F.round("metric", R6).alias("metric"))


@register("summary_by_rule", f"SELECT error_type, CAST(count(*) AS BIGINT) AS n FROM ({RUN_BUILDING_SQL}) GROUP BY error_type")
def q_summary_by_rule(spark, sf):
    """Violation counts per rule of the building run."""
    return RN.summary_by(RN.run_building(_building_ctx(spark, sf)))


_BUILDING_KEYS = ["GeometryNotEmpty", "GeometryValid", "BuildingPolygonsOnly", "OverlappingBuildings", "HolesAreaRatioLimit",
                  "HolesTotalAreaLimit", "MinimumArea", "PartsSelfOverlap", "SliverPolygons", "DuplicateGeometries", "ExpectedCRS"]


@register("rule_summary", "SELECT k.rule_key, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM (VALUES " +
          ", ".join(f"('{k}')" for k in _BUILDING_KEYS) + f") k(rule_key) LEFT JOIN (SELECT error_type, count(*) AS n FROM ({RUN_BUILDING_SQL}) "
          "GROUP BY error_type) c ON c.error_type = k.rule_key")
def q_rule_summary(spark, sf):
    """One row per offered building rule, zero counts included."""
    keys = spark.createDataFrame([(k,) for k in _BUILDING_KEYS], "rule_key string")
    return RN.rule_summary(RN.run_building(_building_ctx(spark, sf)), keys)


@register("rule_filter", f"SELECT * FROM ({RUN_BUILDING_SQL}) WHERE error_type IN ('OverlappingBuildings', 'MinimumArea')")
def q_rule_filter(spark, sf):
    """Keep two chosen rule keys of the building run."""
    v = RN.rule_filter(RN.run_building(_building_ctx(spark, sf)), ["OverlappingBuildings", "MinimumArea"])
    return comparable(v, R6)


@register("example_per_rule", f"""
SELECT error_type, fid, part FROM (
  SELECT error_type, fid, part, row_number() OVER (PARTITION BY error_type
         ORDER BY coalesce(fid, -9223372036854775808), fid NULLS FIRST, part NULLS FIRST) AS rn
  FROM ({RUN_BUILDING_SQL})) WHERE rn = 1""")
def q_example_per_rule(spark, sf):
    """First violation of every rule of the building run."""
    return RN.example_per_rule(RN.run_building(_building_ctx(spark, sf))).select("error_type", "fid", "part")


@register("failures_with_geometry", with_(*B1_X) + """
SELECT v.fid, v.error_type, f.gtype FROM (
  SELECT fid, 'GeometryNotEmpty' AS error_type FROM b1_feat WHERE NOT has_geom
  UNION ALL SELECT fid, 'MinimumArea' FROM b1_fa WHERE area < 1.0) v JOIN b1_feat f ON f.fid = v.fid""")
def q_failures_with_geometry(spark, sf):
    """Feature-level violations with their geometry (dataset rows dropped)."""
    from vectorlint.operators import attribute as A
    from vectorlint.operators import feature as FE
    b = _blocks(spark, sf)
    v = FE.geometry_not_empty(b).unionByName(FE.minimum_area(b, 1.0)).unionByName(A.expected_crs(b))
    return RN.failures_with_geometry(v, b).select("fid", "error_type", F.col("geom.type").alias("gtype"))


@register("map_extent", with_(*B1_X, """
mom AS (
  SELECT e.fid,
         sum(CASE WHEN (e.ring = 0) = (r.sa > 0) THEN 1 ELSE -1 END * (e.x1 * e.y2 - e.x2 * e.y1) * (e.x1 + e.x2)) / 6 AS mx,
         sum(CASE WHEN (e.ring = 0) = (r.sa > 0) THEN 1 ELSE -1 END * (e.x1 * e.y2 - e.x2 * e.y1) * (e.y1 + e.y2)) / 6 AS my
  FROM b1_e e JOIN b1_ra r ON r.fid = e.fid AND r.part = e.part AND r.ring = e.ring GROUP BY e.fid
),
ar AS (SELECT fid, sum(area) AS a FROM b1_pa GROUP BY fid),
pts AS (SELECT m.my / a.a AS lat, m.mx / a.a AS lon FROM mom m JOIN ar a ON a.fid = m.fid WHERE a.a <> 0)""") + """
SELECT round(median(lat), 6) AS centre_lat, round(median(lon), 6) AS centre_lon,
       round(greatest(2.0, least(16.0, log2(360.0 / greatest(max(lat) - min(lat), max(lon) - min(lon), 0.001)))), 6) AS zoom FROM pts""")
def q_map_extent(spark, sf):
    """Map centre (medians) and zoom of the block centroids."""
    from vectorlint.functions import geometry as G
    b = _blocks(spark, sf).where("geom IS NOT NULL")
    cx, cy = G.centroid_xy("geom")
    pts = b.where(f"{G.geom_area('geom')} <> 0").select(F.expr(cy).alias("lat"), F.expr(cx).alias("lon"))
    e = RN.map_extent(pts)
    return e.select(*[F.round(c, R6).alias(c) for c in ("centre_lat", "centre_lon", "zoom")])


@register("latlon_fallback")
def q_latlon_fallback(spark, sf):
    """Coordinates for every violation of the building run (rows-only)."""
    b = _blocks(spark, sf)
    v = RN.run_building(_building_ctx(spark, sf))
    return RN.latlon_fallback(v, b).select("fid", "error_type", F.round("lat", R6).alias("lat"), F.round("lon", R6).alias("lon"))


@register("report_columns")
def q_report_columns(spark, sf):
    """The shaped report of the road run (rows-only)."""
    r = RN.report_columns(RN.run_road(FX.roads(spark, sf)))
    return r.select("fid", "error_type", "output_error", "rule_key", "error_count")


@register("near_duplicate_name")
def q_near_duplicate_name(spark, sf):
    """A7 on the part names (B5) - rows-only; tested against difflib brute
    force on a small fixture."""
    p = close_pairs(FX.names(spark, sf), "suburb", 0.88)
    return p.select("name_a", "name_b", F.round("ratio", R6).alias("ratio"))


@register("any_flag_report")
def q_any_flag_report(spark, sf):
    """The wide per-feature block report (rows-only)."""
    b = _blocks(spark, sf)
    return RN.any_flag_report(b, RN.Context(b, keep=["school_name"]))
