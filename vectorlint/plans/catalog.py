"""Registered queries: one Spark job and (where SQL can say it) one DuckDB
oracle per operator of the inventory.

Every query reads the given parquet tables (through the deterministic
fixtures of ``sources.fixtures``) over their whole extent.  Spark queries
return the *comparable* columns: ids, rule name and rounded metrics;
formatted message text and maps are left out of the comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorlint.functions import geometry as G
from vectorlint.operators import spatial as S
from vectorlint.operators.violations import comparable
from vectorlint.plans import oracle as O
from vectorlint.sources import fixtures as FX

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

R6 = 6  # digits kept when comparing doubles


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ------------------------------------------------------------ shared CTEs --

def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes)


B1 = FX.blocks_sql()
B1_E = O.edges_sql("b1_v", "b1_e")
B1_BX = O.part_boxes_sql("b1_v", "b1_bx")
B1_RA = O.ring_area_sql("b1_e", "b1_ra")
B1_PA = O.part_area_sql("b1_ra", "b1_pa")
B1_RN = """
b1_rn AS (SELECT fid, part, ring, count(*) AS n FROM b1_e GROUP BY fid, part, ring)"""
# invalid parts of the blocks: two non-adjacent edges of one part meet
B1_INV = f"""
b1_inv AS (
  SELECT DISTINCT a.fid, a.part FROM b1_e a
  JOIN b1_e b ON a.fid = b.fid AND a.part = b.part AND (a.ring < b.ring OR (a.ring = b.ring AND a.seq < b.seq))
  JOIN b1_rn n ON n.fid = a.fid AND n.part = a.part AND n.ring = a.ring
  WHERE NOT (a.ring = b.ring AND (b.seq = a.seq + 1 OR (a.seq = 0 AND b.seq = n.n - 1)))
    AND {O.seg_intersect_sql('a', 'b')}
)"""
# valid polygon parts and their boxes / vertices / edges
B1_OK = """
b1_okbx AS (SELECT * FROM b1_bx WHERE (fid, part) NOT IN (SELECT (fid, part) FROM b1_inv)),
b1_oke AS (SELECT * FROM b1_e WHERE (fid, part) NOT IN (SELECT (fid, part) FROM b1_inv)),
b1_okra AS (SELECT * FROM b1_ra WHERE (fid, part) NOT IN (SELECT (fid, part) FROM b1_inv))"""
B1_ALL = [B1, B1_E, B1_BX, B1_RA, B1_PA, B1_RN, B1_INV, B1_OK]


def _blocks(spark, sf):
    return FX.blocks(spark, sf)


def _block_parts(spark, sf):
    return S.parts(_blocks(spark, sf), keep=["srid", "school_name", "p_type"])


def _valid_block_parts(spark, sf):
    """Valid parts, persisted: every pair rule reads them several times
    (grid statistics, both sides of the cell join, both sides' rings)."""
    from vectorlint.operators.feature import valid_parts
    return valid_parts(_block_parts(spark, sf)).persist(StorageLevel.MEMORY_AND_DISK)


def _vsql(select_from: str) -> str:
    return select_from


# ============================================================= flagship ====

OVERLAP_BUILDING_SQL = with_(
    *B1_ALL,
    O.box_pairs_sql("b1_okbx", "cand"),
    O.overlap_area_sql("b1_oke", "b1_okra", "cand", "ov"),
    """
hit AS (SELECT * FROM ov WHERE area > 0.05),
both_dirs AS (
  SELECT a_fid AS fid, a_part AS part, b_fid AS ofid, b_part AS opart, area FROM hit
  UNION ALL SELECT b_fid, b_part, a_fid, a_part, area FROM hit
)""") + """
SELECT fid, part, 'OverlappingBuildings' AS error_type, CAST(count(*) AS BIGINT) AS n_overlaps,
       round(sum(area), 6) AS overlap_area_m2,
       string_agg(CAST(ofid AS VARCHAR) || ':' || CAST(opart AS VARCHAR), ',' ORDER BY ofid, opart) AS overlaps_with
FROM both_dirs GROUP BY fid, part"""


@register("overlap_building", OVERLAP_BUILDING_SQL)
def q_overlap_building(spark, sf):
    """P4 on the blocks fixture used as buildings (valid parts only)."""
    from vectorlint.operators.pairs import overlap_building
    v = overlap_building(_valid_block_parts(spark, sf))
    return v.select("fid", "part", "error_type", F.col("metric").cast("bigint").alias("n_overlaps"),
                    F.round("metric2", R6).alias("overlap_area_m2"), F.col("attrs")["overlaps_with"].alias("overlaps_with"))


@register("bbox_candidates", with_(*B1_ALL, O.box_pairs_sql("b1_bx", "cand")) +
          "\nSELECT a_fid, a_part, b_fid, b_part FROM cand")
def q_bbox_candidates(spark, sf):
    """All part pairs of the blocks whose closed boxes meet."""
    from vectorlint.operators.pairs import bbox_candidates
    return bbox_candidates(_block_parts(spark, sf))


# ============================================================ G kernels ====

@register("geom_area", with_(*B1_ALL) + """
SELECT f.fid, round(coalesce(sum(p.area), 0), 6) AS area
FROM b1_feat f LEFT JOIN b1_pa p ON p.fid = f.fid WHERE f.has_geom GROUP BY f.fid""")
def q_geom_area(spark, sf):
    """G1: polygon area with holes subtracted, per feature."""
    b = _blocks(spark, sf).where("geom IS NOT NULL")
    return b.select("fid", F.round(F.expr(G.geom_area("geom")), R6).alias("area"))


@register("geom_perimeter", with_(*B1_ALL) + """
SELECT fid, round(sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))), 6) AS perimeter
FROM b1_e GROUP BY fid""")
def q_geom_perimeter(spark, sf):
    """Length of all rings, per feature."""
    b = _blocks(spark, sf).where("geom IS NOT NULL")
    return b.select("fid", F.round(F.expr(G.geom_length("geom")), R6).alias("perimeter"))


@register("geom_bounds", with_(*B1_ALL) + """
SELECT fid, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM b1_v GROUP BY fid""")
def q_geom_bounds(spark, sf):
    """Bounding box per feature."""
    b = _blocks(spark, sf).where("geom IS NOT NULL")
    bd = G.geom_bounds("geom")
    return b.select("fid", *[F.expr(bd[k]).alias(k) for k in ("minx", "miny", "maxx", "maxy")])


@register("geom_type", with_(*B1_ALL) + """
SELECT fid, gtype, NOT has_geom AS is_empty FROM b1_feat""")
def q_geom_type(spark, sf):
    """Geometry type and the empty/null test."""
    b = _blocks(spark, sf)
    return b.select("fid", F.col("geom.type").alias("gtype"), F.expr(G.geom_is_empty("geom")).alias("is_empty"))


CENTROID_SQL = with_(*B1_ALL, """
mom AS (
  SELECT e.fid,
         sum(CASE WHEN (e.ring = 0) = (r.sa > 0) THEN 1 ELSE -1 END * (e.x1 * e.y2 - e.x2 * e.y1) * (e.x1 + e.x2)) / 6 AS mx,
         sum(CASE WHEN (e.ring = 0) = (r.sa > 0) THEN 1 ELSE -1 END * (e.x1 * e.y2 - e.x2 * e.y1) * (e.y1 + e.y2)) / 6 AS my
  FROM b1_e e JOIN b1_ra r ON r.fid = e.fid AND r.part = e.part AND r.ring = e.ring GROUP BY e.fid
),
ar AS (SELECT fid, sum(area) AS a FROM b1_pa GROUP BY fid)""") + """
SELECT m.fid, round(m.mx / a.a, 6) AS cx, round(m.my / a.a, 6) AS cy FROM mom m JOIN ar a ON a.fid = m.fid WHERE a.a <> 0"""


@register("centroid", CENTROID_SQL)
def q_centroid(spark, sf):
    """Area-weighted centroid of each valid polygonal feature with area."""
    b = _blocks(spark, sf).where("geom IS NOT NULL")
    cx, cy = G.centroid_xy("geom")
    a = b.select("fid", F.expr(G.geom_area("geom")).alias("a"), F.expr(cx).alias("cx"), F.expr(cy).alias("cy"))
    return a.where("a <> 0").select("fid", F.round("cx", R6).alias("cx"), F.round("cy", R6).alias("cy"))


# ============================================================ helpers ======

def vsel(fid="fid", part="NULL", et="", ofid="NULL", opart="NULL", m="NULL", m2="NULL") -> str:
    """SQL select list of the comparable violation columns."""
    return (f"CAST({fid} AS BIGINT) AS fid, CAST({part} AS INTEGER) AS part, '{et}' AS error_type, "
            f"CAST({ofid} AS BIGINT) AS other_fid, CAST({opart} AS INTEGER) AS other_part, "
            f"round(CAST({m} AS DOUBLE), 6) AS metric, round(CAST({m2} AS DOUBLE), 6) AS metric2")


def _cmp(v: DataFrame) -> DataFrame:
    return comparable(v, R6)


# feature areas / perimeters from vertex rows
B1_FA = """
b1_fa AS (SELECT f.fid, coalesce(sum(p.area), 0) AS area FROM b1_feat f LEFT JOIN b1_pa p ON p.fid = f.fid
          WHERE f.has_geom GROUP BY f.fid),
b1_fp AS (SELECT fid, sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) AS perim FROM b1_e GROUP BY fid),
b1_okpa AS (SELECT * FROM b1_pa WHERE (fid, part) NOT IN (SELECT (fid, part) FROM b1_inv))"""
# vertex angles: incoming edge e1 (seq i-1) and outgoing e2 (seq i) meet at vertex i
B1_ANG = """
b1_ang AS (
  SELECT e2.fid, e2.part, e2.ring, e2.seq AS vtx,
         CASE WHEN sqrt((e1.x1 - e1.x2) * (e1.x1 - e1.x2) + (e1.y1 - e1.y2) * (e1.y1 - e1.y2)) = 0
                OR sqrt((e2.x2 - e2.x1) * (e2.x2 - e2.x1) + (e2.y2 - e2.y1) * (e2.y2 - e2.y1)) = 0 THEN NULL
              ELSE degrees(acos(greatest(-1.0, least(1.0,
                   ((e1.x1 - e1.x2) * (e2.x2 - e2.x1) + (e1.y1 - e1.y2) * (e2.y2 - e2.y1))
                   / (sqrt((e1.x1 - e1.x2) * (e1.x1 - e1.x2) + (e1.y1 - e1.y2) * (e1.y1 - e1.y2))
                      * sqrt((e2.x2 - e2.x1) * (e2.x2 - e2.x1) + (e2.y2 - e2.y1) * (e2.y2 - e2.y1))))))) END AS ang
  FROM b1_e e1 JOIN b1_e e2 ON e1.fid = e2.fid AND e1.part = e2.part AND e1.ring = e2.ring AND e2.seq = e1.seq + 1
)"""
B1_X = [*B1_ALL, B1_FA, B1_ANG]


# ====================================================== feature checks =====

@register("geometry_not_empty", with_(*B1_X) + f"\nSELECT {vsel(et='GeometryNotEmpty')} FROM b1_feat WHERE NOT has_geom")
def q_geometry_not_empty(spark, sf):
    from vectorlint.operators.feature import geometry_not_empty
    return _cmp(geometry_not_empty(_blocks(spark, sf)))


B1_INVR = f"""
b1_invr AS (
  SELECT a.fid, a.part, min(CASE WHEN {O.seg_intersect_sql('a', 'b').replace('<= 0', '< 0')} THEN 3 ELSE 4 END) AS rank
  FROM b1_e a
  JOIN b1_e b ON a.fid = b.fid AND a.part = b.part AND (a.ring < b.ring OR (a.ring = b.ring AND a.seq < b.seq))
  JOIN b1_rn n ON n.fid = a.fid AND n.part = a.part AND n.ring = a.ring
  WHERE NOT (a.ring = b.ring AND (b.seq = a.seq + 1 OR (a.seq = 0 AND b.seq = n.n - 1)))
    AND {O.seg_intersect_sql('a', 'b')}
  GROUP BY a.fid, a.part
  UNION ALL SELECT fid, part, 1 FROM b1_rn WHERE n < 3
)"""


def validity_query(v_cte: str, v: str, p: str) -> str:
    return (with_(v_cte, O.validity_sql(v, p)).replace("WITH", "WITH RECURSIVE", 1) +
            f"\nSELECT {vsel(et='GeometryValid', m='rank')} FROM {p}_rank")


@register("geometry_valid", validity_query(B1, "b1_v", "b1_ok"))
def q_geometry_valid(spark, sf):
    """invalid features with the rank of their reason (3 = crossing)."""
    from vectorlint.operators.feature import geometry_valid
    return _cmp(geometry_valid(_blocks(spark, sf), _block_parts(spark, sf)))


@register("geometry_valid_rings", validity_query(FX.ring_shapes_sql(), "b7_v", "b7"))
def q_geometry_valid_rings(spark, sf):
    """F2 on shapes whose rings do or don't fit each other (nested holes and shells, disconnected interiors)."""
    from vectorlint.operators.feature import geometry_valid
    return _cmp(geometry_valid(FX.ring_shapes(spark, sf)))


@register("not_simple", with_(*B1_X, B1_INVR.replace("a.ring < b.ring OR ", "")) +
          f"\nSELECT DISTINCT {vsel(et='NotSimple')} FROM b1_invr WHERE rank >= 3")
def q_not_simple(spark, sf):
    """a ring crosses or touches itself."""
    from vectorlint.operators.feature import not_simple
    return _cmp(not_simple(_blocks(spark, sf), _block_parts(spark, sf)))


@register("polygons_only", with_(*B1_X) +
          f"\nSELECT {vsel(et='BuildingPolygonsOnly')} FROM b1_feat WHERE coalesce(gtype NOT IN ('Polygon', 'MultiPolygon'), true)")
def q_polygons_only(spark, sf):
    from vectorlint.operators.feature import polygons_only
    return _cmp(polygons_only(_blocks(spark, sf)))


@register("area_non_positive", with_(*B1_X) + f"\nSELECT {vsel(et='AreaNonPositive', m='area')} FROM b1_fa WHERE area <= 0")
def q_area_non_positive(spark, sf):
    from vectorlint.operators.feature import area_non_positive
    return _cmp(area_non_positive(_blocks(spark, sf)))


@register("sliver_area", with_(*B1_X) + f"\nSELECT {vsel(part='part', et='SliverPolygon', m='area')} FROM b1_okpa WHERE area < 30")
def q_sliver_area(spark, sf):
    """F6 on valid parts."""
    from vectorlint.operators.feature import sliver_area
    return _cmp(sliver_area(_valid_block_parts(spark, sf), 30.0))


@register("minimum_area", with_(*B1_X) + f"\nSELECT {vsel(et='MinimumArea', m='area')} FROM b1_fa WHERE area < 1.0")
def q_minimum_area(spark, sf):
    from vectorlint.operators.feature import minimum_area
    return _cmp(minimum_area(_blocks(spark, sf), 1.0))


@register("small_hole", with_(*B1_X) +
          f"\nSELECT {vsel(part='part', et='SmallHole', m='abs(sa)', m2='ring')} FROM b1_okra WHERE ring > 0 AND abs(sa) <= 25")
def q_small_hole(spark, sf):
    from vectorlint.operators.feature import small_hole
    return _cmp(small_hole(_valid_block_parts(spark, sf), 25.0))


B1_HOLES = """
b1_holes AS (SELECT fid, sum(abs(sa)) AS holes FROM b1_ra WHERE ring > 0 GROUP BY fid)"""


@register("holes_total_area", with_(*B1_X, B1_HOLES) +
          f"\nSELECT {vsel(et='HolesTotalAreaLimit', m='holes')} FROM b1_holes WHERE holes > 2.0")
def q_holes_total_area(spark, sf):
    from vectorlint.operators.feature import holes_total_area
    return _cmp(holes_total_area(_blocks(spark, sf), 2.0))


@register("holes_area_ratio", with_(*B1_X, B1_HOLES) +
          f"\nSELECT {vsel(fid='h.fid', et='HolesAreaRatioLimit', m='h.holes', m2='a.area')} FROM b1_holes h JOIN b1_fa a ON a.fid = h.fid "
          "WHERE a.area > 0 AND h.holes / a.area > 0.20")
def q_holes_area_ratio(spark, sf):
    from vectorlint.operators.feature import holes_area_ratio
    return _cmp(holes_area_ratio(_blocks(spark, sf), 0.20))


@register("sliver_ratio", with_(*B1_X) +
          f"\nSELECT {vsel(fid='a.fid', et='SliverPolygons', m='a.area / p.perim', m2='a.area')} FROM b1_fa a JOIN b1_fp p ON p.fid = a.fid "
          "WHERE p.perim <> 0 AND a.area / p.perim < 0.20")
def q_sliver_ratio(spark, sf):
    from vectorlint.operators.feature import sliver_ratio
    return _cmp(sliver_ratio(_blocks(spark, sf), 0.20))


@register("compactness_sliver", with_(*B1_X) +
          f"\nSELECT {vsel(fid='a.fid', et='CompactnessSliver', m='CASE WHEN a.area <> 0 THEN p.perim * p.perim / (4 * 3.1416 * a.area) END', m2='a.area')} "
          "FROM b1_fa a JOIN b1_fp p ON p.fid = a.fid "
          "WHERE coalesce(CASE WHEN a.area <> 0 THEN p.perim * p.perim / (4 * 3.1416 * a.area) > 15 END, a.area = 0 AND p.perim > 0) "
          "OR a.area < 10.0")
def q_compactness_sliver(spark, sf):
    """F12 (+ G15 as metric)."""
    from vectorlint.operators.feature import compactness
    return _cmp(compactness(_blocks(spark, sf)))


@register("short_edge", with_(*B1_X) +
          f"\nSELECT {vsel(part='e.part', et='ShortEdge', m='min(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))')} "
          "FROM b1_oke e WHERE ring = 0 GROUP BY e.fid, e.part "
          "HAVING min(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) < 2.0")
def q_short_edge(spark, sf):
    from vectorlint.operators.feature import short_edge
    return _cmp(short_edge(_valid_block_parts(spark, sf), 2.0))


@register("wrong_orientation", with_(*B1_X) +
          f"\nSELECT {vsel(part='part', et='WrongOrientation', m='max(CASE WHEN ring = 0 AND sa < 0 THEN 1 ELSE 0 END)', m2='sum(CASE WHEN ring > 0 AND sa > 0 THEN 1 ELSE 0 END)')} "
          "FROM b1_okra GROUP BY fid, part "
          "HAVING max(CASE WHEN ring = 0 AND sa < 0 THEN 1 ELSE 0 END) + sum(CASE WHEN ring > 0 AND sa > 0 THEN 1 ELSE 0 END) > 0")
def q_wrong_orientation(spark, sf):
    """F14 (the working rule: exterior CCW, holes CW)."""
    from vectorlint.operators.feature import wrong_orientation
    return _cmp(wrong_orientation(_valid_block_parts(spark, sf)))


@register("acute_angle", with_(*B1_X) +
          f"\nSELECT {vsel(part='part', et='AcuteAngle', m='round(min(ang), 4)')} FROM b1_ang "
          "WHERE ring = 0 AND (fid, part) NOT IN (SELECT (fid, part) FROM b1_inv) GROUP BY fid, part HAVING min(ang) < 5.0")
def q_acute_angle(spark, sf):
    """vertex 0 not looked at, exterior ring, valid parts."""
    from vectorlint.operators.feature import acute_angle
    v = acute_angle(_valid_block_parts(spark, sf), 5.0)
    return _cmp(v.withColumn("metric", F.round("metric", 4)))


@register("acute_boundary_angle", with_(*B1_X) +
          f"\nSELECT {vsel(part='part', et='AcuteBoundaryAngle', m='round(ang, 4)', m2='vtx')} FROM b1_ang "
          "WHERE ring = 0 AND ang < 5.0 AND (fid, part) NOT IN (SELECT (fid, part) FROM b1_inv)")
def q_acute_boundary_angle(spark, sf):
    """F16: one row per exterior vertex below 5 degrees."""
    from vectorlint.operators.feature import acute_boundary_angle
    v = acute_boundary_angle(_valid_block_parts(spark, sf), 5.0)
    return _cmp(v.withColumn("metric", F.round("metric", 4)))


@register("excessive_precision", with_(*B1_X, """
xp AS (SELECT v.fid, v.part, avg(CASE WHEN abs(x - round(x, 3)) >= 1e-9 OR abs(y - round(y, 3)) >= 1e-9 THEN 1.0 ELSE 0.0 END) AS ratio
       FROM b1_v v JOIN b1_feat f ON f.fid = v.fid WHERE v.ring = 0 AND f.srid NOT IN (4326, 4283, 7844) GROUP BY v.fid, v.part)""") +
          f"\nSELECT {vsel(part='part', et='ExcessivePrecision', m='ratio')} FROM xp WHERE ratio > 0.10")
def q_excessive_precision(spark, sf):
    """projected CRS only (blocks are EPSG:7855)."""
    from vectorlint.operators.feature import excessive_precision
    return _cmp(excessive_precision(_block_parts(spark, sf)))


@register("excessive_precision_any", with_(*B1_X) +
          f"\nSELECT DISTINCT {vsel(et='ExcessivePrecisionAny')} FROM b1_v WHERE ring = 0 AND (x <> round(x, 3) OR y <> round(y, 3))")
def q_excessive_precision_any(spark, sf):
    from vectorlint.operators.feature import excessive_precision_any
    return _cmp(excessive_precision_any(_blocks(spark, sf)))


@register("outside_bbox", with_(*B1_X) +
          f"\nSELECT {vsel(part='part', et='OutsideBBox')} FROM b1_bx WHERE NOT (minx >= 140 AND maxx <= 150 AND miny >= -40 AND maxy <= -33 "
          "AND NOT (maxx = 140 OR minx = 150 OR maxy = -40 OR miny = -33))")
def q_outside_bbox(spark, sf):
    from vectorlint.operators.feature import outside_bbox
    return _cmp(outside_bbox(_block_parts(spark, sf)))


@register("too_few_edges", with_(*B1_X, """
b1_ang0 AS (
  SELECT e2.fid, e2.part,
         degrees(acos(greatest(-1.0, least(1.0, ((e1.x1 - e1.x2) * (e2.x2 - e2.x1) + (e1.y1 - e1.y2) * (e2.y2 - e2.y1))
           / (sqrt((e1.x1 - e1.x2) * (e1.x1 - e1.x2) + (e1.y1 - e1.y2) * (e1.y1 - e1.y2))
              * sqrt((e2.x2 - e2.x1) * (e2.x2 - e2.x1) + (e2.y2 - e2.y1) * (e2.y2 - e2.y1))))))) AS ang
  FROM b1_e e1 JOIN b1_e e2 ON e1.fid = e2.fid AND e1.part = e2.part AND e1.ring = 0 AND e2.ring = 0
  JOIN b1_rn n ON n.fid = e1.fid AND n.part = e1.part AND n.ring = 0
  WHERE e2.seq = e1.seq + 1 OR (e2.seq = 0 AND e1.seq = n.n - 1)
)""") + f"""
SELECT {vsel(fid='n.fid', part='n.part', et='TooFewEdges', m='n.n', m2='round(min(a.ang), 4)')}
FROM b1_rn n JOIN b1_ang0 a ON a.fid = n.fid AND a.part = n.part
WHERE n.ring = 0 AND n.n < 4 AND (n.fid, n.part) NOT IN (SELECT (fid, part) FROM b1_inv) GROUP BY n.fid, n.part, n.n""")
def q_too_few_edges(spark, sf):
    """fewer than 4 exterior edges (metric2 = smallest angle, all vertices)."""
    from vectorlint.operators.feature import too_few_edges
    v = too_few_edges(_valid_block_parts(spark, sf))
    return _cmp(v.withColumn("metric2", F.round("metric2", 4)))


PART_CENTROID = """
pmom AS (
  SELECT e.fid, e.part,
         sum(CASE WHEN (e.ring = 0) = (r.sa > 0) THEN 1 ELSE -1 END * (e.x1 * e.y2 - e.x2 * e.y1) * (e.x1 + e.x2)) / 6 AS mx,
         sum(CASE WHEN (e.ring = 0) = (r.sa > 0) THEN 1 ELSE -1 END * (e.x1 * e.y2 - e.x2 * e.y1) * (e.y1 + e.y2)) / 6 AS my
  FROM b1_oke e JOIN b1_ra r ON r.fid = e.fid AND r.part = e.part AND r.ring = e.ring GROUP BY e.fid, e.part
),
pc AS (SELECT m.fid, m.part, m.mx / a.area AS cx, m.my / a.area AS cy FROM pmom m JOIN b1_pa a ON a.fid = m.fid AND a.part = m.part WHERE a.area <> 0),
pip AS (
  SELECT c.fid, c.part, c.cx, c.cy,
         sum(CASE WHEN (e.y1 > c.cy) <> (e.y2 > c.cy) AND c.cx < e.x1 + (c.cy - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1) THEN 1 ELSE 0 END) AS cr,
         max(CASE WHEN (e.x2 - e.x1) * (c.cy - e.y1) - (e.y2 - e.y1) * (c.cx - e.x1) = 0
                   AND c.cx BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2)
                   AND c.cy BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2) THEN 1 ELSE 0 END) AS onedge
  FROM pc c JOIN b1_e e ON e.fid = c.fid AND e.part = c.part GROUP BY c.fid, c.part, c.cx, c.cy
)"""


@register("centroid_outside", with_(*B1_X, PART_CENTROID) +
          f"\nSELECT {vsel(part='part', et='CentroidOutside', m='cx', m2='cy')} FROM pip WHERE NOT (onedge = 0 AND cr % 2 = 1)")
def q_centroid_outside(spark, sf):
    """F10 (uses G5 centroid and G6 strict point-in-polygon) on valid parts."""
    from vectorlint.operators.feature import centroid_outside
    return _cmp(centroid_outside(_valid_block_parts(spark, sf)))


@register("point_in_polygon", with_(*B1_X, PART_CENTROID) +
          "\nSELECT fid, part, (onedge = 0 AND cr % 2 = 1) AS inside FROM pip")
def q_point_in_polygon(spark, sf):
    """Is each valid part's centroid strictly inside it."""
    g = S.part_geom()
    cx, cy = G.centroid_xy(g)
    p = _valid_block_parts(spark, sf).select("fid", "part", "rings", "gtype", F.expr(G.part_area("rings")).alias("a"),
                                            F.expr(cx).alias("cx"), F.expr(cy).alias("cy")).where("a <> 0")
    return p.select("fid", "part", F.expr(G.point_in_polygon(g, "cx", "cy")).alias("inside"))


@register("point_on_surface")
def q_point_on_surface(spark, sf):
    """A point strictly inside each valid part (rows-only check; the
    containment itself is asserted by the unit tests)."""
    g = S.part_geom()
    px, py = G.point_on_surface(g)
    p = _valid_block_parts(spark, sf).select("fid", "part", "rings", "gtype", F.expr(px).alias("sx"), F.expr(py).alias("sy"))
    return p.select("fid", "part", "sx", "sy", F.expr(G.point_in_polygon(g, "sx", "sy")).alias("inside"))


@register("parts_self_overlap", with_(*B1_X,
                                      O.box_pairs_sql("b1_okbx", "cand", where="a.fid = b.fid"),
                                      O.overlap_area_sql("b1_oke", "b1_okra", "cand", "ov")) +
          f"\nSELECT {vsel(fid='a_fid', et='PartsSelfOverlap', m='sum(area)')} FROM ov WHERE area > 1e-9 GROUP BY a_fid")
def q_parts_self_overlap(spark, sf):
    """parts of one MultiPolygon share area."""
    from vectorlint.operators.feature import parts_self_overlap
    return _cmp(parts_self_overlap(_valid_block_parts(spark, sf)))


B1_HULL = O.hull_sql("b1_oke", "b1_hull") + """,
b1_open AS (SELECT h.fid, h.part, abs(h.area - p.area) AS diff FROM b1_hull h JOIN b1_okpa p ON p.fid = h.fid AND p.part = h.part
            WHERE NOT abs(h.area - p.area) < 0.1)"""


@register("triangulation_not_closed", with_(*B1_X, B1_HULL) + f"\nSELECT {vsel(part='part', et='TriangulationNotClosed', m='diff')} FROM b1_open")
def q_triangulation_not_closed(spark, sf):
    """Convex-hull (Delaunay cover) area minus area >= 0.1."""
    from vectorlint.operators.feature import triangulation_not_closed
    return _cmp(triangulation_not_closed(_valid_block_parts(spark, sf), 0.1))


@register("triangulation_worst5", with_(*B1_X, B1_HULL) + f"\nSELECT {vsel(part='part', et='TriangulationNotClosed', m='diff')} FROM b1_open"
          "\nORDER BY metric DESC, fid, part LIMIT 5")
def q_triangulation_worst5(spark, sf):
    """F19 report: the five largest triangulation errors (top-k is the feature)."""
    from vectorlint.operators.feature import triangulation_not_closed
    v = triangulation_not_closed(_valid_block_parts(spark, sf), 0.1)
    return _cmp(v).orderBy(F.desc("metric"), "fid", "part").limit(5)


# ======================================================== G kernels (2) ====

@register("ring_orientation", with_(*B1_X) + "\nSELECT fid, part, ring, sa > 0 AS ccw FROM b1_ra")
def q_ring_orientation(spark, sf):
    """Counter-clockwise test per ring."""
    r = _block_parts(spark, sf).select("fid", "part", F.posexplode("rings").alias("ring", "pts"))
    return r.select("fid", "part", F.col("ring").cast("int").alias("ring"),
                    (F.expr(G.ring_signed_area("pts")) > 0).alias("ccw"))


@register("hole_area", with_(*B1_X) + "\nSELECT fid, part, ring, round(abs(sa), 6) AS area FROM b1_ra WHERE ring > 0")
def q_hole_area(spark, sf):
    """Area of each hole ring."""
    r = _block_parts(spark, sf).select("fid", "part", F.posexplode("rings").alias("ring", "pts")).where("ring > 0")
    return r.select("fid", "part", F.col("ring").cast("int").alias("ring"),
                    F.round(F.abs(F.expr(G.ring_signed_area("pts"))), R6).alias("area"))


@register("min_edge_length", with_(*B1_X) +
          "\nSELECT fid, part, round(min(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))), 6) AS min_edge FROM b1_e WHERE ring = 0 GROUP BY fid, part")
def q_min_edge_length(spark, sf):
    """Shortest exterior edge per part."""
    p = _block_parts(spark, sf)
    return p.select("fid", "part", F.round(F.expr(G.ring_min_edge("rings[0]")), R6).alias("min_edge"))


@register("min_interior_angle", with_(*B1_X) +
          "\nSELECT fid, part, round(min(ang), 4) AS min_angle FROM b1_ang WHERE ring = 0 GROUP BY fid, part")
def q_min_interior_angle(spark, sf):
    """Smallest vertex angle of the exterior, vertex 0 not looked at."""
    p = _block_parts(spark, sf)
    return p.select("fid", "part", F.round(F.expr(f"array_min({G.ring_interior_angles('rings[0]')})"), 4).alias("min_angle"))


@register("max_decimals", with_(*B1_X, """
dec AS (SELECT v.fid, v.x, v.y, min(k) AS d FROM b1_v v, range(0, 13) t(k)
        WHERE abs(v.x * pow(10, k) - round(v.x * pow(10, k))) < 1e-9 * pow(10, k)
          AND abs(v.y * pow(10, k) - round(v.y * pow(10, k))) < 1e-9 * pow(10, k)
        GROUP BY v.fid, v.part, v.ring, v.seq, v.x, v.y)""") +
          "\nSELECT fid, CAST(max(d) AS INTEGER) AS max_decimals FROM dec GROUP BY fid")
def q_max_decimals(spark, sf):
    """Decimals needed by the most precise coordinate."""
    from vectorlint.operators.feature import max_decimals
    return max_decimals(_blocks(spark, sf).where("geom IS NOT NULL"))


@register("convex_hull_area", with_(*B1_X, B1_HULL) + "\nSELECT fid, part, round(area, 6) AS hull_area FROM b1_hull")
def q_convex_hull_area(spark, sf):
    """G13 on valid parts."""
    from vectorlint.operators.feature import convex_hull_area
    return convex_hull_area(_valid_block_parts(spark, sf)).select("fid", "part", F.round("hull_area", R6).alias("hull_area"))


@register("compactness", with_(*B1_X) +
          "\nSELECT a.fid, round(p.perim * p.perim / (4 * 3.1416 * a.area), 6) AS compactness FROM b1_fa a JOIN b1_fp p ON p.fid = a.fid WHERE a.area <> 0")
def q_compactness(spark, sf):
    """perimeter^2 / (4 * 3.1416 * area)."""
    b = _blocks(spark, sf).where("geom IS NOT NULL").select(
        "fid", F.expr(G.geom_area("geom")).alias("a"), F.expr(G.geom_length("geom")).alias("p"))
    return b.where("a <> 0").select("fid", F.round(F.expr("p * p / (4 * 3.1416 * a)"), R6).alias("compactness"))


# the other query families register themselves on import
from vectorlint.plans import catalog_suburb  # noqa: E402,F401
from vectorlint.plans import catalog_network  # noqa: E402,F401
from vectorlint.plans import catalog_registry  # noqa: E402,F401
from vectorlint.plans import catalog_ingest  # noqa: E402,F401
from vectorlint.plans import catalog_runners  # noqa: E402,F401
