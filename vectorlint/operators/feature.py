"""Per-feature and per-part geometry checks.

Each check is a projection + filter over the feature or part table: the
geometry maths runs as higher-order column expressions, so these checks add
no shuffle.  The only joins are those of the validity checks (F2/F3, see
``validity``) and the pair join of F21/F25.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorlint.functions import geometry as G
from vectorlint.model import SRID_GEOGRAPHIC
from vectorlint.operators import spatial as S
from vectorlint.operators.coverage import covered_area
from vectorlint.operators.validity import geometry_valid, invalid_parts, not_simple, valid_parts  # noqa: F401
from vectorlint.operators.violations import violations


def _geom_expr(df: DataFrame, frag: str, name: str) -> DataFrame:
    return df.withColumn(name, F.expr(frag))


# ------------------------------------------------------------ existence ----

def geometry_not_empty(features: DataFrame) -> DataFrame:
    """F1 GeometryNotEmpty: null or empty geometry."""
    return violations(features.where(G.geom_is_empty("geom")), "GeometryNotEmpty", message=F.lit("Empty geometry"))


def polygons_only(features: DataFrame, error_type: str = "BuildingPolygonsOnly") -> DataFrame:
    """geometry type not Polygon/MultiPolygon (a null geometry has no
    type and fails too)."""
    bad = features.where("NOT coalesce(geom.type IN ('Polygon', 'MultiPolygon'), false)")
    return violations(bad, error_type, message=F.lit("Geometry must be Polygon/MultiPolygon"))


# ---------------------------------------------------------------- areas ----

def area_non_positive(features: DataFrame) -> DataFrame:
    """F5 AreaNonPositive: area <= 0 (empty counts, null geometry does not)."""
    a = _geom_expr(features.where("geom IS NOT NULL"), G.geom_area("geom"), "area")
    return violations(a.where("area <= 0"), "AreaNonPositive", message=F.lit("Area <= 0"), metric="area")


def sliver_area(parts_df: DataFrame, min_area: float = 30.0) -> DataFrame:
    """F6 SliverPolygon: part area < min_area."""
    a = _geom_expr(parts_df.where("gtype IN ('Polygon', 'MultiPolygon')"), G.part_area("rings"), "area")
    return violations(a.where(F.col("area") < min_area), "SliverPolygon", part="part",
                      message=F.lit(f"Area < {min_area} m^2"), metric="area")


def minimum_area(features: DataFrame, min_area: float = 1.0) -> DataFrame:
    """F7 MinimumArea: feature area < min_area."""
    a = _geom_expr(features.where("geom IS NOT NULL"), G.geom_area("geom"), "area")
    return violations(a.where(F.col("area") < min_area), "MinimumArea",
                      message=F.format_string(f"Area %.3f < {min_area}", "area"), metric="area")


def small_hole(parts_df: DataFrame, max_hole_area: float = 25.0) -> DataFrame:
    """F8 SmallHole: one row per hole with area <= max_hole_area (metric2 =
    ring index)."""
    h = parts_df.where("gtype IN ('Polygon', 'MultiPolygon')").select(
        "fid", "part", F.posexplode(F.expr("slice(rings, 2, greatest(size(rings) - 1, 0))")).alias("h", "pts"))
    h = _geom_expr(h, f"abs({G.ring_signed_area('pts')})", "area")
    return violations(h.where(F.col("area") <= max_hole_area), "SmallHole", part="part",
                      message=F.lit(f"Hole area <= {max_hole_area} m^2"), metric="area", metric2="h + 1")


def holes_total_area(features: DataFrame, max_total: float = 2.0) -> DataFrame:
    """F9a HolesTotalAreaLimit: summed hole area > max_total."""
    a = _geom_expr(features.where(f"NOT {G.geom_is_empty('geom')}"), G.geom_hole_area("geom"), "holes")
    return violations(a.where(F.col("holes") > max_total), "HolesTotalAreaLimit",
                      message=F.format_string(f"Total hole area %.3f > {max_total}", "holes"), metric="holes")


def holes_area_ratio(features: DataFrame, max_ratio: float = 0.20) -> DataFrame:
    """F9b HolesAreaRatioLimit: holes / area > max_ratio (area <= 0 skipped)."""
    a = features.where(f"NOT {G.geom_is_empty('geom')}").select(
        "fid", F.expr(G.geom_hole_area("geom")).alias("holes"), F.expr(G.geom_area("geom")).alias("area"))
    a = a.where("area > 0").withColumn("ratio", F.col("holes") / F.col("area"))
    return violations(a.where(F.col("ratio") > max_ratio), "HolesAreaRatioLimit",
                      message=F.format_string(f"Holes/Area ratio %.3f > {max_ratio}", "ratio"),
                      metric="holes", metric2="area")


def sliver_ratio(features: DataFrame, min_ratio: float = 0.20) -> DataFrame:
    """F11 SliverPolygons: area / perimeter < min_ratio (perimeter 0 -> not flagged)."""
    a = features.where("geom IS NOT NULL").select(
        "fid", F.expr(G.geom_area("geom")).alias("area"), F.expr(G.geom_length("geom")).alias("perim"))
    a = a.withColumn("ratio", F.expr("area / nullif(perim, 0)"))
    return violations(a.where(F.col("ratio") < min_ratio), "SliverPolygons",
                      message=F.format_string(f"Area/perimeter %.3f < {min_ratio}", "ratio"),
                      metric="ratio", metric2="area")


def compactness(features: DataFrame, max_ratio: float = 15.0, min_area: float = 10.0) -> DataFrame:
    """compactness perimeter^2 / (4 * 3.1416 * area) > max_ratio is a
    sliver (``is_sliver``), area < min_area is ``too_small_area``; one row per
    flagged feature with both flags (metric = compactness, metric2 = area)."""
    a = features.where("geom IS NOT NULL").select(
        "fid", F.expr(G.geom_area("geom")).alias("area"), F.expr(G.geom_length("geom")).alias("perim"))
    a = a.withColumn("cmp", F.expr("perim * perim / nullif(4 * 3.1416 * area, 0)")).withColumn(
        "is_sliver", F.expr(f"coalesce(cmp > {max_ratio}, area = 0 AND perim > 0)")).withColumn(
        "too_small", F.col("area") < min_area)
    flagged = a.where("is_sliver OR too_small")
    return violations(flagged, "CompactnessSliver",
                      message=F.concat_ws("; ", F.when(F.col("is_sliver"), F.lit("is_sliver")),
                                          F.when(F.col("too_small"), F.lit("too_small_area"))),
                      metric="cmp", metric2="area",
                      attrs=F.create_map(F.lit("is_sliver"), F.col("is_sliver").cast("string"),
                                         F.lit("too_small_area"), F.col("too_small").cast("string")))


# ---------------------------------------------------------------- edges ----

def short_edge(parts_df: DataFrame, min_len: float = 2.0, include_interiors: bool = False) -> DataFrame:
    """F13 ShortEdge: shortest exterior edge < min_len."""
    if include_interiors:
        frag = f"array_min(flatten(transform(rings, r -> {G.ring_edge_lengths('r')})))"
    else:
        frag = f"array_min({G.ring_edge_lengths('rings[0]')})"
    a = _geom_expr(parts_df.where("gtype IN ('Polygon', 'MultiPolygon')"), frag, "m")
    return violations(a.where(F.col("m") < min_len), "ShortEdge", part="part",
                      message=F.format_string(f"Shortest edge %.6f < {min_len}.", "m"), metric="m")


def wrong_orientation(parts_df: DataFrame) -> DataFrame:
    """F14 WrongOrientation: exterior not counter-clockwise, or a hole not
    clockwise (the working form of the rule; metric = 1 if the exterior is
    wrong, metric2 = number of wrong holes)."""
    ext_bad = f"CASE WHEN {G.ring_signed_area('rings[0]')} < 0 THEN 1 ELSE 0 END"
    holes_bad = f"size(filter(slice(rings, 2, greatest(size(rings) - 1, 0)), r -> {G.ring_signed_area('r')} > 0))"
    a = parts_df.where("gtype IN ('Polygon', 'MultiPolygon')").select(
        "fid", "part", F.expr(ext_bad).alias("eb"), F.expr(holes_bad).alias("hb"))
    return violations(a.where("eb + hb > 0"), "WrongOrientation", part="part",
                      message=F.lit("Outer ring is clockwise (expected CCW)."), metric="eb", metric2="hb")


def acute_angle(parts_df: DataFrame, min_deg: float = 5.0, include_interiors: bool = False) -> DataFrame:
    """F15 AcuteAngle: smallest vertex angle (vertex 0 not looked at) < min_deg."""
    if include_interiors:
        frag = f"array_min(flatten(transform(rings, r -> {G.ring_interior_angles('r')})))"
    else:
        frag = f"array_min({G.ring_interior_angles('rings[0]')})"
    a = _geom_expr(parts_df.where("gtype IN ('Polygon', 'MultiPolygon')"), frag, "m")
    return violations(a.where(F.col("m") < min_deg), "AcuteAngle", part="part",
                      message=F.format_string(f"Minimum interior angle %.4f deg < {min_deg} deg.", "m"),
                      metric="m")


def acute_boundary_angle(parts_df: DataFrame, min_deg: float = 5.0) -> DataFrame:
    """F16 AcuteBoundaryAngle: one row per exterior vertex (index 1..n-2)
    with an angle < min_deg; metric2 = vertex index."""
    a = parts_df.where("gtype IN ('Polygon', 'MultiPolygon')").select(
        "fid", "part", F.posexplode(F.expr(G.ring_interior_angles("rings[0]"))).alias("k", "ang"))
    return violations(a.where(F.col("ang") < min_deg), "AcuteBoundaryAngle", part="part",
                      message=F.format_string(f"Angle %.2f deg < {min_deg} deg", "ang"),
                      metric="ang", metric2="k + 1")


def too_few_edges(parts_df: DataFrame, min_edges: int = 4, small_angle: float = 30.0) -> DataFrame:
    """polygon parts whose exterior has fewer than ``min_edges`` edges;
    the message joins every problem found with "; " (too few edges, and
    the smallest angle when it is below ``small_angle``)."""
    ang = f"array_min({G.ring_interior_angles('rings[0]', skip_first=False)})"
    a = parts_df.where("gtype IN ('Polygon', 'MultiPolygon')").select(
        "fid", "part", F.expr("size(rings[0]) - 1").alias("n"), F.expr(ang).alias("m"))
    bad = a.where(F.col("n") < min_edges)
    msg = F.concat_ws("; ", F.format_string("Too few edges: %d", "n"),
                      F.when(F.col("m") < small_angle, F.format_string("Minimum angle too small: %.2f deg", "m")))
    return violations(bad, "TooFewEdges", part="part", message=msg, metric="n", metric2="m")


# ------------------------------------------------------------ precision ----

def excessive_precision(parts_df: DataFrame, srid_col: str = "srid", max_decimals: int = 3,
                        max_bad_ratio: float = 0.10) -> DataFrame:
    """F17 ExcessivePrecision: projected CRS only; share of exterior vertices
    (closing vertex included) with x or y off its ``max_decimals`` rounding
    by >= 1e-9 is > max_bad_ratio."""
    geo = [k for k, v in SRID_GEOGRAPHIC.items() if v]
    d = max_decimals
    bad = f"size(filter(rings[0], q -> abs(q.x - round(q.x, {d})) >= 1e-9 OR abs(q.y - round(q.y, {d})) >= 1e-9))"
    a = parts_df.where(F.col(srid_col).isNotNull() & ~F.col(srid_col).isin(geo)).where(
        "gtype IN ('Polygon', 'MultiPolygon') AND size(rings[0]) > 0").select(
        "fid", "part", (F.expr(bad) / F.expr("size(rings[0])")).alias("ratio"))
    return violations(a.where(F.col("ratio") > max_bad_ratio), "ExcessivePrecision", part="part",
                      message=F.lit(f"> {d} decimals"), metric="ratio")


def excessive_precision_any(features: DataFrame, max_decimals: int = 3) -> DataFrame:
    """any exterior coordinate whose shortest decimal text has more than
    ``max_decimals`` decimals (i.e. differs from its own rounding)."""
    d = max_decimals
    frag = (f"exists(geom.coords, pp -> exists(pp[0], q -> q.x <> round(q.x, {d}) OR q.y <> round(q.y, {d})))")
    a = features.where(f"geom.type IN ('Polygon', 'MultiPolygon') AND {frag}")
    return violations(a, "ExcessivePrecisionAny", message=F.lit(f"more than {d} decimals"))


def max_decimals(features: DataFrame) -> DataFrame:
    """Decimals needed by the most precise coordinate (0..12)."""
    pts = G.all_points("geom")
    k = "sequence(0, 12)"
    need = (f"array_max(transform({pts}, q -> coalesce(array_min(filter({k}, d -> "
            f"abs(q.x * pow(10, d) - round(q.x * pow(10, d))) < 1e-9 * pow(10, d) AND "
            f"abs(q.y * pow(10, d) - round(q.y * pow(10, d))) < 1e-9 * pow(10, d))), 12)))")
    return features.select("fid", F.expr(need).alias("max_decimals"))


# ---------------------------------------------------------- containment ----

def centroid_outside(parts_df: DataFrame) -> DataFrame:
    """F10 CentroidOutside: the part's centroid is not strictly inside it;
    metric/metric2 = a point on the surface (x, y)."""
    g = S.part_geom()
    cx, cy = G.centroid_xy(g)
    a = parts_df.where("gtype IN ('Polygon', 'MultiPolygon')").select(
        "fid", "part", "rings", "gtype", F.expr(cx).alias("cx"), F.expr(cy).alias("cy"))
    px, py = G.point_on_surface(g)
    bad = a.where(F.expr(f"NOT {G.point_in_polygon(g, 'cx', 'cy')}"))
    bad = bad.select("fid", "part", "cx", "cy", F.expr(px).alias("sx"), F.expr(py).alias("sy"))
    return violations(bad, "CentroidOutside", part="part", message=F.lit("Centroid not contained in polygon"),
                      metric="cx", metric2="cy",
                      attrs=F.create_map(F.lit("surface_x"), F.col("sx").cast("string"),
                                         F.lit("surface_y"), F.col("sy").cast("string")))


def outside_bbox(parts_df: DataFrame, bbox=((140.0, -40.0), (150.0, -33.0))) -> DataFrame:
    """F20 OutsideBBox: part not within the box.  Within = bounds inside the
    closed box and some of it in the open interior (a zero-area piece lying
    only on the box edge is not within)."""
    (x0, y0), (x1, y1) = bbox
    inside = (f"minx >= {x0} AND maxx <= {x1} AND miny >= {y0} AND maxy <= {y1} AND "
              f"NOT (maxx = {x0} OR minx = {x1} OR maxy = {y0} OR miny = {y1})")
    return violations(parts_df.where(f"NOT ({inside})"), "OutsideBBox", part="part",
                      message=F.lit("Geometry lies outside the bounding box."))


def road_bbox_outlier(features: DataFrame, box=(112.0, 129.0, -36.0, -12.0), pad: float = 5 / 111) -> DataFrame:
    """centroid outside the padded (lon, lat) box."""
    cx, cy = G.centroid_xy("geom")
    a = features.select("fid", F.expr(cx).alias("cx"), F.expr(cy).alias("cy")).where("cx IS NOT NULL")
    x0, x1, y0, y1 = box
    cond = (f"NOT (cx BETWEEN {x0 - pad!r} AND {x1 + pad!r} AND cy BETWEEN {y0 - pad!r} AND {y1 + pad!r})")
    return violations(a.where(cond), "RoadBBoxOutlier", message=F.lit("Centroid outside the expected extent"),
                      metric="cx", metric2="cy")


def within_bounding_polygon(features: DataFrame, boundary: DataFrame) -> DataFrame:
    """F22 WithinBoundingPolygon: feature centroid not strictly inside the
    one boundary polygon (``boundary``: one row with ``geom``)."""
    a = G.with_centroid(features, "cx", "cy")
    # the segments of the one boundary geometry as a scalar subquery; Spark raises if there are several
    j = a.withColumn("edges", boundary.select(F.expr(G.segments("geom"))).scalar())
    bad = j.where(F.expr(f"cx IS NULL OR NOT {G.point_in_segments('edges', 'cx', 'cy')}"))
    return violations(bad, "WithinBoundingPolygon", message=F.lit("Feature centroid outside boundary"))


def outside_extent(parts_df: DataFrame, extent_parts: DataFrame) -> DataFrame:
    """F21 OutsideExtent: part not within the union of the extent polygons,
    which may overlap: the part's area that they cover (``coverage``) is below
    its own area."""
    inside = covered_area(parts_df, extent_parts)
    a = _geom_expr(parts_df, G.part_area("rings"), "area").join(inside, ["fid", "part"], "left")
    bad = a.where("coalesce(covered, 0D) < area - 1e-9 * area")
    return violations(bad, "OutsideExtent", part="part", message=F.lit("Feature outside provided extent"),
                      metric="area - coalesce(covered, 0D)")


def parts_self_overlap(parts_df: DataFrame, tol: float = 0.0) -> DataFrame:
    """F25 PartsSelfOverlap: two parts of one feature share area > tol; one
    row per feature."""
    multi = parts_df.where("gtype = 'MultiPolygon'")
    pairs = S.candidate_pairs(multi).where("a_fid = b_fid")
    from vectorlint.operators.pairs import relate
    ar = relate(multi, pairs, contacts=False).where((F.col("area") > F.lit(tol)) & (F.col("area") > 0))
    bad = ar.groupBy(F.col("a_fid").alias("fid")).agg(F.sum("area").alias("area"))
    return violations(bad, "PartsSelfOverlap", message=F.lit("MultiPolygon parts overlap"), metric="area")


# -------------------------------------------------------- triangulation ----

def convex_hull_area(parts_df: DataFrame) -> DataFrame:
    """Area of the convex hull of a part's vertices (what a Delaunay
    triangulation of those vertices covers)."""
    return parts_df.select("fid", "part", F.expr(G.hull_area("rings")).alias("hull_area"))


def triangulation_not_closed(parts_df: DataFrame, tol: float = 0.1) -> DataFrame:
    """F19 TriangulationNotClosed: |hull area - area| >= tol (or NaN)."""
    a = parts_df.where("gtype IN ('Polygon', 'MultiPolygon')").select(
        "fid", "part", F.expr(G.part_area("rings")).alias("area"), F.expr(G.hull_area("rings")).alias("hull"))
    a = a.withColumn("diff", F.abs(F.col("hull") - F.col("area")))
    return violations(a.where(f"NOT (diff < {tol})"), "TriangulationNotClosed", part="part",
                      message=F.format_string(f"Triangulated area differs by %.6f (tol {tol}).", "diff"),
                      metric="diff")
