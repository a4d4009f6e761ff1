"""Runners (R1-R6) and report shaping.

A runner builds its shared intermediates once - the features, the part
table, the valid parts and the pair relations (candidate join + area kernel
+ boundary contacts) - checkpoints them into ``spark.checkpoint.dir`` (so the
eleven-odd checks start from short plans and survive executor loss), and
returns one ``unionByName`` of lazily built violation frames in the fixed
schema.  The caller triggers a single write
or collect; nothing is iterated on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorlint.functions import geometry as G
from vectorlint.functions.projection import to_metric
from vectorlint.model import SRID_GEOGRAPHIC
from vectorlint.operators import attribute as A
from vectorlint.operators import feature as FE
from vectorlint.operators import network as N
from vectorlint.operators import pairs as P
from vectorlint.operators import spatial as S
from vectorlint.operators.violations import violations
from vectorlint.session import checkpoint_dir, materialize


class Context:
    """Shared, checkpointed intermediates of one validation run.

    ``source`` is the input in its own CRS: rules about the CRS, coordinate
    precision, bounding boxes in degrees and equality of geometries use it.
    ``features`` is the metric frame (geographic rows projected to
    ``work_srid``): area and length rules use it.  If no row is projected the
    two are one."""

    def __init__(self, features: DataFrame, keep: list[str] | None = None, work_srid: int | None = None,
                 persist: bool = True):
        self._persist = persist
        self.source = self._cut(features) if persist else features
        geographic = [k for k, v in SRID_GEOGRAPHIC.items() if v]
        self.projected = bool(work_srid) and not self.source.where(F.col("srid").isNull() | F.col("srid").isin(geographic)).isEmpty()
        self.features = self.source
        if self.projected:
            f = to_metric(self.source, work_srid)
            self.features = self._cut(f) if persist else f
        self.keep = [c for c in (keep or []) if c in features.columns]
        self._cache: dict[str, DataFrame] = {}

    def _cut(self, df: DataFrame) -> DataFrame:
        """Materialise into ``spark.checkpoint.dir`` (shared storage on a
        cluster): later plans start from a leaf instead of re-analysing the
        whole geometry pipeline, and a lost executor costs a re-read, not a
        recomputation."""
        checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)

    def _p(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._cache:
            df = build()
            if self._persist:
                df = self._cut(df)
            self._cache[name] = df
        return self._cache[name]

    @property
    def parts(self) -> DataFrame:
        return self._p("parts", lambda: S.parts(self.features, keep=["srid", *self.keep]))

    @property
    def source_parts(self) -> DataFrame:
        """Parts in the source CRS."""
        return self._p("source_parts", lambda: S.parts(self.source, keep=["srid", *self.keep])) if self.projected else self.parts

    @property
    def source_valid(self) -> DataFrame:
        return self._p("source_valid", lambda: FE.valid_parts(self.source_parts)) if self.projected else self.valid_parts

    @property
    def source_rel_area(self) -> DataFrame:
        return self._p("source_rel_area", lambda: P.relate(self.source_valid, contacts=False)) if self.projected else self.rel_area

    @property
    def valid_parts(self) -> DataFrame:
        return self._p("valid", lambda: FE.valid_parts(self.parts))

    @property
    def rel(self) -> DataFrame:
        return self._p("rel", lambda: P.relate(self.valid_parts))

    @property
    def rel_area(self) -> DataFrame:
        """Area-only relations (no boundary contacts) for overlap rules; a run that
        has the whole relations already takes the areas from those."""
        if "rel" in self._cache:
            return self._cache["rel"]
        return self._p("rel_area", lambda: P.relate(self.valid_parts, contacts=False))

    def release(self) -> None:
        self._cache.clear()


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# ---------------------------------------------------------------- R1-R5 ----

def run_suburb(ctx: Context, min_area_m2: float = 30, min_shared_len_m: float = 5,
               name_typos: bool = True) -> DataFrame:
    """The 17 suburb checks in the reference order."""
    f, p, vp = ctx.features, ctx.parts, ctx.valid_parts
    rel = ctx.rel       # before the areas are asked for, which it holds
    frames = [
        FE.geometry_valid(f, p, error_type="InvalidGeometry"),
        P.overlap_suburb(ctx.source_valid, ctx.source_rel_area),
        FE.sliver_area(vp, min_area_m2),
        FE.area_non_positive(f),
        P.topological_gaps(vp),
        FE.small_hole(vp, 25.0),
        A.non_contiguous_parts(p, "suburb"),
        P.boundary_misalignment(vp, 0.5),
        P.short_shared_boundary(vp, rel, min_shared_len_m),
        P.enclave(vp, ctx.rel_area),
        A.crs_not_projected(ctx.source),
        FE.centroid_outside(vp),
        P.duplicate_geometry(ctx.source, "DuplicateGeometry"),
    ]
    if all(c in f.columns for c in ("suburb", "postcode", "legalstartdate")):
        frames += [A.duplicate_name(f), A.missing_value(f), A.invalid_date(f)]
    if all(c in f.columns for c in ("suburb", "postcode")):
        frames += [A.suburb_multi_postcode(f), A.postcode_multi_suburb(f)]
    frames.append(P.neighbour_attr_mismatch(vp, ("state",), rel))
    if name_typos and "suburb" in f.columns:
        from vectorlint.operators.names import near_duplicate_names
        frames.append(near_duplicate_names(f, "suburb"))
    return _union(frames)


def run_road(roads: DataFrame, start_col: str = "start_node_name", end_col: str = "end_node_name") -> DataFrame:
    """R2: N1, then N2 + N3."""
    c = materialize(N.endpoint_candidates(roads, start_col, end_col), "road-candidates")
    return N.endpoint_isolated(roads, start_col, end_col, c).unionByName(N.isolation(roads, start_col=start_col, end_col=end_col, candidates=c))


def run_building(ctx: Context, overlap_tol_m2: float = 0.05, holes_ratio_max: float = 0.20, min_area_m2: float = 1.0,
                 hole_total_area_max_m2: float = 2.0, sliver_ratio_min: float = 0.20) -> DataFrame:
    """The 11 building checks."""
    f, p, vp = ctx.features, ctx.parts, ctx.valid_parts
    return _union([
        FE.geometry_not_empty(f),
        FE.geometry_valid(f, p, error_type="GeometryValid"),
        FE.polygons_only(f),
        P.duplicate_geometry(ctx.source, "DuplicateGeometries"),
        A.expected_crs(ctx.source, (4326, 7844)),
        P.overlap_building(vp, ctx.rel_area, overlap_tol_m2),
        FE.holes_area_ratio(f, holes_ratio_max),
        FE.holes_total_area(f, hole_total_area_max_m2),
        FE.minimum_area(f, min_area_m2),
        FE.parts_self_overlap(vp),
        FE.sliver_ratio(f, sliver_ratio_min),
    ])


def run_blocks(ctx: Context, min_len_m: float = 2.0, bbox=((140.0, -40.0), (150.0, -33.0))) -> DataFrame:
    """The 10 block checks."""
    f, p, vp = ctx.features, ctx.parts, ctx.valid_parts
    return _union([
        FE.geometry_valid(f, p, error_type="InvalidGeometry", fixed_message="Geometry is invalid."),
        FE.not_simple(f, p),
        P.overlap_block(vp, ctx.rel_area, 0.0),
        FE.short_edge(vp, min_len_m),
        FE.wrong_orientation(vp),
        P.nonmanifold_edge(vp),
        FE.acute_angle(vp, 5.0),
        # Decimals say nothing about degrees, so geographic rows are left out.
        FE.excessive_precision(ctx.source_valid.where(~F.coalesce(F.col("srid"), F.lit(4326)).isin([k for k, v in SRID_GEOGRAPHIC.items() if v]))),
        FE.triangulation_not_closed(vp, 0.1),
        FE.outside_bbox(ctx.source_parts, bbox),
    ])


def run_floor(ctx: Context) -> DataFrame:
    """The 7 floor-space checks (the pairs table is ``P.overlap_pairs_table``)."""
    f, p, vp = ctx.features, ctx.parts, ctx.valid_parts
    return _union([
        FE.geometry_valid(f, p, error_type="GeometryValidity", fixed_message="Invalid geometry"),
        P.overlap_floor(vp, ctx.rel_area),
        A.null_values(f.drop("fid")),
        A.negative_value(f),
        A.total_consistency(f),
        A.crs_missing(f),
        A.conflict_block_uses(f),
    ])


RUNNERS = {"suburb": run_suburb, "building": run_building, "blocks": run_blocks, "floor": run_floor}
WORK_SRID = {"suburb": 3107, "building": 7855, "blocks": 3107, "floor": None}


def validate(features: DataFrame, dataset_type: str, keep: list[str] | None = None, clean: bool = False, **params) -> DataFrame:
    """One entry point: dataset type -> guard (S13) -> runner -> violations.

    Raises ``ValueError`` if no row has a geometry type of the dataset.  With
    ``clean`` null and empty geometries, repeated vertices and ring directions
    are mended first (S15).  Rows in an unknown CRS, which metric rules can't
    measure, and degrees out of range (S14) get violation rows of their own."""
    from vectorlint.sources import ingest as I
    if clean:
        features = I.clean_geometry(features)
    guard = I.dataset_guard(features, dataset_type).first()
    if guard.types and not guard.ok:
        raise ValueError(f"no {dataset_type} geometries among the types {guard.types}")
    if dataset_type == "road":
        return run_road(features, **params)
    ctx = Context(features, keep=keep, work_srid=WORK_SRID.get(dataset_type))
    frames = [RUNNERS[dataset_type](ctx, **params)]
    if ctx.projected:
        geographic = ctx.source.where(F.coalesce(F.col("srid"), F.lit(4326)).isin([k for k, v in SRID_GEOGRAPHIC.items() if v]))
        frames.append(violations(I.coord_range_check(geographic).where("NOT ok").withColumn("fid", F.lit(None).cast("bigint")), "CoordinateRange", fid=None,
                                 message=F.lit("Coordinates are not longitudes and latitudes"), metric="lat_share", metric2="lon_share"))
    if WORK_SRID.get(dataset_type):
        frames.append(violations(ctx.source.where(F.col("srid").isNotNull() & ~F.col("srid").isin(list(SRID_GEOGRAPHIC))), "ReprojectionError",
                                 message=F.lit("Unsupported coordinate system; not projected")))
    return _union(frames)


# ------------------------------------------------------------------- R6 ----

@dataclass
class Rule:
    """A named rule: ``fn(ctx) -> violations`` plus metadata."""
    name: str
    fn: Callable[[Context], DataFrame]
    category: str = "general"
    applies_to: frozenset = frozenset({"common"})
    description: str = ""
    params: dict = field(default_factory=dict)


class RuleEngine:
    """Run a list of rules; every violation gets ``rule`` and ``category``."""

    def __init__(self, rules: list[Rule]):
        self.rules = list(rules)

    def run(self, ctx: Context) -> DataFrame:
        return _union([r.fn(ctx).withColumn("rule", F.lit(r.name)).withColumn("category", F.lit(r.category))
                       for r in self.rules])

    def run_with_geometry(self, ctx: Context) -> DataFrame:
        return failures_with_geometry(self.run(ctx), ctx.features)


def default_building_rules(min_area_m2: float = 5.0, overlap_tol_m2: float = 0.1, max_total_hole_area_m2: float = 2.0,
                           sliver_ratio_min: float = 0.15, required_fields=(), unique_fields=()) -> list[Rule]:
    """R6 preset (thresholds of the preset, not of the plain runner)."""
    rules = [
        Rule("ExpectedCRS", lambda c: A.expected_crs(c.features, (4326, 7844, 28355, 7855)), "crs"),
        Rule("GeometryNotEmpty", lambda c: FE.geometry_not_empty(c.features), "geometry"),
        Rule("GeometryValid", lambda c: FE.geometry_valid(c.features, c.parts), "geometry"),
        Rule("BuildingPolygonsOnly", lambda c: FE.polygons_only(c.features), "geometry"),
        Rule("AttributeNotNull", lambda c: A.attribute_not_null(c.features, list(required_fields)), "attribute"),
        *[Rule(f"UniqueField[{u}]", (lambda c, u=u: A.unique_field(c.features, u)), "attribute") for u in unique_fields],
        Rule("DuplicateGeometries", lambda c: P.duplicate_geometry(c.features, "DuplicateGeometries"), "geometry"),
        Rule("MinimumArea", lambda c: FE.minimum_area(c.features, min_area_m2), "geometry"),
        Rule("HolesTotalAreaLimit", lambda c: FE.holes_total_area(c.features, max_total_hole_area_m2), "geometry"),
        Rule("OverlappingBuildings", lambda c: P.overlap_building(c.valid_parts, c.rel_area, overlap_tol_m2), "topology"),
        Rule("PartsSelfOverlap", lambda c: FE.parts_self_overlap(c.valid_parts), "topology"),
        Rule("SliverPolygons", lambda c: FE.sliver_ratio(c.features, sliver_ratio_min), "geometry"),
    ]
    return rules


# --------------------------------------------------------------- R7-R14 ----

def failures_with_geometry(v: DataFrame, features: DataFrame) -> DataFrame:
    """Feature-level rows joined with their geometry (left join)."""
    return v.where("fid IS NOT NULL").join(features.select("fid", "geom"), "fid", "left")


def summary_by(v: DataFrame, col: str = "error_type") -> DataFrame:
    """Violation counts by one column."""
    return v.groupBy(col).agg(F.count("*").alias("n"))


def rule_summary(v: DataFrame, rule_keys: DataFrame) -> DataFrame:
    """One row per known rule, zero counts included (left join from the
    rule list)."""
    c = v.groupBy(F.col("error_type").alias("rule_key")).agg(F.count("*").alias("n"))
    return rule_keys.select("rule_key").distinct().join(c, "rule_key", "left").select(
        "rule_key", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def report_columns(v: DataFrame) -> DataFrame:
    """output_error / error_count / rule_key added; pinned columns
    first, columns holding only null / "" / none / nan / nat last (decided
    by one aggregate over the report, which is written as a table: the run that
    made it is not repeated)."""
    out = (v.withColumn("output_error", F.regexp_replace(F.concat_ws(": ", F.col("error_type"), F.col("message")), r"^: |: $", ""))
            .withColumn("error_count", F.lit(1)).withColumn("rule_key", F.col("error_type")))
    void = [c for c, t in out.dtypes if t == "void"]       # no file holds these
    out = materialize(out.drop(*void), "report").select(*[F.lit(None).alias(c) if c in void else F.col(c) for c in out.columns])
    pin = [c for c in ("fid", "error_type", "message", "output_error", "rule_key", "error_count", "lon", "lat") if c in out.columns]
    others = [c for c in out.columns if c not in pin]
    flat = {c: (F.col(c).cast("string") if not isinstance(out.schema[c].dataType, (T.MapType, T.ArrayType, T.StructType))
                else F.to_json(F.col(c))) for c in others}
    noneish = out.agg(*[F.bool_and(F.coalesce(F.lower(F.trim(flat[c])).isin("", "none", "nan", "nat"), F.lit(True))).alias(c)
                        for c in others]).first() if others else None
    empty_cols = [c for c in others if noneish is not None and noneish[c]]
    keep = [c for c in others if c not in empty_cols]
    return out.select(*pin, *keep, *empty_cols)


# UI rule names that do not match the emitted error types.
RULE_ALIASES = {
    "PolygonOverlap": "Overlap", "NonmanifoldEdge": "NonManifoldEdge", "MinInteriorAngle": "AcuteAngle",
    "OutsideBBOX": "OutsideBBox", "TouchesOnly": "Touches", "EndpointCandidate": "EndpointIsolated",
    "IsolatedSegment": "IsolatedRoad",
}
AUTO = {"auto", "Auto", "Auto (based on dataset)", "Auto (based on dataset type)"}


def rule_filter(v: DataFrame, keys: list[str] | None) -> DataFrame:
    """Keep the chosen rule keys (UI aliases mapped); auto/empty = all."""
    if not keys or set(keys) & AUTO:
        return v
    wanted = sorted({RULE_ALIASES.get(k, k) for k in keys})
    return v.where(F.col("error_type").isin(wanted))


def latlon_fallback(v: DataFrame, features: DataFrame, preview=(-37.8136, 144.9631)) -> DataFrame:
    """Violation lat/lon = its own (metric/metric2 when a rule put a
    point there is not assumed; columns ``lat``/``lon`` if present), else the
    feature centroid, else the dataset centroid (a scalar subquery), else the
    preview centre.  The dataset centroid is the mean of the feature centroids
    of the highest dimension that the layer has: polygons by area, lines by
    length, points by count (overlaps count for each feature)."""
    cent = G.with_centroid(features.select("fid", "geom", F.col("geom.type").alias("kind"), F.expr(G.geom_area("geom")).alias("area"), F.expr(G.geom_length("geom")).alias("length")),
                           "fx", "fy", "kind", "area", "length")
    found = cent.where("fx IS NOT NULL AND NOT isnan(fx) AND NOT isnan(fy)")

    def mean(c: str) -> F.Column:
        area, line = F.expr("if(kind IN ('Polygon', 'MultiPolygon'), area, 0D)"), F.expr("if(kind IN ('LineString', 'MultiLineString'), length, 0D)")
        return F.coalesce(*[F.try_divide(F.sum(F.col(c) * w), F.sum(w)) for w in (area, line)], F.avg(c))

    ds = found.agg(F.struct(mean("fx").alias("dx"), mean("fy").alias("dy"))).scalar()
    own_lat = F.col("lat") if "lat" in v.columns else F.lit(None).cast("double")
    own_lon = F.col("lon") if "lon" in v.columns else F.lit(None).cast("double")
    j = v.join(S.large(cent.select("fid", "fx", "fy")), "fid", "left").withColumn("dx", ds["dx"]).withColumn("dy", ds["dy"])
    return j.withColumn("lat_", F.coalesce(own_lat, F.col("fy"), F.col("dy"), F.lit(preview[0]))).withColumn(
        "lon_", F.coalesce(own_lon, F.col("fx"), F.col("dx"), F.lit(preview[1]))).drop(
        "fx", "fy", "dx", "dy", *([c for c in ("lat", "lon") if c in v.columns])).withColumnRenamed(
        "lat_", "lat").withColumnRenamed("lon_", "lon")


#: Buckets of a selection pass; each pass narrows the range that many times.
_BUCKETS = 4096


def _kth(values: DataFrame, k: int, low: float, high: float) -> float:
    """The k-th smallest (from 0) of the column ``x``, between its bounds.  A pass
    counts a bucket table of fixed size and goes on within the bucket that holds
    the k-th value, until all values there are equal; no values are collected."""
    while low < high:
        width = (high - low) / _BUCKETS
        bucket = F.least(F.floor((F.col("x") - low) / width), F.lit(_BUCKETS - 1)) if width > 0 else (F.col("x") > low).cast("bigint")
        counts = values.where(F.col("x").between(low, high)).groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        for r in sorted(counts, key=lambda r: r["b"]):
            if k < r["n"]:
                low, high = r["lo"], r["hi"]
                break
            k -= r["n"]
    return low


def exact_median(df: DataFrame, col: str) -> float | None:
    """Median (mean of the two middle values) of the numbers in a column, by selection."""
    values = df.select(F.col(col).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    a = values.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if not a["n"]:
        return None
    middle = {(a["n"] - 1) // 2, a["n"] // 2}
    return sum(_kth(values, k, a["lo"], a["hi"]) for k in middle) / len(middle)


def map_extent(points: DataFrame) -> DataFrame:
    """centre = median lat / lon (interpolated), zoom = log2(360 / max
    span) clamped to [2, 16]."""
    lat, lon = (F.lit(exact_median(points, c)).cast("double").alias(f"centre_{c}") for c in ("lat", "lon"))
    return points.agg((F.max("lat") - F.min("lat")).alias("lat_span"), (F.max("lon") - F.min("lon")).alias("lon_span")).select(
        lat, lon,
        F.greatest(F.lit(2.0), F.least(F.lit(16.0), F.log2(F.lit(360.0) / F.greatest("lat_span", "lon_span", F.lit(0.001))))).alias("zoom"))


def example_per_rule(v: DataFrame) -> DataFrame:
    """The first violation (smallest fid, then part) of every rule, by
    a grouped min - not a window over what may be one huge rule."""
    g = v.groupBy("error_type").agg(F.min(F.struct(
        F.coalesce(F.col("fid"), F.lit(-(2 ** 63))).alias("k"), "fid", "part", "message")).alias("m"))
    return g.select("error_type", "m.fid", "m.part", "m.message")


def any_flag_report(features: DataFrame, ctx: Context, min_area: float = 10.0, max_compact: float = 15.0,
                    min_len: float = 2.0, min_deg: float = 5.0, bbox=((140.0, -40.0), (150.0, -33.0))) -> DataFrame:
    """The notebook's wide block report - one row per feature with any
    flag set: too_small_area, is_sliver, short_edge, wrong_orientation,
    dup_id, nonmanifold_edge, acute_angle, excessive_precision, outside_bbox."""
    vp, p = ctx.valid_parts, ctx.parts

    def ids(v: DataFrame, name: str) -> DataFrame:
        return v.select("fid").distinct().withColumn(name, F.lit(True))

    cmp = FE.compactness(features, max_compact, min_area)
    flags = [
        ids(cmp.where(F.col("attrs")["too_small_area"] == "true"), "too_small_area"),
        ids(cmp.where(F.col("attrs")["is_sliver"] == "true"), "is_sliver"),
        ids(FE.short_edge(vp, min_len), "short_edge"),
        ids(FE.wrong_orientation(vp), "wrong_orientation"),
        ids(P.nonmanifold_edge(vp), "nonmanifold_edge"),
        ids(FE.acute_angle(vp, min_deg), "acute_angle"),
        ids(FE.excessive_precision_any(features), "excessive_precision"),
        ids(FE.outside_bbox(p, bbox), "outside_bbox"),
    ]
    names = ["too_small_area", "is_sliver", "short_edge", "wrong_orientation", "nonmanifold_edge", "acute_angle",
             "excessive_precision", "outside_bbox"]
    base = features.select("fid", *[c for c in ("school_name",) if c in features.columns])
    dup = P.duplicate_of_first(features)
    out = base.join(dup, "fid", "left")
    for fl in flags:
        out = out.join(fl, "fid", "left")
    out = out.select(*base.columns, *[F.coalesce(F.col(n), F.lit(False)).alias(n) for n in names], "dup_id")
    any_set = reduce(lambda a, b: a | b, [F.col(n) for n in names]) | F.col("dup_id").isNotNull()
    return out.where(any_set)


def violation_schema_frame(spark) -> DataFrame:
    return violations(spark.range(0).withColumn("fid", F.col("id")), "none")
