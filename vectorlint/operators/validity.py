"""OGC validity of polygons (F2) and simplicity of linework.

Three kinds of checks, from the cheapest to the rarest:

* in the row: NaN coordinates, short or open rings, edges that fold back;
* an edge self-join per part on (fid, part, cell): rings that cross, run along
  each other or touch themselves.  Points where two rings of a part touch are
  kept: they are the part's ring-touch graph;
* ring containment: test points of holes and shells against the edges of the
  other rings, by an equi-join on (fid, part, vertical slab).  A hole in a hole or
  a shell in another part is a reason of its own, partial containment a crossing.

The last two also work on whole features, whose parts must fit each other.

A part's interior is disconnected if its ring-touch graph (rings and touch
points) has a cycle; that is found by uniting rings and points part by part.
All that is grouped here belongs to one feature, whose rings came in one row.

Signs of orientations are exact up to double-double arithmetic
(``geometry.orientation``).  Repeated points of a ring count once.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorlint.functions import geometry as G
from vectorlint.operators import spatial as S
from vectorlint.operators.violations import violations
from vectorlint.session import materialize

#: Reasons by rank; a feature's reason is the one of lowest rank.
REASONS = ["Invalid Coordinate", "Too few points in geometry component", "Ring not closed", "Self-intersection", "Ring Self-intersection",
           "Hole lies outside shell", "Nested holes", "Nested shells", "Interior is disconnected"]
_POLYGONS = "gtype IN ('Polygon', 'MultiPolygon')"
#: Rank of partial containment: a crossing, if no ring is broken by itself.
_PARTLY = "4.5D"
_BAD_POINT = "isnan(q.x) OR isnan(q.y) OR abs(q.x) = double('infinity') OR abs(q.y) = double('infinity')"
_BOX = ["minx", "miny", "maxx", "maxy", "nedges", "nrings"]


def _deduplicated(rings: str) -> str:
    """Rings without repeated consecutive points."""
    return f"transform({rings}, r -> filter(r, (q, i) -> i = 0 OR q.x <> r[i - 1].x OR q.y <> r[i - 1].y))"


def ring_issues(parts_df: DataFrame) -> DataFrame:
    """``fid, part, rank`` of problems of single rings, found in the row."""
    nan = f"exists(flatten(rings), q -> {_BAD_POINT})"
    few = "exists(rings, r -> size(r) < 4)"
    unclosed = f"exists(rings, r -> NOT {G.ring_is_closed('r')})"
    corners = ("transform(filter(rings, r -> size(r) > 3), r -> transform(sequence(0, size(r) - 2), i -> "
               "named_struct('p', r[i], 'q', r[i + 1], 's', if(i + 2 < size(r), r[i + 2], r[1]))))")
    back = ("(t.q.x - t.p.x) * (t.s.x - t.q.x) + (t.q.y - t.p.y) * (t.s.y - t.q.y) < 0 AND "
            f"{G.orientation('t.p.x', 't.p.y', 't.q.x', 't.q.y', 't.s.x', 't.s.y')} = 0")
    folded = f"({_POLYGONS} AND exists(flatten({corners}), t -> {back}))"
    return parts_df.withColumn("rings", F.expr(_deduplicated("rings"))).select(
        "fid", "part", F.expr(f"CASE WHEN {nan} THEN 0 WHEN {few} THEN 1 WHEN {unclosed} THEN 2 WHEN {folded} THEN 3 END").alias("rank")).where("rank IS NOT NULL")


def _frame(df: DataFrame, whole: bool) -> DataFrame:
    """The rings that can be compared, with the box and counts of their group:
    ``fid, grp, part, rings, gtype`` and ``_BOX``.  A group is a part, or with
    ``whole`` a feature (``df``: features with ``geom``)."""
    if whole:
        x = df.where("geom IS NOT NULL").select("fid", F.lit(0).alias("grp"), F.col("geom.type").alias("gtype"), F.expr("transform(geom.coords, p -> " + _deduplicated("p").replace("(r)", "r") + ")").alias("polys"))
    else:
        x = df.select("fid", F.col("part").alias("grp"), "gtype", F.array(F.expr(_deduplicated("rings"))).alias("polys"))
    usable = f"filter(p, r -> size(r) > 1 AND NOT exists(r, q -> {_BAD_POINT}))"
    x = x.withColumn("polys", F.expr(f"transform(polys, p -> {usable})")).where("size(flatten(flatten(polys))) > 0")
    pts = "flatten(flatten(polys))"
    x = x.selectExpr("fid", "grp", "gtype", "polys", *[f"array_{f}(transform({pts}, q -> q.{c})) AS {f}{c}" for f in ("min", "max") for c in "xy"],
                     f"size({pts}) - size(flatten(polys)) AS nedges", "size(flatten(polys)) AS nrings")
    return x.select("fid", "grp", "gtype", *_BOX, F.posexplode("polys").alias("part", "rings")).withColumn("part", F.expr("part" if whole else "grp"))


def edge_contacts(frame: DataFrame, same_ring_only: bool = False) -> DataFrame:
    """Contacts of two edges of one group that aren't neighbours in a ring: both
    sides' part, ring, seq and ends, ``kind`` (``cross``; ``along``: a common
    stretch; ``touch``) and the touch point ``x, y``.  An equi-join on (fid, grp,
    cell) with cells sized per group (about sqrt(edges) cells per side), each edge
    pair kept only in the cell of its boxes' overlap corner."""
    e = S.edges(frame.where("nedges >= 3"), keep=["grp", *_BOX])
    cs = f"greatest(greatest(maxx - minx, maxy - miny) / greatest(ceil(sqrt(nedges / {S.EDGES_PER_SLAB})), 1), 1e-12)"
    e = e.withColumn("cs", F.expr(cs)).select(
        "fid", "grp", "part", "ring", "seq", "x1", "y1", "x2", "y2", "ring_edges", "cs",
        F.expr("least(x1, x2)").alias("ex0"), F.expr("least(y1, y2)").alias("ey0"),
        F.expr("greatest(x1, x2)").alias("ex1"), F.expr("greatest(y1, y2)").alias("ey1"))
    e = (e.withColumn("cx", F.explode(F.expr("sequence(CAST(floor(ex0 / cs) AS BIGINT), CAST(floor(ex1 / cs) AS BIGINT))")))
          .withColumn("cy", F.explode(F.expr("sequence(CAST(floor(ey0 / cs) AS BIGINT), CAST(floor(ey1 / cs) AS BIGINT))"))))
    a = e.select(*[F.col(c).alias(f"a_{c}") for c in e.columns])
    b = e.select(*[F.col(c).alias(f"b_{c}") for c in e.columns])
    same = "a_part = b_part AND a_ring = b_ring AND a_seq < b_seq"
    cond = [a.a_fid == b.b_fid, a.a_grp == b.b_grp, a.a_cx == b.b_cx, a.a_cy == b.b_cy,
            F.expr(same if same_ring_only else f"a_part < b_part OR (a_part = b_part AND a_ring < b_ring) OR ({same})")]
    adjacent = "a_part = b_part AND a_ring = b_ring AND (b_seq = a_seq + 1 OR (a_seq = 0 AND b_seq = a_ring_edges - 1))"
    refcell = ("a_cx = CAST(floor(greatest(a_ex0, b_ex0) / a_cs) AS BIGINT) AND "
               "a_cy = CAST(floor(greatest(a_ey0, b_ey0) / a_cs) AS BIGINT)")
    box = "a_ex0 <= b_ex1 AND b_ex0 <= a_ex1 AND a_ey0 <= b_ey1 AND b_ey0 <= a_ey1"
    j = a.join(S.large(b), cond).where(f"NOT ({adjacent}) AND {refcell} AND {box}")

    def side(p: str, q: str, end: int) -> str:
        return f"sign({G.orientation(f'{p}_x1', f'{p}_y1', f'{p}_x2', f'{p}_y2', f'{q}_x{end}', f'{q}_y{end}')})"

    def on(p: str, q: str, end: int) -> str:
        return f"{q}_x{end} BETWEEN {p}_ex0 AND {p}_ex1 AND {q}_y{end} BETWEEN {p}_ey0 AND {p}_ey1"

    ends = [("a", "b", 1), ("a", "b", 2), ("b", "a", 1), ("b", "a", 2)]
    j = G.held(j, **{f"d{k}": side(*end) for k, end in enumerate(ends, 1)})
    j = j.where("d1 * d2 <= 0 AND d3 * d4 <= 0")
    along = "(d1 = 0 AND d2 = 0 AND (greatest(a_ex0, b_ex0) < least(a_ex1, b_ex1) OR greatest(a_ey0, b_ey0) < least(a_ey1, b_ey1)))"
    kind = f"CASE WHEN d1 * d2 < 0 AND d3 * d4 < 0 THEN 'cross' WHEN {along} THEN 'along' ELSE 'touch' END"
    point = " ".join(f"WHEN d{k} = 0 AND {on(*end)} THEN {end[1]}_{{0}}{end[2]}" for k, end in enumerate(ends, 1))
    return j.select(F.col("a_fid").alias("fid"), F.col("a_grp").alias("grp"), *[f"{s}_{c}" for s in "ab" for c in ("part", "ring", "seq", "x1", "y1", "x2", "y2")], F.expr(kind).alias("kind"),
                    *[F.expr(f"CASE {point.format(c)} END").alias(c) for c in "xy"])


def ring_containment(frame: DataFrame, touches: DataFrame | None) -> DataFrame:
    """How rings lie in others of their group: ``fid, grp, part, ring, in_part,
    in_ring`` and of the ring's test points ``n``, how many are inside (``n_in``) and
    on the boundary (``n_on``).  Holes are compared with the other rings of their
    part, shells (``in_ring`` -1) with the other parts.

    Test points are a vertex of each ring and, where it touches others
    (``touches``, if there are any), the middles of the stretches into which the
    touch points cut its edges.  Points
    meet the group's edges by an equi-join on vertical slabs; a point is inside
    if an odd number of edges lies above it."""
    slabs = f"CAST(least(greatest(nedges div {S.EDGES_PER_SLAB}, 1), {S.MAX_SLABS}) AS INT)"
    some = frame.where(f"nrings > 1 AND {_POLYGONS}").withColumn("k", F.expr(slabs)).withColumn("w", F.expr("greatest((maxx - minx) / k, 1e-300)"))
    slab = "CAST(least(floor(({0} - minx) / w), k - 1) AS INT)"
    keys = ["fid", "grp", "part", "ring"]
    ring = some.select("fid", "grp", "part", "minx", "w", "k", F.posexplode("rings").alias("ring", "pts"))
    points = ring.selectExpr(*keys, "1 AS n", "pts[0].x AS px", "pts[0].y AS py", slab.format("pts[0].x") + " AS slab")
    if touches is not None:
        ends = F.explode(F.array(*[F.struct(*[F.col(f"{s}_{c}").alias(c) for c in ("part", "ring", "seq", "x1", "y1", "x2", "y2")]) for s in "ab"])).alias("e")
        cuts = touches.select("fid", "grp", "x", "y", ends).select("fid", "grp", "x", "y", "e.*")
        cuts = cuts.withColumn("t", F.expr("CASE WHEN abs(x2 - x1) >= abs(y2 - y1) THEN (x - x1) / (x2 - x1) ELSE (y - y1) / (y2 - y1) END"))
        at = cuts.groupBy(*keys, "seq", "x1", "y1", "x2", "y2").agg(F.array_sort(F.array_union(F.collect_set("t"), F.expr("array(0D, 1D)"))).alias("ts"))      # at most the touches of one edge
        middle = at.select(*keys, "x1", "y1", "x2", "y2", F.explode(F.expr("transform(sequence(0, size(ts) - 2), i -> (ts[i] + ts[i + 1]) / 2)")).alias("t")).selectExpr(*keys, "x1 + t * (x2 - x1) AS x", "y1 + t * (y2 - y1) AS y")
        own = ring.selectExpr(*keys, "pts[0].x AS x", "pts[0].y AS y").unionByName(middle).groupBy(*keys).agg(F.collect_set(F.struct("x", "y")).alias("ps"))
        points = own.join(S.large(ring.select(*keys, "minx", "w", "k")), keys).select("*", F.size("ps").alias("n"), F.explode("ps").alias("p")).selectExpr(*keys, "n", "p.x AS px", "p.y AS py", slab.format("p.x") + " AS slab")
    e = S.edges(some, keep=["grp", "minx", "w", "k"]).selectExpr(
        "fid", "grp", "part AS in_part", "ring AS in_ring", "minx", "w", "k", "if(x1 <= x2, x1, x2) AS xl", "if(x1 <= x2, y1, y2) AS yl", "if(x1 <= x2, x2, x1) AS xr", "if(x1 <= x2, y2, y1) AS yr")
    e = e.withColumn("slab", F.explode(F.expr(f"sequence({slab.format('xl')}, {slab.format('xr')})"))).drop("minx", "w", "k")
    met = points.join(S.large(e), ["fid", "grp", "slab"]).where("px BETWEEN xl AND xr AND if(ring > 0, in_part = part AND in_ring <> ring, in_part <> part)")
    met = G.held(met, o=G.orientation("xl", "yl", "xr", "yr", "px", "py"))
    hit = met.selectExpr(*keys, "n", "px", "py", "in_part", "if(ring > 0, in_ring, -1) AS in_ring", "CAST(px < xr AND o < 0 AS INT) AS above",
                         "CAST(o = 0 AND py BETWEEN least(yl, yr) AND greatest(yl, yr) AS INT) AS on")
    # A hole none of whose points has an edge of the shell in its slab still gets its row.
    none = points.where("ring > 0").selectExpr(*keys, "n", "px", "py", "part AS in_part", "0 AS in_ring", "0 AS above", "0 AS on")
    each = hit.unionByName(none).groupBy(*keys, "n", "px", "py", "in_part", "in_ring").agg((F.sum("above") % 2).alias("inside"), F.max("on").alias("on"))
    return each.groupBy(*keys, "n", "in_part", "in_ring").agg(F.sum(F.expr("if(on = 1, 0, inside)")).alias("n_in"), F.sum("on").alias("n_on"))


def _cyclic(met: list[dict]) -> bool:
    """Whether the ring-touch graph of one part has a cycle (``met``: its rings' distinct touch points)."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for m in met:
        a, b = root(m["ring"]), root((m["x"], m["y"]))
        if a == b:
            return True
        parent[a] = b
    return False


def _disconnected(touches: DataFrame) -> DataFrame:
    """``fid, part, rank`` of parts whose rings touch in a circle.  A row holds the
    touches of one part; a circle takes four."""
    ends = F.explode(F.array(*[F.struct(F.col(f"{s}_ring").alias("ring"), "x", "y") for s in "ab"])).alias("m")
    met = touches.where("a_part = b_part").select("fid", F.col("a_part").alias("part"), ends).groupBy("fid", "part").agg(F.collect_set("m").alias("met")).where("size(met) >= 4")
    types = {f.name: f.dataType.simpleString() for f in met.schema.fields}

    def work(batches):
        for b in batches:
            yield b.select(["fid", "part"]).filter(pa.array([_cyclic(m) for m in b.column("met").to_pylist()], pa.bool_()))

    return met.mapInArrow(work, f"fid {types['fid']}, part {types['part']}").withColumn("rank", F.lit(8.0))


def _conflicts(frame: DataFrame) -> DataFrame:
    """``fid, part, whole, rank`` of what is found between edges and rings; ``whole``
    is 1 for what concerns several parts."""
    # Few rows, read three times below.
    contacts = materialize(edge_contacts(frame.where(_POLYGONS)), "edge-contacts")
    crossing = contacts.selectExpr("fid", "a_part AS part", "CAST(a_part <> b_part AS INT) AS whole",
                                   "CASE WHEN kind <> 'touch' THEN 3D WHEN a_part = b_part AND a_ring = b_ring THEN 4D END AS rank").where("rank IS NOT NULL")
    touches = contacts.where("kind = 'touch' AND NOT (a_part = b_part AND a_ring = b_ring)")
    if touches.isEmpty():
        touches = None
    else:
        crossing = crossing.unionByName(_disconnected(touches).selectExpr("fid", "part", "0 AS whole", "rank"))
    r = f"""CASE WHEN in_ring = 0 THEN CASE WHEN n_in + n_on = n THEN NULL WHEN n_in = 0 THEN 5D ELSE {_PARTLY} END
                 WHEN n_in = 0 THEN NULL WHEN n_in + n_on < n THEN {_PARTLY} WHEN in_ring > 0 THEN 6D ELSE 7D END"""
    rings = ring_containment(frame, touches).selectExpr("fid", "part", "CAST(in_part <> part AS INT) AS whole", f"{r} AS rank").where("rank IS NOT NULL")
    return crossing.unionByName(rings)


def _first(issues: DataFrame, *keys: str) -> DataFrame:
    """The reason of each key: what a part has by itself comes before what parts have together."""
    least = issues.groupBy(*keys).agg(F.min(F.struct("whole", "rank")).alias("first"))
    return least.select(*keys, F.expr(f"CAST(CASE WHEN first.rank = {_PARTLY} THEN 3 ELSE first.rank END AS INT)").alias("rank"))


def invalid_parts(parts_df: DataFrame) -> DataFrame:
    """``fid, part, rank`` of invalid polygon parts (lowest rank), each part taken as a polygon of its own."""
    polys = parts_df.where(_POLYGONS)
    issues = ring_issues(polys).selectExpr("fid", "part", "0 AS whole", "CAST(rank AS DOUBLE) AS rank").unionByName(_conflicts(_frame(polys, False)))
    return _first(issues, "fid", "part")


def geometry_valid(features: DataFrame, parts_df: DataFrame | None = None, error_type: str = "GeometryValid",
                   fixed_message: str | None = None, whole_features: bool = True) -> DataFrame:
    """one row per invalid feature with its reason of lowest rank (``REASONS``).

    With ``whole_features`` a feature's parts must also fit each other (crossing
    parts, nested shells); without, each part is judged by itself."""
    parts_df = parts_df if parts_df is not None else S.parts(features)
    polys = parts_df.where(_POLYGONS)
    frame = _frame(features, True) if whole_features else _frame(polys, False)
    issues = ring_issues(polys).selectExpr("fid", "part", "0 AS whole", "CAST(rank AS DOUBLE) AS rank").unionByName(_conflicts(frame))
    inv = _first(issues, "fid")
    msg = F.lit(fixed_message) if fixed_message else F.element_at(F.array(*[F.lit(r) for r in REASONS]), F.col("rank") + 1)
    return violations(inv, error_type, message=msg, metric=F.col("rank").cast("double"))


def not_simple(features: DataFrame, parts_df: DataFrame | None = None) -> DataFrame:
    """F3 NotSimple: linework of a ring crosses or touches itself."""
    parts_df = parts_df if parts_df is not None else S.parts(features)
    return violations(edge_contacts(_frame(parts_df, False), same_ring_only=True).select("fid").distinct(), "NotSimple", message=F.lit("Geometry is not simple."))


def valid_parts(parts_df: DataFrame) -> DataFrame:
    """Parts without validity problems (input to the area kernels).  The invalid
    ones are written as a table, so that what reads the valid ones often stays a short plan."""
    return parts_df.join(S.large(materialize(invalid_parts(parts_df).select("fid", "part"), "invalid-parts")), ["fid", "part"], "left_anti")
