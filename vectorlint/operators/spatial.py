"""The spatial pair join and the exact pair kernels.

``parts``          one row per polygon/line part with its bounding box.
``edges``          one row per ring segment (for grouped edge statistics).
``candidate_pairs`` every pair of parts whose (optionally grown) boxes meet,
                   each pair exactly once, as an equi-join on grid cells.
``intersection_area`` exact area of A and B for candidate pairs (signed
                   trapezoid sums over x-overlapping edge pairs).
``boundary_contacts`` whether the boundaries meet, and the length they share.

Design for scale
----------------
* The grid join never falls back to a nested-loop or cartesian join.  A part
  lies on the grid level of its own size (cells of 4^L, at least as wide as
  its box and less than 4 times that), a pair on the grid of the larger part.
  So a state-sized polygon covers a few coarse cells, and a town of small
  parts inside one coarse cell is spread over fine cells of its own: a cell
  holds many parts of its level only where they lie on top of each other.
* Each pair is emitted once without a ``distinct``: a pair is kept only in
  the cell holding the lower-left corner of the two boxes' overlap.
* Edge-pair work inside a pair is also an equi-join: both parts' edges are
  clipped to the pair's common x-range and cut into K vertical slabs (K =
  edges / 16, up to 512), joined on (pair, slab), and a pair of edges is
  kept only in the slab where their x-overlap starts.  Simple shapes use one
  slab; a polygon with thousands of edges never meets all edges of its
  partner, only those of its slab.
* A coarse cell that a third of all parts look into meets only the few large
  parts that lie there; its rows stream past them, and AQE's skew-join
  handling (enabled in ``session.get_spark``) cuts them into several tasks.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorlint.functions import geometry as G

LEVEL_FACTOR = 4        # cell sides of neighbouring grid levels
FINEST_LEVEL = -15      # points, and boxes below 4^-15 units
MAX_SLABS = 512
EDGES_PER_SLAB = 16     # about this many edges of a pair share one slab / cell

PAIR_KEYS = ["a_fid", "a_part", "b_fid", "b_part"]


def large(df: DataFrame) -> DataFrame:
    """Side of an equi-join that grows with the input.  Spark takes the size of
    derived geometry from the few columns it is made of, and would collect rows of
    any number on the driver to broadcast them."""
    return df.hint("merge")


# ----------------------------------------------------------------- parts ----

def parts(features: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per part: ``fid, part, rings, gtype, minx..maxy, nedges`` (+ keep).

    Null/empty geometries produce no rows (they are reported by
    ``geometry_not_empty``)."""
    keep = keep or []
    p = features.where("geom IS NOT NULL").select(
        "fid", *keep, F.col("geom.type").alias("gtype"),
        F.posexplode("geom.coords").alias("part", "rings"))
    pts = "flatten(rings)"
    return p.where(f"size({pts}) > 0").selectExpr(
        "fid", "CAST(part AS INT) AS part", *keep, "gtype", "rings",
        f"array_min(transform({pts}, q -> q.x)) AS minx",
        f"array_min(transform({pts}, q -> q.y)) AS miny",
        f"array_max(transform({pts}, q -> q.x)) AS maxx",
        f"array_max(transform({pts}, q -> q.y)) AS maxy",
        "aggregate(transform(rings, r -> greatest(size(r) - 1, 0)), 0, (a, t) -> a + t) AS nedges",
    )


def part_geom(rings: str = "rings", gtype: str = "gtype") -> str:
    """Wrap a part's rings back into a single-part geometry struct."""
    single = f"CASE WHEN {gtype} = 'MultiPolygon' THEN 'Polygon' WHEN {gtype} = 'MultiLineString' THEN 'LineString' ELSE {gtype} END"
    return f"named_struct('type', {single}, 'coords', array({rings}))"


def edges(parts_df: DataFrame, keep: list[str] | None = None, exterior_only: bool = False) -> DataFrame:
    """One row per segment: ``fid, part, ring, seq, x1, y1, x2, y2`` (+ keep)."""
    keep = keep or []
    r = parts_df.select("fid", "part", *keep, F.posexplode("rings").alias("ring", "pts"))
    if exterior_only:
        r = r.where("ring = 0")
    seg = ("CASE WHEN size(pts) < 2 THEN array() ELSE transform(sequence(0, size(pts) - 2), i -> "
           "named_struct('seq', i, 'x1', pts[i].x, 'y1', pts[i].y, 'x2', pts[i + 1].x, 'y2', pts[i + 1].y)) END")
    e = r.select("fid", "part", *keep, "ring", F.expr("size(pts) - 1").alias("ring_edges"), F.explode(F.expr(seg)).alias("e"))
    return e.select("fid", "part", *keep, F.col("ring").cast("int").alias("ring"), "ring_edges",
                    "e.seq", "e.x1", "e.y1", "e.x2", "e.y2")


# ------------------------------------------------------------ pair join ----

def _side() -> Column:
    return F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))


def cell_size(boxes: DataFrame) -> Column:
    """Twice the median box side, as a scalar subquery."""
    a = boxes.agg(F.percentile_approx(_side(), 0.5, 1000).alias("m"), F.max(_side()).alias("mx"))
    return a.select(F.when(F.col("m") > 0, 2 * F.col("m")).when(F.col("mx") > 0, F.col("mx")).otherwise(F.lit(1.0)).cast("double").alias("cell")).scalar()


def _level(cell: float, eps: float) -> Column:
    """The grid level whose cells are just as wide as a box grown by ``eps``."""
    side = (_side() + 2 * eps) / cell
    return F.when(side > 0, F.greatest(F.lit(FINEST_LEVEL), F.ceil(F.log(float(LEVEL_FACTOR), side) - 1e-12))).otherwise(FINEST_LEVEL).cast("int")


def _key_lt(a: str, b: str) -> Column:
    return (F.col(f"{a}_fid") < F.col(f"{b}_fid")) | (
        (F.col(f"{a}_fid") == F.col(f"{b}_fid")) & (F.col(f"{a}_part") < F.col(f"{b}_part")))


def _cells_at(df: DataFrame, lvl_col: str, cell: float, eps: float) -> DataFrame:
    """Explode each box over the cells of grid level ``lvl_col``."""
    return (df.withColumn("gsize", F.expr(f"{cell!r}D * pow({LEVEL_FACTOR}, {lvl_col})"))
              .withColumn("cx", F.explode(F.expr(f"sequence(CAST(floor((minx - {eps!r}D) / gsize) AS BIGINT), CAST(floor((maxx + {eps!r}D) / gsize) AS BIGINT))")))
              .withColumn("cy", F.explode(F.expr(f"sequence(CAST(floor((miny - {eps!r}D) / gsize) AS BIGINT), CAST(floor((maxy + {eps!r}D) / gsize) AS BIGINT))"))))


def grid(boxes: DataFrame, cell: float | None = None, eps: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(probe, build) rows of boxes on the grid, keyed by ``glvl, cx, cy``: a
    box is built in the cells of its own level ``lvl`` (at most 2 an axis, but
    for rounding) and probes those of its own and of every coarser level that
    some box has."""
    cell = float(cell or 1.0)
    x = boxes.withColumn("lvl", _level(cell, eps))
    # the levels in use (an integer each, bounded by the range of doubles): a scalar subquery
    levels = boxes.select(_level(cell, eps).alias("lvl")).agg(F.collect_set("lvl").alias("levels")).scalar()
    build = _cells_at(x.withColumn("glvl", F.col("lvl")), "glvl", cell, eps)
    probe = _cells_at(x.withColumn("levels", levels).withColumn("glvl", F.explode(F.expr("filter(levels, v -> v >= lvl)"))).drop("levels"),
                      "glvl", cell, eps)
    return probe, build


def candidate_pairs(left: DataFrame, right: DataFrame | None = None, cell: float | None = None,
                    eps: float = 0.0, carry: list[str] | None = None) -> DataFrame:
    """Pairs of parts whose boxes (grown by ``eps`` each side) intersect.

    Self-join (``right`` None): unordered pairs once, ``a`` < ``b`` by
    (fid, part).  Two inputs: every (left, right) pair once, ``a`` from
    ``left``.  Output columns ``a_fid, a_part, a_minx.. a_maxy, b_...`` plus
    ``a_``/``b_`` copies of ``carry`` columns.

    One lazy plan: the levels in use come from a one-row aggregate used as a
    scalar subquery.  Probe meets build on (level, cx, cy), so a pair of a
    small and a huge part is found once, on the huge part's grid, by a single
    equi-join.  ``cell`` (default 1) is the cell side of level 0."""
    self_join = right is None
    carry = carry or []
    cols = ["fid", "part", "minx", "miny", "maxx", "maxy", *carry]
    if self_join:
        tagged = left.select(*cols, F.lit(0).alias("side"))
    else:
        tagged = left.select(*cols, F.lit(0).alias("side")).unionByName(right.select(*cols, F.lit(1).alias("side")))
    probe, build = grid(tagged, cell, eps)
    a = probe.select(*[F.col(c).alias(f"a_{c}") for c in cols], F.col("side").alias("a_side"), F.col("lvl").alias("a_lvl"),
                     "glvl", "gsize", "cx", "cy")
    b = build.select(*[F.col(c).alias(f"b_{c}") for c in cols], F.col("side").alias("b_side"), F.col("lvl").alias("b_lvl"),
                     F.col("glvl").alias("bg"), F.col("cx").alias("bcx"), F.col("cy").alias("bcy"))
    cond = [a.glvl == b.bg, a.cx == b.bcx, a.cy == b.bcy,
            a.a_minx - eps <= b.b_maxx + eps, b.b_minx - eps <= a.a_maxx + eps,
            a.a_miny - eps <= b.b_maxy + eps, b.b_miny - eps <= a.a_maxy + eps]
    j = a.join(large(b), cond).where(
        # reference cell: the one holding the overlap's lower-left corner
        (F.col("cx") == F.floor((F.greatest("a_minx", "b_minx") - eps) / F.col("gsize")))
        & (F.col("cy") == F.floor((F.greatest("a_miny", "b_miny") - eps) / F.col("gsize"))))
    if self_join:
        j = j.where((F.col("a_lvl") < F.col("b_lvl")) | ((F.col("a_lvl") == F.col("b_lvl")) & _key_lt("a", "b")))
        swap = ~_key_lt("a", "b")
    else:
        j = j.where((F.col("a_side") != F.col("b_side")) &
                    ((F.col("a_lvl") < F.col("b_lvl")) | ((F.col("a_lvl") == F.col("b_lvl")) & (F.col("a_side") == 0))))
        swap = F.col("a_side") == 1
    return j.select(*[F.when(swap, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")).alias(f"a_{c}") for c in cols],
                    *[F.when(swap, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(f"b_{c}") for c in cols])


def both_directions(pairs: DataFrame, cols: list[str]) -> DataFrame:
    """Each unordered pair as two ordered rows (a, b) and (b, a)."""
    swapped = pairs.select(*[F.col(f"b_{c}").alias(f"a_{c}") for c in cols],
                           *[F.col(f"a_{c}").alias(f"b_{c}") for c in cols])
    return pairs.select(*[f"a_{c}" for c in cols], *[f"b_{c}" for c in cols]).unionByName(swapped)


# ------------------------------------------------- intersection area (4.3) --

_SLAB_EDGES = """
flatten(transform(
  transform(rings, (r, j) -> named_struct('r', r, 'o', CASE WHEN (j = 0) = ({ring_area} > 0) THEN 1D ELSE -1D END)),
  ro -> CASE WHEN size(ro.r) < 2 THEN array() ELSE
  transform(sequence(0, size(ro.r) - 2), i -> named_struct(
    'x1', ro.r[i].x - ox, 'y1', ro.r[i].y - oy, 'x2', ro.r[i + 1].x - ox, 'y2', ro.r[i + 1].y - oy,
    's', CASE WHEN ro.r[i + 1].x < ro.r[i].x THEN ro.o ELSE -ro.o END)) END))
"""


def _pair_edges(base: DataFrame, side: str) -> DataFrame:
    """Edges of one side of each pair, shifted to the pair origin, clipped to
    the pair's common x-range, exploded over the slabs they cross."""
    ring_area = G.ring_signed_area("r")
    e = base.select(*PAIR_KEYS, "ox", "oy", "ix0", "ix1", "nslab",
                    F.explode(F.expr(_SLAB_EDGES.format(ring_area=ring_area).replace("rings", f"{side}_rings"))).alias("e"))
    e = e.where("e.x1 <> e.x2").select(
        *PAIR_KEYS, "ix0", "ix1", "nslab", "e.*",
        F.expr("greatest(least(e.x1, e.x2), ix0)").alias("lo"),
        F.expr("least(greatest(e.x1, e.x2), ix1)").alias("hi")).where("lo < hi")
    sw = "((ix1 - ix0) / nslab)"
    return e.withColumn("slab", F.explode(F.expr(
        f"sequence(CAST(least(floor((lo - ix0) / {sw}), nslab - 1) AS INT), CAST(least(floor((hi - ix0) / {sw}), nslab - 1) AS INT))")))


def by_size(pairs: DataFrame, parts_df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of few (``SMALL_PAIR``) and of many edge pairs, with their rings.
    Pairs that know their edge counts (``candidate_pairs`` with ``nedges`` carried)
    are parted first, so that each meets the rings once."""
    few, many = f"na * nb <= {SMALL_PAIR}", f"na * nb > {SMALL_PAIR}"
    if "na" not in pairs.columns:
        base = with_rings(pairs, parts_df)
        return base.where(few), base.where(many)
    small, big = (with_rings(pairs.where(c).drop("na", "nb"), parts_df) for c in (few, many))
    return small, big


def edge_counts(pairs: DataFrame) -> list[Column]:
    """Columns ``na, nb`` of pairs that carry their edge counts."""
    return [F.col(f"{s}_nedges").alias(f"n{s}") for s in "ab" if f"{s}_nedges" in pairs.columns]


def with_rings(pairs: DataFrame, parts_df: DataFrame) -> DataFrame:
    """Pairs joined once per side with that side's rings and edge count."""
    pa = parts_df.select(F.col("fid").alias("a_fid"), F.col("part").alias("a_part"),
                         F.col("rings").alias("a_rings"), F.col("nedges").alias("na"))
    pb = parts_df.select(F.col("fid").alias("b_fid"), F.col("part").alias("b_part"),
                         F.col("rings").alias("b_rings"), F.col("nedges").alias("nb"))
    return pairs.join(large(pa), ["a_fid", "a_part"]).join(large(pb), ["b_fid", "b_part"])


SMALL_PAIR = 1024   # na * nb at or below this: exact area computed in-row

_EDGE_ARRAY = """
filter(flatten(transform(
  transform({rings}, (r, j) -> named_struct('r', r, 'o', CASE WHEN (j = 0) = ({ring_area} > 0) THEN 1D ELSE -1D END)),
  ro -> CASE WHEN size(ro.r) < 2 THEN array() ELSE
  transform(sequence(0, size(ro.r) - 2), i -> named_struct(
    'x1', ro.r[i].x - ox, 'y1', ro.r[i].y - oy, 'x2', ro.r[i + 1].x - ox, 'y2', ro.r[i + 1].y - oy,
    's', CASE WHEN ro.r[i + 1].x < ro.r[i].x THEN ro.o ELSE -ro.o END)) END)), e -> e.x1 <> e.x2)
"""

# integral of min(f_a, f_b) over the common x-range of edges ea and eb, the
# intermediate values bound with one-element transforms (lambda "let")
_PAIR_TERM = """
transform(array(named_struct('u', greatest(least(ea.x1, ea.x2), least(eb.x1, eb.x2)),
                             'v', least(greatest(ea.x1, ea.x2), greatest(eb.x1, eb.x2)))), q ->
  CASE WHEN q.u >= q.v THEN 0D ELSE
  transform(array(named_struct(
      'fau', ea.y1 + (q.u - ea.x1) * (ea.y2 - ea.y1) / (ea.x2 - ea.x1),
      'fav', ea.y1 + (q.v - ea.x1) * (ea.y2 - ea.y1) / (ea.x2 - ea.x1),
      'fbu', eb.y1 + (q.u - eb.x1) * (eb.y2 - eb.y1) / (eb.x2 - eb.x1),
      'fbv', eb.y1 + (q.v - eb.x1) * (eb.y2 - eb.y1) / (eb.x2 - eb.x1))), f ->
    transform(array(named_struct('du', f.fau - f.fbu, 'dv', f.fav - f.fbv)), d ->
      CASE WHEN d.du * d.dv < 0 THEN
        transform(array(q.u + (q.v - q.u) * d.du / (d.du - d.dv)), w ->
          transform(array(ea.y1 + (w - ea.x1) * (ea.y2 - ea.y1) / (ea.x2 - ea.x1)), fw ->
            (w - q.u) * (least(f.fau, f.fbu) + fw) / 2 + (q.v - w) * (fw + least(f.fav, f.fbv)) / 2)[0])[0]
      ELSE (q.v - q.u) * (least(f.fau, f.fbu) + least(f.fav, f.fbv)) / 2 END)[0])[0] * ea.s * eb.s END)[0]
"""


def _in_row_area(base: DataFrame) -> DataFrame:
    """Exact area for small pairs, one projection: the edges of both parts
    (shifted to the pair origin) as arrays, summed over all edge pairs."""
    ra = G.ring_signed_area("r")
    ea = _EDGE_ARRAY.format(rings="a_rings", ring_area=ra)
    eb = _EDGE_ARRAY.format(rings="b_rings", ring_area=ra)
    x = base.select(*PAIR_KEYS, F.expr(ea).alias("ea_"), F.expr(eb).alias("eb_"))
    total = ("aggregate(ea_, 0D, (acc, ea) -> acc + aggregate(eb_, 0D, (acc2, eb) -> acc2 + "
             f"{_PAIR_TERM}))")
    return x.select(*PAIR_KEYS, F.expr(total).alias("area"))


def intersection_area(pairs: DataFrame, parts_df: DataFrame) -> DataFrame:
    """``pairs`` (a_/b_ keys and boxes, as from ``candidate_pairs``) ->
    ``a_fid, a_part, b_fid, b_part, area`` for every pair whose boxes overlap
    with positive width and height (others have area 0 and are not listed).
    Rings must be valid (no self-crossing); orientation does not matter.

    Pairs with at most ``SMALL_PAIR`` edge pairs are summed in-row (bounded
    work per row, no shuffle); larger pairs go through the slab join, so a
    polygon with thousands of edges never meets all of its partner's edges."""
    base = pairs.select(
        *PAIR_KEYS, *edge_counts(pairs),
        F.least("a_minx", "b_minx").alias("ox"), F.least("a_miny", "b_miny").alias("oy"),
        (F.greatest("a_minx", "b_minx") - F.least("a_minx", "b_minx")).alias("ix0"),
        (F.least("a_maxx", "b_maxx") - F.least("a_minx", "b_minx")).alias("ix1"),
        F.greatest("a_miny", "b_miny").alias("iy0"), F.least("a_maxy", "b_maxy").alias("iy1"),
    ).where("ix1 > ix0 AND iy1 > iy0")
    return exact_area(*by_size(base, parts_df))


def exact_area(small: DataFrame, big: DataFrame) -> DataFrame:
    """Pair keys and ``area`` of pairs with few and with many edge pairs: their
    rings, edge counts, origin and common x-range (see ``intersection_area``)."""
    small = _in_row_area(small)
    big = big.withColumn(
        "nslab", F.expr(f"CAST(least(greatest((na + nb) div {EDGES_PER_SLAB}, 1), {MAX_SLABS}) AS INT)"))
    ea = _pair_edges(big, "a").select(
        *PAIR_KEYS, "ix0", "slab", "nslab", "ix1",
        *[F.col(c).alias(f"a{c}") for c in ("x1", "y1", "x2", "y2", "s", "lo", "hi")])
    eb = _pair_edges(big, "b").select(
        *PAIR_KEYS, "slab", *[F.col(c).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2", "s", "lo", "hi")])
    j = ea.join(large(eb), [*PAIR_KEYS, "slab"])
    sw = "((ix1 - ix0) / nslab)"
    j = (j.withColumn("u", F.greatest("alo", "blo")).withColumn("v", F.least("ahi", "bhi"))
          .where(F.expr(f"u < v AND slab = CAST(least(floor((u - ix0) / {sw}), nslab - 1) AS INT)")))
    slabs = (trapezoid_sum(j, "ax1", "ay1", "ax2", "ay2", "bx1", "by1", "bx2", "by2", "as", "bs")
             .groupBy(*PAIR_KEYS).agg(F.sum("c").alias("area")))
    return small.unionByName(slabs)


def trapezoid_sum(j: DataFrame, ax1, ay1, ax2, ay2, bx1, by1, bx2, by2, sa, sb) -> DataFrame:
    """Adds ``c`` = sa * sb * integral over [u, v] of min(f_a, f_b), where
    f_a, f_b are the lines through the two (non-vertical) segments.  Staged
    projections keep each generated expression small."""
    j = (j.withColumn("fau", F.expr(f"{ay1} + (u - {ax1}) * ({ay2} - {ay1}) / ({ax2} - {ax1})"))
          .withColumn("fav", F.expr(f"{ay1} + (v - {ax1}) * ({ay2} - {ay1}) / ({ax2} - {ax1})"))
          .withColumn("fbu", F.expr(f"{by1} + (u - {bx1}) * ({by2} - {by1}) / ({bx2} - {bx1})"))
          .withColumn("fbv", F.expr(f"{by1} + (v - {bx1}) * ({by2} - {by1}) / ({bx2} - {bx1})"))
          .withColumn("du", F.expr("fau - fbu")).withColumn("dv", F.expr("fav - fbv"))
          .withColumn("w", F.expr("CASE WHEN du * dv < 0 THEN u + (v - u) * du / (du - dv) ELSE v END"))
          .withColumn("fw", F.expr(f"{ay1} + (w - {ax1}) * ({ay2} - {ay1}) / ({ax2} - {ax1})")))
    integral = ("CASE WHEN du * dv < 0 THEN (w - u) * (least(fau, fbu) + fw) / 2 + (v - w) * (fw + least(fav, fbv)) / 2 "
                "ELSE (v - u) * (least(fau, fbu) + least(fav, fbv)) / 2 END")
    return j.withColumn("c", F.col(sa) * F.col(sb) * F.expr(integral))


def with_area(pairs: DataFrame, parts_df: DataFrame) -> DataFrame:
    """Candidate pairs with their intersection area (0 when none)."""
    ar = intersection_area(pairs, parts_df)
    return pairs.join(large(ar), PAIR_KEYS, "left").withColumn("area", F.coalesce("area", F.lit(0.0)))
