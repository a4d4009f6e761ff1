"""Pair checks: spatial self-joins between features.

All of them start from ``spatial.candidate_pairs`` (grid-cell equi-join,
every box-meeting pair once) and then run an exact kernel:

* ``spatial.intersection_area``  - shared area (overlaps, enclaves);
* ``pair_contacts``              - do the boundaries meet, how long is the
  shared boundary, how close do they come (touches, shared length,
  misalignment).  Edge pairs are found by an equi-join on (pair, cell)
  with per-pair cells, never by listing all edge pairs of a pair.

Pairs are of *parts* (``a_part``/``b_part``); feature-level relations group
the part pairs by (a_fid, b_fid).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectorlint.functions import geometry as G
from vectorlint.operators import spatial as S
from vectorlint.operators.graph import star_components
from vectorlint.operators.violations import violations

K = S.PAIR_KEYS
#: A shared area counts if it exceeds this share of the smaller part's box: the
#: kernels' rounding noise grows with the boxes (about 1e-17 of them per edge
#: pair), so the same test holds in metres and in degrees.
REL_EPS = 1e-12
#: Share of the largest coordinate within which a point lies on a line: a vertex
#: put on a slanted edge is rounded to a double, which moves it by up to a few
#: parts in 2^53.
ROUNDING = 2.0 ** -50


# -------------------------------------------------------- edge contacts ----

_SEGS = ("flatten(transform({r}, (r, j) -> CASE WHEN size(r) < 2 THEN array() ELSE "
         "transform(sequence(0, size(r) - 2), i -> named_struct('ring', j, 'seq', i, "
         "'x1', r[i].x - ox, 'y1', r[i].y - oy, 'x2', r[i + 1].x - ox, 'y2', r[i + 1].y - oy)) END))")


def _clipped(side: str, eps: float) -> str:
    """Edges of one side (an array) with their grown boxes, clipped to the pair's common box."""
    return (f"filter(transform({_SEGS.format(r=f'{side}_rings')}, e -> named_struct('ring', e.ring, 'seq', e.seq, 'x1', e.x1, 'y1', e.y1, 'x2', e.x2, 'y2', e.y2, "
            f"'cx0', greatest(least(e.x1, e.x2) - {eps!r}D, ix0), 'cy0', greatest(least(e.y1, e.y2) - {eps!r}D, iy0), "
            f"'cx1', least(greatest(e.x1, e.x2) + {eps!r}D, ix1), 'cy1', least(greatest(e.y1, e.y2) + {eps!r}D, iy1))), "
            "e -> e.cx0 <= e.cx1 AND e.cy0 <= e.cy1)")


def _in_row_edge_pairs(base: DataFrame, eps: float) -> DataFrame:
    """Edge pairs of pairs with few edges, without another shuffle."""
    a = base.select(*K, "tol", F.explode(F.expr(_clipped("a", eps))).alias("a"), F.expr(_clipped("b", eps)).alias("bs"))
    meet = "filter(bs, b -> a.cx0 <= b.cx1 AND b.cx0 <= a.cx1 AND a.cy0 <= b.cy1 AND b.cy0 <= a.cy1)"
    return a.select(*K, "tol", "a", F.explode(F.expr(meet)).alias("b")).select(
        *K, "tol", *[F.col(f"{s}.{c}").alias(f"{s}{c}") for s in "ab" for c in ("ring", "seq", "x1", "y1", "x2", "y2")])


def _side_edges(base: DataFrame, side: str, eps: float) -> DataFrame:
    e = base.select(*K, "tol", "ix0", "iy0", "ix1", "iy1", "cs", F.explode(F.expr(_clipped(side, eps))).alias("e")).select(
        *K, "tol", "ix0", "iy0", "ix1", "iy1", "cs", "e.*")
    return (e.withColumn("gx", F.explode(F.expr("sequence(CAST(floor((cx0 - ix0) / cs) AS BIGINT), CAST(floor((cx1 - ix0) / cs) AS BIGINT))")))
             .withColumn("gy", F.explode(F.expr("sequence(CAST(floor((cy0 - iy0) / cs) AS BIGINT), CAST(floor((cy1 - iy0) / cs) AS BIGINT))"))))


_FARTHEST = "greatest(" + ", ".join(f"abs({s}_{c})" for s in "ab" for c in ("minx", "miny", "maxx", "maxy")) + ")"


def edge_pairs(pairs: DataFrame, parts_df: DataFrame, eps: float = 0.0, snap: float = 0.0) -> DataFrame:
    """Edge pairs (one edge of each side of a candidate pair) whose boxes,
    grown by ``eps``, meet inside the pair's common box.  Columns: pair keys,
    ``aring, aseq, ax1..ay2, bring, bseq, bx1..by2``, ``tol`` (the distance at
    which a point counts as lying on a line: rounding of the coordinates, or
    ``snap`` if larger) and the orientation columns.  Pairs with at most
    ``spatial.SMALL_PAIR`` edge pairs are taken apart in their row, others by a
    join on (pair, cell)."""
    base = pairs.select(
        *K, *S.edge_counts(pairs), F.greatest(F.expr(_FARTHEST) * ROUNDING, F.lit(float(snap))).alias("tol"),
        F.lit(0.0).alias("ox"), F.lit(0.0).alias("oy"),
        (F.greatest("a_minx", "b_minx") - eps).alias("ix0"), (F.greatest("a_miny", "b_miny") - eps).alias("iy0"),
        (F.least("a_maxx", "b_maxx") + eps).alias("ix1"), (F.least("a_maxy", "b_maxy") + eps).alias("iy1"))
    small, base = S.by_size(base, parts_df)
    small = _in_row_edge_pairs(small, eps)
    base = base.withColumn(
        "cs", F.expr(f"greatest(greatest(ix1 - ix0, iy1 - iy0) / least(greatest(ceil(sqrt((na + nb) / {S.EDGES_PER_SLAB})), 1), 64), 1e-9)")
    )
    cols = ["ring", "seq", "x1", "y1", "x2", "y2", "cx0", "cy0", "cx1", "cy1"]
    a = _side_edges(base, "a", eps).select(*K, "gx", "gy", "ix0", "iy0", "cs", "tol",
                                           *[F.col(c).alias(f"a{c}") for c in cols])
    b = _side_edges(base, "b", eps).select(*K, "gx", "gy", *[F.col(c).alias(f"b{c}") for c in cols])
    j = a.join(S.large(b), [*K, "gx", "gy"]).where(
        "acx0 <= bcx1 AND bcx0 <= acx1 AND acy0 <= bcy1 AND bcy0 <= acy1 AND "
        "gx = CAST(floor((greatest(acx0, bcx0) - ix0) / cs) AS BIGINT) AND "
        "gy = CAST(floor((greatest(acy0, bcy0) - iy0) / cs) AS BIGINT)")
    j = j.select(*K, "tol", "aring", "aseq", "ax1", "ay1", "ax2", "ay2", "bring", "bseq", "bx1", "by1", "bx2", "by2")
    return with_orientation(small.unionByName(j))


def with_orientation(j: DataFrame) -> DataFrame:
    """Adds ``d1..d4`` (side of each end point against the other segment's line:
    -1, 1, or 0 within ``tol`` of it) and ``sh``, the length of the stretch that
    the segments share."""
    ends = [("a", "b", 1), ("a", "b", 2), ("b", "a", 1), ("b", "a", 2)]
    o = [G.orientation(f"{p}x1", f"{p}y1", f"{p}x2", f"{p}y2", f"{q}x{end}", f"{q}y{end}") for p, q, end in ends]
    t = lambda x, y: f"CASE WHEN la > 0 THEN ((({x}) - ax1) * (ax2 - ax1) + (({y}) - ay1) * (ay2 - ay1)) / la END"
    j = j.withColumn("la", F.expr("hypot(ax2 - ax1, ay2 - ay1)")).withColumn("lb", F.expr("hypot(bx2 - bx1, by2 - by1)"))
    j = G.held(j, **{f"o{k}": x for k, x in enumerate(o, 1)}, t1=t("bx1", "by1"), t2=t("bx2", "by2"))
    j = j.withColumns({f"d{k}": F.expr(f"CASE WHEN abs(o{k}) <= tol * l{p} THEN 0D ELSE sign(o{k}) END") for k, (p, _, _) in enumerate(ends, 1)}).drop("o1", "o2", "o3", "o4")
    # On one line: both ends of the one (the shorter, as a rule) lie on the other's line.
    return j.withColumn("sh", F.expr(
        "CASE WHEN la > 0 AND lb > 0 AND (d1 = 0 AND d2 = 0 OR d3 = 0 AND d4 = 0) THEN greatest(0D, least(greatest(t1, t2), la) - greatest(least(t1, t2), 0D)) ELSE 0D END"))


BOX = ("least(ax1, ax2) <= greatest(bx1, bx2) + tol AND least(bx1, bx2) <= greatest(ax1, ax2) + tol AND "
       "least(ay1, ay2) <= greatest(by1, by2) + tol AND least(by1, by2) <= greatest(ay1, ay2) + tol")
MEET = f"({BOX} AND d1 * d2 <= 0 AND d3 * d4 <= 0)"
CROSS = "(d1 * d2 < 0 AND d3 * d4 < 0)"
SHARED = "sh"


def _pt_seg(px, py, x1, y1, x2, y2) -> str:
    """Distance from a point to a closed segment."""
    l2 = f"(({x2} - {x1}) * ({x2} - {x1}) + ({y2} - {y1}) * ({y2} - {y1}))"
    t = f"greatest(0D, least(1D, (({px} - {x1}) * ({x2} - {x1}) + ({py} - {y1}) * ({y2} - {y1})) / {l2}))"
    return (f"CASE WHEN {l2} = 0 THEN hypot({px} - {x1}, {py} - {y1}) ELSE "
            f"hypot(({px} - {x1}) - {t} * ({x2} - {x1}), ({py} - {y1}) - {t} * ({y2} - {y1})) END")


SEG_DIST = (f"CASE WHEN {MEET} THEN 0D ELSE least({_pt_seg('ax1', 'ay1', 'bx1', 'by1', 'bx2', 'by2')}, "
            f"{_pt_seg('ax2', 'ay2', 'bx1', 'by1', 'bx2', 'by2')}, {_pt_seg('bx1', 'by1', 'ax1', 'ay1', 'ax2', 'ay2')}, "
            f"{_pt_seg('bx2', 'by2', 'ax1', 'ay1', 'ax2', 'ay2')}) END")


def pair_contacts(pairs: DataFrame, parts_df: DataFrame, snap: float = 0.0) -> DataFrame:
    """Per candidate pair with touching boundaries: ``meets`` (true),
    ``crosses`` (some edges cross properly), ``shared_len`` (length of the
    common boundary).  Pairs whose boundaries never meet are absent."""
    ep = edge_pairs(pairs, parts_df, eps=snap / 2, snap=snap).where(MEET)
    return ep.groupBy(*K).agg(
        F.lit(True).alias("meets"),
        F.max(F.expr(f"CAST({CROSS} AS INT)")).cast("boolean").alias("crosses"),
        F.sum(F.expr(SHARED)).alias("shared_len"))


def relate(parts_df: DataFrame, pairs: DataFrame | None = None, cell: float | None = None,
           contacts: bool = True, snap: float = 0.0) -> DataFrame:
    """Candidate part pairs with ``area`` (shared area, 0 up to the rounding
    noise of their boxes and coordinates), ``meets`` (boundaries meet), ``shared_len``; the basis of every overlap / touch rule.  With
    ``contacts=False`` only the area kernel runs (meets/shared_len False/0).
    ``snap``: distance up to which vertices lie on a neighbour's edge, for layers
    whose seams were bent by a projection; slivers as thin as that are no overlap."""
    pairs = pairs if pairs is not None else S.candidate_pairs(parts_df, cell=cell, eps=snap / 2, carry=["nedges"]).persist(StorageLevel.MEMORY_AND_DISK)
    ar = S.intersection_area(pairs, parts_df)
    box = F.least(*[F.expr(f"({s}_maxx - {s}_minx) * ({s}_maxy - {s}_miny)") for s in "ab"])
    rim = F.least(*[F.expr(f"({s}_maxx - {s}_minx) + ({s}_maxy - {s}_miny)") for s in "ab"])
    thin = F.greatest(F.expr(_FARTHEST) * ROUNDING, F.lit(float(snap)))
    out = pairs.select(*K, F.greatest(box * REL_EPS, rim * thin).alias("noise")).join(S.large(ar), K, "left")
    out = out.withColumn("area", F.expr("CASE WHEN area > noise THEN area END")).drop("noise")
    if contacts:
        out = out.join(S.large(pair_contacts(pairs, parts_df, snap)), K, "left")
    else:
        out = out.select("*", F.lit(None).cast("boolean").alias("meets"), F.lit(None).cast("boolean").alias("crosses"),
                         F.lit(None).cast("double").alias("shared_len"))
    return out.select(*K, F.coalesce("area", F.lit(0.0)).alias("area"),
                      F.coalesce("meets", F.lit(False)).alias("meets"),
                      F.coalesce("crosses", F.lit(False)).alias("crosses"),
                      F.coalesce("shared_len", F.lit(0.0)).alias("shared_len"))


def _part_areas(parts_df: DataFrame) -> DataFrame:
    return parts_df.select("fid", "part", F.expr(G.part_area("rings")).alias("parea"))


def _positive(area_col: str = "area") -> str:
    return f"{area_col} > 0"


def feature_relations(rel: DataFrame) -> DataFrame:
    """Part-pair relations rolled up to feature pairs (a_fid < b_fid)."""
    r = rel.where("a_fid <> b_fid")
    return r.groupBy("a_fid", "b_fid").agg(
        F.sum("area").alias("area"), F.max(F.col("meets").cast("int")).cast("boolean").alias("meets"),
        F.sum("shared_len").alias("shared_len"))


def _mirror(df: DataFrame, a: str = "a_fid", b: str = "b_fid", extra: list[tuple[str, str]] | None = None) -> DataFrame:
    """Both directions of each pair row (a, b) and (b, a), the columns of
    ``extra`` swapped as well; each row is doubled where it is, so that what
    made it runs once."""
    swap = {a: b, b: a} | {x: y for p in extra or [] for x, y in (p, p[::-1])}
    if "a_part" in df.columns:
        swap |= {"a_part": "b_part", "b_part": "a_part"}
    ways = [F.struct(*[F.col(w.get(c, c)).alias(c) for c in df.columns]) for w in ({}, swap)]
    return df.select(F.explode(F.array(*ways)).alias("m")).select("m.*")


# ------------------------------------------------------------------ P0 ----

def bbox_candidates(parts_df: DataFrame, cell: float | None = None) -> DataFrame:
    """Candidate pairs whose closed boxes meet, each once."""
    return S.candidate_pairs(parts_df, cell=cell).select(*K)


# ------------------------------------------------------------- overlaps ----

def overlap_suburb(parts_df: DataFrame, rel: DataFrame | None = None, name_col: str = "suburb") -> DataFrame:
    """P1 Overlap: part pairs sharing area > 0; a row for each side, with the
    names swapped on the mirror row (attrs suburb / other_suburb)."""
    rel = rel if rel is not None else relate(parts_df, contacts=False)
    ov = rel.where(_positive())
    names = parts_df.select("fid", "part", F.col(name_col).cast("string").alias("nm"))
    both = _mirror(ov.select(*K, "area"))
    both = (both.join(S.large(names.select(F.col("fid").alias("a_fid"), F.col("part").alias("a_part"), F.col("nm").alias("an"))), ["a_fid", "a_part"], "left")
                .join(S.large(names.select(F.col("fid").alias("b_fid"), F.col("part").alias("b_part"), F.col("nm").alias("bn"))), ["b_fid", "b_part"], "left"))
    return violations(both, "Overlap", fid="a_fid", part="a_part", other_fid="b_fid", other_part="b_part",
                      message=F.lit("Polygon overlaps neighbour"), metric="area",
                      attrs=F.map_from_arrays(F.array(F.lit("suburb"), F.lit("other_suburb")), F.array("an", "bn")))


def overlap_block(parts_df: DataFrame, rel: DataFrame | None = None, min_area: float = 0.0) -> DataFrame:
    """P2 Overlap: overlap area > min_area; both rows; metric = overlap
    area, metric2 = overlap / own area."""
    rel = rel if rel is not None else relate(parts_df, contacts=False)
    ov = rel.where(f"area > greatest({min_area!r}D, 0D)").select(*K, "area")
    both = _mirror(ov)
    pa = _part_areas(parts_df).select(F.col("fid").alias("a_fid"), F.col("part").alias("a_part"), "parea")
    both = both.join(S.large(pa), ["a_fid", "a_part"], "left")
    return violations(both, "Overlap", fid="a_fid", part="a_part", other_fid="b_fid", other_part="b_part",
                      message=F.lit("Overlap"), metric="area", metric2="area / nullif(parea, 0)")


def overlap_floor(parts_df: DataFrame, rel: DataFrame | None = None, swap_ids: bool = False) -> DataFrame:
    """P3 GeometryOverlap: *feature* pairs sharing area > 0, both rows.  The
    mirror row keeps side 1's block id/use unless ``swap_ids``."""
    rel = rel if rel is not None else relate(parts_df, contacts=False)
    fr = feature_relations(rel).where(_positive())
    attrs = parts_df.select("fid", F.col("block_id").cast("string").alias("bid"),
                            F.col("space_use").alias("use")).dropDuplicates(["fid"])
    fwd = fr.select("a_fid", "b_fid", "area",
                    F.col("a_fid").alias("s1"), F.col("b_fid").alias("s2"))
    bwd = fr.select(F.col("b_fid").alias("a_fid"), F.col("a_fid").alias("b_fid"), "area",
                    F.col("b_fid" if swap_ids else "a_fid").alias("s1"), F.col("a_fid" if swap_ids else "b_fid").alias("s2"))
    both = fwd.unionByName(bwd)
    both = (both.join(S.large(attrs.select(F.col("fid").alias("s1"), F.col("bid").alias("bid1"), F.col("use").alias("use1"))), "s1", "left")
                .join(S.large(attrs.select(F.col("fid").alias("s2"), F.col("bid").alias("bid2"), F.col("use").alias("use2"))), "s2", "left"))
    return violations(both, "GeometryOverlap", fid="a_fid", other_fid="b_fid", message=F.lit("Overlaps neighbour"),
                      metric="area",
                      attrs=F.map_from_arrays(F.array(*[F.lit(x) for x in ("block_id", "other_block_id", "block_use", "other_block_use")]),
                                              F.array("bid1", "bid2", "use1", "use2")))


def overlap_building(parts_df: DataFrame, rel: DataFrame | None = None, tol: float = 0.05) -> DataFrame:
    """P4 OverlappingBuildings: one row per part that overlaps others by
    > tol: metric = number of partners, metric2 = summed overlap area,
    attrs.overlaps_with = sorted partner list "fid:part,..."."""
    rel = rel if rel is not None else relate(parts_df, contacts=False)
    ov = _mirror(rel.where(F.col("area") > tol).select(*K, "area"))
    g = ov.groupBy("a_fid", "a_part").agg(
        F.count("*").alias("n"), F.sum("area").alias("total"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b_fid", "b_part"))),
                                 lambda s: F.concat_ws(":", s["b_fid"].cast("string"), s["b_part"].cast("string"))), ",").alias("partners"))
    return violations(g, "OverlappingBuildings", fid="a_fid", part="a_part",
                      message=F.format_string("Overlaps %d feature(s); total overlap area %.3f m^2", "n", "total"),
                      metric="n", metric2="total", attrs=F.create_map(F.lit("overlaps_with"), F.col("partners")))


def intersects_pairs(parts_df: DataFrame, rel: DataFrame | None = None) -> DataFrame:
    """P5: ordered feature pairs (i, j) and (j, i) that intersect (touching
    counts).  Columns ``fid, other_fid``."""
    rel = rel if rel is not None else relate(parts_df)
    fr = feature_relations(rel).where(f"meets OR {_positive()}")
    both = _mirror(fr.select("a_fid", "b_fid"))
    return both.select(F.col("a_fid").alias("fid"), F.col("b_fid").alias("other_fid"))


def interior_overlap_any(parts_df: DataFrame, rel: DataFrame | None = None) -> DataFrame:
    """Features whose interior meets another feature's (not a mere
    touch); once per feature."""
    rel = rel if rel is not None else relate(parts_df, contacts=False)
    fr = feature_relations(rel).where(_positive())
    ids = fr.select(F.col("a_fid").alias("fid")).unionByName(fr.select(F.col("b_fid").alias("fid"))).distinct()
    return violations(ids, "InteriorOverlap", message=F.lit("Intersects another feature beyond touching"))


def touching_neighbours(parts_df: DataFrame, rel: DataFrame | None = None) -> DataFrame:
    """P7 Touches: part pairs whose boundaries meet and interiors do not;
    both rows; metric = shared boundary length (0 for a corner)."""
    rel = rel if rel is not None else relate(parts_df)
    t = rel.where(f"meets AND NOT ({_positive()})").select(*K, "shared_len")
    return violations(_mirror(t), "Touches", fid="a_fid", part="a_part", other_fid="b_fid", other_part="b_part",
                      message=F.lit("Touches neighbour"), metric="shared_len")


def short_shared_boundary(parts_df: DataFrame, rel: DataFrame | None = None, min_len: float = 5.0,
                          name_col: str = "suburb") -> DataFrame:
    """P8 VeryShortSharedBoundary: touching with shared length < min_len (a
    corner touch, length 0, is flagged); both rows, names not swapped."""
    rel = rel if rel is not None else relate(parts_df)
    t = rel.where(f"meets AND NOT ({_positive()}) AND shared_len < {min_len!r}D").select(*K, "shared_len")
    names = parts_df.select("fid", "part", F.col(name_col).cast("string").alias("nm"))
    t = (t.join(S.large(names.select(F.col("fid").alias("a_fid"), F.col("part").alias("a_part"), F.col("nm").alias("an"))), ["a_fid", "a_part"], "left")
          .join(S.large(names.select(F.col("fid").alias("b_fid"), F.col("part").alias("b_part"), F.col("nm").alias("bn"))), ["b_fid", "b_part"], "left"))
    return violations(_mirror(t), "VeryShortSharedBoundary", fid="a_fid", part="a_part", other_fid="b_fid", other_part="b_part",
                      message=F.lit(f"Shared boundary < {min_len} m"), metric="shared_len",
                      attrs=F.map_from_arrays(F.array(F.lit("suburb"), F.lit("other_suburb")), F.array("an", "bn")))


def neighbour_attr_mismatch(parts_df: DataFrame, attrs: tuple[str, ...] = ("state",),
                            rel: DataFrame | None = None) -> DataFrame:
    """P11 NeighbourAttributeMismatch: touching parts whose attribute
    differs (null-safe); one row per side and attribute, values swapped on
    the mirror row.  An absent column compares equal (no rows)."""
    attrs = tuple(a for a in attrs if a in parts_df.columns)
    rel = rel if rel is not None else relate(parts_df)
    t = rel.where(f"meets AND NOT ({_positive()})").select(*K)
    if not attrs:
        return violations(t.limit(0), "NeighbourAttributeMismatch")
    vals = parts_df.select("fid", "part", F.map_from_arrays(
        F.array(*[F.lit(a) for a in attrs]), F.array(*[F.col(a).cast("string") for a in attrs])).alias("m"))
    t = (t.join(S.large(vals.select(F.col("fid").alias("a_fid"), F.col("part").alias("a_part"), F.col("m").alias("ma"))), ["a_fid", "a_part"])
          .join(S.large(vals.select(F.col("fid").alias("b_fid"), F.col("part").alias("b_part"), F.col("m").alias("mb"))), ["b_fid", "b_part"]))
    x = t.select(*K, "ma", "mb", F.explode(F.array(*[F.lit(a) for a in attrs])).alias("attr"))
    x = x.select(*K, "attr", F.col("ma")[F.col("attr")].alias("vi"), F.col("mb")[F.col("attr")].alias("vj"))
    x = x.where(~F.col("vi").eqNullSafe(F.col("vj")))
    return violations(_mirror(x, extra=[("vi", "vj")]), "NeighbourAttributeMismatch", fid="a_fid", part="a_part", other_fid="b_fid",
                      other_part="b_part", message=F.format_string("Attribute '%s' mismatch with neighbour", "attr"),
                      attrs=F.map_from_arrays(F.array(F.lit("attr"), F.lit("val_i"), F.lit("val_j")),
                                              F.array("attr", "vi", "vj")))


def enclave(parts_df: DataFrame, rel: DataFrame | None = None, name_col: str = "suburb") -> DataFrame:
    """P10 Enclave: part a lies within part b (area(a and b) = area(a)) and
    the names differ (null-safe); ordered, so equal parts with different
    names flag both ways."""
    rel = rel if rel is not None else relate(parts_df, contacts=False)
    pa = _part_areas(parts_df).join(S.large(parts_df.select("fid", "part", F.col(name_col).cast("string").alias("nm"))), ["fid", "part"])
    ov = _mirror(rel.where(_positive()).select(*K, "area"))
    j = (ov.join(S.large(pa.select(F.col("fid").alias("a_fid"), F.col("part").alias("a_part"), F.col("parea").alias("aa"), F.col("nm").alias("an"))), ["a_fid", "a_part"])
           .join(S.large(pa.select(F.col("fid").alias("b_fid"), F.col("part").alias("b_part"), F.col("nm").alias("bn"))), ["b_fid", "b_part"]))
    inside = j.where("abs(area - aa) <= 1e-9 * aa AND NOT (an <=> bn)")
    return violations(inside, "Enclave", fid="a_fid", part="a_part", other_fid="b_fid", other_part="b_part",
                      message=F.lit("Polygon is fully inside a different suburb"), metric="area",
                      attrs=F.map_from_arrays(F.array(F.lit("inner_suburb"), F.lit("outer_suburb")), F.array("an", "bn")))


def boundary_misalignment(parts_df: DataFrame, tolerance: float = 0.5, cell: float | None = None) -> DataFrame:
    """P9 BoundaryMisalignment (re-aimed): neighbouring parts of which some
    vertex lies off the other's boundary, yet within ``tolerance`` of it
    (distance in (0, tolerance]); a contact elsewhere hides nothing.  Both
    rows, metric = the smallest such distance."""
    pairs = S.candidate_pairs(parts_df, cell=cell, eps=tolerance / 2, carry=["nedges"]).where("a_fid <> b_fid")
    ep = edge_pairs(pairs, parts_df, eps=tolerance / 2)
    # Every vertex starts one edge of its closed ring; its distance is the least over the partner's near edges.
    sides = F.expr(f"""array(named_struct('side', 'a', 'ring', aring, 'seq', aseq, 'd', {_pt_seg('ax1', 'ay1', 'bx1', 'by1', 'bx2', 'by2')}),
                             named_struct('side', 'b', 'ring', bring, 'seq', bseq, 'd', {_pt_seg('bx1', 'by1', 'ax1', 'ay1', 'ax2', 'ay2')}))""")
    v = ep.select(*K, "tol", F.explode(sides).alias("v")).groupBy(*K, "v.side", "v.ring", "v.seq").agg(F.min("v.d").alias("d"), F.max("tol").alias("tol"))
    bad = v.where(f"d > tol AND d <= {tolerance!r}D").groupBy(*K).agg(F.min("d").alias("d"))
    return violations(_mirror(bad), "BoundaryMisalignment", fid="a_fid", part="a_part", other_fid="b_fid",
                      other_part="b_part", message=F.lit("Suspicious shared boundary alignment"), metric="d")


def overlap_pairs_table(parts_df: DataFrame, rel: DataFrame | None = None) -> DataFrame:
    """Readable list of overlapping feature pairs (row1 < row2) with
    both sides' block id and use, de-duplicated and sorted."""
    rel = rel if rel is not None else relate(parts_df, contacts=False)
    fr = feature_relations(rel).where(_positive()).select(F.col("a_fid").alias("row1"), F.col("b_fid").alias("row2")).distinct()
    at = parts_df.select("fid", "block_id", "space_use").dropDuplicates(["fid"])
    out = (fr.join(S.large(at.select(F.col("fid").alias("row1"), F.col("block_id").alias("block1_id"), F.col("space_use").alias("block1_use"))), "row1", "left")
             .join(S.large(at.select(F.col("fid").alias("row2"), F.col("block_id").alias("block2_id"), F.col("space_use").alias("block2_use"))), "row2", "left"))
    return out.select("row1", "row2", "block1_id", "block1_use", "block2_id", "block2_use").orderBy("row1", "row2")


# ----------------------------------------------------------- duplicates ----

def geometry_key(col: str = "geom") -> F.Column:
    """Order-sensitive canonical key of a geometry (type + coordinates)."""
    return F.sha2(F.to_json(F.col(col)), 256)


def duplicate_geometry(features: DataFrame, error_type: str = "DuplicateGeometry",
                       nulls_equal: bool = True) -> DataFrame:
    """Every member of a group of identical geometries (count > 1).
    With ``nulls_equal`` the null geometries form one group too."""
    f = features.select("fid", geometry_key().alias("k"))
    if not nulls_equal:
        f = f.where("k IS NOT NULL")
    g = f.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    # group counts are one row per distinct key; the join is on the key (no window over a hot key)
    dup = f.join(S.large(g), f.k.eqNullSafe(g.k)).select("fid", "n")
    return violations(dup, error_type, message=F.lit("Exact duplicate geometry"), metric="n")


def duplicate_of_first(features: DataFrame) -> DataFrame:
    """``fid, dup_id`` - dup_id is the smallest fid with the same
    geometry, null for that first one (and for unique geometries)."""
    f = features.where("geom IS NOT NULL").select("fid", geometry_key().alias("k"))
    first = f.groupBy("k").agg(F.min("fid").alias("first"))
    j = f.join(S.large(first), "k")
    return j.select("fid", F.when(F.col("first") != F.col("fid"), F.col("first")).alias("dup_id"))


def nonmanifold_edge(parts_df: DataFrame, include_interiors: bool = False) -> DataFrame:
    """P17 NonManifoldEdge: parts with an undirected edge (exact coordinates)
    used more than twice over all parts.  Grouping by the edge key is a
    hash aggregate with map-side partial counts, so a hot edge costs one
    counter per partition, not one task holding all its rows."""
    e = S.edges(parts_df.where("gtype IN ('Polygon', 'MultiPolygon')"), exterior_only=not include_interiors)
    p1 = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))
    p2 = F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    e = e.select("fid", "part", F.least(p1, p2).alias("p"), F.greatest(p1, p2).alias("q"))
    hot = e.groupBy("p", "q").agg(F.count("*").alias("n")).where("n > 2")
    bad = e.join(S.large(hot), ["p", "q"], "left_semi").select("fid", "part").distinct()
    return violations(bad, "NonManifoldEdge", part="part", message=F.lit("Edge shared by more than two polygons."))


# --------------------------------------------------------------- graphs ----

def touch_edges(parts_df: DataFrame, rel: DataFrame | None = None) -> DataFrame:
    """Feature touch graph edges (a_fid < b_fid): boundaries meet, no shared
    area."""
    rel = rel if rel is not None else relate(parts_df)
    fr = feature_relations(rel)
    return fr.where(f"meets AND NOT ({_positive()})").select(F.col("a_fid").alias("src"), F.col("b_fid").alias("dst"))


def adjacency_graph(features: DataFrame, edges_df: DataFrame) -> DataFrame:
    """One row ``n_nodes, n_edges, avg_degree`` (= 2E / N)."""
    n = features.select(F.count("*").alias("n_nodes"))
    e = n.withColumn("n_edges", edges_df.select(F.count("*")).scalar())
    return e.select("n_nodes", "n_edges", F.round(F.expr("2 * n_edges / nullif(n_nodes, 0)"), 6).alias("avg_degree"))


def connected_components(nodes: DataFrame, edges_df: DataFrame) -> DataFrame:
    """``fid, component`` (component = smallest fid in it).

    Alternating stars (``graph``): a component of any size, or a node with any
    number of neighbours, never falls to one task; nodes without edges are
    components of their own."""
    found = star_components(edges_df.select(F.col("src").alias("a"), F.col("dst").alias("b"))).withColumnRenamed("node", "fid")
    return nodes.select("fid").distinct().join(S.large(found), "fid", "left").select("fid", F.coalesce("label", "fid").alias("component"))


def component_summary(components: DataFrame) -> DataFrame:
    """One row ``n_components, largest_size``."""
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    return sizes.agg(F.count("*").alias("n_components"), F.max("size").alias("largest_size"))


# ----------------------------------------------------------------- gaps ----

def noded(edges: DataFrame) -> DataFrame:
    """Directed edges (p, q: points; x1..y2: their ends in any order) cut at every
    vertex of the layer that lies inside them, up to the rounding of coordinates.

    Vertices meet edges by the grid pair join.  Only edges that are cut are put in
    order along their length; the pieces take the vertices' own coordinates, so
    that they equal the neighbour's edges."""
    from vectorlint.session import materialize
    e = materialize(edges.select("p", "q", F.least("x1", "x2").alias("minx"), F.least("y1", "y2").alias("miny"), F.greatest("x1", "x2").alias("maxx"), F.greatest("y1", "y2").alias("maxy"))
                    .withColumn("fid", F.monotonically_increasing_id()).withColumn("part", F.lit(0)), "coverage-edges")
    v = e.select(F.explode(F.array("p", "q")).alias("v")).distinct()
    v = v.select(F.xxhash64("v.x", "v.y").alias("fid"), F.lit(0).alias("part"), F.col("v.x").alias("minx"), F.col("v.y").alias("miny"), F.col("v.x").alias("maxx"), F.col("v.y").alias("maxy"))
    near = S.candidate_pairs(e.drop("p", "q"), v).select(F.col("a_fid").alias("fid"), F.struct(F.col("b_minx").alias("x"), F.col("b_miny").alias("y")).alias("v"))
    near = near.join(S.large(e.select("fid", "p", "q")), "fid").where("NOT (v.x = p.x AND v.y = p.y) AND NOT (v.x = q.x AND v.y = q.y)")
    near = G.held(near, o=G.orientation("p.x", "p.y", "q.x", "q.y", "v.x", "v.y"))
    near = near.withColumn("length", F.expr("hypot(q.x - p.x, q.y - p.y)")).withColumn("t", F.expr("((v.x - p.x) * (q.x - p.x) + (v.y - p.y) * (q.y - p.y)) / (length * length)"))
    tol = f"{ROUNDING!r}D * greatest(abs(p.x), abs(p.y), abs(q.x), abs(q.y))"
    cuts = materialize(near.where(f"abs(o) <= length * {tol} AND t > 0 AND t < 1").select("fid", "p", "q", "v", "t"), "coverage-cuts")
    whole = e.join(S.large(cuts.select("fid").distinct()), "fid", "left_anti").select("p", "q")
    ends = cuts.select("fid", "p", "q").distinct()
    stops = cuts.select("fid", "v", "t").unionByName(ends.select("fid", F.col("p").alias("v"), F.lit(0.0).alias("t"))).unionByName(ends.select("fid", F.col("q").alias("v"), F.lit(1.0).alias("t")))
    pieces = stops.select(F.col("v").alias("p"), F.lead("v").over(Window.partitionBy("fid").orderBy("t")).alias("q")).where("q IS NOT NULL")
    return whole.unionByName(pieces)


def topological_gaps(parts_df: DataFrame) -> DataFrame:
    """P18 TopologicalGaps (re-aimed): holes in a coverage.  Edges used by
    exactly one part are free boundary, directed with the polygon on their
    left.  Each free edge is followed by the free edge that leaves its end
    point nearest anticlockwise from the way back, so the uncovered area stays on
    the right and rings that only meet in a point stay apart: one ring, one
    face.  A ring of negative signed area bounds a gap.  One row per gap:
    metric = area, metric2 = number of edges, attrs.component = "x,y" of its
    smallest vertex.  Edges are first split at other parts' vertices that lie
    on them (``noded``), so neighbours need not share vertices."""
    e = S.edges(parts_df.where("gtype IN ('Polygon', 'MultiPolygon')"))
    ring_sign = parts_df.select("fid", "part", F.posexplode("rings").alias("ring", "pts")).select(
        "fid", "part", F.col("ring").cast("int").alias("ring"),
        F.expr(f"CASE WHEN (ring = 0) = ({_ring_area('pts')} > 0) THEN 1 ELSE -1 END").alias("o"))
    e = e.join(S.large(ring_sign), ["fid", "part", "ring"])
    # orient every edge as it runs on a CCW exterior / CW hole
    p1 = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))
    p2 = F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    e = noded(e.select("x1", "y1", "x2", "y2", F.when(F.col("o") > 0, p1).otherwise(p2).alias("p"), F.when(F.col("o") > 0, p2).otherwise(p1).alias("q")))
    und = e.select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v"), "p", "q")
    free = und.groupBy("u", "v").agg(F.count("*").alias("n"), F.first("p").alias("p"), F.first("q").alias("q")).where("n = 1")
    free = free.select(F.struct(F.col("p.x").alias("x"), F.col("p.y").alias("y")).alias("p"), F.struct(F.col("q.x").alias("x"), F.col("q.y").alias("y")).alias("q"))
    # The next edge of p->q among those leaving q: the least angle, turning anticlockwise, from q->p.
    leaving = free.select(F.col("p").alias("at"), F.col("q").alias("to"), F.expr("atan2(q.y - p.y, q.x - p.x)").alias("out"))
    turn = F.expr("pmod(out - atan2(p.y - q.y, p.x - q.x), 2 * pi())")
    step = (free.join(S.large(leaving), free.q == leaving["at"]).withColumn("turn", F.when(turn <= 0, 2 * F.pi()).otherwise(turn))
            .groupBy("p", "q").agg(F.min(F.struct("turn", "to")).alias("n")).select("p", "q", F.col("n.to").alias("to")))
    from vectorlint.session import materialize
    edges = materialize(step.withColumn("id", F.monotonically_increasing_id()), "free-edges")
    after = edges.select(F.col("id").alias("dst"), F.col("p").alias("np"), F.col("q").alias("nq"))
    links = edges.join(S.large(after), (edges.q == after["np"]) & (edges["to"] == after["nq"])).select(F.col("id").alias("src"), "dst")
    comp = connected_components(edges.select(F.col("id").alias("fid")), links)
    ring = edges.join(S.large(comp.withColumnRenamed("fid", "id")), "id")
    low = ring.groupBy("component").agg(F.min("p").alias("o"))
    # Coordinates are taken from the ring's smallest vertex, which keeps small gaps far from the origin exact.
    area = ring.join(S.large(low), "component").groupBy("component", "o").agg(
        (F.sum(F.expr("(p.x - o.x) * (q.y - o.y) - (q.x - o.x) * (p.y - o.y)")) / 2).alias("sa"), F.count("*").alias("n_edges"))
    gaps = area.where("sa < 0")
    return violations(gaps, "TopologicalGaps", fid=None, message=F.lit("Potential gaps between polygons"),
                      metric="-sa", metric2="n_edges",
                      attrs=F.create_map(F.lit("component"), F.concat_ws(",", F.col("o.x").cast("string"), F.col("o.y").cast("string"))))


def _ring_area(pts: str) -> str:
    return G.ring_signed_area(pts)
