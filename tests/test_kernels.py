"""Hand-worked geometry cases for the column kernels and the pair kernels."""

import math

import pytest
from pyspark.sql import functions as F

from helpers import features, multi, poly
from vectorlint.functions import geometry as G
from vectorlint.operators import spatial as S

L_SHAPE = [(0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10)]
HOLE = [(1, 1), (1, 3), (3, 3), (3, 1)]
STAR = [(5, 0), (6, 4), (10, 4), (7, 6), (8, 10), (5, 7), (2, 10), (3, 6), (0, 4), (4, 4)]
ZPOLY = [(1, 1), (9, 2), (5, 5), (9, 9), (1, 8), (3, 5)]


def _sq(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def _areas(spark, a, b):
    df = features(spark, [(1, a), (2, b)])
    p = S.parts(df)
    pairs = S.candidate_pairs(p, cell=4.0)
    r = S.with_area(pairs, p).collect()
    return r[0]["area"] if r else 0.0


def _self_area(spark, g):
    df = features(spark, [(1, g), (2, g)])
    p = S.parts(df)
    return S.with_area(S.candidate_pairs(p, cell=4.0), p).collect()[0]["area"]


def test_area_holes_subtracted(spark):
    df = features(spark, [(1, poly(L_SHAPE, HOLE)), (2, poly(_sq(0, 0, 2, 2)[::-1]))])
    r = {x.fid: x.a for x in df.select("fid", F.expr(G.geom_area("geom")).alias("a")).collect()}
    assert r[1] == 64 - 4 and r[2] == 4      # L = 100 - 36; CW ring still positive


def test_l_with_hole_against_itself(spark):
    assert _self_area(spark, poly(L_SHAPE, HOLE)) == pytest.approx(60.0)


def test_l_against_square(spark):
    assert _areas(spark, poly(L_SHAPE, HOLE), poly(_sq(2, 2, 8, 8))) == pytest.approx(19.0)


def test_l_touching_square_has_no_area(spark):
    assert _areas(spark, poly(L_SHAPE), poly(_sq(4, 4, 10, 10))) == pytest.approx(0.0, abs=1e-9)


def test_star_against_z(spark):
    assert _areas(spark, poly(STAR), poly(ZPOLY)) == pytest.approx(17.721448, abs=1e-6)


def test_area_symmetry_and_cell_size_invariance(spark):
    df = features(spark, [(1, poly(STAR)), (2, poly(ZPOLY)), (3, poly(_sq(3, 3, 12, 5))), (4, poly(L_SHAPE, HOLE))])
    p = S.parts(df)
    out = []
    for c in (0.5, 2.0, 7.0, 40.0):
        rows = S.with_area(S.candidate_pairs(p, cell=c), p).select("a_fid", "b_fid", F.round("area", 9).alias("a")).collect()
        out.append(sorted(tuple(r) for r in rows))
    assert all(o == out[0] for o in out)
    assert len(out[0]) == 6                     # every pair once, no duplicates


def test_orientation_independent(spark):
    a = _areas(spark, poly(STAR), poly(ZPOLY))
    b = _areas(spark, poly(STAR[::-1]), poly(ZPOLY[::-1]))
    assert a == pytest.approx(b)


def test_multilevel_grid_pairs_exactly_once(spark):
    """One huge polygon and many small ones: the huge one sits on a coarse
    level; every (small, huge) pair is still found exactly once."""
    rows = [(0, poly(_sq(0, 0, 10000, 10000)))]
    rows += [(i, poly(_sq(i * 3, 5, i * 3 + 2, 7))) for i in range(1, 60)]
    rows += [(100, poly(_sq(20000, 20000, 20001, 20001)))]
    p = S.parts(features(spark, rows))
    pairs = S.candidate_pairs(p).select("a_fid", "b_fid").collect()
    keys = [tuple(r) for r in pairs]
    assert len(keys) == len(set(keys))
    assert {k for k in keys if k[0] == 0} == {(0, i) for i in range(1, 60)}
    # small neighbours 1 apart do not touch (gap 1): only huge-small pairs
    assert len(keys) == 59


def test_two_input_pairs(spark):
    left = S.parts(features(spark, [(1, poly(_sq(0, 0, 4, 4))), (2, poly(_sq(10, 10, 12, 12)))]))
    right = S.parts(features(spark, [(7, poly(_sq(3, 3, 11, 11))), (8, poly(_sq(50, 50, 60, 60)))]))
    r = sorted(tuple(x) for x in S.candidate_pairs(left, right).select("a_fid", "b_fid").collect())
    assert r == [(1, 7), (2, 7)]


def test_perimeter_bounds_centroid(spark):
    df = features(spark, [(1, poly(_sq(0, 0, 4, 2))), (2, poly(L_SHAPE))])
    cx, cy = G.centroid_xy("geom")
    b = G.geom_bounds("geom")
    r = {x.fid: x for x in df.select("fid", F.expr(G.geom_length("geom")).alias("p"), F.expr(b["maxx"]).alias("mx"),
                                        F.expr(cx).alias("cx"), F.expr(cy).alias("cy")).collect()}
    assert r[1].p == 12 and r[1].mx == 4 and (r[1].cx, r[1].cy) == (2, 1)
    # L: 10x4 bar (cx 5, cy 2, area 40) + 4x6 arm (cx 2, cy 7, area 24)
    assert r[2].cx == pytest.approx((40 * 5 + 24 * 2) / 64) and r[2].cy == pytest.approx((40 * 2 + 24 * 7) / 64)


def test_point_in_polygon_strict_and_surface_point(spark):
    u = poly([(0, 0), (12, 0), (12, 12), (10, 12), (10, 2), (2, 2), (2, 12), (0, 12)])
    df = features(spark, [(1, u)])
    px, py = G.point_on_surface("geom")
    r = df.select(F.expr(G.point_in_polygon("geom", "6D", "6D")).alias("hollow"),
                  F.expr(G.point_in_polygon("geom", "1D", "6D")).alias("arm"),
                  F.expr(G.point_in_polygon("geom", "0D", "6D")).alias("edge"),
                  F.expr(px).alias("sx"), F.expr(py).alias("sy")).first()
    assert (r.hollow, r.arm, r.edge) == (False, True, False)
    inside = df.select(F.expr(G.point_in_polygon("geom", f"{r.sx}D", f"{r.sy}D"))).first()[0]
    assert inside


def test_interior_angles_skip_vertex_zero(spark):
    spike = poly([(0, 0), (12, 0), (12, 12), (4.25, 12), (4, 1), (3.75, 12), (0, 12)])
    df = features(spark, [(1, spike)])
    angs = df.select(F.expr(G.ring_interior_angles("geom.coords[0][0]")).alias("a")).first().a
    assert len(angs) == 6                        # vertices 1..6, vertex 0 skipped
    assert min(angs) == pytest.approx(math.degrees(2 * math.atan(0.25 / 11)), abs=1e-9)


def test_multipolygon_parts(spark):
    df = features(spark, [(1, multi(poly(_sq(0, 0, 8, 8)), poly(_sq(4, 4, 12, 12))))])
    p = S.parts(df).collect()
    assert [r.part for r in p] == [0, 1]


def test_slab_join_path_matches_in_row_path(spark, monkeypatch):
    """Large pairs go through the slab join; force it and compare."""
    rows = [(1, poly(STAR)), (2, poly(ZPOLY)), (3, poly(L_SHAPE, HOLE)), (4, poly(_sq(2, 2, 8, 8)))]
    p = S.parts(features(spark, rows))
    pairs = S.candidate_pairs(p, cell=4.0)
    in_row = sorted((r.a_fid, r.b_fid, round(r.area, 9)) for r in S.intersection_area(pairs, p).collect())
    monkeypatch.setattr(S, "SMALL_PAIR", 0)
    monkeypatch.setattr(S, "EDGES_PER_SLAB", 2)
    slab = sorted((r.a_fid, r.b_fid, round(r.area, 9)) for r in S.intersection_area(pairs, p).collect())
    assert in_row == slab and any(a == 17.721448 or abs(a - 17.721448) < 1e-6 for _, _, a in slab)
