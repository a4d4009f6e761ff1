"""Plans and shared steps that must grow with the input, not on the driver or in one group."""

import math

from helpers import features, multi, poly
from pyspark.sql import functions as F

from vectorlint.functions import geometry as G
from vectorlint.operators import feature as FE
from vectorlint.operators import pairs as P
from vectorlint.operators import spatial as S
from vectorlint.operators import validity as V
from vectorlint.plans import runners as RN
from vectorlint.sources import fixtures as FX


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _square(x, y, s=16):
    return poly([(x, y), (x + s, y), (x + s, y + s), (x, y + s)])


def test_parts_are_not_broadcast(spark, sf):
    """Joins of parts and pairs never collect a side on the driver, however small Spark takes it for."""
    p = S.parts(FX.suburbs(spark, sf, "enclave"), keep=["suburb"])
    rel = P.relate(p)
    for df in (rel, P.touching_neighbours(p, rel), P.overlap_suburb(p, rel), P.enclave(p, rel), P.short_shared_boundary(p, rel), P.boundary_misalignment(p)):
        assert "BroadcastExchange" not in _plan(df)


def test_edge_pairs_in_row_and_by_cells_agree(spark, monkeypatch):
    """Pairs of few edges are taken apart in their row; the join by cells finds the same edge pairs."""
    p = S.parts(features(spark, [(1, _square(0, 0)), (2, _square(16, 0)), (3, _square(8, 16)), (4, _square(4, 4, 8)), (5, _square(40.3, 0))]))
    pairs = S.candidate_pairs(p, eps=0.5).cache()
    cols = ["a_fid", "b_fid", "aseq", "bseq", "d1", "d2", "d3", "d4", "sh"]
    in_row = sorted(P.edge_pairs(pairs, p, eps=0.5).select(*cols).collect())
    monkeypatch.setattr(S, "SMALL_PAIR", 0)
    assert in_row and in_row == sorted(P.edge_pairs(pairs, p, eps=0.5).select(*cols).collect())


def test_ring_touch_circles_take_no_python_call_per_part(spark):
    """A part whose hole touches its shell once has no circle, one that touches it twice has."""
    touches = spark.createDataFrame([(1, 0, 0, 0, 1, 0.0, 8.0), (2, 0, 0, 0, 1, 0.0, 8.0), (2, 0, 0, 0, 1, 16.0, 8.0), (2, 0, 0, 0, 1, 16.0, 8.0)],
                                    "fid bigint, a_part int, b_part int, a_ring int, b_ring int, x double, y double")
    found = V._disconnected(touches)
    assert [tuple(r) for r in found.collect()] == [(2, 0, 8.0)]
    assert "FlatMapGroups" not in _plan(found)


def test_centroid_is_computed_once_a_row(spark):
    """The centroid's fold is in the plan of F22 once, not once for every use of its coordinates."""
    line = {"type": "LineString", "coords": [[[{"x": 1.0, "y": 1.0}, {"x": 3.0, "y": 1.0}]]]}
    away = {"type": "LineString", "coords": [[[{"x": 90.0, "y": 1.0}, {"x": 93.0, "y": 1.0}]]]}
    f = features(spark, [(1, line), (2, away), (3, None), (4, multi(_square(1, 1, 2), _square(5, 5, 2)))])
    bad = FE.within_bounding_polygon(f, features(spark, [(0, _square(0, 0))]))
    assert sorted(r.fid for r in bad.collect()) == [2, 3]
    assert _plan(bad).split("Subquery")[0].count("hypot(") <= 8
    x, y = G.centroid_xy("geom")
    assert [tuple(r) for r in f.orderBy("fid").select(F.expr(x), F.expr(y)).collect()] == [(2.0, 1.0), (91.5, 1.0), (None, None), (4.0, 4.0)]


def test_roads_are_compared_once(spark, sf, monkeypatch):
    """A road run finds its candidates and what they meet once; the shaped report does not run it again."""
    from vectorlint.operators import network as N
    from vectorlint.plans import runners as RN
    made = []
    for module in (N, RN):
        monkeypatch.setattr(module, "materialize", lambda df, name, real=module.materialize: made.append(name) or real(df, name))
    v = RN.run_road(FX.roads(spark, sf))
    assert made == ["road-candidates", "connected-roads"]
    assert "BroadcastExchange" not in _plan(v)
    r = RN.report_columns(v.withColumn("nothing", F.lit(None)))
    assert made[2:] == ["report"] and "SortMergeJoin" not in _plan(r)
    assert r.columns[-1] == "nothing" and r.count() == v.count()


def test_pairs_are_parted_before_they_meet_rings(spark):
    """Pairs that carry edge counts: those of one kernel don't run through the other's ring joins; areas stay."""
    wheel = [[(cx + 3 * math.cos(math.pi * k / 20), 3 * math.sin(math.pi * k / 20)) for k in range(40)] for cx in (0, 2)]
    p = S.parts(features(spark, [(1, _square(0, 0, 1)), (2, _square(90, 0, 1)), (3, poly(wheel[0])), (4, poly(wheel[1]))]))
    plain, carried = S.candidate_pairs(p), S.candidate_pairs(p, carry=["nedges"])
    areas = [sorted(map(tuple, S.intersection_area(pairs, p).collect())) for pairs in (plain, carried)]
    assert areas[0] == areas[1] and [a[:3:2] for a in areas[0]] == [(1, 3), (1, 4), (3, 4)]
    pairs = P.relate(p, contacts=False)._jdf.queryExecution().analyzed().toString()
    assert "a_nedges" in pairs      # 40 x 40 edge pairs go to the slab join, 4 x 40 don't
    many = S.by_size(carried.select(*S.PAIR_KEYS, *S.edge_counts(carried)), p)[1]
    assert [tuple(r) for r in many.select(*S.PAIR_KEYS).collect()] == [(3, 0, 4, 0)]


def test_a_run_with_whole_relations_takes_areas_from_them(spark, sf):
    """The suburb run relates its parts once; what the area-only relations would give is in there."""
    ctx = RN.Context(FX.suburbs(spark, sf, "enclave").where("fid % 1000000000 < 150"), keep=["suburb", "postcode", "state"], work_srid=3107)
    rel = ctx.rel
    assert ctx.rel_area is rel and ctx.source_rel_area is rel
    cols = [*S.PAIR_KEYS, "area"]
    assert sorted(rel.select(cols).collect()) == sorted(P.relate(ctx.valid_parts, contacts=False).select(cols).collect())
