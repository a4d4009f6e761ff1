"""Union coverage against known areas and random points."""

import numpy as np

from helpers import features, poly
from vectorlint.operators import feature as FE
from vectorlint.operators import spatial as S
from vectorlint.operators.coverage import covered_area

SQUARE = poly([(0, 0), (10, 0), (10, 10), (0, 10)])


def run(spark, parts, cover):
    a, b = (S.parts(features(spark, list(enumerate(x)))) for x in (parts, cover))
    return {r.fid: r.covered for r in covered_area(a, b).collect()}, sorted(r.fid for r in FE.outside_extent(a, b).collect())


def test_overlapping_extents_count_once(spark):
    """A tenth of the part is bare, though the extents' areas within it sum to more than its own."""
    got, out = run(spark, [SQUARE], [poly([(0, 0), (9, 0), (9, 10), (0, 10)]), poly([(-1, -1), (6, -1), (6, 12), (-1, 12)])])
    assert abs(got[0] - 90) < 1e-9 and out == [0]


def test_slanted_seams(spark):
    """Triangles that overlap or meet along a diagonal, a hole that another extent fills, far from the origin."""
    x, y = 321000.1, 5812000.7
    move = lambda pts: [(x + a, y + b) for a, b in pts]
    part = poly(move([(0, 0), (10, 0), (10, 10), (0, 10)]))
    low, high = move([(0, 0), (12, 0), (0, 12)]), move([(10, 10), (0, 10), (10, 0)])
    assert run(spark, [part], [poly(low), poly(high)])[1] == []
    ring = poly(move([(-5, -5), (15, -5), (15, 15), (-5, 15)]), move([(2, 2), (2, 5), (5, 5), (5, 2)]))
    got, out = run(spark, [part], [ring])
    assert abs(got[0] - 91) < 1e-6 and out == [0]
    assert run(spark, [part], [ring, poly(move([(1, 1), (6, 1), (6, 6), (1, 6)]))])[1] == []
    assert run(spark, [part], [poly(move([(50, 50), (60, 50), (60, 60)]))]) == ({}, [0])


def test_random_polygons(spark):
    r = np.random.default_rng(7)

    def star(cx, cy, size):
        a = np.sort(r.uniform(0, 2 * np.pi, 9))
        d = r.uniform(0.5, 1, 9) * size
        return [(cx + float(k * np.cos(t)), cy + float(k * np.sin(t))) for t, k in zip(a, d)]

    def inside(ring, p):
        q = np.array(ring + ring[:1])
        hit = np.zeros(len(p), int)
        for (x1, y1), (x2, y2) in zip(q, q[1:]):
            if y1 != y2:
                hit += ((y1 > p[:, 1]) != (y2 > p[:, 1])) & (p[:, 0] < x1 + (p[:, 1] - y1) * (x2 - x1) / (y2 - y1))
        return hit % 2 == 1

    parts = [star(10 * i, 0, 6) for i in range(4)]
    cover = [star(float(r.uniform(-5, 35)), float(r.uniform(-4, 4)), 4) for _ in range(14)]
    got, _ = run(spark, [poly(p) for p in parts], [poly(c) for c in cover])
    for i, p in enumerate(parts):
        points = np.column_stack([r.uniform(10 * i - 6, 10 * i + 6, 200_000), r.uniform(-6, 6, 200_000)])
        share = (inside(p, points) & np.any([inside(c, points) for c in cover], axis=0)).mean()
        assert abs(got.get(i, 0) - 144 * share) < 1.0
