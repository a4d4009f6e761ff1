"""Contacts along slanted edges whose vertices were rounded."""

import math

import pytest
from pyspark.sql import functions as F

from helpers import features, poly
from vectorlint.functions.projection import reproject
from vectorlint.operators import pairs as P
from vectorlint.operators import spatial as S


def junction(ax, ay, bx, by, up, ts=(0.0, 0.3, 0.77, 1.0)):
    """A polygon below the edge a-b and, above it, polygons that start at points of that edge."""
    nx, ny = -(by - ay), bx - ax
    n = math.hypot(nx, ny)
    nx, ny = nx / n * up, ny / n * up
    at = [(ax + t * (bx - ax), ay + t * (by - ay)) for t in ts]
    shapes = [poly([(ax, ay), (ax - nx, ay - ny), (bx - nx, by - ny), (bx, by)])]
    shapes += [poly([p, q, (q[0] + nx, q[1] + ny), (p[0] + nx, p[1] + ny)]) for p, q in zip(at, at[1:])]
    return shapes


@pytest.mark.parametrize("x, y, size", [(320000.3, 5812345.7, 1.0), (0.1, 0.7, 1.0), (144.9631, -37.8136, 1e-5)])
def test_t_junctions_on_slanted_edges(spark, x, y, size):
    shapes = junction(x, y, x + 83.7 * size, y + 41.9 * size, 30 * size)
    parts = S.parts(features(spark, list(enumerate(shapes))))
    got = {(r.fid, r.other_fid): r.metric for r in P.touching_neighbours(parts).collect()}
    length = math.hypot(83.7 * size, 41.9 * size)
    for k, share in enumerate((0.3, 0.47, 0.23), 1):
        assert abs(got[0, k] - share * length) < 1e-6 * length and got[0, k] == got[k, 0]
    assert {(1, 2), (2, 3)} <= set(got) and (1, 3) not in got
    assert P.short_shared_boundary(parts.withColumn("suburb", F.lit("x")), min_len=0.2 * length).collect() == []
    graph = P.touch_edges(parts)
    assert {r.component for r in P.connected_components(features(spark, list(enumerate(shapes))), graph).collect()} == {0}


def test_reprojected_junction(spark):
    """A projection bends the seam by some tenths of a millimetre; ``snap`` is wider."""
    shapes = junction(144.9631, -37.8136, 144.9638, -37.8133, 3e-4)
    df = features(spark, list(enumerate(shapes))).withColumn("srid", F.lit(4326))
    parts = S.parts(reproject(df, 7855))
    found = P.touching_neighbours(parts, P.relate(parts, snap=0.005)).collect()
    got = {(r.fid, r.other_fid): r.metric for r in found}
    whole = sum(got[0, k] for k in (1, 2, 3))
    assert 60 < whole < 80 and abs(got[0, 1] / whole - 0.3) < 1e-3 and abs(got[0, 3] / whole - 0.23) < 1e-3


def test_near_is_not_on(spark):
    """A millionth of a metre beside the edge is no contact, and across it an overlap."""
    x, y = 320000.0, 5812000.0
    low = poly([(x, y), (x + 100, y + 50), (x + 100, y - 10), (x, y - 10)])
    for d, n in ((1e-6, 0), (0.0, 2)):
        up = poly([(x + 20, y + 10 + d), (x + 60, y + 30 + d), (x + 40, y + 60)])
        assert P.touching_neighbours(S.parts(features(spark, [(1, low), (2, up)]))).count() == n
    up = poly([(x + 20, y + 9.99), (x + 60, y + 29.99), (x + 40, y + 60)])
    parts = S.parts(features(spark, [(1, low), (2, up)]))
    assert P.touching_neighbours(parts).count() == 0 and P.relate(parts).first().area > 0.1
