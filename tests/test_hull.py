"""The convex hull as a fold over sorted points."""

import math
import random

from helpers import features, poly

from vectorlint.operators import spatial as S
from vectorlint.operators.feature import convex_hull_area


def _area(points):
    """Gift wrapping on exact integers."""
    points = sorted(set(points))
    start = at = points[0]
    twice = 0
    while True:
        to = points[0] if points[0] != at else points[1]
        for p in points:
            turn = (to[0] - at[0]) * (p[1] - at[1]) - (to[1] - at[1]) * (p[0] - at[0])
            if turn < 0 or (turn == 0 and math.dist(at, p) > math.dist(at, to)):
                to = p
        twice += at[0] * to[1] - at[1] * to[0]
        at = to
        if at == start:
            return twice / 2


def test_hulls(spark):
    rng, rows, want = random.Random(11), [], {}
    for i in range(60):
        n, span = rng.choice([3, 4, 9, 60]), rng.choice([3, 10, 1000])
        points = [(rng.randrange(span) + 321000, rng.randrange(span) + 5812000) for _ in range(n)]
        if len(set(points)) > 1:
            rows.append((i, poly([*points, points[0]])))
            want[i] = _area([(x - 321000, y - 5812000) for x, y in points])
    circle = [(math.cos(k * math.tau / 3000), math.sin(k * math.tau / 3000)) for k in range(3000)]
    rows += [(100, poly([*circle, circle[0]])), (101, poly([(5, 5), (5, 5), (5, 5), (5, 5)])), (102, poly([(0, 0), (1, 1), (2, 2), (0, 0)]))]
    want |= {100: 1500 * math.sin(math.tau / 3000), 101: 0, 102: 0}
    out = convex_hull_area(S.parts(features(spark, rows)))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.fid: r.hull_area for r in out.collect()}
    assert got.keys() == want.keys()
    for i, area in want.items():
        assert abs(got[i] - area) <= 1e-9 * max(1, area), i
