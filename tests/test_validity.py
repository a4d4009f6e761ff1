"""Validity reasons by shape, and exactness of the orientation expression."""

import random
from fractions import Fraction

from pyspark.sql import functions as F

from helpers import features, multi, poly
from vectorlint.functions import geometry as G
from vectorlint.operators import spatial as S
from vectorlint.operators import validity as V


def sq(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


SHAPES = {
    "hole in hole": (poly(sq(0, 0, 10, 10), sq(2, 2, 8, 8), sq(3, 3, 5, 5)), "Nested holes"),
    "hole touches shell once": (poly(sq(0, 0, 10, 10), [(0, 5), (2, 6), (2, 4)]), None),
    "hole touches shell twice": (poly(sq(0, 0, 10, 10), [(0, 5), (5, 6), (10, 5), (5, 4)]), "Interior is disconnected"),
    "three holes touch in a circle": (poly(sq(0, 0, 24, 24), [(4, 8), (8, 12), (12, 8), (8, 4)], [(12, 8), (16, 12), (20, 8), (16, 4)], [(8, 12), (12, 20), (16, 12)]), "Interior is disconnected"),
    "three holes touch in one point": (poly(sq(0, 0, 10, 10), [(5, 5), (6, 8), (4, 8)], [(5, 5), (2, 4), (2, 6)], [(5, 5), (8, 4), (8, 6)]), None),
    "two holes touch once": (poly(sq(0, 0, 10, 10), [(2, 2), (2, 4), (4, 4)], [(4, 4), (6, 4), (6, 6)]), None),
    "shell in shell": (multi(poly(sq(0, 0, 10, 10)), poly(sq(2, 2, 4, 4))), "Nested shells"),
    "shell in shell, touching": (multi(poly(sq(0, 0, 10, 10)), poly([(0, 5), (3, 4), (3, 6)])), "Nested shells"),
    "island in a hole": (multi(poly(sq(0, 0, 10, 10), sq(1, 1, 9, 9)), poly(sq(2, 2, 4, 4))), None),
    "island fills its hole's corner": (multi(poly(sq(0, 0, 10, 10), sq(1, 1, 9, 9)), poly([(1, 1), (4, 3), (3, 4)])), None),
    "crossing parts": (multi(poly(sq(0, 0, 8, 8)), poly(sq(4, 4, 12, 12))), "Self-intersection"),
    "parts share an edge": (multi(poly(sq(0, 0, 4, 4)), poly(sq(4, 0, 8, 4))), "Self-intersection"),
    "parts share a corner": (multi(poly(sq(0, 0, 4, 4)), poly(sq(4, 4, 8, 8))), None),
    "folds back": (poly([(0, 0), (10, 0), (10, 10), (10, 5), (10, 10), (0, 10)]), "Self-intersection"),
    "folds back past its start": (poly([(0, 0), (0, -5), (0, 10), (10, 10), (10, 0)]), "Self-intersection"),
    "repeated point": (poly([(0, 0), (10, 0), (10, 0), (10, 10), (0, 10)]), None),
    "hole outside": (poly(sq(0, 0, 4, 4), sq(10, 10, 11, 11)), "Hole lies outside shell"),
    "hole outside, touching": (poly(sq(0, 0, 4, 4), [(4, 2), (6, 1), (6, 3)]), "Hole lies outside shell"),
    "hole crosses shell": (poly(sq(0, 0, 10, 10), [(-2, 5), (2, 6), (2, 4)]), "Self-intersection"),
    "hole crosses shell through its corners": (poly([(0, 0), (10, 0), (10, 4), (8, 5), (10, 6), (10, 10), (0, 10)], [(6, 5), (10, 4), (12, 5), (10, 6)]), "Self-intersection"),
    "touches itself": (poly([(0, 0), (4, 0), (4, 4), (2, 0), (0, 4)]), "Ring Self-intersection"),
    "infinite": (poly([(0, 0), (float("inf"), 0), (4, 4)]), "Invalid Coordinate"),
}


def test_reasons(spark):
    df = features(spark, [(i, g) for i, (g, _) in enumerate(SHAPES.values())] + [(99, None)])
    got = {r.fid: r.message for r in V.geometry_valid(df).collect()}
    assert {name: got.get(i) for i, name in enumerate(SHAPES)} == {name: reason for name, (_, reason) in SHAPES.items()} and 99 not in got


def test_parts_by_themselves(spark):
    """Parts that don't fit each other are valid parts; with them alone the feature passes."""
    df = features(spark, [(1, multi(poly(sq(0, 0, 8, 8)), poly(sq(4, 4, 12, 12)))), (2, multi(poly(sq(0, 0, 4, 4), sq(9, 9, 10, 10)), poly(sq(20, 20, 24, 24))))])
    parts = S.parts(df)
    assert sorted((r.fid, r.part) for r in V.valid_parts(parts).collect()) == [(1, 0), (1, 1), (2, 1)]
    assert [r.fid for r in V.geometry_valid(df, parts, whole_features=False).collect()] == [2]


def test_many_holes(spark):
    """A part with hundreds of holes, one of them in another, works on slabs."""
    holes = [sq(3 * i + 1, 3 * j + 1, 3 * i + 2.5, 3 * j + 2.5) for i in range(20) for j in range(20)]
    df = features(spark, [(1, poly(sq(0, 0, 61, 61), *holes)), (2, poly(sq(0, 0, 61, 61), *holes, sq(31.2, 31.2, 31.4, 31.4)))])
    assert [(r.fid, r.message) for r in V.geometry_valid(df).collect()] == [(2, "Nested holes")]


def test_orientation(spark):
    """The sign is that of exact arithmetic, far from the origin and almost in line."""
    r, rows = random.Random(1), []
    for _ in range(1500):
        ax, ay = r.uniform(3e5, 4e5), r.uniform(5.8e6, 5.9e6)
        bx, by, t = ax + r.uniform(-100, 100), ay + r.uniform(-100, 100), r.random()
        rows.append((ax, ay, bx, by, ax + t * (bx - ax), ay + t * (by - ay)))
    rows += [(0.0, 0.0, 1.0, 1.0, 0.5, 0.5), (0.1, 0.1, 0.3, 0.3, 0.2, 0.2), (1e6, 1e6, 1e6 + 8, 1e6 + 2, 1e6 + 4, 1e6 + 1), (5.0, 1.0, 5.0, 9.0, 5.0, 4.0)]
    sign = F.expr("CAST(sign(" + G.orientation("a", "b", "c", "d", "e", "f") + ") AS INT)").alias("s")
    for x in spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double").select("*", sign).collect():
        a, b, c, d, e, f = map(Fraction, x[:6])
        exact = (c - a) * (f - b) - (d - b) * (e - a)
        assert x.s == (exact > 0) - (exact < 0)
