"""Verdicts on coordinates that are not dyadic: long slanted boundaries, degrees, corner contacts."""

import math

import pytest
from helpers import features, multi, poly

from vectorlint.operators import pairs as P
from vectorlint.operators import spatial as S
from vectorlint.plans import runners as RN


def jagged(n, length, x0, y0):
    """A slanted, jagged line of n points."""
    return [(x0 + length * k / (n - 1) + 37.1 * math.sin(3.3 * k), y0 + 0.31 * length * k / (n - 1) + 53.7 * math.cos(1.7 * k)) for k in range(n)]


def test_edge_matched_neighbours_over_300_km(spark):
    line = jagged(400, 300_000.0, 1_234_567.891, 1_765_432.123)
    up = poly(line + [(line[-1][0], line[-1][1] + 80_000.7), (line[0][0], line[0][1] + 80_000.3)])
    down = poly(line[::-1] + [(line[0][0], line[0][1] - 70_000.9), (line[-1][0], line[-1][1] - 70_000.1)])
    parts = S.parts(features(spark, [(1, up), (2, down)]))
    rel = P.relate(parts).collect()
    shared = sum(math.dist(a, b) for a, b in zip(line, line[1:]))
    assert len(rel) == 1 and rel[0].area == 0 and rel[0].meets and rel[0].shared_len == pytest.approx(shared, rel=1e-6)
    assert P.touching_neighbours(parts).count() == 2 and P.overlap_block(parts).count() == 0


def test_small_overlap_in_degrees(spark):
    a = poly([(144.9, -37.8), (144.9011, -37.8), (144.9011, -37.799), (144.9, -37.799)])
    b = poly([(144.9011 - 3e-7, -37.8), (144.902, -37.8), (144.902, -37.7998), (144.9011 - 3e-7, -37.7998)])
    parts = S.parts(features(spark, [(1, a), (2, b)]))
    assert P.overlap_block(parts).count() == 2 and P.touching_neighbours(parts).count() == 0


def cells(spark, missing, n=4):
    return S.parts(features(spark, [(i * n + j, poly([(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)])) for i in range(n) for j in range(n) if (i, j) not in missing]))


@pytest.mark.parametrize("missing, areas", [({(1, 1), (2, 2)}, [1, 1]), ({(1, 1), (1, 2)}, [2]), ({(0, 0), (1, 1)}, [1]), (set(), [])])
def test_gaps_that_meet_in_a_corner(spark, missing, areas):
    assert sorted(r.metric for r in P.topological_gaps(cells(spark, missing)).collect()) == areas


def test_misalignment_beside_a_contact(spark):
    a = poly([(0, 0), (10, 0), (10, 10), (0, 10)])
    b = poly([(10, 0), (20, 0), (20, 10), (10.3, 10)])
    got = P.boundary_misalignment(S.parts(features(spark, [(1, a), (2, b)])), 0.5).collect()
    assert sorted((r.fid, r.other_fid) for r in got) == [(1, 2), (2, 1)] and all(abs(r.metric - 0.3) < 0.01 for r in got)


def test_components_of_a_long_path(spark):
    n = 400
    nodes = spark.range(n).selectExpr("id AS fid")
    got = P.connected_components(nodes, spark.range(n - 1).selectExpr("id AS src", "id + 1 AS dst")).collect()
    assert {r.component for r in got} == {0} and len(got) == n


@pytest.fixture(scope="module")
def degrees(spark):
    from pyspark.sql import functions as F
    a = poly([(145.0, -37.0), (145.01, -37.0), (145.01, -36.99), (145.0, -36.99)])
    b = poly([(145.02, -37.0), (145.03, -37.0), (145.03, -36.99), (145.02, -36.99)])
    return features(spark, [(1, a), (2, b)]).withColumn("srid", F.lit(4326))


@pytest.mark.parametrize("kind, wanted", [("building", set()), ("blocks", set()), ("suburb", {"CRSNotProjected"})])
def test_clean_degrees(spark, degrees, kind, wanted):
    from pyspark.sql import functions as F
    named = degrees.withColumn("suburb", F.concat(F.lit("place "), "fid")).withColumn("state", F.lit("SA"))
    assert {r.error_type for r in RN.validate(named, kind, keep=["suburb", "state"]).collect()} == wanted


def test_wrong_types_raise(spark, degrees):
    with pytest.raises(ValueError):
        RN.validate(degrees, "road")


def test_registry_reads_snapshot_and_appends(spark, tmp_path):
    from vectorlint.plans.registry import RegistryStore
    store = RegistryStore(spark, str(tmp_path))
    assert store.read("t") is None
    store.append("t", spark.range(3))
    store.write("t", spark.range(3))
    store.append("t", spark.range(10, 13))
    store.append("t", spark.range(20, 22), key="batch-7")
    store.append("t", spark.range(20, 23), key="batch-7")
    assert sorted(r.id for r in store.read("t").collect()) == [0, 1, 2, 10, 11, 12, 20, 21, 22]


def test_dates(spark):
    from vectorlint.operators.attribute import invalid_date
    texts = ["06/05/2011", "6 May 2011", "20110506", "2011-05-06", "2011-05-06 10:00:00", "May 6, 2011", "not a date", None, "32/01/2011"]
    df = spark.createDataFrame(list(enumerate(texts)), "fid bigint, legalstartdate string")
    assert sorted(r.fid for r in invalid_date(df).collect()) == [6, 7, 8]


def test_lonlat_columns_go_first_and_latitude_first_texts_are_swapped(spark):
    from vectorlint.sources.ingest import attach_geometry
    both = spark.createDataFrame([("POINT (1 2)", 144.5, -37.5)], "wkt string, longitude double, latitude double")
    p = attach_geometry(both).first().geom.coords[0][0][0]
    assert (p.x, p.y) == (144.5, -37.5)
    text = spark.createDataFrame([("POINT (-37.5 144.5)",), ("POINT (-36.5 145.5)",)], "wkt string")
    assert sorted(r.geom.coords[0][0][0].x for r in attach_geometry(text).collect()) == [144.5, 145.5]
