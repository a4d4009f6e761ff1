"""Named quirk tests and rule semantics on small hand-made inputs."""

from pyspark.sql import functions as F

from helpers import features, poly
from vectorlint.operators import attribute as A
from vectorlint.operators import feature as FE
from vectorlint.operators import network as N
from vectorlint.operators import pairs as P
from vectorlint.operators import spatial as S


def _sq(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def test_bowtie_is_invalid_and_not_simple(spark):
    df = features(spark, [(1, poly([(0, 0), (4, 4), (4, 0), (0, 4)])), (2, poly(_sq(0, 0, 4, 4)))])
    p = S.parts(df)
    v = FE.geometry_valid(df, p).collect()
    assert [(r.fid, r.message) for r in v] == [(1, "Self-intersection")]
    assert [r.fid for r in FE.not_simple(df, p).collect()] == [1]


def test_hole_outside_shell_and_unclosed(spark):
    from vectorlint.model import GEOMETRY_DDL
    bad_hole = poly(_sq(0, 0, 4, 4), _sq(10, 10, 11, 11))
    unclosed = {"type": "Polygon", "coords": [[[{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 4.0},
                                                 {"x": 0.0, "y": 4.0}]]]}
    df = spark.createDataFrame([(1, bad_hole), (2, unclosed)], f"fid bigint, geom {GEOMETRY_DDL}").withColumn("srid", F.lit(7855))
    r = {x.fid: x.message for x in FE.geometry_valid(df).collect()}
    assert r == {1: "Hole lies outside shell", 2: "Ring not closed"}


def test_corner_touch_is_short_shared_boundary(spark):
    df = features(spark, [(1, poly(_sq(0, 0, 1, 1))), (2, poly(_sq(1, 1, 2, 2))), (3, poly(_sq(1, 0, 2, 1)))],
                  ).withColumn("suburb", F.concat(F.lit("S"), F.col("fid").cast("string")))
    p = S.parts(df, keep=["suburb"])
    t = {(r.fid, r.other_fid): r.metric for r in P.touching_neighbours(p).collect()}
    assert t[(1, 2)] == 0.0 and t[(1, 3)] == 1.0 and t[(3, 1)] == 1.0
    s = {(r.fid, r.other_fid) for r in P.short_shared_boundary(p, min_len=0.5).collect()}
    assert s == {(1, 2), (2, 1)}


def test_equal_polygons_different_names_enclave_both_ways(spark):
    df = features(spark, [(1, poly(_sq(0, 0, 2, 2))), (2, poly(_sq(0, 0, 2, 2)))]).withColumn(
        "suburb", F.when(F.col("fid") == 1, "A").otherwise("B"))
    p = S.parts(df, keep=["suburb"])
    assert {(r.fid, r.other_fid) for r in P.enclave(p).collect()} == {(1, 2), (2, 1)}


def test_wrong_orientation_fires(spark):
    # the library form of this rule never fires in the reference (NameError
    # swallowed); the working rule flags a clockwise exterior
    df = features(spark, [(1, poly(_sq(0, 0, 2, 2)[::-1])), (2, poly(_sq(0, 0, 2, 2)))])
    assert [r.fid for r in FE.wrong_orientation(S.parts(df)).collect()] == [1]


def test_endpoint_loop_counts_twice(spark):
    from vectorlint.model import GEOMETRY_DDL
    line = lambda x: {"type": "LineString", "coords": [[[{"x": float(x), "y": 0.0}, {"x": float(x) + 1, "y": 0.0}]]]}
    rows = [(1, line(0), "a", "a"), (2, line(10), "b", "c"), (3, line(11), "d", "e"), (4, line(50), None, "z")]
    roads = spark.createDataFrame(rows, f"fid bigint, geom {GEOMETRY_DDL}, start_node_name string, end_node_name string").withColumn("srid", F.lit(3107))
    n1 = sorted(r.fid for r in N.endpoint_isolated(roads).collect())
    assert n1 == [2, 3, 4]        # loop 'a' occurs twice -> not isolated; NULL is a value
    iso = {(r.fid, r.error_type) for r in N.isolation(roads).collect()}
    assert iso == {(2, "EndpointButConnected"), (3, "EndpointButConnected"), (4, "IsolatedRoad")}


def test_value_counts_nulls_and_domain(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "b")], "fid bigint, f string")
    assert sorted(r.fid for r in A.unique_field(df, "f").collect()) == [2, 3]
    assert sorted(r.fid for r in A.attribute_in_domain(df, "f", ["a"]).collect()) == [2, 3, 4]
    assert sorted(r.fid for r in A.attribute_in_domain(df, "f", ["a", None]).collect()) == [4]


def test_invalid_date_uses_try_parse(spark):
    df = spark.createDataFrame([(1, "2011-05-14"), (2, "not a date"), (3, None)], "fid bigint, legalstartdate string")
    assert sorted(r.fid for r in A.invalid_date(df).collect()) == [2, 3]


def test_nonmanifold_counts_repeats(spark):
    df = features(spark, [(1, poly(_sq(0, 0, 1, 1))), (2, poly(_sq(0, 0, 1, 1))), (3, poly(_sq(1, 0, 2, 1))),
                          (4, poly(_sq(5, 5, 6, 6)))])
    bad = sorted(r.fid for r in P.nonmanifold_edge(S.parts(df)).collect())
    assert bad == [1, 2, 3]


def test_near_duplicate_names_match_difflib(spark):
    from vectorlint.operators.names import brute_force, close_pairs
    names = ["Glenelg", "Glenelg North", "Glenelg East", "Glenelg South", "Adelaide", "Adelaid", "Norwood",
             "Norwood South", "Kent Town", "Kenttown", None, "Brighton", "Brigton", "Seacliff", "Seacliff Park"]
    df = spark.createDataFrame([(n,) for n in names], "suburb string")
    got = sorted((r.name_a, r.name_b) for r in close_pairs(df, "suburb").collect())
    assert got == sorted(brute_force(names))


def test_components_on_a_path(spark):
    nodes = spark.range(0, 40).select(F.col("id").alias("fid"))
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 39) if i != 19], "src long, dst long")
    comp = {r.fid: r.component for r in P.connected_components(nodes, edges).collect()}
    assert set(comp[i] for i in range(20)) == {0} and set(comp[i] for i in range(20, 40)) == {20}


def test_topological_gap_found(spark):
    sq = [(i, poly(_sq(x * 2, y * 2, x * 2 + 2, y * 2 + 2))) for i, (x, y) in enumerate(
        [(x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)])]
    p = S.parts(features(spark, sq))
    g = P.topological_gaps(p).collect()
    assert len(g) == 1 and g[0].metric == 4.0 and g[0].metric2 == 4


def test_gap_behind_t_junctions(spark):
    """A gap whose corners lie inside the neighbours' slanted sides, far from the origin."""
    x, y = 321000.1, 5812000.3
    a, b = (x, y), (x + 83.7, y + 41.9)                      # one long seam
    at = lambda t: (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
    up = lambda p, k=1: (p[0] - 20.9 * k, p[1] + 41.8 * k)
    long_low = poly([a, (x + 20, y - 60), (x + 100, y - 20), b])
    rows = [poly([at(s), at(t), up(at(t)), up(at(s))]) for s, t in ((0.0, 0.3), (0.5, 1.0))]
    cap = poly([up(a), up(b), up(b, 2), up(a, 2)])
    p = S.parts(features(spark, list(enumerate([long_low, *rows, cap]))))
    g = P.topological_gaps(p).collect()
    area = abs((b[0] - a[0]) * 41.8 + 20.9 * (b[1] - a[1])) * 0.2
    assert len(g) == 1 and abs(g[0].metric - area) < 1e-6 * area and g[0].metric2 == 4
