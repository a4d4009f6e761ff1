"""Plan shape checks: the pair join never becomes a cartesian product or a
nested-loop join, and filters/columns reach the parquet scan."""

from helpers import SF
from pyspark.sql import functions as F

from vectorlint.operators import spatial as S
from vectorlint.sources import fixtures as FX


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pair_join_is_an_equi_join(spark, sf):
    p = S.parts(FX.blocks(spark, sf))
    plan = _plan(S.candidate_pairs(p))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "HashJoin" in plan or "SortMergeJoin" in plan


def test_area_kernel_has_no_nested_loop(spark, sf):
    p = S.parts(FX.blocks(spark, sf).where("fid % 16 <> 6"))
    plan = _plan(S.intersection_area(S.candidate_pairs(p), p))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_prunes_columns(spark, sf):
    plan = _plan(FX.blocks(spark, sf).select("fid", "p_size"))
    read = plan.split("ReadSchema: struct<")[1].split(">")[0].split(",")
    assert "p_size:int" in read and not any(c.startswith(("p_comment", "p_retailprice", "p_container", "p_mfgr")) for c in read)
    plan2 = _plan(spark.read.parquet(f"{SF}/part.parquet").where("p_size > 10").select("p_partkey"))
    assert "PushedFilters: [IsNotNull(p_size), GreaterThan(p_size,10)]" in plan2
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan2


def _boxes(spark):
    """A sparse state of 1,000 wide parts; 1,000 small ones and 50 points in one of their cells."""
    wide = spark.range(1000).selectExpr("id AS fid", "0 AS part", "id % 40 * 1000D AS minx", "id div 40 * 1000D AS miny", "900D AS w")
    town = spark.range(1000).selectExpr("10000 + id AS fid", "0 AS part", "200 + id % 40 * 0.5D AS minx", "200 + id div 40 * 0.5D AS miny", "0.4D AS w")
    points = spark.range(50).selectExpr("20000 + id AS fid", "0 AS part", "200 + id * 0.3D AS minx", "200 + id * 0.2D AS miny", "0D AS w")
    return wide.unionByName(town).unionByName(points).selectExpr("fid", "part", "minx", "miny", "minx + w AS maxx", "miny + w AS maxy")


def test_dense_town_in_a_sparse_state(spark):
    """Boxes that are compared grow with the parts, not with the square of a town."""
    boxes = _boxes(spark)
    probe, build = S.grid(boxes)
    key = ["glvl", "cx", "cy"]
    probes, builds = probe.groupBy(*key).agg(F.count("*").alias("p")), build.groupBy(*key).agg(F.count("*").alias("b"))
    n = boxes.count()
    assert builds.agg(F.max("b")).first()[0] <= 50
    assert probes.join(builds, key).agg(F.sum(F.col("p") * F.col("b"))).first()[0] <= 60 * n
    assert probe.count() <= 20 * n


def test_levels_find_all_pairs(spark):
    boxes = _boxes(spark)
    rows = boxes.toPandas()
    x0, y0, x1, y1, fid = (rows[c].to_numpy() for c in ("minx", "miny", "maxx", "maxy", "fid"))
    for eps in (0.0, 0.1):
        got = {(r.a_fid, r.b_fid) for r in S.candidate_pairs(boxes, eps=eps).select("a_fid", "b_fid").collect()}
        want = set()
        for i in range(len(rows)):
            hit = (x0[i] - eps <= x1 + eps) & (x0 - eps <= x1[i] + eps) & (y0[i] - eps <= y1 + eps) & (y0 - eps <= y1[i] + eps) & (fid > fid[i])
            want |= {(int(fid[i]), int(j)) for j in fid[hit]}
        assert got == want
