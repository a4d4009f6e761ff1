"""Road-network isolation checks.

N1 is a node-degree count (hash aggregate over the union of start and end
names) and two semi joins; N2 confirms the candidates geometrically with
one pair join of the candidates against all roads - no per-candidate index
rebuild, no order dependence between the phases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorlint.operators import pairs as P
from vectorlint.operators import spatial as S
from vectorlint.operators.violations import violations
from vectorlint.session import materialize


def endpoint_candidates(roads: DataFrame, start_col: str = "start_node_name",
                        end_col: str = "end_node_name") -> DataFrame:
    """Roads whose start and end node names each occur exactly once over all
    starts and ends (a loop counts its node twice; NULL is a value too)."""
    nodes = roads.select(F.col(start_col).alias("n")).unionAll(roads.select(F.col(end_col).alias("n")))
    once = nodes.groupBy("n").agg(F.count("*").alias("c")).where("c = 1").select("n")
    s = once.select(F.col("n").alias("_s"))
    e = once.select(F.col("n").alias("_e"))
    r = roads.join(S.large(s), roads[start_col].eqNullSafe(s["_s"]), "left_semi")
    return r.join(S.large(e), r[end_col].eqNullSafe(e["_e"]), "left_semi")


def endpoint_isolated(roads: DataFrame, start_col: str = "start_node_name", end_col: str = "end_node_name",
                      candidates: DataFrame | None = None) -> DataFrame:
    """N1 EndpointIsolated (``candidates``: the rows of ``endpoint_candidates``, if there)."""
    c = candidates if candidates is not None else endpoint_candidates(roads, start_col, end_col)
    return violations(c, "EndpointIsolated", message=F.lit("Segment has endpoints that appear only once in the network"),
                      attrs=F.create_map(F.lit("start"), F.col(start_col), F.lit("end"), F.col(end_col)))


def connected_candidates(roads: DataFrame, candidates: DataFrame, strict: bool = False,
                         buffer_eps: float = 0.0, parts_all: DataFrame | None = None) -> DataFrame:
    """Candidate fids that meet some *other* road: intersects (default),
    crosses-or-overlaps (``strict``), or within ``buffer_eps``."""
    pa = parts_all if parts_all is not None else S.parts(roads)
    pc = pa.join(S.large(candidates.select("fid")), "fid", "left_semi")
    half = buffer_eps / 2 if buffer_eps else 0.0
    pairs = S.candidate_pairs(pc, pa, eps=half).where("a_fid <> b_fid")
    ep = P.edge_pairs(pairs, pa, eps=half)
    if buffer_eps:
        hit = ep.where(F.expr(P.SEG_DIST) <= buffer_eps)
    elif strict:
        hit = ep.where(f"{P.CROSS} OR ({P.SHARED}) > 0")
    else:
        hit = ep.where(P.MEET)
    return hit.select(F.col("a_fid").alias("fid")).distinct()


def isolation(roads: DataFrame, strict: bool = False, buffer_eps: float = 0.0,
              start_col: str = "start_node_name", end_col: str = "end_node_name", candidates: DataFrame | None = None) -> DataFrame:
    """N2 IsolatedRoad + N3 EndpointButConnected (N4 ``strict``, N5
    ``buffer_eps``): N1 candidates split by whether they meet another road.
    What they meet is found once and written as a table, for both."""
    cand = candidates if candidates is not None else materialize(endpoint_candidates(roads, start_col, end_col), "road-candidates")
    conn = materialize(connected_candidates(roads, cand, strict=strict, buffer_eps=buffer_eps), "connected-roads")
    attrs = F.create_map(F.lit("start"), F.col(start_col), F.lit("end"), F.col(end_col))
    iso = violations(cand.join(S.large(conn), "fid", "left_anti"), "IsolatedRoad",
                     message=F.lit("Road segment is isolated (no geometric connection to others)"), attrs=attrs)
    ebc = violations(cand.join(S.large(conn), "fid", "left_semi"), "EndpointButConnected",
                     message=F.lit("Endpoint test flagged it, but it intersects other roads"), attrs=attrs)
    return iso.unionByName(ebc)


def isolated_endpoints(roads: DataFrame, start_col: str = "start_node_name", end_col: str = "end_node_name") -> DataFrame:
    """First and last point of each line part of the N1 roads:
    ``fid, part, which, x, y``."""
    c = endpoint_candidates(roads, start_col, end_col)
    p = c.select("fid", F.posexplode("geom.coords").alias("part", "rings")).where("size(rings) > 0 AND size(rings[0]) > 0")
    pts = p.select("fid", "part", F.explode(F.array(
        F.struct(F.lit("start").alias("which"), F.expr("rings[0][0]").alias("pt")),
        F.struct(F.lit("end").alias("which"), F.expr("rings[0][size(rings[0]) - 1]").alias("pt")))).alias("e"))
    return pts.select("fid", F.col("part").cast("int").alias("part"), "e.which", F.col("e.pt.x").alias("x"), F.col("e.pt.y").alias("y"))


def isolation_summary(violations_df: DataFrame) -> DataFrame:
    """Counts of EndpointIsolated / IsolatedRoad / EndpointButConnected."""
    return violations_df.groupBy("error_type").agg(F.count("*").alias("n"))
