"""Registered road-network queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectorlint.operators import network as N
from vectorlint.plans import oracle as O
from vectorlint.plans.catalog import _cmp, register, vsel, with_
from vectorlint.session import materialize
from vectorlint.sources import fixtures as FX

_N1 = [FX.roads_sql(), """
nodes AS (SELECT start_node_name AS n FROM b3 UNION ALL SELECT end_node_name FROM b3),
once AS (SELECT n FROM nodes GROUP BY n HAVING count(*) = 1),
cand AS (SELECT * FROM b3 WHERE start_node_name IN (SELECT n FROM once) AND end_node_name IN (SELECT n FROM once))"""]


def _conn(pred: str, grow: float = 0.0) -> str:
    g = grow / 2
    return f"""
conn AS (
  SELECT DISTINCT c.fid FROM cand c JOIN b3 o ON o.fid <> c.fid
   AND least(c.x1, c.x2) - {g} <= greatest(o.x1, o.x2) + {g} AND least(o.x1, o.x2) - {g} <= greatest(c.x1, c.x2) + {g}
   AND least(c.y1, c.y2) - {g} <= greatest(o.y1, o.y2) + {g} AND least(o.y1, o.y2) - {g} <= greatest(c.y1, c.y2) + {g}
  WHERE {pred}
)"""


_STRICT = f"""(
  (sign((c.x2 - c.x1) * (o.y1 - c.y1) - (c.y2 - c.y1) * (o.x1 - c.x1)) * sign((c.x2 - c.x1) * (o.y2 - c.y1) - (c.y2 - c.y1) * (o.x2 - c.x1)) < 0
   AND sign((o.x2 - o.x1) * (c.y1 - o.y1) - (o.y2 - o.y1) * (c.x1 - o.x1)) * sign((o.x2 - o.x1) * (c.y2 - o.y1) - (o.y2 - o.y1) * (c.x2 - o.x1)) < 0)
  OR ((c.x2 - c.x1) * (o.y1 - c.y1) - (c.y2 - c.y1) * (o.x1 - c.x1) = 0
      AND (c.x2 - c.x1) * (o.y2 - c.y1) - (c.y2 - c.y1) * (o.x2 - c.x1) = 0
      AND sqrt((c.x2 - c.x1) * (c.x2 - c.x1) + (c.y2 - c.y1) * (c.y2 - c.y1)) > 0
      AND least(greatest(((o.x1 - c.x1) * (c.x2 - c.x1) + (o.y1 - c.y1) * (c.y2 - c.y1)),
                         ((o.x2 - c.x1) * (c.x2 - c.x1) + (o.y2 - c.y1) * (c.y2 - c.y1))) / sqrt((c.x2 - c.x1) * (c.x2 - c.x1) + (c.y2 - c.y1) * (c.y2 - c.y1)),
                sqrt((c.x2 - c.x1) * (c.x2 - c.x1) + (c.y2 - c.y1) * (c.y2 - c.y1)))
          - greatest(least(((o.x1 - c.x1) * (c.x2 - c.x1) + (o.y1 - c.y1) * (c.y2 - c.y1)),
                           ((o.x2 - c.x1) * (c.x2 - c.x1) + (o.y2 - c.y1) * (c.y2 - c.y1))) / sqrt((c.x2 - c.x1) * (c.x2 - c.x1) + (c.y2 - c.y1) * (c.y2 - c.y1)), 0.0) > 0)
)"""


def _roads(spark, sf):
    return FX.roads(spark, sf)


@register("endpoint_isolated", with_(*_N1) + f"\nSELECT {vsel(et='EndpointIsolated')} FROM cand")
def q_endpoint_isolated(spark, sf):
    """Both end nodes occur once over all starts and ends."""
    return _cmp(N.endpoint_isolated(_roads(spark, sf)))


@register("isolated_road", with_(*_N1, _conn(O.seg_intersect_sql("c", "o"))) +
          f"\nSELECT {vsel(et='IsolatedRoad')} FROM cand WHERE fid NOT IN (SELECT fid FROM conn)")
def q_isolated_road(spark, sf):
    """N1 roads that meet no other road."""
    return _cmp(N.isolation(_roads(spark, sf)).where("error_type = 'IsolatedRoad'"))


@register("endpoint_but_connected", with_(*_N1, _conn(O.seg_intersect_sql("c", "o"))) +
          f"\nSELECT {vsel(et='EndpointButConnected')} FROM cand WHERE fid IN (SELECT fid FROM conn)")
def q_endpoint_but_connected(spark, sf):
    """N1 roads that do meet another road."""
    return _cmp(N.isolation(_roads(spark, sf)).where("error_type = 'EndpointButConnected'"))


@register("isolated_strict", with_(*_N1, _conn(_STRICT)) +
          f"\nSELECT {vsel(et='IsolatedRoad')} FROM cand WHERE fid NOT IN (SELECT fid FROM conn)")
def q_isolated_strict(spark, sf):
    """Connected only by a proper crossing or a shared stretch."""
    return _cmp(N.isolation(_roads(spark, sf), strict=True).where("error_type = 'IsolatedRoad'"))


@register("isolated_buffered", with_(*_N1, _conn(f"{O.seg_dist_sql('c', 'o')} <= 1.5", grow=1.5)) +
          f"\nSELECT {vsel(et='IsolatedRoad')} FROM cand WHERE fid NOT IN (SELECT fid FROM conn)")
def q_isolated_buffered(spark, sf):
    """Roads grown by 1.5 before the test."""
    return _cmp(N.isolation(_roads(spark, sf), buffer_eps=1.5).where("error_type = 'IsolatedRoad'"))


@register("isolated_endpoints", with_(*_N1) + """
SELECT fid, CAST(0 AS INTEGER) AS part, 'start' AS which, x1 AS x, y1 AS y FROM cand
UNION ALL SELECT fid, CAST(0 AS INTEGER), 'end', x2, y2 FROM cand""")
def q_isolated_endpoints(spark, sf):
    """First and last point of each N1 road."""
    return N.isolated_endpoints(_roads(spark, sf))


@register("isolation_summary", with_(*_N1, _conn(O.seg_intersect_sql("c", "o"))) + """
SELECT 'EndpointIsolated' AS error_type, CAST(count(*) AS BIGINT) AS n FROM cand
UNION ALL SELECT 'IsolatedRoad', CAST(count(*) AS BIGINT) FROM cand WHERE fid NOT IN (SELECT fid FROM conn)
UNION ALL SELECT 'EndpointButConnected', CAST(count(*) AS BIGINT) FROM cand WHERE fid IN (SELECT fid FROM conn)""")
def q_isolation_summary(spark, sf):
    """The three counts (R2 run_road is N1 then N2 + N3)."""
    r = _roads(spark, sf)
    c = materialize(N.endpoint_candidates(r), "road-candidates")
    v = N.endpoint_isolated(r, candidates=c).unionByName(N.isolation(r, candidates=c))
    return N.isolation_summary(v)


@register("road_bbox_outlier", with_(FX.roads_sql()) + f"""
SELECT {vsel(et='RoadBBoxOutlier', m='(x1 + x2) / 2', m2='(y1 + y2) / 2')} FROM b3
WHERE NOT ((x1 + x2) / 2 BETWEEN {112 - 5 / 111!r} AND {129 + 5 / 111!r} AND (y1 + y2) / 2 BETWEEN {-36 - 5 / 111!r} AND {-12 + 5 / 111!r})""")
def q_road_bbox_outlier(spark, sf):
    """road centroid outside the padded expected extent."""
    from vectorlint.operators.feature import road_bbox_outlier
    return _cmp(road_bbox_outlier(_roads(spark, sf)))


_TRIANGLE = ((100.3, -20.0), (1500.7, -10.0), (700.1, 60.9))
_LEFT = " AND ".join(f"({bx - ax!r}) * ((y1 + y2) / 2 - ({ay!r})) - ({by - ay!r}) * ((x1 + x2) / 2 - ({ax!r})) > 0"
                     for (ax, ay), (bx, by) in zip(_TRIANGLE, (*_TRIANGLE[1:], _TRIANGLE[0])))


@register("within_bounding_polygon", with_(FX.roads_sql()) + f"SELECT {vsel(et='WithinBoundingPolygon')} FROM b3 WHERE NOT ({_LEFT})")
def q_within_bounding_polygon(spark, sf):
    """road centroids outside one boundary polygon (oracle: half planes)."""
    from vectorlint.operators.feature import within_bounding_polygon
    ring = ", ".join(f"named_struct('x', {x!r}D, 'y', {y!r}D)" for x, y in (*_TRIANGLE, _TRIANGLE[0]))
    boundary = spark.range(1).select(F.expr(f"named_struct('type', 'Polygon', 'coords', array(array(array({ring}))))").alias("geom"))
    return _cmp(within_bounding_polygon(_roads(spark, sf), boundary))


@register("duplicate_road_geometry", with_(FX.roads_sql(), """
grp AS (SELECT x1, y1, x2, y2, count(*) AS n FROM b3 GROUP BY x1, y1, x2, y2 HAVING count(*) > 1)""") +
          f"\nSELECT {vsel(fid='b.fid', et='DuplicateGeometry', m='g.n')} FROM b3 b JOIN grp g ON g.x1 = b.x1 AND g.y1 = b.y1 AND g.x2 = b.x2 AND g.y2 = b.y2")
def q_duplicate_road_geometry(spark, sf):
    """P15 (road form): identical road geometries."""
    from vectorlint.operators.pairs import duplicate_geometry
    return _cmp(duplicate_geometry(_roads(spark, sf)))
