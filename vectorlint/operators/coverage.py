"""Area of parts that a layer covers, where the layer's polygons may overlap.

Each part is cut into vertical strips, and these at every edge end and crossing
into slabs in which no two edges cross.  Within a slab the edges lie one above
the other; running sums over them count how many polygons of the layer cover the
space between two neighbours, and whether it belongs to the part.  Space that
several polygons cover so counts once.

Strips are columns of a raster as wide as two typical parts, split further where
many edges meet.  A part meets an edge of the layer only in the columns that they
share, by an equi-join on (polygon, column): a boundary with millions of edges is
never sent whole to each part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectorlint.functions import geometry as G
from vectorlint.operators import spatial as S
from vectorlint.session import materialize

_SEGMENT = ["x1", "y1", "x2", "y2"]


def _directed_edges(parts_df: DataFrame, keep: list[str]) -> DataFrame:
    """Non-vertical edges from left to right; ``d`` is 1 where the polygon lies above, -1 below."""
    r = parts_df.where("gtype IN ('Polygon', 'MultiPolygon')").select("fid", "part", *keep, F.posexplode("rings").alias("ring", "pts"))
    r = r.withColumn("o", F.expr(f"CASE WHEN (ring = 0) = ({G.ring_signed_area('pts')} > 0) THEN 1 ELSE -1 END"))
    seg = "CASE WHEN size(pts) < 2 THEN array() ELSE transform(sequence(0, size(pts) - 2), i -> named_struct('p', pts[i], 'q', pts[i + 1])) END"
    e = r.select("fid", "part", *keep, "o", F.explode(F.expr(seg)).alias("e")).where("e.p.x <> e.q.x")
    return e.selectExpr("fid", "part", *keep, "if(e.p.x < e.q.x, o, -o) AS d", "if(e.p.x < e.q.x, e.p, e.q) AS l", "if(e.p.x < e.q.x, e.q, e.p) AS r").selectExpr(
        "fid", "part", *keep, "d", "l.x AS x1", "l.y AS y1", "r.x AS x2", "r.y AS y2")


def covered_area(parts_df: DataFrame, cover: DataFrame) -> DataFrame:
    """``fid, part, covered``: the part's area within the union of ``cover``'s
    polygons (parts without any are missing).  Rings must be valid; both sides are parts."""
    cell = S.cell_size(parts_df)

    def columns(lo: str, hi: str):
        return F.explode(F.expr(f"sequence(CAST(floor({lo} / cell) AS BIGINT), CAST(floor({hi} / cell) AS BIGINT))"))

    boxes = ["minx", "miny", "maxx", "maxy"]
    own = _directed_edges(parts_df, boxes).withColumn("cell", cell).withColumn("col", columns("x1", "x2")).withColumn("layer", F.lit(0))
    pairs = S.candidate_pairs(parts_df.select("fid", "part", *boxes), cover.select("fid", "part", *boxes))
    met = pairs.select(*S.PAIR_KEYS, *[F.col(f"a_{c}").alias(c) for c in boxes]).withColumn("cell", cell).withColumn("col", columns("minx", "maxx"))
    over = _directed_edges(cover, []).withColumn("cell", cell).withColumn("col", columns("x1", "x2")).drop("cell")
    over = over.withColumnRenamed("fid", "b_fid").withColumnRenamed("part", "b_part")
    # What lies above the part changes nothing below it.
    over = met.join(over, ["b_fid", "b_part", "col"]).where("x1 < maxx AND x2 > minx AND least(y1, y2) < maxy").selectExpr("a_fid AS fid", "a_part AS part", *boxes, "cell", "col", "d", *_SEGMENT, "1 AS layer")
    e = own.unionByName(over.select(*own.columns))
    # From here on relative to the part's lower left corner.
    e = e.selectExpr("fid", "part", "col", "layer", "d", "x1 - minx AS x1", "y1 - miny AS y1", "x2 - minx AS x2", "y2 - miny AS y2",
                     "greatest(col * cell - minx, 0D) AS c0", "least((col + 1) * cell - minx, maxx - minx) AS c1")
    strip = Window.partitionBy("fid", "part", "col")
    e = e.withColumn("lo", F.expr("greatest(x1, c0)")).withColumn("hi", F.expr("least(x2, c1)")).where("lo < hi")
    e = e.withColumn("k", F.least(F.greatest(F.count("*").over(strip) / S.EDGES_PER_SLAB, F.lit(1)), F.lit(S.MAX_SLABS)).cast("int")).withColumn("w", F.expr("(c1 - c0) / k"))
    e = e.withColumn("sub", F.explode(F.expr("sequence(CAST(least(floor((lo - c0) / w), k - 1) AS INT), CAST(least(floor((hi - c0) / w), k - 1) AS INT))")))
    e = e.withColumn("lo", F.expr("greatest(lo, c0 + sub * w)")).withColumn("hi", F.expr("least(hi, if(sub = k - 1, c1, c0 + (sub + 1) * w))")).where("lo < hi")
    keys = ["fid", "part", "col", "sub"]
    e = materialize(e.select(*keys, "layer", "d", *_SEGMENT, "lo", "hi"), "coverage-edges")

    at = lambda s, x: f"({s}y1 + ({x} - {s}x1) * ({s}y2 - {s}y1) / ({s}x2 - {s}x1))"
    line = lambda p: [F.col(c).alias(f"{p}{c}") for c in (*_SEGMENT, "lo", "hi")]
    x = e.select(*keys, *line("a")).join(e.select(*keys, *line("b")), keys).where("struct(ax1, ay1, ax2, ay2) < struct(bx1, by1, bx2, by2) AND greatest(alo, blo) < least(ahi, bhi)")
    x = x.selectExpr(*keys, "greatest(alo, blo) AS u", "least(ahi, bhi) AS v", *[f"a{c}" for c in _SEGMENT], *[f"b{c}" for c in _SEGMENT]).selectExpr(
        *keys, "u", "v", f"{at('a', 'u')} - {at('b', 'u')} AS du", f"{at('a', 'v')} - {at('b', 'v')} AS dv").where("du * dv < 0").selectExpr(*keys, "u + (v - u) * du / (du - dv) AS x")
    cuts = e.select(*keys, F.explode(F.array("lo", "hi")).alias("x")).unionByName(x).distinct()
    slabs = cuts.withColumn("x1", F.lead("x").over(Window.partitionBy(*keys).orderBy("x"))).where("x1 IS NOT NULL").withColumnRenamed("x", "x0")
    inside = slabs.join(e.select(*keys, "layer", "d", *_SEGMENT, "lo", "hi").toDF(*keys, "layer", "d", "ex1", "ey1", "ex2", "ey2", "lo", "hi"), keys).where("lo <= x0 AND hi >= x1")
    inside = inside.selectExpr(*keys, "x0", "x1 - x0 AS w", "layer", "d", f"{at('e', '((x0 + x1) / 2)')} AS y")
    up = Window.partitionBy(*keys, "x0").orderBy("y")
    sums = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    between = inside.select("fid", "part", "w", (F.lead("y").over(up) - F.col("y")).alias("gap"), F.sum(F.expr("if(layer = 0, d, 0)")).over(sums).alias("own"), F.sum(F.expr("if(layer = 1, d, 0)")).over(sums).alias("covers"))
    return between.where("own > 0 AND covers > 0").groupBy("fid", "part").agg(F.sum(F.col("w") * F.col("gap")).alias("covered"))
