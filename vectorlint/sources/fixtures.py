"""Deterministic feature tables derived from the TPC-H-ish test tables.

Every builder returns a Spark DataFrame computed from the given parquet
tables by projection only (no shuffle), and every builder has a DuckDB SQL
twin (``*_sql`` CTE text) used by the oracle queries.  The two are written
independently: Spark assembles nested coordinate arrays in one expression,
the SQL joins a vertex template and works on flat vertex rows.

All coordinates are multiples of 1/16, so areas and axis-aligned lengths
are exact in DOUBLE in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Shape templates of the blocks fixture.  Each point is
# (x_const, x_times_w, y_const, y_times_h), i.e. x = x0 + x_const + x_times_w * w
# and y = y0 + y_const + y_times_h * h.  Shape code = p_partkey % 16, and 16
# for the small triangle used when p_partkey % 32 = 14.  Rings are closed.
_R = [(0, 0, 0, 0), (0, 1, 0, 0), (0, 1, 0, 1), (0, 0, 0, 1), (0, 0, 0, 0)]        # rect CCW


def _box(x1, y1, x2, y2, ccw=True):
    pts = [(x1, 0, y1, 0), (x2, 0, y1, 0), (x2, 0, y2, 0), (x1, 0, y2, 0), (x1, 0, y1, 0)]
    return pts if ccw else pts[::-1]


BLOCK_SHAPES: dict[int, list[list[list[tuple]]]] = {
    0: [[_R]],
    1: [[_R[::-1]]],
    2: [[[(0, 0, 0, 0), (0, 1, 0, 0), (0, 1, 4, 0), (4, 0, 4, 0), (4, 0, 0, 1), (0, 0, 0, 1), (0, 0, 0, 0)]]],
    3: [[_R, _box(4, 4, 6, 6, ccw=False)]],
    4: [[_R, [(2, 0, 2, 0), (2, 0, -2, 1), (-2, 1, -2, 1), (-2, 1, 2, 0), (2, 0, 2, 0)]]],
    5: [[[(0, 0, 0, 0), (0, 1, 0, 0), (0, 1, 0, 1), (4.25, 0, 0, 1), (4, 0, 1, 0), (3.75, 0, 0, 1),
          (0, 0, 0, 1), (0, 0, 0, 0)]]],
    6: [[[(0, 0, 0, 0), (0, 1, 0, 1), (0, 1, 0, 0), (0, 0, 0, 1), (0, 0, 0, 0)]]],
    7: [[_box(0, 0, 8, 8)], [_box(4, 4, 12, 12)]],
    8: [[_R]],
    9: [[_R]],
    10: [[[(0, 0, 0, 0), (0, 1, 0, 0), (0, 1, 0.25, 0), (0, 0, 0.25, 0), (0, 0, 0, 0)]]],
    11: [[[(0, 0, 0, 0), (0, 1, 0, 0), (0, 1, -0.5, 1), (-0.5, 1, 0, 1), (0, 0, 0, 1), (0, 0, 0, 0)]]],
    12: [[[(0, 0, 0, 0), (0, 1, 0, 0), (0, 1, 0, 1), (-2, 1, 0, 1), (-2, 1, 2, 0), (2, 0, 2, 0),
           (2, 0, 0, 1), (0, 0, 0, 1), (0, 0, 0, 0)]]],
    13: [[[(0.0625 + a, b, c, d) for (a, b, c, d) in _R]]],
    14: [[[(0, 0, 0, 0), (0, 1, 0, 0), (0, 0, 0, 1), (0, 0, 0, 0)]]],
    15: [[_box(0, 0, 4, 4)], [_box(8, 8, 12, 12)]],
    16: [[[(0, 0, 0, 0), (1, 0, 0, 0), (0, 0, 1, 0), (0, 0, 0, 0)]]],
}

# Blocks fixture parameters.
BLOCK_SRID = 7855
SUBURB_SRID = 3107
ROAD_SRID = 3107


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from vectorlint.session import spread
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


# ------------------------------------------------------------ B1 blocks ----

def _shape_table(spark: SparkSession) -> DataFrame:
    """The templates as a 17-row table ``(sk, gtype, tpl)`` - a fixed-size
    side for a broadcast hash join on the shape code, instead of a large
    literal expression carried through every optimizer pass."""
    rows = [(code, "MultiPolygon" if len(parts) > 1 else "Polygon",
             [[[tuple(float(v) for v in pt) for pt in ring] for ring in part] for part in parts])
            for code, parts in BLOCK_SHAPES.items()]
    return spark.createDataFrame(
        rows, "sk int, gtype string, tpl array<array<array<struct<xc:double,xw:double,yc:double,yh:double>>>>")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: one polygon feature per part row (null geometry when fid % 64 = 0)."""
    part = _read(spark, sf_dir, "part")
    base = part.select(
        F.col("p_partkey").alias("fid"),
        F.col("p_name").alias("school_name"),
        F.col("p_type"), F.col("p_size"), F.col("p_brand"),
        F.expr("p_partkey % 16").alias("k"),
    ).selectExpr(
        "*",
        "fid - CASE WHEN k = 9 THEN 1 ELSE 0 END AS q",
    ).selectExpr(
        "*",
        "CAST((q % 50) * 16 AS DOUBLE) AS x0",
        "CAST((q div 50) * 16 AS DOUBLE) AS y0",
        "CAST(CASE WHEN k IN (8, 9) THEN 14 ELSE 12 + p_size % 8 END AS DOUBLE) AS w",
        "CAST(CASE WHEN k IN (8, 9) THEN 13 ELSE 12 + (fid * 7) % 6 END AS DOUBLE) AS h",
        "CASE WHEN k = 14 AND fid % 32 = 14 THEN 16 ELSE k END AS sk",
    )
    shaped = base.join(F.broadcast(_shape_table(spark)), "sk")     # 17 template rows
    coords = ("transform(tpl, pp -> transform(pp, rr -> transform(rr, q -> "
              "named_struct('x', x0 + q.xc + q.xw * w, 'y', y0 + q.yc + q.yh * h))))")
    return shaped.select(
        "fid", "school_name", "p_type", "p_size", "p_brand",
        F.lit(BLOCK_SRID).alias("srid"),
        F.expr(f"CASE WHEN fid % 64 = 0 THEN NULL ELSE named_struct('type', gtype, 'coords', {coords}) END").alias("geom"),
    )


def _shape_values_sql() -> str:
    rows = []
    for code, parts in BLOCK_SHAPES.items():
        for pi, part in enumerate(parts):
            for ri, ring in enumerate(part):
                for si, (a, b, c, d) in enumerate(ring):
                    rows.append(f"({code}, {pi}, {ri}, {si}, {float(a)}, {float(b)}, {float(c)}, {float(d)})")
    return ",\n    ".join(rows)


def blocks_sql() -> str:
    """CTEs ``b1_feat(fid, school_name, p_type, p_size, p_brand, srid, gtype, has_geom)``
    and ``b1_v(fid, part, ring, seq, x, y)`` (vertices, rings closed)."""
    return f"""
b1_base AS (
  SELECT p_partkey AS fid, p_name AS school_name, p_type, p_size, p_brand, p_partkey % 16 AS k,
         p_partkey - CASE WHEN p_partkey % 16 = 9 THEN 1 ELSE 0 END AS q
  FROM part
),
b1_dim AS (
  SELECT *, CAST((q % 50) * 16 AS DOUBLE) AS x0, CAST((q // 50) * 16 AS DOUBLE) AS y0,
         CAST(CASE WHEN k IN (8, 9) THEN 14 ELSE 12 + p_size % 8 END AS DOUBLE) AS w,
         CAST(CASE WHEN k IN (8, 9) THEN 13 ELSE 12 + (fid * 7) % 6 END AS DOUBLE) AS h,
         CASE WHEN k = 14 AND fid % 32 = 14 THEN 16 ELSE k END AS sk
  FROM b1_base
),
b1_tpl(sk, part, ring, seq, xc, xw, yc, yh) AS (VALUES
    {_shape_values_sql()}
),
b1_feat AS (
  SELECT fid, school_name, p_type, p_size, p_brand, {BLOCK_SRID} AS srid,
         CASE WHEN fid % 64 = 0 THEN NULL WHEN k IN (7, 15) THEN 'MultiPolygon' ELSE 'Polygon' END AS gtype,
         fid % 64 <> 0 AS has_geom, k
  FROM b1_dim
),
b1_v AS (
  SELECT d.fid, t.part, t.ring, t.seq, d.x0 + t.xc + t.xw * d.w AS x, d.y0 + t.yc + t.yh * d.h AS y
  FROM b1_dim d JOIN b1_tpl t ON d.sk = t.sk
  WHERE d.fid % 64 <> 0
)"""


# ----------------------------------------------------------- B2 suburbs ----

def _square(x: str, y: str, s: str) -> str:
    return (f"named_struct('type', 'Polygon', 'coords', array(array(array("
            f"named_struct('x', {x}, 'y', {y}), named_struct('x', {x} + {s}, 'y', {y}), "
            f"named_struct('x', {x} + {s}, 'y', {y} + {s}), named_struct('x', {x}, 'y', {y} + {s}), "
            f"named_struct('x', {x}, 'y', {y})))))")


def suburbs(spark: SparkSession, sf_dir: str, variant: str = "base") -> DataFrame:
    """B2: an edge-matched coverage of 16 x 16 squares with missing cells.

    variant ``enclave`` adds a 4 x 4 square inside every cell with
    fid % 50 = 7 (fid 10^9 + fid, suburb 'E' || fid); variant ``copies``
    adds a copy of the cell square for fid % 53 = 0 (fid 2 * 10^9 + fid);
    variant ``shifted`` moves the square of every fid % 43 = 5 right by
    0.25 (boundaries that nearly meet)."""
    part = _read(spark, sf_dir, "part").where("p_partkey % 37 <> 0")
    base = part.selectExpr(
        "p_partkey AS fid",
        "CAST(p_partkey % 50 AS DOUBLE) * 16 AS gx",
        "CAST(p_partkey div 50 AS DOUBLE) * 16 AS gy",
        "concat('S', CAST((p_partkey div 3) % 400 AS STRING)) AS suburb",
        "CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE 3000 + (p_partkey div 6) % 150 END AS postcode",
        "concat('ST', CAST((p_partkey % 50) div 17 AS STRING)) AS state",
        "CASE WHEN p_partkey % 23 = 0 THEN 'not a date' WHEN p_partkey % 29 = 0 THEN NULL "
        "ELSE concat('20', lpad(CAST(p_size % 24 AS STRING), 2, '0'), '-0', CAST(1 + p_size % 9 AS STRING), "
        "'-1', CAST(p_size % 9 AS STRING)) END AS legalstartdate",
    )
    cols = ["fid", "suburb", "postcode", "state", "legalstartdate", F.lit(SUBURB_SRID).alias("srid")]
    if variant == "shifted":
        base = base.withColumn("gx", F.expr("gx + CASE WHEN fid % 43 = 5 THEN 0.25D ELSE 0D END"))
    out = base.select(*cols, F.expr(_square("gx", "gy", "16D")).alias("geom"))
    if variant == "enclave":
        extra = base.where("fid % 50 = 7").select(
            F.expr("1000000000 + fid").alias("fid"), F.expr("concat('E', CAST(fid AS STRING))").alias("suburb"),
            "postcode", "state", "legalstartdate", F.lit(SUBURB_SRID).alias("srid"),
            F.expr(_square("gx + 4D", "gy + 4D", "4D")).alias("geom"))
        out = out.unionByName(extra)
    elif variant == "copies":
        extra = base.where("fid % 53 = 0").select(
            F.expr("2000000000 + fid").alias("fid"), "suburb", "postcode", "state", "legalstartdate",
            F.lit(SUBURB_SRID).alias("srid"), F.expr(_square("gx", "gy", "16D")).alias("geom"))
        out = out.unionByName(extra)
    return out


def suburbs_sql(variant: str = "base") -> str:
    """CTEs ``b2_feat(fid, suburb, postcode, state, legalstartdate, srid)`` and
    ``b2_v(fid, part, ring, seq, x, y)``."""
    extra_feat, extra_sq = "", ""
    if variant == "enclave":
        extra_feat = ("UNION ALL SELECT 1000000000 + fid, 'E' || CAST(fid AS VARCHAR), postcode, state, "
                      "legalstartdate, srid, gx + 4, gy + 4, 4.0 FROM b2_base WHERE fid % 50 = 7")
    elif variant == "copies":
        extra_feat = ("UNION ALL SELECT 2000000000 + fid, suburb, postcode, state, legalstartdate, srid, "
                      "gx, gy, 16.0 FROM b2_base WHERE fid % 53 = 0")
    shift = "CASE WHEN fid % 43 = 5 THEN 0.25 ELSE 0.0 END" if variant == "shifted" else "0.0"
    return f"""
b2_base AS (
  SELECT p_partkey AS fid, CAST(p_partkey % 50 AS DOUBLE) * 16 AS gx, CAST(p_partkey // 50 AS DOUBLE) * 16 AS gy,
         'S' || CAST((p_partkey // 3) % 400 AS VARCHAR) AS suburb,
         CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE 3000 + (p_partkey // 6) % 150 END AS postcode,
         'ST' || CAST((p_partkey % 50) // 17 AS VARCHAR) AS state,
         CASE WHEN p_partkey % 23 = 0 THEN 'not a date' WHEN p_partkey % 29 = 0 THEN NULL
              ELSE '20' || lpad(CAST(p_size % 24 AS VARCHAR), 2, '0') || '-0' || CAST(1 + p_size % 9 AS VARCHAR)
                   || '-1' || CAST(p_size % 9 AS VARCHAR) END AS legalstartdate,
         {SUBURB_SRID} AS srid
  FROM part WHERE p_partkey % 37 <> 0
),
b2_sq AS (
  SELECT fid, suburb, postcode, state, legalstartdate, srid, gx + {shift} AS sx, gy AS sy, 16.0 AS s FROM b2_base
  {extra_feat}
),
b2_feat AS (SELECT fid, suburb, postcode, state, legalstartdate, srid FROM b2_sq),
b2_v AS (
  SELECT fid, 0 AS part, 0 AS ring, t.seq, sx + t.a * s AS x, sy + t.b * s AS y
  FROM b2_sq, (VALUES (0, 0.0, 0.0), (1, 1.0, 0.0), (2, 1.0, 1.0), (3, 0.0, 1.0), (4, 0.0, 0.0)) t(seq, a, b)
)"""


# ------------------------------------------------------------- B3 roads ----

def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-point road segments with start/end node names."""
    o = _read(spark, sf_dir, "orders")
    base = o.selectExpr(
        "o_orderkey AS fid", "o_custkey",
        "CASE WHEN o_orderkey % 11 = 0 THEN concat('A', CAST(o_orderkey AS STRING)) "
        "ELSE concat('N', CAST(o_orderkey div 3 AS STRING)) END AS start_node_name",
        "CASE WHEN o_orderkey % 11 = 0 THEN concat('B', CAST(o_orderkey AS STRING)) "
        "ELSE concat('N', CAST((o_orderkey + o_custkey % 5) div 3 AS STRING)) END AS end_node_name",
        "CAST(o_orderkey % 200 AS DOUBLE) * 8 AS sx", "CAST(o_orderkey div 200 AS DOUBLE) * 8 AS sy",
        "CASE o_custkey % 4 WHEN 0 THEN 10D WHEN 1 THEN 4D WHEN 2 THEN 0D ELSE 3D END AS dx",
        "CASE o_custkey % 4 WHEN 0 THEN 0D WHEN 1 THEN 4D WHEN 2 THEN 10D ELSE 1D END AS dy",
        "0D AS start_slk", "CAST(o_custkey % 20 AS DOUBLE) AS end_slk", "0D AS start_true_dist",
        "CAST(o_custkey % 20 - CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS end_true_dist",
        "concat('R', CAST(o_orderkey % 97 AS STRING)) AS road",
    )
    return base.select(
        "fid", "start_node_name", "end_node_name", "road", "start_slk", "end_slk",
        "start_true_dist", "end_true_dist", F.lit(ROAD_SRID).alias("srid"),
        F.expr("named_struct('type', 'LineString', 'coords', array(array(array("
               "named_struct('x', sx, 'y', sy), named_struct('x', sx + dx, 'y', sy + dy)))))").alias("geom"))


def roads_sql() -> str:
    """CTE ``b3(fid, start_node_name, end_node_name, x1, y1, x2, y2, start_slk, end_slk,
    start_true_dist, end_true_dist)``: one segment per road."""
    return """
b3 AS (
  SELECT o_orderkey AS fid,
         CASE WHEN o_orderkey % 11 = 0 THEN 'A' || CAST(o_orderkey AS VARCHAR) ELSE 'N' || CAST(o_orderkey // 3 AS VARCHAR) END AS start_node_name,
         CASE WHEN o_orderkey % 11 = 0 THEN 'B' || CAST(o_orderkey AS VARCHAR) ELSE 'N' || CAST((o_orderkey + o_custkey % 5) // 3 AS VARCHAR) END AS end_node_name,
         CAST(o_orderkey % 200 AS DOUBLE) * 8 AS x1, CAST(o_orderkey // 200 AS DOUBLE) * 8 AS y1,
         CAST(o_orderkey % 200 AS DOUBLE) * 8 + CASE o_custkey % 4 WHEN 0 THEN 10.0 WHEN 1 THEN 4.0 WHEN 2 THEN 0.0 ELSE 3.0 END AS x2,
         CAST(o_orderkey // 200 AS DOUBLE) * 8 + CASE o_custkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 4.0 WHEN 2 THEN 10.0 ELSE 1.0 END AS y2,
         0.0 AS start_slk, CAST(o_custkey % 20 AS DOUBLE) AS end_slk, 0.0 AS start_true_dist,
         CAST(o_custkey % 20 - CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS end_true_dist
  FROM orders
)"""


# ------------------------------------------------------------- B4 floor ----

def floor_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floor-space blocks on the B1 geometry."""
    b = blocks(spark, sf_dir)
    return b.selectExpr(
        "fid", "fid % 300 AS block_id", "p_type AS space_use", "p_size - 3 AS floor_space",
        "CASE WHEN fid % 31 = 0 THEN NULL ELSE p_size END AS residential",
        "fid % 30 AS office", "p_size + 300 AS total", "srid", "geom")


def floor_sql() -> str:
    return """
b4 AS (
  SELECT p_partkey AS fid, p_partkey % 300 AS block_id, p_type AS space_use, p_size - 3 AS floor_space,
         CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE p_size END AS residential,
         p_partkey % 30 AS office, p_size + 300 AS total
  FROM part
)"""


# ------------------------------------------------------------- B5 names ----

def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").selectExpr("p_partkey AS fid", "concat(p_name, ' ', p_brand) AS suburb")


# ---------------------------------------------------------- B6 registry ----

def status_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violation-status history rows derived from ``events``."""
    e = _read(spark, sf_dir, "events")
    return e.selectExpr(
        "event_id % 4 AS run_id", "event_type AS rule_key",
        "md5(concat(CAST(user_id AS STRING), '|', event_type)) AS feature_hash",
        "ts AS set_at", "event_id AS status_id",
        "CASE WHEN event_type = 'view' THEN 'waived' ELSE 'invalid' END AS status",
        "value AS lat", "CAST(event_id % 360 - 180 AS DOUBLE) AS lon")


def status_history_sql() -> str:
    return """
b6 AS (
  SELECT event_id % 4 AS run_id, event_type AS rule_key,
         md5(CAST(user_id AS VARCHAR) || '|' || event_type) AS feature_hash,
         ts AS set_at, event_id AS status_id,
         CASE WHEN event_type = 'view' THEN 'waived' ELSE 'invalid' END AS status,
         value AS lat, CAST(event_id % 360 - 180 AS DOUBLE) AS lon
  FROM events
)"""


# ------------------------------------------------------------- B7 shapes ----

# Shapes of rings that fit or don't fit each other, by p_partkey % 10, on a raster of 32.
def _sq(x1, y1, x2, y2):
    return [(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)]


RING_SHAPES: dict[int, list[list[list[tuple]]]] = {
    0: [[_sq(0, 0, 16, 16), [(0, 8), (4, 10), (4, 6), (0, 8)]]],                                        # hole touches the shell once: valid
    1: [[_sq(0, 0, 16, 16), _sq(2, 2, 12, 12)[::-1], _sq(4, 4, 6, 6)[::-1]]],                           # hole in a hole
    2: [[_sq(0, 0, 16, 16), [(0, 8), (8, 10), (16, 8), (8, 6), (0, 8)]]],                               # hole touches the shell twice
    3: [[_sq(0, 0, 16, 16)], [_sq(4, 4, 8, 8)]],                                                        # shell in a shell
    4: [[_sq(0, 0, 16, 16), _sq(2, 2, 14, 14)[::-1]], [_sq(4, 4, 8, 8)]],                               # island in a hole: valid
    5: [[_sq(0, 0, 24, 24), [(4, 8), (8, 12), (12, 8), (8, 4), (4, 8)], [(12, 8), (16, 12), (20, 8), (16, 4), (12, 8)],
         [(8, 12), (12, 20), (16, 12), (8, 12)]]],                                                      # three holes that touch in a circle
    6: [[[(0, 0), (8, 0), (8, 8), (8, 4), (8, 12), (0, 12), (0, 0)]]],                                  # folds back on itself
    7: [[_sq(0, 0, 8, 8)], [_sq(4, 4, 12, 12)]],                                                        # crossing parts
    8: [[[(0, 0), (8, 0), (8, 0), (8, 8), (0, 8), (0, 0)]], [_sq(8, 8, 16, 16)]],                       # repeated point, parts touch: valid
    9: [[_sq(0, 0, 16, 16), _sq(20, 20, 24, 24)[::-1]]],                                                # hole outside
}


def ring_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fid, srid, geom``, one polygon feature per part row, shapes of ``RING_SHAPES``."""
    rows = [(k, "MultiPolygon" if len(parts) > 1 else "Polygon", [[[(float(x), float(y)) for x, y in ring] for ring in part] for part in parts]) for k, parts in RING_SHAPES.items()]
    shapes = spark.createDataFrame(rows, "k bigint, gtype string, tpl array<array<array<struct<x:double,y:double>>>>")
    f = _read(spark, sf_dir, "part").selectExpr("p_partkey AS fid", "p_partkey % 10 AS k", "CAST((p_partkey % 50) * 32 AS DOUBLE) AS x0", "CAST((p_partkey div 50) * 32 AS DOUBLE) AS y0")
    coords = "transform(tpl, pp -> transform(pp, rr -> transform(rr, q -> named_struct('x', x0 + q.x, 'y', y0 + q.y))))"
    return f.join(F.broadcast(shapes), "k").select("fid", F.lit(BLOCK_SRID).alias("srid"), F.expr(f"named_struct('type', gtype, 'coords', {coords})").alias("geom"))


def ring_shapes_sql() -> str:
    """CTE ``b7_v(fid, part, ring, seq, x, y)``."""
    rows = ", ".join(f"({k}, {p}, {r}, {s}, {float(x)}, {float(y)})" for k, parts in RING_SHAPES.items() for p, part in enumerate(parts) for r, ring in enumerate(part) for s, (x, y) in enumerate(ring))
    return f"""
b7_v AS (
  SELECT p.p_partkey AS fid, t.part, t.ring, t.seq, (p.p_partkey % 50) * 32 + t.x AS x, (p.p_partkey // 50) * 32 + t.y AS y
  FROM part p JOIN (VALUES {rows}) t(k, part, ring, seq, x, y) ON t.k = p.p_partkey % 10
)"""
