"""Registered queries over the suburb coverage (B2), the floor blocks (B4),
the blocks used pairwise (B1) and the names (B5): attribute checks and the
pair family."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectorlint.operators import attribute as A
from vectorlint.operators import pairs as P
from vectorlint.operators import spatial as S
from vectorlint.plans import oracle as O
from vectorlint.plans.catalog import (B1_X, R6, _blocks, _cmp, _valid_block_parts, register, vsel, with_)
from vectorlint.sources import fixtures as FX


def b2_ctes(variant: str = "base") -> list[str]:
    return [FX.suburbs_sql(variant), O.edges_sql("b2_v", "b2_e"), O.part_boxes_sql("b2_v", "b2_bx"),
            O.ring_area_sql("b2_e", "b2_ra"), O.part_area_sql("b2_ra", "b2_pa"),
            O.box_pairs_sql("b2_bx", "b2_cand"), O.overlap_area_sql("b2_e", "b2_ra", "b2_cand", "b2_ov"),
            O.contacts_sql("b2_e", "b2_cand", "b2_ct"), """
b2_rel AS (
  SELECT c.a_fid, c.a_part, c.b_fid, c.b_part, coalesce(o.area, 0) AS area, t.a_fid IS NOT NULL AS meets,
         coalesce(t.shared_len, 0) AS shared_len
  FROM b2_cand c
  LEFT JOIN b2_ov o ON o.a_fid = c.a_fid AND o.a_part = c.a_part AND o.b_fid = c.b_fid AND o.b_part = c.b_part
  LEFT JOIN b2_ct t ON t.a_fid = c.a_fid AND t.a_part = c.a_part AND t.b_fid = c.b_fid AND t.b_part = c.b_part
),
b2_touch AS (SELECT * FROM b2_rel WHERE meets AND area <= 1e-9)"""]


def _suburbs(spark, sf, variant="base"):
    return FX.suburbs(spark, sf, variant)


def _suburb_parts(spark, sf, variant="base"):
    from pyspark import StorageLevel
    return S.parts(_suburbs(spark, sf, variant), keep=["suburb", "postcode", "state", "srid"]).persist(StorageLevel.MEMORY_AND_DISK)


def _floor(spark, sf):
    return FX.floor_blocks(spark, sf)


# ================================================== suburb attributes ======

@register("duplicate_suburb_name", with_(*b2_ctes()) +
          "\nSELECT suburb, CAST(count(*) AS BIGINT) AS n FROM b2_feat WHERE suburb IS NOT NULL GROUP BY suburb HAVING count(*) > 1")
def q_duplicate_suburb_name(spark, sf):
    """A1: suburb names used more than once."""
    v = A.duplicate_name(_suburbs(spark, sf))
    return v.select(F.col("attrs")["suburb"].alias("suburb"), F.col("metric").cast("bigint").alias("n"))


@register("missing_postcode", with_(*b2_ctes()) + f"\nSELECT {vsel(et='MissingPostcode')} FROM b2_feat WHERE postcode IS NULL")
def q_missing_postcode(spark, sf):
    """A2."""
    return _cmp(A.missing_value(_suburbs(spark, sf), "postcode", "MissingPostcode"))


@register("invalid_legal_start_date", with_(*b2_ctes()) +
          f"\nSELECT {vsel(et='InvalidLegalStartDate')} FROM b2_feat WHERE try_cast(legalstartdate AS TIMESTAMP) IS NULL")
def q_invalid_legal_start_date(spark, sf):
    """A3: missing or unparsable dates (try_to_timestamp, never a plain cast)."""
    return _cmp(A.invalid_date(_suburbs(spark, sf)))


@register("non_contiguous_parts", with_(*b2_ctes()) +
          "\nSELECT f.suburb, CAST(count(*) AS BIGINT) AS n FROM b2_bx b JOIN b2_feat f ON f.fid = b.fid "
          "WHERE f.suburb IS NOT NULL GROUP BY f.suburb HAVING count(*) > 1")
def q_non_contiguous_parts(spark, sf):
    """A4: more than one exploded part per suburb."""
    v = A.non_contiguous_parts(_suburb_parts(spark, sf))
    return v.select(F.col("attrs")["suburb"].alias("suburb"), F.col("metric").cast("bigint").alias("n"))


@register("suburb_multi_postcode", with_(*b2_ctes()) +
          "\nSELECT suburb, CAST(count(DISTINCT postcode) AS BIGINT) AS n FROM b2_feat WHERE suburb IS NOT NULL "
          "GROUP BY suburb HAVING count(DISTINCT postcode) > 1")
def q_suburb_multi_postcode(spark, sf):
    """A5."""
    v = A.suburb_multi_postcode(_suburbs(spark, sf))
    return v.select(F.col("attrs")["suburb"].alias("suburb"), F.col("metric").cast("bigint").alias("n"))


@register("postcode_multi_suburb", with_(*b2_ctes()) +
          "\nSELECT CAST(postcode AS VARCHAR) AS postcode, CAST(count(DISTINCT suburb) AS BIGINT) AS n FROM b2_feat "
          "WHERE postcode IS NOT NULL GROUP BY postcode HAVING count(DISTINCT suburb) > 1")
def q_postcode_multi_suburb(spark, sf):
    """A6."""
    v = A.postcode_multi_suburb(_suburbs(spark, sf))
    return v.select(F.col("attrs")["postcode"].alias("postcode"), F.col("metric").cast("bigint").alias("n"))


@register("crs_not_projected", with_(*b2_ctes()) +
          "\nSELECT DISTINCT CAST(srid AS DOUBLE) AS srid FROM b2_feat WHERE srid IS NULL OR srid IN (4326, 4283, 7844)")
def q_crs_not_projected(spark, sf):
    """A16 on the suburbs (projected EPSG:3107, so no rows)."""
    return A.crs_not_projected(_suburbs(spark, sf)).select(F.col("metric").alias("srid"))


@register("expected_crs", with_(*B1_X) +
          "\nSELECT DISTINCT CAST(srid AS DOUBLE) AS srid FROM b1_feat WHERE srid IS NULL OR srid NOT IN (4326, 7844)")
def q_expected_crs(spark, sf):
    """A17 on the blocks used as buildings (EPSG:7855 is not in 4326/7844)."""
    return A.expected_crs(_blocks(spark, sf)).select(F.col("metric").alias("srid"))


@register("crs_missing", with_(*B1_X) + "\nSELECT DISTINCT CAST(srid AS DOUBLE) AS srid FROM b1_feat WHERE srid IS NULL")
def q_crs_missing(spark, sf):
    """A18."""
    return A.crs_missing(_blocks(spark, sf)).select(F.col("metric").alias("srid"))


@register("crs_audit", with_(*B1_X) + "\nSELECT DISTINCT CAST(srid AS DOUBLE) AS srid FROM b1_feat WHERE srid IS DISTINCT FROM 4283")
def q_crs_audit(spark, sf):
    """S20 (re-aimed): CRS differs from the expected EPSG:4283."""
    return A.crs_audit(_blocks(spark, sf), 4283).select(F.col("metric").alias("srid"))


# ===================================================== floor attributes ====

B4 = FX.floor_sql()


@register("attribute_not_null", with_(B4) + """
SELECT fid, 'residential' AS field FROM b4 WHERE residential IS NULL
UNION ALL SELECT fid, 'space_use' FROM b4 WHERE space_use IS NULL""")
def q_attribute_not_null(spark, sf):
    """Fields residential, space_use and an absent one (skipped)."""
    v = A.attribute_not_null(_floor(spark, sf), ["residential", "space_use", "not_a_column"])
    return v.select("fid", F.col("attrs")["field"].alias("field"))


@register("attribute_in_domain", with_(B4) +
          f"\nSELECT {vsel(et='AttributeInDomain')} FROM b4 WHERE coalesce(space_use NOT IN ('ECONOMY', 'SMALL', 'STANDARD'), true)")
def q_attribute_in_domain(spark, sf):
    """space_use outside a three-value domain (null fails)."""
    return _cmp(A.attribute_in_domain(_floor(spark, sf), "space_use", ["ECONOMY", "SMALL", "STANDARD"]))


@register("unique_field", with_(B4, "cnt AS (SELECT block_id, count(*) AS n FROM b4 GROUP BY block_id HAVING count(*) > 1)") +
          f"\nSELECT {vsel(fid='b.fid', et='UniqueField', m='c.n')} FROM b4 b JOIN cnt c ON c.block_id IS NOT DISTINCT FROM b.block_id")
def q_unique_field(spark, sf):
    """A10: block_id values that repeat."""
    return _cmp(A.unique_field(_floor(spark, sf), "block_id"))


@register("null_values", with_(B4) + """
SELECT * FROM (
  SELECT 'residential' AS column, CAST(count(*) FILTER (WHERE residential IS NULL) AS BIGINT) AS null_count FROM b4
  UNION ALL SELECT 'geom', CAST(count(*) FILTER (WHERE fid % 64 = 0) AS BIGINT) FROM b4
  UNION ALL SELECT 'space_use', CAST(count(*) FILTER (WHERE space_use IS NULL) AS BIGINT) FROM b4
  UNION ALL SELECT 'floor_space', CAST(count(*) FILTER (WHERE floor_space IS NULL) AS BIGINT) FROM b4
) t WHERE null_count > 0""")
def q_null_values(spark, sf):
    """One row per column with nulls (geometry included)."""
    v = A.null_values(_floor(spark, sf))
    return v.select(F.col("attrs")["column"].alias("column"), F.col("metric").cast("bigint").alias("null_count"))


@register("null_counts_top3")
def q_null_counts_top3(spark, sf):
    """A11 series, top-3 columns by null count (the top-k is the report)."""
    return A.null_counts(_floor(spark, sf)).orderBy(F.desc("null_count"), "column").limit(3)


@register("negative_floor_space", with_(B4) + f"\nSELECT {vsel(et='NegativeFloorSpace', m='floor_space')} FROM b4 WHERE floor_space < 0")
def q_negative_floor_space(spark, sf):
    """A12."""
    return _cmp(A.negative_value(_floor(spark, sf)))


@register("total_consistency", with_(B4) +
          f"\nSELECT {vsel(et='TotalConsistency', m='block_id + floor_space + coalesce(residential, 0) + office', m2='total')} FROM b4 "
          "WHERE block_id + floor_space + coalesce(residential, 0) + office > total")
def q_total_consistency(spark, sf):
    """Numeric components (fid, srid left out) above the total."""
    return _cmp(A.total_consistency(_floor(spark, sf)))


@register("conflict_block_uses", with_(B4) +
          f"\nSELECT {vsel(fid='block_id', et='ConflictBlockUses', m='count(DISTINCT space_use)')} FROM b4 "
          "WHERE block_id IS NOT NULL GROUP BY block_id HAVING count(DISTINCT space_use) > 3")
def q_conflict_block_uses(spark, sf):
    """A14."""
    return _cmp(A.conflict_block_uses(_floor(spark, sf)))


@register("histogram_min_edge", with_(*B1_X, """
me AS (SELECT fid, part, min(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) AS v FROM b1_oke WHERE ring = 0 GROUP BY fid, part),
rg AS (SELECT min(v) AS lo_, max(v) AS hi_ FROM me),
bn AS (SELECT CASE WHEN hi_ = lo_ THEN 0 ELSE least(CAST(floor((v - lo_) / ((hi_ - lo_) / 30)) AS INTEGER), 29) END AS bin, lo_, hi_ FROM me, rg)""") + """
SELECT bin, round(lo_ + bin * (hi_ - lo_) / 30, 6) AS lo, round(lo_ + (bin + 1) * (hi_ - lo_) / 30, 6) AS hi, CAST(count(*) AS BIGINT) AS n
FROM bn GROUP BY bin, lo_, hi_""")
def q_histogram_min_edge(spark, sf):
    """30-bin histogram of the shortest exterior edge of valid parts."""
    from vectorlint.functions import geometry as G
    p = _valid_block_parts(spark, sf).select(F.expr(G.ring_min_edge("rings[0]")).alias("v"))
    h = A.histogram(p, "v", 30)
    return h.select("bin", F.round("lo", R6).alias("lo"), F.round("hi", R6).alias("hi"), "n")


@register("sample_rows")
def q_sample_rows(spark, sf):
    """A seeded sample of 20 floor blocks (sampling is the feature)."""
    return A.sample_rows(_floor(spark, sf).select("fid", "block_id", "space_use"), 20, 42)


@register("slk_exceeds_true_distance", with_(FX.roads_sql()) +
          f"\nSELECT {vsel(et='SlkExceedsTrueDistance', m='end_slk - start_slk', m2='end_true_dist - start_true_dist')} FROM b3 "
          "WHERE end_slk - start_slk > end_true_dist - start_true_dist + 1e-6")
def q_slk_exceeds_true_distance(spark, sf):
    """A15 on the roads."""
    return _cmp(A.slk_exceeds_true_distance(FX.roads(spark, sf)))


# ======================================================== pair family ======

@register("overlap_suburb", with_(*b2_ctes("enclave"), """
hit AS (SELECT * FROM b2_rel WHERE area > 1e-9)""") + f"""
SELECT {vsel(fid='a_fid', part='a_part', et='Overlap', ofid='b_fid', opart='b_part', m='area')} FROM hit
UNION ALL SELECT {vsel(fid='b_fid', part='b_part', et='Overlap', ofid='a_fid', opart='a_part', m='area')} FROM hit""")
def q_overlap_suburb(spark, sf):
    """P1 on the coverage with enclave squares added."""
    return _cmp(P.overlap_suburb(_suburb_parts(spark, sf, "enclave")))


B1_PAIRS = [O.box_pairs_sql("b1_okbx", "cand"), O.overlap_area_sql("b1_oke", "b1_okra", "cand", "ov"),
            O.contacts_sql("b1_oke", "cand", "ct"), """
rel AS (
  SELECT c.a_fid, c.a_part, c.b_fid, c.b_part, coalesce(o.area, 0) AS area, t.a_fid IS NOT NULL AS meets
  FROM cand c
  LEFT JOIN ov o ON o.a_fid = c.a_fid AND o.a_part = c.a_part AND o.b_fid = c.b_fid AND o.b_part = c.b_part
  LEFT JOIN ct t ON t.a_fid = c.a_fid AND t.a_part = c.a_part AND t.b_fid = c.b_fid AND t.b_part = c.b_part
),
frel AS (SELECT a_fid, b_fid, sum(area) AS area, bool_or(meets) AS meets FROM rel WHERE a_fid <> b_fid GROUP BY a_fid, b_fid)"""]


@register("overlap_block", with_(*B1_X, *B1_PAIRS, """
hit AS (SELECT * FROM rel WHERE area > greatest(0.0, 1e-9))""") + f"""
SELECT {vsel(fid='h.a_fid', part='h.a_part', et='Overlap', ofid='h.b_fid', opart='h.b_part', m='h.area', m2='h.area / p.area')}
FROM hit h JOIN b1_pa p ON p.fid = h.a_fid AND p.part = h.a_part
UNION ALL SELECT {vsel(fid='h.b_fid', part='h.b_part', et='Overlap', ofid='h.a_fid', opart='h.a_part', m='h.area', m2='h.area / p.area')}
FROM hit h JOIN b1_pa p ON p.fid = h.b_fid AND p.part = h.b_part""")
def q_overlap_block(spark, sf):
    """Overlap area > 0 and its share of each side's area."""
    return _cmp(P.overlap_block(_valid_block_parts(spark, sf), min_area=0.0))


@register("overlap_floor", with_(*B1_X, *B1_PAIRS, "hit AS (SELECT * FROM frel WHERE area > 1e-9)") + f"""
SELECT {vsel(fid='a_fid', et='GeometryOverlap', ofid='b_fid', m='area')} FROM hit
UNION ALL SELECT {vsel(fid='b_fid', et='GeometryOverlap', ofid='a_fid', m='area')} FROM hit""")
def q_overlap_floor(spark, sf):
    """Feature pairs of the floor blocks sharing area, both rows."""
    fl = _floor(spark, sf)
    from vectorlint.operators.feature import valid_parts
    parts = valid_parts(S.parts(fl, keep=["block_id", "space_use"]))
    return _cmp(P.overlap_floor(parts))


@register("intersects_pairs_count", with_(*B1_X, *B1_PAIRS, "hit AS (SELECT * FROM frel WHERE meets OR area > 1e-9)") + """
SELECT a_fid AS fid, b_fid AS other_fid FROM hit UNION ALL SELECT b_fid, a_fid FROM hit""")
def q_intersects_pairs_count(spark, sf):
    """P5: ordered feature pairs that intersect (touching counts)."""
    return P.intersects_pairs(_valid_block_parts(spark, sf))


@register("building_interior_overlap_any", with_(*B1_X, *B1_PAIRS, "hit AS (SELECT * FROM frel WHERE area > 1e-9)") + f"""
SELECT DISTINCT {vsel(et='InteriorOverlap')} FROM (SELECT a_fid AS fid FROM hit UNION SELECT b_fid FROM hit) t""")
def q_building_interior_overlap_any(spark, sf):
    """Features that overlap another beyond touching, once each."""
    return _cmp(P.interior_overlap_any(_valid_block_parts(spark, sf)))


@register("touching_neighbours", with_(*b2_ctes()) + f"""
SELECT {vsel(fid='a_fid', part='a_part', et='Touches', ofid='b_fid', opart='b_part', m='shared_len')} FROM b2_touch
UNION ALL SELECT {vsel(fid='b_fid', part='b_part', et='Touches', ofid='a_fid', opart='a_part', m='shared_len')} FROM b2_touch""")
def q_touching_neighbours(spark, sf):
    """P7 on the suburb coverage: side neighbours (length 16) and corners (0)."""
    return _cmp(P.touching_neighbours(_suburb_parts(spark, sf)))


@register("short_shared_boundary", with_(*b2_ctes(), "hit AS (SELECT * FROM b2_touch WHERE shared_len < 5)") + f"""
SELECT {vsel(fid='a_fid', part='a_part', et='VeryShortSharedBoundary', ofid='b_fid', opart='b_part', m='shared_len')} FROM hit
UNION ALL SELECT {vsel(fid='b_fid', part='b_part', et='VeryShortSharedBoundary', ofid='a_fid', opart='a_part', m='shared_len')} FROM hit""")
def q_short_shared_boundary(spark, sf):
    """Touching with shared boundary < 5 m (corner touches included)."""
    return _cmp(P.short_shared_boundary(_suburb_parts(spark, sf), min_len=5.0))


@register("neighbour_attr_mismatch", with_(*b2_ctes(), """
hit AS (SELECT t.* FROM b2_touch t JOIN b2_feat fa ON fa.fid = t.a_fid JOIN b2_feat fb ON fb.fid = t.b_fid
        WHERE fa.state IS DISTINCT FROM fb.state)""") + f"""
SELECT {vsel(fid='a_fid', part='a_part', et='NeighbourAttributeMismatch', ofid='b_fid', opart='b_part')} FROM hit
UNION ALL SELECT {vsel(fid='b_fid', part='b_part', et='NeighbourAttributeMismatch', ofid='a_fid', opart='a_part')} FROM hit""")
def q_neighbour_attr_mismatch(spark, sf):
    """Touching suburbs in different states."""
    return _cmp(P.neighbour_attr_mismatch(_suburb_parts(spark, sf), ("state",)))


@register("enclave", with_(*b2_ctes("enclave"), """
hit AS (SELECT a_fid AS i, a_part AS ip, b_fid AS o, b_part AS op, area FROM b2_rel WHERE area > 1e-9
        UNION ALL SELECT b_fid, b_part, a_fid, a_part, area FROM b2_rel WHERE area > 1e-9)""") + f"""
SELECT {vsel(fid='h.i', part='h.ip', et='Enclave', ofid='h.o', opart='h.op', m='h.area')}
FROM hit h JOIN b2_pa p ON p.fid = h.i AND p.part = h.ip
JOIN b2_feat fi ON fi.fid = h.i JOIN b2_feat fo ON fo.fid = h.o
WHERE abs(h.area - p.area) <= 1e-9 * greatest(p.area, 1.0) AND fi.suburb IS DISTINCT FROM fo.suburb""")
def q_enclave(spark, sf):
    """P10: a part inside a part of another suburb."""
    return _cmp(P.enclave(_suburb_parts(spark, sf, "enclave")))


_MIS = [FX.suburbs_sql("shifted"), O.edges_sql("b2_v", "b2_e"), O.part_boxes_sql("b2_v", "b2_bx"),
        O.box_pairs_sql("b2_bx", "b2_cand", eps=0.25, where="a.fid <> b.fid"), f"""
sides AS (SELECT * FROM (SELECT a_fid, a_part, b_fid, b_part FROM b2_cand) UNION ALL SELECT b_fid AS a_fid, b_part AS a_part, a_fid AS b_fid, a_part AS b_part FROM b2_cand),
near AS (
  SELECT c.a_fid, c.a_part, c.b_fid, c.b_part, v.x1 AS px, v.y1 AS py, min(sqrt(
    pow(v.x1 - e.x1 - least(1.0, greatest(0.0, ((v.x1 - e.x1) * (e.x2 - e.x1) + (v.y1 - e.y1) * (e.y2 - e.y1)) / (pow(e.x2 - e.x1, 2) + pow(e.y2 - e.y1, 2)))) * (e.x2 - e.x1), 2) +
    pow(v.y1 - e.y1 - least(1.0, greatest(0.0, ((v.x1 - e.x1) * (e.x2 - e.x1) + (v.y1 - e.y1) * (e.y2 - e.y1)) / (pow(e.x2 - e.x1, 2) + pow(e.y2 - e.y1, 2)))) * (e.y2 - e.y1), 2))) AS d
  FROM (SELECT a_fid, a_part, b_fid, b_part FROM sides) c JOIN b2_e v ON v.fid = c.a_fid AND v.part = c.a_part JOIN b2_e e ON e.fid = c.b_fid AND e.part = c.b_part
  WHERE pow(e.x2 - e.x1, 2) + pow(e.y2 - e.y1, 2) > 0
  GROUP BY ALL
),
dist AS (SELECT least(a_fid, b_fid) AS a_fid, CASE WHEN a_fid < b_fid THEN a_part ELSE b_part END AS a_part,
                greatest(a_fid, b_fid) AS b_fid, CASE WHEN a_fid < b_fid THEN b_part ELSE a_part END AS b_part, min(d) AS d
         FROM near WHERE d > 0 AND d <= 0.5 GROUP BY ALL),
hit AS (SELECT * FROM dist WHERE d > 0 AND d <= 0.5)"""]


@register("boundary_misalignment", with_(*_MIS) + f"""
SELECT {vsel(fid='a_fid', part='a_part', et='BoundaryMisalignment', ofid='b_fid', opart='b_part', m='d')} FROM hit
UNION ALL SELECT {vsel(fid='b_fid', part='b_part', et='BoundaryMisalignment', ofid='a_fid', opart='a_part', m='d')} FROM hit""")
def q_boundary_misalignment(spark, sf):
    """P9 (re-aimed) on the coverage with some squares shifted by 0.25."""
    return _cmp(P.boundary_misalignment(_suburb_parts(spark, sf, "shifted"), tolerance=0.5))


@register("adjacency_graph", with_(*b2_ctes()) + """
SELECT CAST((SELECT count(*) FROM b2_feat) AS BIGINT) AS n_nodes, CAST((SELECT count(*) FROM b2_touch) AS BIGINT) AS n_edges,
       round(2.0 * (SELECT count(*) FROM b2_touch) / (SELECT count(*) FROM b2_feat), 6) AS avg_degree""")
def q_adjacency_graph(spark, sf):
    """Touch graph of the suburbs."""
    sp = _suburb_parts(spark, sf)
    return P.adjacency_graph(_suburbs(spark, sf), P.touch_edges(sp))


@register("connected_components", with_(*b2_ctes(), """
und AS (SELECT a_fid AS src, b_fid AS dst FROM b2_touch UNION SELECT b_fid, a_fid FROM b2_touch)""").replace("WITH ", "WITH RECURSIVE ", 1) + """,
walk(node, comp) AS (
  SELECT fid, fid FROM b2_feat
  UNION
  SELECT u.dst, w.comp FROM walk w JOIN und u ON u.src = w.node
),
lab AS (SELECT node, min(comp) AS comp FROM walk GROUP BY node),
sizes AS (SELECT comp, count(*) AS n FROM lab GROUP BY comp)
SELECT CAST(count(*) AS BIGINT) AS n_components, CAST(max(n) AS BIGINT) AS largest_size FROM sizes""")
def q_connected_components(spark, sf):
    """Components of the suburb touch graph (count, largest)."""
    sp = _suburb_parts(spark, sf)
    comp = P.connected_components(_suburbs(spark, sf).select("fid"), P.touch_edges(sp))
    return P.component_summary(comp)


@register("overlap_pairs_table", with_(*B1_X, *B1_PAIRS, B4, "hit AS (SELECT DISTINCT a_fid AS row1, b_fid AS row2 FROM frel WHERE area > 1e-9)") + """
SELECT h.row1, h.row2, f1.block_id AS block1_id, f1.space_use AS block1_use, f2.block_id AS block2_id, f2.space_use AS block2_use
FROM hit h JOIN b4 f1 ON f1.fid = h.row1 JOIN b4 f2 ON f2.fid = h.row2""")
def q_overlap_pairs_table(spark, sf):
    """Readable overlap pairs of the floor blocks."""
    from vectorlint.operators.feature import valid_parts
    parts = valid_parts(S.parts(_floor(spark, sf), keep=["block_id", "space_use"]))
    return P.overlap_pairs_table(parts)


GKEY = """
gk AS (
  SELECT f.fid, CASE WHEN f.has_geom THEN f.gtype || ':' || (
           SELECT string_agg(CAST(v.part AS VARCHAR) || ',' || CAST(v.ring AS VARCHAR) || ',' || CAST(v.x AS VARCHAR) || ',' || CAST(v.y AS VARCHAR), ';'
                             ORDER BY v.part, v.ring, v.seq) FROM b1_v v WHERE v.fid = f.fid) END AS k
  FROM b1_feat f
)"""


@register("duplicate_geometry", with_(*B1_X, GKEY, "grp AS (SELECT k, count(*) AS n FROM gk GROUP BY k HAVING count(*) > 1)") +
          f"\nSELECT {vsel(fid='g.fid', et='DuplicateGeometries', m='c.n')} FROM gk g JOIN grp c ON c.k IS NOT DISTINCT FROM g.k")
def q_duplicate_geometry(spark, sf):
    """P15 (building form: raw features, null geometries equal each other)."""
    return _cmp(P.duplicate_geometry(_blocks(spark, sf), "DuplicateGeometries", nulls_equal=True))


@register("duplicate_of_first", with_(*B1_X, GKEY, "fst AS (SELECT k, min(fid) AS first FROM gk WHERE k IS NOT NULL GROUP BY k)") + """
SELECT g.fid, CASE WHEN f.first <> g.fid THEN f.first END AS dup_id FROM gk g JOIN fst f ON f.k = g.k""")
def q_duplicate_of_first(spark, sf):
    """dup_id = first fid with the same geometry."""
    return P.duplicate_of_first(_blocks(spark, sf))


@register("nonmanifold_edge", with_(*b2_ctes("copies"), """
ue0 AS (SELECT fid, part, x1, y1, x2, y2, (x1 > x2 OR (x1 = x2 AND y1 > y2)) AS sw FROM b2_e WHERE ring = 0),
ue AS (SELECT fid, part, CASE WHEN sw THEN x2 ELSE x1 END AS px, CASE WHEN sw THEN y2 ELSE y1 END AS py,
              CASE WHEN sw THEN x1 ELSE x2 END AS qx, CASE WHEN sw THEN y1 ELSE y2 END AS qy FROM ue0),
hot AS (SELECT px, py, qx, qy FROM ue GROUP BY px, py, qx, qy HAVING count(*) > 2)""") + f"""
SELECT DISTINCT {vsel(fid='u.fid', part='u.part', et='NonManifoldEdge')} FROM ue u
JOIN hot h ON h.px = u.px AND h.py = u.py AND h.qx = u.qx AND h.qy = u.qy""")
def q_nonmanifold_edge(spark, sf):
    """P17 on the coverage with copied squares."""
    return _cmp(P.nonmanifold_edge(_suburb_parts(spark, sf, "copies")))


_GAPS_CTES = """
sgn AS (SELECT fid, part, ring, CASE WHEN (ring = 0) = (sa > 0) THEN 1 ELSE -1 END AS o FROM b2_ra),
oe AS (SELECT CASE WHEN s.o > 0 THEN e.x1 ELSE e.x2 END AS px, CASE WHEN s.o > 0 THEN e.y1 ELSE e.y2 END AS py,
              CASE WHEN s.o > 0 THEN e.x2 ELSE e.x1 END AS qx, CASE WHEN s.o > 0 THEN e.y2 ELSE e.y1 END AS qy
       FROM b2_e e JOIN sgn s ON s.fid = e.fid AND s.part = e.part AND s.ring = e.ring),
vert AS (SELECT DISTINCT px AS x, py AS y FROM oe),
ne AS (SELECT row_number() OVER () AS id, * FROM oe),
stops AS (SELECT id, px AS x, py AS y, 0.0 AS t FROM ne UNION ALL SELECT id, qx, qy, 1.0 FROM ne
          UNION ALL SELECT id, x, y, CASE WHEN qx <> px THEN (x - px) / (qx - px) ELSE (y - py) / (qy - py) END FROM ne JOIN vert
            ON (qx - px) * (y - py) = (qy - py) * (x - px) AND x BETWEEN least(px, qx) AND greatest(px, qx) AND y BETWEEN least(py, qy) AND greatest(py, qy)
            AND NOT (x = px AND y = py) AND NOT (x = qx AND y = qy)),
pe AS (SELECT x AS px, y AS py, lead(x) OVER w AS qx, lead(y) OVER w AS qy FROM stops WINDOW w AS (PARTITION BY id ORDER BY t)),
ke AS (SELECT *, (px < qx OR (px = qx AND py < qy)) AS fwd FROM pe WHERE qx IS NOT NULL),
kk AS (SELECT CASE WHEN fwd THEN px ELSE qx END AS ux, CASE WHEN fwd THEN py ELSE qy END AS uy,
              CASE WHEN fwd THEN qx ELSE px END AS vx, CASE WHEN fwd THEN qy ELSE py END AS vy, px, py, qx, qy FROM ke),
free AS (SELECT any_value(px) AS px, any_value(py) AS py, any_value(qx) AS qx, any_value(qy) AS qy
         FROM kk GROUP BY ux, uy, vx, vy HAVING count(*) = 1),
fe AS (SELECT CAST(px AS VARCHAR) || ',' || CAST(py AS VARCHAR) AS a, CAST(qx AS VARCHAR) || ',' || CAST(qy AS VARCHAR) AS b,
              px, py, qx, qy FROM free),
und AS (SELECT a AS s, b AS d FROM fe UNION SELECT b, a FROM fe)"""
_GAPS_END = """,
walk(node, comp) AS (SELECT s, s FROM und UNION SELECT u.d, w.comp FROM walk w JOIN und u ON u.s = w.node),
lab AS (SELECT node, min(comp) AS comp FROM walk GROUP BY node),
rings AS (SELECT l.comp, sum(fe.px * fe.qy - fe.qx * fe.py) / 2 AS sa, count(*) AS n FROM fe JOIN lab l ON l.node = fe.a GROUP BY l.comp)
SELECT 'TopologicalGaps' AS error_type, round(-sa, 6) AS metric, round(CAST(n AS DOUBLE), 6) AS metric2 FROM rings WHERE sa < 0"""



def _gaps_sql(*ctes: str) -> str:
    return with_(*ctes, _GAPS_CTES).replace("WITH ", "WITH RECURSIVE ", 1) + _GAPS_END


@register("topological_gaps", _gaps_sql(*b2_ctes()))
def q_topological_gaps(spark, sf):
    """P18 (re-aimed): holes of the suburb coverage, one row per gap ring."""
    return _cmp(P.topological_gaps(_suburb_parts(spark, sf))).drop("fid", "part", "other_fid", "other_part")


# Every second row of the coverage moved by half a square: its corners lie on the neighbours' sides.
_BRICKS = [FX.suburbs_sql("base").replace("b2_v AS (", "b2_v0 AS (") + ",\nb2_v AS (SELECT fid, part, ring, seq, x + 8 * ((fid // 50) % 2) AS x, y FROM b2_v0)", *b2_ctes()[1:]]


@register("topological_gaps_bricks", _gaps_sql(*_BRICKS))
def q_topological_gaps_bricks(spark, sf):
    """P18 behind T-junctions: the coverage laid like bricks."""
    from vectorlint.operators import spatial as S
    f = _suburbs(spark, sf).withColumn("geom", F.expr("named_struct('type', geom.type, 'coords', transform(geom.coords, p -> transform(p, r -> transform(r, q -> "
                                                      "named_struct('x', q.x + 8 * ((fid div 50) % 2), 'y', q.y)))))"))
    return _cmp(P.topological_gaps(S.parts(f))).drop("fid", "part", "other_fid", "other_part")


_EXTENT = """ext AS (SELECT min(minx) AS x0, min(miny) AS y0, floor((min(minx) + 2 * max(maxx)) / 3) + 0.5 AS x1, floor((min(miny) + 2 * max(maxy)) / 3) + 0.25 AS y1 FROM b2_bx),
inb AS (SELECT p.fid, p.part, p.area, b.minx, b.miny, b.maxx, b.maxy, x0, y0, x1, y1 FROM b2_pa p JOIN b2_bx b ON b.fid = p.fid AND b.part = p.part, ext)"""


@register("outside_extent", with_(*b2_ctes(), _EXTENT) + f"""
SELECT {vsel(part='part', et='OutsideExtent', m='area - greatest(0, least(maxx, x1) - greatest(minx, x0)) * greatest(0, least(maxy, y1) - greatest(miny, y0))')}
FROM inb WHERE maxx > x1 OR maxy > y1""")
def q_outside_extent(spark, sf):
    """suburb parts (boxes) not within an extent of two thirds of the coverage each way."""
    from vectorlint.operators.feature import outside_extent
    sp = _suburb_parts(spark, sf)
    e = sp.agg(F.min("minx").alias("x0"), F.min("miny").alias("y0"), F.expr("floor((min(minx) + 2 * max(maxx)) / 3) + 0.5D").alias("x1"), F.expr("floor((min(miny) + 2 * max(maxy)) / 3) + 0.25D").alias("y1"))
    corner = lambda x, y: f"named_struct('x', {x}, 'y', {y})"
    ring = ", ".join(corner(x, y) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0")))
    extent = e.select(F.lit(-1).cast("bigint").alias("fid"), F.expr(f"named_struct('type', 'Polygon', 'coords', array(array(array({ring}))))").alias("geom"))
    from vectorlint.operators import spatial as S
    keys = ["fid", "part", "gtype", "rings", "minx", "miny", "maxx", "maxy", "nedges"]
    return _cmp(outside_extent(sp.select(*keys), S.parts(extent).select(*keys)))


_EXTENTS = """ext AS (SELECT fid, minx - 8 AS x0, miny - 4 AS y0, maxx + 8 + fid % 5 AS x1, maxy + 4 + fid % 3 AS y1 FROM b2_bx WHERE fid % 4 <> 3),
hit AS (SELECT b.fid, b.part, e.fid AS efid, greatest(b.minx, x0) AS x0, greatest(b.miny, y0) AS y0, least(b.maxx, x1) AS x1, least(b.maxy, y1) AS y1
        FROM b2_bx b JOIN ext e ON x0 < b.maxx AND x1 > b.minx AND y0 < b.maxy AND y1 > b.miny),
xs AS (SELECT fid, part, x, lead(x) OVER (PARTITION BY fid, part ORDER BY x) AS nx FROM (SELECT fid, part, x0 AS x FROM hit UNION SELECT fid, part, x1 FROM hit)),
ys AS (SELECT fid, part, y, lead(y) OVER (PARTITION BY fid, part ORDER BY y) AS ny FROM (SELECT fid, part, y0 AS y FROM hit UNION SELECT fid, part, y1 FROM hit)),
cov AS (SELECT xs.fid, xs.part, sum((nx - x) * (ny - y)) AS covered FROM xs JOIN ys ON ys.fid = xs.fid AND ys.part = xs.part
        WHERE nx IS NOT NULL AND ny IS NOT NULL AND EXISTS (SELECT 1 FROM hit h WHERE h.fid = xs.fid AND h.part = xs.part AND h.x0 <= x AND h.x1 >= nx AND h.y0 <= y AND h.y1 >= ny) GROUP BY ALL)"""


@register("outside_extent_overlapping", with_(*b2_ctes(), _EXTENTS) + f"""
SELECT {vsel(fid='p.fid', part='p.part', et='OutsideExtent', m='p.area - coalesce(c.covered, 0)')}
FROM b2_pa p LEFT JOIN cov c ON c.fid = p.fid AND c.part = p.part WHERE coalesce(c.covered, 0) < p.area - 1e-9 * p.area""")
def q_outside_extent_overlapping(spark, sf):
    """F21 with an extent of many boxes around three of four suburbs, which overlap each other."""
    from vectorlint.operators import spatial as S
    from vectorlint.operators.feature import outside_extent
    sp = _suburb_parts(spark, sf)
    box = sp.where("fid % 4 <> 3").selectExpr("fid", "minx - 8 AS x0", "miny - 4 AS y0", "maxx + 8 + fid % 5 AS x1", "maxy + 4 + fid % 3 AS y1")
    ring = ", ".join(f"named_struct('x', CAST({x} AS DOUBLE), 'y', CAST({y} AS DOUBLE))" for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0")))
    extent = S.parts(box.select("fid", F.expr(f"named_struct('type', 'Polygon', 'coords', array(array(array({ring}))))").alias("geom")))
    return _cmp(outside_extent(sp, extent))
