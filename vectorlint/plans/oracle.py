"""DuckDB SQL twins of the spatial kernels, for the correctness oracle.

The oracle works on flat vertex rows ``v(fid, part, ring, seq, x, y)`` and
uses plain inequality joins where Spark uses the grid-cell equi-join, so a
wrong cell rule in the Spark plan shows up as a mismatch.
"""

from __future__ import annotations


def edges_sql(v: str, out: str = "e") -> str:
    """CTE ``{out}(fid, part, ring, seq, x1, y1, x2, y2)`` from vertex CTE ``v``."""
    return f"""
{out} AS (
  SELECT a.fid, a.part, a.ring, a.seq, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
  FROM {v} a JOIN {v} b ON a.fid = b.fid AND a.part = b.part AND a.ring = b.ring AND b.seq = a.seq + 1
)"""


def part_boxes_sql(v: str, out: str = "bx") -> str:
    return f"""
{out} AS (
  SELECT fid, part, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy
  FROM {v} GROUP BY fid, part
)"""


def ring_area_sql(e: str, out: str = "ra") -> str:
    """Signed ring areas (shoelace on absolute coordinates)."""
    return f"""
{out} AS (
  SELECT fid, part, ring, sum(x1 * y2 - x2 * y1) / 2 AS sa FROM {e} GROUP BY fid, part, ring
)"""


def part_area_sql(ra: str, out: str = "pa") -> str:
    return f"""
{out} AS (
  SELECT fid, part, sum(CASE WHEN ring = 0 THEN abs(sa) ELSE -abs(sa) END) AS area FROM {ra} GROUP BY fid, part
)"""


def box_pairs_sql(bx: str, out: str = "cand", eps: float = 0.0, where: str = "TRUE") -> str:
    """Unordered pairs of parts whose closed boxes meet (a < b by fid, part)."""
    return f"""
{out} AS (
  SELECT a.fid AS a_fid, a.part AS a_part, b.fid AS b_fid, b.part AS b_part,
         a.minx AS a_minx, a.miny AS a_miny, a.maxx AS a_maxx, a.maxy AS a_maxy,
         b.minx AS b_minx, b.miny AS b_miny, b.maxx AS b_maxx, b.maxy AS b_maxy
  FROM {bx} a JOIN {bx} b
    ON (a.fid < b.fid OR (a.fid = b.fid AND a.part < b.part))
   AND a.minx - {eps} <= b.maxx + {eps} AND b.minx - {eps} <= a.maxx + {eps}
   AND a.miny - {eps} <= b.maxy + {eps} AND b.miny - {eps} <= a.maxy + {eps}
  WHERE {where}
)"""


def _trap(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2, u, v) -> str:
    fa = lambda x: f"({ay1} + ({x} - {ax1}) * ({ay2} - {ay1}) / ({ax2} - {ax1}))"
    fb = lambda x: f"({by1} + ({x} - {bx1}) * ({by2} - {by1}) / ({bx2} - {bx1}))"
    du, dv = f"({fa(u)} - {fb(u)})", f"({fa(v)} - {fb(v)})"
    w = f"({u} + ({v} - {u}) * {du} / ({du} - {dv}))"
    mu, mv = f"least({fa(u)}, {fb(u)})", f"least({fa(v)}, {fb(v)})"
    return (f"CASE WHEN {du} * {dv} < 0 THEN ({w} - {u}) * ({mu} + {fa(w)}) / 2 + ({v} - {w}) * ({fa(w)} + {mv}) / 2 "
            f"ELSE ({v} - {u}) * ({mu} + {mv}) / 2 END")


def overlap_area_sql(e: str, ra: str, cand: str, out: str = "ov") -> str:
    """``{out}(a_fid, a_part, b_fid, b_part, area)`` for candidate pairs with a
    positive-area box overlap: signed sum over x-overlapping edge pairs of
    the integral of min(f_a, f_b), coordinates shifted to the pair origin."""
    trap = _trap("ax1", "ay1", "ax2", "ay2", "bx1", "by1", "bx2", "by2", "u", "v")
    return f"""
{out}_se AS (
  SELECT e.fid, e.part, e.x1, e.y1, e.x2, e.y2,
         CASE WHEN e.x2 < e.x1 THEN 1.0 ELSE -1.0 END
         * CASE WHEN (e.ring = 0) = (r.sa > 0) THEN 1.0 ELSE -1.0 END AS s
  FROM {e} e JOIN {ra} r ON e.fid = r.fid AND e.part = r.part AND e.ring = r.ring
  WHERE e.x1 <> e.x2
),
{out}_pp AS (
  SELECT a_fid, a_part, b_fid, b_part, least(a_minx, b_minx) AS ox, least(a_miny, b_miny) AS oy
  FROM {cand}
  WHERE least(a_maxx, b_maxx) > greatest(a_minx, b_minx) AND least(a_maxy, b_maxy) > greatest(a_miny, b_miny)
),
{out}_ep AS (
  SELECT p.a_fid, p.a_part, p.b_fid, p.b_part, ea.s * eb.s AS ss,
         ea.x1 - p.ox AS ax1, ea.y1 - p.oy AS ay1, ea.x2 - p.ox AS ax2, ea.y2 - p.oy AS ay2,
         eb.x1 - p.ox AS bx1, eb.y1 - p.oy AS by1, eb.x2 - p.ox AS bx2, eb.y2 - p.oy AS by2,
         greatest(least(ea.x1, ea.x2), least(eb.x1, eb.x2)) - p.ox AS u,
         least(greatest(ea.x1, ea.x2), greatest(eb.x1, eb.x2)) - p.ox AS v
  FROM {out}_pp p
  JOIN {out}_se ea ON ea.fid = p.a_fid AND ea.part = p.a_part
  JOIN {out}_se eb ON eb.fid = p.b_fid AND eb.part = p.b_part
  WHERE greatest(least(ea.x1, ea.x2), least(eb.x1, eb.x2)) < least(greatest(ea.x1, ea.x2), greatest(eb.x1, eb.x2))
),
{out} AS (
  SELECT a_fid, a_part, b_fid, b_part, sum(ss * ({trap})) AS area FROM {out}_ep GROUP BY a_fid, a_part, b_fid, b_part
)"""


def seg_intersect_sql(a: str, b: str) -> str:
    """Closed segments ``a`` and ``b`` (columns x1, y1, x2, y2) share a point,
    touching and collinear overlap included: boxes meet and both orientation
    products are <= 0."""
    def orient(p, qx, qy):
        return f"(({p}.x2 - {p}.x1) * ({qy} - {p}.y1) - ({p}.y2 - {p}.y1) * ({qx} - {p}.x1))"
    d1, d2 = orient(a, f"{b}.x1", f"{b}.y1"), orient(a, f"{b}.x2", f"{b}.y2")
    d3, d4 = orient(b, f"{a}.x1", f"{a}.y1"), orient(b, f"{a}.x2", f"{a}.y2")
    box = (f"least({a}.x1, {a}.x2) <= greatest({b}.x1, {b}.x2) AND least({b}.x1, {b}.x2) <= greatest({a}.x1, {a}.x2) "
           f"AND least({a}.y1, {a}.y2) <= greatest({b}.y1, {b}.y2) AND least({b}.y1, {b}.y2) <= greatest({a}.y1, {a}.y2)")
    return f"({box} AND sign({d1}) * sign({d2}) <= 0 AND sign({d3}) * sign({d4}) <= 0)"


def contacts_sql(e: str, cand: str, out: str = "ct") -> str:
    """``{out}(a_fid, a_part, b_fid, b_part, shared_len)`` for candidate pairs
    whose boundaries meet (some edge pair shares a point); shared_len sums
    the collinear overlaps measured along a's edges."""
    return f"""
{out}_ep AS (
  SELECT c.a_fid, c.a_part, c.b_fid, c.b_part,
         ea.x1 AS ax1, ea.y1 AS ay1, ea.x2 AS ax2, ea.y2 AS ay2, eb.x1 AS bx1, eb.y1 AS by1, eb.x2 AS bx2, eb.y2 AS by2
  FROM {cand} c
  JOIN {e} ea ON ea.fid = c.a_fid AND ea.part = c.a_part
  JOIN {e} eb ON eb.fid = c.b_fid AND eb.part = c.b_part
  WHERE {seg_intersect_sql('ea', 'eb')}
),
{out}_d AS (
  SELECT *, ((ax2 - ax1) * (by1 - ay1) - (ay2 - ay1) * (bx1 - ax1)) AS d1,
            ((ax2 - ax1) * (by2 - ay1) - (ay2 - ay1) * (bx2 - ax1)) AS d2,
            sqrt((ax2 - ax1) * (ax2 - ax1) + (ay2 - ay1) * (ay2 - ay1)) AS la
  FROM {out}_ep
),
{out}_t AS (
  SELECT *, CASE WHEN la > 0 THEN ((bx1 - ax1) * (ax2 - ax1) + (by1 - ay1) * (ay2 - ay1)) / la END AS t1,
            CASE WHEN la > 0 THEN ((bx2 - ax1) * (ax2 - ax1) + (by2 - ay1) * (ay2 - ay1)) / la END AS t2
  FROM {out}_d
),
{out} AS (
  SELECT a_fid, a_part, b_fid, b_part,
         sum(CASE WHEN d1 = 0 AND d2 = 0 AND la > 0 THEN greatest(0, least(greatest(t1, t2), la) - greatest(least(t1, t2), 0)) ELSE 0 END) AS shared_len
  FROM {out}_t GROUP BY a_fid, a_part, b_fid, b_part
)"""


def pt_seg_sql(px, py, x1, y1, x2, y2) -> str:
    l2 = f"(({x2} - {x1}) * ({x2} - {x1}) + ({y2} - {y1}) * ({y2} - {y1}))"
    t = f"greatest(0.0, least(1.0, (({px} - {x1}) * ({x2} - {x1}) + ({py} - {y1}) * ({y2} - {y1})) / {l2}))"
    return (f"CASE WHEN {l2} = 0 THEN sqrt(({px} - {x1}) * ({px} - {x1}) + ({py} - {y1}) * ({py} - {y1})) ELSE "
            f"sqrt(({px} - ({x1} + {t} * ({x2} - {x1}))) * ({px} - ({x1} + {t} * ({x2} - {x1}))) + "
            f"({py} - ({y1} + {t} * ({y2} - {y1}))) * ({py} - ({y1} + {t} * ({y2} - {y1})))) END")


def seg_dist_sql(a: str, b: str) -> str:
    """Distance between closed segments a and b."""
    return (f"CASE WHEN {seg_intersect_sql(a, b)} THEN 0.0 ELSE least("
            f"{pt_seg_sql(f'{a}.x1', f'{a}.y1', f'{b}.x1', f'{b}.y1', f'{b}.x2', f'{b}.y2')}, "
            f"{pt_seg_sql(f'{a}.x2', f'{a}.y2', f'{b}.x1', f'{b}.y1', f'{b}.x2', f'{b}.y2')}, "
            f"{pt_seg_sql(f'{b}.x1', f'{b}.y1', f'{a}.x1', f'{a}.y1', f'{a}.x2', f'{a}.y2')}, "
            f"{pt_seg_sql(f'{b}.x2', f'{b}.y2', f'{a}.x1', f'{a}.y1', f'{a}.x2', f'{a}.y2')}) END")


def validity_sql(v: str, p: str) -> str:
    """CTEs up to ``{p}_rank(fid, rank)``: reasons of invalid features from vertices ``v``.

    Plain all-pairs joins of edges and rings within a feature; needs WITH RECURSIVE."""
    ring = "fid, part, ring"

    def orient(a, x, y):
        return f"(({a}.x2 - {a}.x1) * ({y} - {a}.y1) - ({a}.y2 - {a}.y1) * ({x} - {a}.x1))"

    inside = """(SELECT count(*) % 2 FROM {p}_e s WHERE s.fid = q.fid AND s.part = o.part AND s.ring = o.ring AND (s.y1 > q.y) <> (s.y2 > q.y)
                 AND q.x < s.x1 + (q.y - s.y1) * (s.x2 - s.x1) / (s.y2 - s.y1))""".format(p=p)
    on = f"EXISTS (SELECT 1 FROM {p}_e s WHERE s.fid = q.fid AND s.part = o.part AND s.ring = o.ring AND {orient('s', 'q.x', 'q.y')} = 0 AND q.x BETWEEN least(s.x1, s.x2) AND greatest(s.x1, s.x2) AND q.y BETWEEN least(s.y1, s.y2) AND greatest(s.y1, s.y2))"
    return f"""
{p}_d AS (
  SELECT {ring}, row_number() OVER (PARTITION BY {ring} ORDER BY seq) - 1 AS seq, x, y
  FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM {v} WINDOW w AS (PARTITION BY {ring} ORDER BY seq)) WHERE px IS NULL OR px <> x OR py <> y
),{edges_sql(f'{p}_d', f'{p}_e')},
{p}_n AS (SELECT {ring}, count(*) AS n FROM {p}_e GROUP BY {ring}),
{p}_m AS (
  SELECT a.fid, a.part AS ap, a.ring AS ar, b.part AS bp, b.ring AS br, {orient('a', 'b.x1', 'b.y1')} AS d1, {orient('a', 'b.x2', 'b.y2')} AS d2, {orient('b', 'a.x1', 'a.y1')} AS d3, {orient('b', 'a.x2', 'a.y2')} AS d4,
         greatest(least(a.x1, a.x2), least(b.x1, b.x2)) < least(greatest(a.x1, a.x2), greatest(b.x1, b.x2)) OR greatest(least(a.y1, a.y2), least(b.y1, b.y2)) < least(greatest(a.y1, a.y2), greatest(b.y1, b.y2)) AS wide,
         CASE WHEN {orient('a', 'b.x1', 'b.y1')} = 0 AND b.x1 BETWEEN least(a.x1, a.x2) AND greatest(a.x1, a.x2) AND b.y1 BETWEEN least(a.y1, a.y2) AND greatest(a.y1, a.y2) THEN [b.x1, b.y1]
              WHEN {orient('a', 'b.x2', 'b.y2')} = 0 AND b.x2 BETWEEN least(a.x1, a.x2) AND greatest(a.x1, a.x2) AND b.y2 BETWEEN least(a.y1, a.y2) AND greatest(a.y1, a.y2) THEN [b.x2, b.y2]
              WHEN {orient('b', 'a.x1', 'a.y1')} = 0 AND a.x1 BETWEEN least(b.x1, b.x2) AND greatest(b.x1, b.x2) AND a.y1 BETWEEN least(b.y1, b.y2) AND greatest(b.y1, b.y2) THEN [a.x1, a.y1]
              ELSE [a.x2, a.y2] END AS pt
  FROM {p}_e a JOIN {p}_e b ON a.fid = b.fid AND (a.part, a.ring, a.seq) < (b.part, b.ring, b.seq) JOIN {p}_n n ON n.fid = a.fid AND n.part = a.part AND n.ring = a.ring
  WHERE NOT (a.part = b.part AND a.ring = b.ring AND (b.seq = a.seq + 1 OR (a.seq = 0 AND b.seq = n.n - 1))) AND {seg_intersect_sql('a', 'b')}
),
{p}_k AS (SELECT *, CASE WHEN d1 * d2 < 0 AND d3 * d4 < 0 OR (d1 = 0 AND d2 = 0 AND wide) THEN 3 WHEN ap = bp AND ar = br THEN 4 END AS rank FROM {p}_m),
{p}_inc AS (
  SELECT DISTINCT fid, ap AS part, 'r' || ar AS r, 'p' || pt[1] || ' ' || pt[2] AS q FROM {p}_k WHERE rank IS NULL AND ap = bp
  UNION SELECT DISTINCT fid, ap, 'r' || br, 'p' || pt[1] || ' ' || pt[2] FROM {p}_k WHERE rank IS NULL AND ap = bp
),
{p}_reach(fid, part, x, y) AS (
  SELECT fid, part, r, r FROM {p}_inc UNION SELECT fid, part, q, q FROM {p}_inc
  UNION SELECT c.fid, c.part, c.x, CASE WHEN c.y = i.r THEN i.q ELSE i.r END FROM {p}_reach c JOIN {p}_inc i ON i.fid = c.fid AND i.part = c.part AND (c.y = i.r OR c.y = i.q)
),
{p}_comp AS (SELECT fid, part, x, min(y) AS c FROM {p}_reach GROUP BY fid, part, x),
{p}_loop AS (
  SELECT n.fid, n.part FROM (SELECT fid, part, count(*) AS nodes, count(DISTINCT c) AS comps FROM {p}_comp GROUP BY fid, part) n
  JOIN (SELECT fid, part, count(*) AS links FROM {p}_inc GROUP BY fid, part) l ON l.fid = n.fid AND l.part = n.part WHERE l.links > n.nodes - n.comps
),
{p}_in AS (
  SELECT q.fid, q.part, q.ring, o.part AS in_part, o.ring AS in_ring, bool_and({inside} = 1 OR {on}) AS within, bool_or({inside} = 1 AND NOT {on}) AS any_in
  FROM {p}_d q JOIN (SELECT DISTINCT {ring} FROM {p}_d) o ON o.fid = q.fid AND (o.part, o.ring) <> (q.part, q.ring) GROUP BY ALL
),
{p}_all AS (
  SELECT fid, rank FROM {p}_k WHERE rank IS NOT NULL
  UNION ALL SELECT fid, 1 FROM {p}_n WHERE n < 3
  UNION ALL SELECT a.fid, 3 FROM {p}_e a JOIN {p}_n n USING ({ring}) JOIN {p}_e b ON b.fid = a.fid AND b.part = a.part AND b.ring = a.ring AND b.seq = (a.seq + 1) % n.n
            WHERE {orient('a', 'b.x2', 'b.y2')} = 0 AND (a.x2 - a.x1) * (b.x2 - b.x1) + (a.y2 - a.y1) * (b.y2 - b.y1) < 0
  UNION ALL SELECT fid, 5 FROM {p}_in WHERE ring > 0 AND in_part = part AND in_ring = 0 AND NOT any_in
  UNION ALL SELECT fid, 6 FROM {p}_in WHERE ring > 0 AND in_part = part AND in_ring > 0 AND within AND any_in
  UNION ALL SELECT i.fid, 7 FROM {p}_in i WHERE i.ring = 0 AND i.in_part <> i.part AND i.in_ring = 0 AND i.within AND i.any_in
            AND NOT EXISTS (SELECT 1 FROM {p}_in h WHERE h.fid = i.fid AND h.part = i.part AND h.ring = 0 AND h.in_part = i.in_part AND h.in_ring > 0 AND h.within)
  UNION ALL SELECT fid, 8 FROM {p}_loop
),
{p}_rank AS (SELECT fid, min(rank) AS rank FROM {p}_all GROUP BY fid)"""


def hull_sql(e: str, out: str = "hull") -> str:
    """``{out}(fid, part, area)``: convex hull area by supporting edges.  An ordered
    pair of a part's points is a side of its hull if no point lies to the right
    of it and none on its line beyond its ends."""
    cross = "((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x))"
    eps = "1e-9 * ((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))"
    return f"""
{out}_p AS (
  SELECT DISTINCT e.fid, e.part, e.x1 - o.ox AS x, e.y1 - o.oy AS y
  FROM {e} e JOIN (SELECT fid, part, min(x1) AS ox, min(y1) AS oy FROM {e} GROUP BY fid, part) o ON o.fid = e.fid AND o.part = e.part
),
{out}_s AS (
  SELECT a.fid, a.part, a.x * b.y - b.x * a.y AS twice
  FROM {out}_p a JOIN {out}_p b ON a.fid = b.fid AND a.part = b.part AND (a.x <> b.x OR a.y <> b.y)
  JOIN {out}_p c ON a.fid = c.fid AND a.part = c.part
  GROUP BY a.fid, a.part, a.x, a.y, b.x, b.y
  HAVING bool_and({cross} > {eps} OR (abs({cross}) <= {eps}
         AND c.x BETWEEN least(a.x, b.x) AND greatest(a.x, b.x) AND c.y BETWEEN least(a.y, b.y) AND greatest(a.y, b.y)))
),
{out} AS (SELECT p.fid, p.part, coalesce(any_value(s.t), 0) / 2 AS area FROM {out}_p p
  LEFT JOIN (SELECT fid, part, sum(twice) AS t FROM {out}_s GROUP BY fid, part) s ON s.fid = p.fid AND s.part = p.part GROUP BY p.fid, p.part)"""
