"""Geometry measures as Spark SQL column expressions.

Every function here returns a SQL fragment over a geometry column (the
``model.GEOMETRY`` struct) or over its parts/rings, built from the
higher-order functions ``transform`` / ``aggregate`` / ``filter``.  They run
inside whole-stage codegen, per row, with no shuffle and no Python.  The
``col`` wrappers at the bottom return ``Column`` objects.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ids = itertools.count()


def _v(name: str) -> str:
    """A fresh lambda variable name, so nested lambdas never shadow."""
    return f"{name}_{next(_ids)}"


# ---------------------------------------------------------------- rings ----

def ring_signed_area(r: str) -> str:
    """Shoelace as a fan from the first vertex (shifted for precision).
    Positive = counter-clockwise.  Rings with < 3 points have area 0."""
    a, i = _v("a"), _v("i")
    return (f"(CASE WHEN size({r}) < 3 THEN 0D ELSE aggregate(sequence(1, size({r}) - 2), 0D, "
            f"({a}, {i}) -> {a} + (({r}[{i}].x - {r}[0].x) * ({r}[{i} + 1].y - {r}[0].y) "
            f"- ({r}[{i} + 1].x - {r}[0].x) * ({r}[{i}].y - {r}[0].y))) / 2 END)")


def orientation(px1: str, py1: str, px2: str, py2: str, qx: str, qy: str) -> str:
    """Twice the signed area of (p1, p2, q): > 0 if q lies to the left of p1 -> p2.

    Plain arithmetic decides where its error bound allows; otherwise the
    determinant is expanded in double-double: differences and products are kept
    with their exact rounding errors, so that the sign is right down to about
    1e-30 of the products."""
    s, t, w, e = (_v(n) for n in "stwe")
    left, right = f"(({px2}) - ({px1})) * (({qy}) - ({py1}))", f"(({py2}) - ({py1})) * (({qx}) - ({px1}))"

    def rest(a: str, b: str) -> str:            # rounding error of a - b
        d = f"(({a}) - ({b}))"
        return f"((({a}) - ({d} + (({a}) - {d}))) + ((({a}) - {d}) - ({b})))"

    def excess(a: int, b: int) -> str:          # rounding error of h_a * h_b, from their 26-bit halves g and l
        return f"({w}.l{a} * {w}.l{b} - ((({w}.h{a} * {w}.h{b} - {w}.g{a} * {w}.g{b}) - {w}.l{a} * {w}.g{b}) - {w}.g{a} * {w}.l{b}))"

    def keep(v: str, *names: str) -> str:
        return ", ".join(f"'{n}{k}', {v}.{n}{k}" for n in names for k in range(4))

    ends = [(px2, px1), (qy, py1), (py2, py1), (qx, px1)]
    first = ", ".join(f"'h{k}', ({a}) - ({b}), 't{k}', {rest(a, b)}" for k, (a, b) in enumerate(ends))
    high = ", ".join(f"'g{k}', 134217729D * {s}.h{k} - (134217729D * {s}.h{k} - {s}.h{k})" for k in range(4))
    low = ", ".join(f"'l{k}', {t}.h{k} - {t}.g{k}" for k in range(4))
    products = (f"'p', {w}.h0 * {w}.h1, 'pe', {excess(0, 1)} + ({w}.h0 * {w}.t1 + {w}.t0 * {w}.h1), "
                f"'r', {w}.h2 * {w}.h3, 're', {excess(2, 3)} + ({w}.h2 * {w}.t3 + {w}.t2 * {w}.h3)")
    exact = f"array(named_struct({first}))"
    for v, fields in ((s, f"{keep(s, 'h', 't')}, {high}"), (t, f"{keep(t, 'h', 't', 'g')}, {low}"), (w, products)):
        exact = f"transform({exact}, {v} -> named_struct({fields}))"
    exact = f"transform({exact}, {e} -> ({e}.p - {e}.r) + ({rest(f'{e}.p', f'{e}.r')} + ({e}.pe - {e}.re)))[0]"
    return (f"(CASE WHEN abs({left} - {right}) > 4e-16D * (abs({left}) + abs({right})) THEN {left} - {right} "
            f"WHEN {left} = 0 AND {right} = 0 THEN 0D ELSE {exact} END)")


def ring_length(r: str) -> str:
    a, i = _v("a"), _v("i")
    return (f"(CASE WHEN size({r}) < 2 THEN 0D ELSE aggregate(sequence(0, size({r}) - 2), 0D, "
            f"({a}, {i}) -> {a} + hypot({r}[{i} + 1].x - {r}[{i}].x, {r}[{i} + 1].y - {r}[{i}].y)) END)")


def ring_edge_lengths(r: str) -> str:
    i = _v("i")
    return (f"(CASE WHEN size({r}) < 2 THEN array() ELSE transform(sequence(0, size({r}) - 2), "
            f"{i} -> hypot({r}[{i} + 1].x - {r}[{i}].x, {r}[{i} + 1].y - {r}[{i}].y)) END)")


def ring_min_edge(r: str) -> str:
    """Shortest edge; NULL for a ring without edges."""
    return f"array_min({ring_edge_lengths(r)})"


def ring_is_closed(r: str) -> str:
    return f"(size({r}) > 0 AND {r}[0].x = {r}[size({r}) - 1].x AND {r}[0].y = {r}[size({r}) - 1].y)"


def ring_interior_angles(r: str, skip_first: bool = True) -> str:
    """Angle in degrees at each vertex of a closed ring.

    ``skip_first``: angles at vertices 1..n-2 (vertex 0 / the closing vertex
    is not looked at), as the library rule does.  Otherwise every vertex is
    covered (the notebook variant, with wrap-around).  A zero-length side
    gives NULL (ignored by array_min)."""
    i = _v("i")
    n = f"(size({r}) - 1)"   # distinct vertices of a closed ring
    if skip_first:
        prev_ = f"{r}[{i} - 1]"
        next_ = f"{r}[{i} + 1]"
        rng = f"sequence(1, size({r}) - 2)"
    else:
        prev_ = f"{r}[({i} + {n} - 1) % {n}]"
        next_ = f"{r}[({i} + 1) % {n}]"
        rng = f"sequence(0, {n} - 1)"
    cur = f"{r}[{i}]"
    ux, uy = f"({prev_}.x - {cur}.x)", f"({prev_}.y - {cur}.y)"
    vx, vy = f"({next_}.x - {cur}.x)", f"({next_}.y - {cur}.y)"
    cosv = f"(({ux} * {vx} + {uy} * {vy}) / (hypot({ux}, {uy}) * hypot({vx}, {vy})))"
    ang = (f"CASE WHEN hypot({ux}, {uy}) = 0 OR hypot({vx}, {vy}) = 0 THEN CAST(NULL AS DOUBLE) "
           f"ELSE degrees(acos(greatest(-1D, least(1D, {cosv})))) END")
    return f"(CASE WHEN size({r}) < 4 THEN CAST(array() AS array<double>) ELSE transform({rng}, {i} -> {ang}) END)"


# ---------------------------------------------------------------- parts ----

def part_area(rings: str) -> str:
    """Polygon part area: |exterior| - sum |holes|."""
    r, j = _v("r"), _v("j")
    terms = f"transform({rings}, ({r}, {j}) -> CASE WHEN {j} = 0 THEN abs({ring_signed_area(r)}) ELSE -abs({ring_signed_area(r)}) END)"
    a, t = _v("a"), _v("t")
    return f"aggregate({terms}, 0D, ({a}, {t}) -> {a} + {t})"


def part_hole_areas(rings: str) -> str:
    r = _v("r")
    return f"transform(slice({rings}, 2, greatest(size({rings}) - 1, 0)), {r} -> abs({ring_signed_area(r)}))"


def part_exterior_area(rings: str) -> str:
    return f"(CASE WHEN size({rings}) = 0 THEN 0D ELSE abs({ring_signed_area(f'{rings}[0]')}) END)"


def part_perimeter(rings: str) -> str:
    r, a, t = _v("r"), _v("a"), _v("t")
    return f"aggregate(transform({rings}, {r} -> {ring_length(r)}), 0D, ({a}, {t}) -> {a} + {t})"


def _sum(arr: str) -> str:
    a, t = _v("a"), _v("t")
    return f"aggregate({arr}, 0D, ({a}, {t}) -> {a} + {t})"


# ------------------------------------------------------------ geometries ----

def all_points(g: str) -> str:
    return f"flatten(flatten({g}.coords))"


def geom_area(g: str) -> str:
    """Area of a polygonal geometry, holes subtracted; 0 for other types."""
    p = _v("p")
    return (f"(CASE WHEN {g}.type IN ('Polygon', 'MultiPolygon') "
            f"THEN {_sum(f'transform({g}.coords, {p} -> {part_area(p)})')} ELSE 0D END)")


def geom_hole_area(g: str) -> str:
    p, h = _v("p"), _v("h")
    return (f"(CASE WHEN {g}.type IN ('Polygon', 'MultiPolygon') THEN "
            f"{_sum(f'flatten(transform({g}.coords, {p} -> {part_hole_areas(p)}))')} ELSE 0D END)")


def geom_exterior_area(g: str) -> str:
    p = _v("p")
    return f"{_sum(f'transform({g}.coords, {p} -> {part_exterior_area(p)})')}"


def geom_length(g: str) -> str:
    """Perimeter incl. hole rings for polygons, length for lines, 0 for points."""
    p = _v("p")
    return f"{_sum(f'transform({g}.coords, {p} -> {part_perimeter(p)})')}"


def geom_npoints(g: str) -> str:
    return f"size({all_points(g)})"


def geom_is_empty(g: str) -> str:
    return f"({g} IS NULL OR {g}.coords IS NULL OR size({all_points(g)}) = 0)"


def geom_bounds(g: str) -> dict[str, str]:
    pts, q = all_points(g), _v("q")
    return {
        "minx": f"array_min(transform({pts}, {q} -> {q}.x))",
        "miny": f"array_min(transform({pts}, {q} -> {q}.y))",
        "maxx": f"array_max(transform({pts}, {q} -> {q}.x))",
        "maxy": f"array_max(transform({pts}, {q} -> {q}.y))",
    }


def _ring_moments(r: str) -> str:
    """struct(a, mx, my): signed area and signed first moments (x 6A) of a
    ring, fan-triangulated from the ring's first vertex ``o``."""
    acc, i = _v("m"), _v("i")
    o = f"{r}[0]"
    x1, y1 = f"({r}[{i}].x - {o}.x)", f"({r}[{i}].y - {o}.y)"
    x2, y2 = f"({r}[{i} + 1].x - {o}.x)", f"({r}[{i} + 1].y - {o}.y)"
    cr = f"({x1} * {y2} - {x2} * {y1})"
    step = (f"named_struct('a', {acc}.a + {cr} / 2, 'mx', {acc}.mx + {cr} * ({x1} + {x2}), "
            f"'my', {acc}.my + {cr} * ({y1} + {y2}))")
    zero = "named_struct('a', 0D, 'mx', 0D, 'my', 0D)"
    return (f"(CASE WHEN size({r}) < 3 THEN {zero} ELSE aggregate(sequence(1, size({r}) - 2), {zero}, "
            f"({acc}, {i}) -> {step}) END)")


def polygon_centroid(g: str) -> dict[str, str]:
    """Area-weighted centroid of a polygonal geometry (holes subtract).
    Each ring's moments are taken about its own first vertex and moved to
    the geometry origin ``o`` (first vertex overall)."""
    o = f"{g}.coords[0][0][0]"
    p, r, j, t, a = _v("p"), _v("r"), _v("j"), _v("t"), _v("a")
    m = _v("mm")
    # per ring: sign so that exterior counts +, holes -, whatever the winding
    ring_terms = (
        f"flatten(transform({g}.coords, {p} -> transform({p}, ({r}, {j}) -> "
        f"named_struct('m', {_ring_moments(r)}, 'ox', {r}[0].x - {o}.x, 'oy', {r}[0].y - {o}.y, "
        f"'w', CASE WHEN {j} = 0 THEN 1D ELSE -1D END))))")
    # signed area A, moment about ring origin Sx = mx/6 (= A * cx_local)
    fold = (f"aggregate({ring_terms}, named_struct('a', 0D, 'sx', 0D, 'sy', 0D), ({a}, {t}) -> "
            f"named_struct('a', {a}.a + {t}.w * abs({t}.m.a), "
            f"'sx', {a}.sx + {t}.w * signum({t}.m.a) * ({t}.m.mx / 6 + {t}.m.a * {t}.ox), "
            f"'sy', {a}.sy + {t}.w * signum({t}.m.a) * ({t}.m.my / 6 + {t}.m.a * {t}.oy)))")
    return {"struct": fold, "x": f"{o}.x", "y": f"{o}.y", "m": m}


def centroid(g: str) -> str:
    """Centroid by dimension: polygons area-weighted, lines length-weighted,
    points the mean.  A struct fragment (x, y); a geometry whose area (or
    length) is 0 falls back to the next lower dimension.  Each fold runs at
    most once, and a fold of a higher dimension only where it applies."""
    pc = polygon_centroid(g)
    s, a, f, l = _v("s"), _v("a"), _v("f"), _v("l")
    fold = f"CASE WHEN {g}.type IN ('Polygon', 'MultiPolygon') THEN {pc['struct']} END"
    line = (f"aggregate({segments(g)}, named_struct('l', 0D, 'sx', 0D, 'sy', 0D), ({a}, {s}) -> "
            f"named_struct('l', {a}.l + hypot({s}.x2 - {s}.x1, {s}.y2 - {s}.y1), "
            f"'sx', {a}.sx + hypot({s}.x2 - {s}.x1, {s}.y2 - {s}.y1) * ({s}.x1 + {s}.x2) / 2, "
            f"'sy', {a}.sy + hypot({s}.x2 - {s}.x1, {s}.y2 - {s}.y1) * ({s}.y1 + {s}.y2) / 2))")
    pts, q = all_points(g), _v("q")
    mean = "named_struct(" + ", ".join(f"'{c}', {_sum(f'transform({pts}, {q} -> {q}.{c})')} / size({pts})" for c in "xy") + ")"
    lower = f"transform(array({line}), {l} -> CASE WHEN {l}.l <> 0 THEN named_struct('x', {l}.sx / {l}.l, 'y', {l}.sy / {l}.l) ELSE {mean} END)[0]"
    return (f"(CASE WHEN {geom_is_empty(g)} THEN NULL ELSE transform(array({fold}), {f} -> CASE WHEN {f}.a <> 0 THEN "
            f"named_struct('x', {pc['x']} + {f}.sx / {f}.a, 'y', {pc['y']} + {f}.sy / {f}.a) ELSE {lower} END)[0] END)")


def centroid_xy(g: str) -> tuple[str, str]:
    """The centroid's (x, y) fragments; ``with_centroid`` finds both at once."""
    return f"({centroid(g)}).x", f"({centroid(g)}).y"


def held(df: DataFrame, **fragments: str) -> DataFrame:
    """``df`` with a column for each fragment, computed once a row.  They are
    computed in a projection; inline() keeps Spark from copying a long fragment
    into every filter and expression that uses it."""
    made = df.select("*", *[F.expr(x).alias(f"__{c}") for c, x in fragments.items()])
    return made.select(*df.columns, F.expr("inline(array(named_struct(" + ", ".join(f"'{c}', __{c}" for c in fragments) + ")))"))


def with_centroid(features: DataFrame, x: str, y: str, *keep: str) -> DataFrame:
    """``fid``, the columns ``keep`` and the centroid of ``geom`` as columns ``x`` and ``y``."""
    c = held(features.select("fid", "geom", *keep), __c=centroid("geom"))
    return c.select("fid", *keep, F.col("__c.x").alias(x), F.col("__c.y").alias(y))


def segments(g: str) -> str:
    """All segments of all rings of all parts as an array of structs."""
    p, r, i = _v("p"), _v("r"), _v("i")
    seg = (f"named_struct('x1', {r}[{i}].x, 'y1', {r}[{i}].y, 'x2', {r}[{i} + 1].x, 'y2', {r}[{i} + 1].y)")
    per_ring = f"CASE WHEN size({r}) < 2 THEN array() ELSE transform(sequence(0, size({r}) - 2), {i} -> {seg}) END"
    return f"flatten(flatten(transform({g}.coords, {p} -> transform({p}, {r} -> {per_ring}))))"


def point_in_polygon(g: str, px: str, py: str) -> str:
    """Strict containment of (px, py) in a polygonal geometry: even-odd
    crossing count over all rings, and a point on any edge is outside."""
    return point_in_segments(segments(g), px, py)


def point_in_segments(segs: str, px: str, py: str) -> str:
    """``point_in_polygon`` for a geometry given as the array of its segments."""
    s = _v("s")
    on_edge = (f"exists({segs}, {s} -> (({s}.x2 - {s}.x1) * ({py} - {s}.y1) - ({s}.y2 - {s}.y1) * ({px} - {s}.x1)) = 0 "
               f"AND {px} BETWEEN least({s}.x1, {s}.x2) AND greatest({s}.x1, {s}.x2) "
               f"AND {py} BETWEEN least({s}.y1, {s}.y2) AND greatest({s}.y1, {s}.y2))")
    s2 = _v("s")
    crossings = (f"size(filter({segs}, {s2} -> (({s2}.y1 > {py}) <> ({s2}.y2 > {py})) AND "
                 f"{px} < {s2}.x1 + ({py} - {s2}.y1) * ({s2}.x2 - {s2}.x1) / ({s2}.y2 - {s2}.y1 + CASE WHEN {s2}.y2 = {s2}.y1 THEN 1D ELSE 0D END)))")
    return f"(NOT {on_edge} AND {crossings} % 2 = 1)"


def point_on_surface(g: str) -> tuple[str, str]:
    """A point strictly inside a polygonal geometry: on the horizontal line
    through the middle of the first part's height, the midpoint of the
    widest span between consecutive edge crossings that lies inside."""
    b = geom_bounds(f"named_struct('type', {g}.type, 'coords', slice({g}.coords, 1, 1))")
    ymid = f"(({b['miny']}) + ({b['maxy']})) / 2"
    segs = segments(f"named_struct('type', {g}.type, 'coords', slice({g}.coords, 1, 1))")
    s, c1, c2, k = _v("s"), _v("c"), _v("c"), _v("k")
    xs = (f"array_sort(transform(filter({segs}, {s} -> (({s}.y1 > {ymid}) <> ({s}.y2 > {ymid}))), "
          f"{s} -> {s}.x1 + ({ymid} - {s}.y1) * ({s}.x2 - {s}.x1) / ({s}.y2 - {s}.y1)))")
    # crossings come in (enter, leave) pairs along the line: spans 0-1, 2-3, ...
    spans = (f"transform(sequence(0, greatest(size({xs}) div 2 - 1, 0)), {k} -> "
             f"named_struct('w', {xs}[2 * {k} + 1] - {xs}[2 * {k}], 'x', ({xs}[2 * {k}] + {xs}[2 * {k} + 1]) / 2))")
    best = f"(CASE WHEN size({xs}) < 2 THEN CAST(NULL AS DOUBLE) ELSE array_max({spans}).x END)"
    _ = (c1, c2)   # struct order in array_max: widest span first, then x
    return best, ymid


# ---------------------------------------------------------------- Column ----

def col(fragment: str) -> Column:
    return F.expr(fragment)


_POINT = "struct<x:double,y:double>"


def _hull_chain(points: str) -> str:
    """One side of the convex hull of sorted points (left turns only): a fold that
    keeps the chain so far.  Turns of a convex chain as seen from a point beyond
    its end change sign once, so where to cut it is found by bisection: the
    longest beginning whose last edge has the point on its left."""
    h, p, s, i, m = _v("h"), _v("p"), _v("s"), _v("i"), _v("m")
    left = (f"(({h}[{m} - 1].x - {h}[{m} - 2].x) * ({p}.y - {h}[{m} - 2].y) "
            f"- ({h}[{m} - 1].y - {h}[{m} - 2].y) * ({p}.x - {h}[{m} - 2].x)) > 0")
    step = (f"transform(array(cast(({s}.lo + {s}.hi + 1) div 2 AS INT)), {m} -> CASE WHEN {s}.lo = {s}.hi THEN {s} "
            f"WHEN {left} THEN named_struct('lo', {m}, 'hi', {s}.hi) ELSE named_struct('lo', {s}.lo, 'hi', {m} - 1) END)[0]")
    keep = (f"CASE WHEN size({h}) < 2 THEN size({h}) ELSE aggregate(sequence(1, CAST(ceil(log2(size({h}))) AS INT)), "
            f"named_struct('lo', 1, 'hi', size({h})), ({s}, {i}) -> {step}, {s} -> {s}.lo) END")
    return f"aggregate({points}, CAST(array() AS ARRAY<{_POINT}>), ({h}, {p}) -> concat(slice({h}, 1, {keep}), array({p})))"


def hull_area(rings: str) -> str:
    """Area of the convex hull of all vertices (monotone chain over the
    sorted distinct points, moved to the first one).  0 below three points."""
    q, a, i, c, s = _v("q"), _v("a"), _v("i"), _v("c"), _v("s")
    points = f"array_sort(array_distinct(flatten({rings})))"
    moved = f"transform(array({points}), {s} -> transform({s}, {q} -> named_struct('x', {q}.x - {s}[0].x, 'y', {q}.y - {s}[0].y)))[0]"
    twice = (f"CASE WHEN size({c}) < 2 THEN 0D ELSE aggregate(sequence(0, size({c}) - 2), 0D, "
             f"({a}, {i}) -> {a} + ({c}[{i}].x * {c}[{i} + 1].y - {c}[{i} + 1].x * {c}[{i}].y)) END")
    chains = f"transform(array({moved}), {s} -> array({_hull_chain(s)}, {_hull_chain(f'reverse({s})')}))[0]"
    return f"abs(aggregate(transform({chains}, {c} -> {twice}), 0D, ({a}, {q}) -> {a} + {q})) / 2"
