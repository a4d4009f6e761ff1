"""Readers and geometry decoding.

Every reader ends in the same feature table: attribute columns, ``geom``
(the ``model.GEOMETRY`` struct), ``srid`` and ``fid``.  Decoding is column
expressions (``from_json`` / ``regexp`` / ``split`` / ``transform``), so a
file is parsed by the tasks that read it.

Large inputs: GeoJSON should come one Feature per line (GeoJSONSeq); the
FeatureCollection form (``multiline=True``) is a single JSON document and is
read by one task per file.  Row ids come from ``monotonically_increasing_id``
(unique, not dense) unless an id column is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorlint.functions import geometry as G

# Column-name candidates for coordinates and geometry text.
LON_NAMES = ["lon", "long", "longitude", "lng", "x", "point_x", "xcoord", "easting"]
LAT_NAMES = ["lat", "latitude", "y", "point_y", "ycoord", "northing"]
GEOM_NAMES = ["wkt", "geometry", "geom", "the_geom", "shape", "geom_wkt", "geojson"]
WKT_PATTERN = r"(?i)^\s*(MULTI)?(POINT|LINESTRING|POLYGON)\s*\("

_D1 = T.ArrayType(T.DoubleType())
_D2 = T.ArrayType(_D1)
_D3 = T.ArrayType(_D2)
_D4 = T.ArrayType(_D3)


# ------------------------------------------------------- GeoJSON geometry --

def _pt(a: str) -> str:
    return f"named_struct('x', CAST({a}[0] AS DOUBLE), 'y', CAST({a}[1] AS DOUBLE))"


def geojson_geometry(text: Column) -> Column:
    """GeoJSON geometry text (or a Feature wrapping one) -> geometry
    struct; unparsable text -> NULL (never an error).  A GeometryCollection
    becomes the multi-geometry of its members (see ``_collected``)."""
    g = F.coalesce(F.get_json_object(text, "$.geometry"), text)
    # A member is an object without objects in it, however deep the collections are nested.
    members = F.transform(F.regexp_extract_all(g, F.lit(r"(\{[^{}]*\})"), F.lit(1)), _member_geometry)
    return F.when(F.get_json_object(g, "$.type") == "GeometryCollection", _collected(members)).otherwise(_member_geometry(g))


def _collected(members: Column) -> Column:
    """One geometry from a collection's members: its polygons if it has any, else
    its lines, else its points; none of these: NULL."""
    out = None
    for kind in ("Polygon", "LineString", "Point"):
        some = F.filter(members, _of_kind(kind))
        coords = F.flatten(F.transform(some, lambda m: m["coords"]))
        one = F.struct(F.when(F.size(coords) == 1, F.lit(kind)).otherwise(F.lit("Multi" + kind)).alias("type"), coords.alias("coords"))
        out = F.when(F.size(coords) > 0, one) if out is None else out.when(F.size(coords) > 0, one)
    return out


def _of_kind(kind: str):
    return lambda m: m["type"].isin(kind, "Multi" + kind)


def _member_geometry(g: Column) -> Column:
    """Geometry struct of the text of a simple or multi-geometry."""
    typ = F.get_json_object(g, "$.type")
    coords = F.get_json_object(g, "$.coordinates")
    d1 = F.from_json(coords, _D1)
    d2 = F.from_json(coords, _D2)
    d3 = F.from_json(coords, _D3)
    d4 = F.from_json(coords, _D4)
    pt = lambda c: F.struct(c.getItem(0).alias("x"), c.getItem(1).alias("y"))
    line = lambda c: F.transform(c, pt)
    rings = lambda c: F.transform(c, line)
    parts = (F.when(typ == "Point", F.array(F.array(F.array(pt(d1)))))
              .when(typ == "MultiPoint", F.transform(d2, lambda p: F.array(F.array(pt(p)))))
              .when(typ == "LineString", F.array(F.array(line(d2))))
              .when(typ == "MultiLineString", F.transform(d3, lambda ln: F.array(line(ln))))
              .when(typ == "Polygon", F.array(rings(d3)))
              .when(typ == "MultiPolygon", F.transform(d4, rings)))
    return F.when(parts.isNotNull(), F.struct(typ.alias("type"), parts.alias("coords")))


def read_geojson(spark: SparkSession, path: str, multiline: bool = False, id_col: str | None = None,
                 srid: int | None = None) -> DataFrame:
    """Features -> rows, ``properties`` -> columns, geometry decoded.

    ``multiline=False`` expects GeoJSONSeq (one Feature per line, splittable);
    ``multiline=True`` reads FeatureCollection documents.  The CRS is taken
    from ``crs.properties.name`` when present (S10), else ``srid`` or 4326."""
    reader = spark.read.option("multiLine", multiline)
    raw = reader.schema(_geometry_as_text(reader.json(path).schema)).json(path)
    if "features" in raw.columns:
        crs = (F.col("crs.properties.name") if "crs" in raw.columns else F.lit(None).cast("string"))
        feats = raw.select(crs.alias("_crs"), F.explode("features").alias("f")).select("_crs", "f.*")
    else:
        feats = raw.withColumn("_crs", F.lit(None).cast("string"))
    props = [f"properties.{c}" for c in feats.select("properties.*").columns] if "properties" in feats.columns else []
    out = feats.select(
        *[F.col(p).alias(p.split(".", 1)[1]) for p in props],
        geojson_geometry(F.col("geometry")).alias("geom"),
        srid_from_text(F.col("_crs"), default=srid if srid is not None else 4326).alias("srid"))
    return with_fid(out, id_col)


def _geometry_as_text(schema: T.StructType) -> T.StructType:
    """The inferred schema with every ``geometry`` field read as raw JSON
    text (coordinate nesting differs by geometry type, so it cannot be one
    inferred array type)."""
    fields = []
    for f in schema.fields:
        if f.name == "geometry":
            fields.append(T.StructField("geometry", T.StringType(), True))
        elif f.name == "features" and isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            fields.append(T.StructField("features", T.ArrayType(_geometry_as_text(f.dataType.elementType)), True))
        else:
            fields.append(f)
    return T.StructType(fields)


def with_fid(df: DataFrame, id_col: str | None = None) -> DataFrame:
    if id_col and id_col in df.columns:
        return df.withColumn("fid", F.col(id_col).cast("bigint"))
    return df.withColumn("fid", F.monotonically_increasing_id())


# ------------------------------------------------------------------- WKT --

def _wkt_points(ring: str) -> str:
    return (f"transform(filter(split(trim(regexp_replace({ring}, '[()]', '')), '\\\\s*,\\\\s*'), s -> s <> ''), "
            f"s -> named_struct('x', CAST(split(trim(s), '\\\\s+')[0] AS DOUBLE), "
            f"'y', CAST(split(trim(s), '\\\\s+')[1] AS DOUBLE)))")


_WKT_STRIP = "'^\\\\s*[A-Za-z]+\\\\s*(ZM|Z|M)?\\\\s*'"


def wkt_geometry_sql(text: str) -> str:
    """S7 as a SQL fragment over the text expression ``text``: POINT,
    LINESTRING, POLYGON and their MULTI forms (Z/M values ignored) ->
    geometry struct; anything else -> NULL."""
    body = f"regexp_replace(regexp_replace({text}, {_WKT_STRIP}, ''), '\\\\s+$', '')"
    t = f"upper(regexp_extract({text}, '^\\\\s*([A-Za-z]+)', 1))"
    rings_sep = "'\\\\)\\\\s*,\\\\s*\\\\('"
    parts_sep = "'\\\\)\\\\s*\\\\)\\\\s*,\\\\s*\\\\(\\\\s*\\\\('"
    frags = {
        ("POINT", "Point"): f"array(array({_wkt_points(body)}))",
        ("LINESTRING", "LineString"): f"array(array({_wkt_points(body)}))",
        ("POLYGON", "Polygon"): f"array(transform(split({body}, {rings_sep}), r -> {_wkt_points('r')}))",
        ("MULTILINESTRING", "MultiLineString"): f"transform(split({body}, {rings_sep}), r -> array({_wkt_points('r')}))",
        ("MULTIPOINT", "MultiPoint"): f"transform({_wkt_points(body)}, q -> array(array(q)))",
        ("MULTIPOLYGON", "MultiPolygon"): f"transform(split({body}, {parts_sep}), p -> transform(split(p, {rings_sep}), r -> {_wkt_points('r')}))",
    }
    whens = " ".join(f"WHEN {t} = '{k}' THEN named_struct('type', '{name}', 'coords', {frag})" for (k, name), frag in frags.items())
    return f"(CASE {whens} END)"


def wkt_geometry(col: str) -> Column:
    """S7 over a column name; a GEOMETRYCOLLECTION becomes the multi-geometry of
    its members (see ``_collected``)."""
    # Polygons hold two levels of brackets, multi-polygons three; collections in collections fall away.
    member = r"(?i)((?:MULTI)?(?:POLYGON|LINESTRING|POINT)\s*(?:ZM|Z|M)?\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))"
    escaped = member.replace("\\", "\\\\")
    members = F.expr(f"transform(regexp_extract_all(`{col}`, '{escaped}', 1), m -> {wkt_geometry_sql('m')})")
    return F.when(F.col(f"`{col}`").rlike(r"(?i)^\s*GEOMETRYCOLLECTION"), _collected(members)).otherwise(F.expr(wkt_geometry_sql(f"`{col}`")))


def parse_wkt(df: DataFrame, col: str, out: str = "geom") -> DataFrame:
    """S7 over a DataFrame column."""
    return df.withColumn(out, wkt_geometry(col))


def to_wkt(geom: str = "geom") -> Column:
    """Geometry struct -> WKT text (sink side of S7)."""
    pt = "concat(CAST(q.x AS STRING), ' ', CAST(q.y AS STRING))"
    ring = f"concat('(', array_join(transform(r, q -> {pt}), ', '), ')')"
    part = f"concat('(', array_join(transform(p, r -> {ring}), ', '), ')')"
    frag = (f"CASE {geom}.type "
            f"WHEN 'Point' THEN concat('POINT ', transform({geom}.coords, p -> transform(p, r -> {ring}))[0][0]) "
            f"WHEN 'LineString' THEN concat('LINESTRING ', transform({geom}.coords, p -> transform(p, r -> {ring}))[0][0]) "
            f"WHEN 'Polygon' THEN concat('POLYGON ', transform({geom}.coords, p -> {part})[0]) "
            f"WHEN 'MultiPolygon' THEN concat('MULTIPOLYGON (', array_join(transform({geom}.coords, p -> {part}), ', '), ')') "
            f"WHEN 'MultiLineString' THEN concat('MULTILINESTRING (', array_join(transform({geom}.coords, p -> transform(p, r -> {ring})[0]), ', '), ')') "
            f"WHEN 'MultiPoint' THEN concat('MULTIPOINT (', array_join(transform({geom}.coords, p -> {pt.replace('q.', 'p[0][0].')}), ', '), ')') END")
    return F.expr(frag)


def to_geojson(geom: str = "geom") -> Column:
    """Geometry struct -> GeoJSON geometry text (sink side of S1/S9)."""
    pt = "array(q.x, q.y)"
    ring = f"transform(r, q -> {pt})"
    frag = (f"CASE {geom}.type "
            f"WHEN 'Point' THEN to_json(named_struct('type', 'Point', 'coordinates', transform({geom}.coords[0][0], q -> {pt})[0])) "
            f"WHEN 'MultiPoint' THEN to_json(named_struct('type', 'MultiPoint', 'coordinates', transform({geom}.coords, p -> transform(p[0], q -> {pt})[0]))) "
            f"WHEN 'LineString' THEN to_json(named_struct('type', 'LineString', 'coordinates', transform({geom}.coords[0][0], q -> {pt}))) "
            f"WHEN 'MultiLineString' THEN to_json(named_struct('type', 'MultiLineString', 'coordinates', transform({geom}.coords, p -> transform(p[0], q -> {pt})))) "
            f"WHEN 'Polygon' THEN to_json(named_struct('type', 'Polygon', 'coordinates', transform({geom}.coords[0], r -> {ring}))) "
            f"WHEN 'MultiPolygon' THEN to_json(named_struct('type', 'MultiPolygon', 'coordinates', transform({geom}.coords, p -> transform(p, r -> {ring})))) END")
    return F.expr(frag)


# ------------------------------------------------------------ detection ----

def detect_lonlat(columns: list[str]) -> tuple[str | None, str | None]:
    """First case-insensitive match of the lon and lat name lists."""
    low = {c.lower(): c for c in reversed(columns)}
    lon = next((low[n] for n in LON_NAMES if n in low), None)
    lat = next((low[n] for n in LAT_NAMES if n in low), None)
    return lon, lat


def geometry_candidates(df: DataFrame) -> DataFrame:
    """One row per candidate geometry column, in order: name matches
    first, then string columns where any value looks like WKT or starts
    with '{' / '['.  One aggregate over all string columns."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    by_name = [c for n in GEOM_NAMES for c in df.columns if c.lower() == n]
    looks = (df.agg(*[F.bool_or(F.col(c).rlike(WKT_PATTERN) | F.col(c).rlike(r"^\s*[\{\[]")).alias(c) for c in strings])
             if strings else None)
    spark = df.sparkSession
    rows = [(c, 0, i) for i, c in enumerate(dict.fromkeys(by_name))]
    named = spark.createDataFrame(rows, "column string, how int, pos int")
    if looks is None:
        return named
    content = looks.unpivot([], strings, "column", "hit").where("hit").select(
        "column", F.lit(1).alias("how"), (F.array_position(F.array(*[F.lit(c) for c in strings]), F.col("column")) - 1).cast("int").alias("pos"))
    allc = named.unionByName(content)
    first = allc.groupBy("column").agg(F.min(F.struct("how", "pos")).alias("k"))
    return first.select("column", F.col("k.how").alias("how"), F.col("k.pos").alias("pos"))


def decode_geometry_text(text: Column) -> Column:
    """WKT or GeoJSON text -> geometry (None when neither parses)."""
    return F.when(text.rlike(r"^\s*[\{\[]"), geojson_geometry(text))


def from_lonlat(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """Point geometry from two numeric columns (non-numbers -> NULL)."""
    x, y = F.expr(f"try_cast({lon} AS DOUBLE)"), F.expr(f"try_cast({lat} AS DOUBLE)")
    g = F.when(x.isNotNull() & y.isNotNull(),
               F.struct(F.lit("Point").alias("type"), F.array(F.array(F.array(F.struct(x.alias("x"), y.alias("y"))))).alias("coords")))
    return df.withColumn("geom", g)


def swap_if_latlon(df: DataFrame, text_col: str, geom: str = "geom") -> DataFrame:
    """Swap x and y of every geometry when more than half of the rows
    have |second number of the text| > 90.  The share is one aggregate
    used as a scalar subquery."""
    second = F.regexp_extract(F.col(text_col), r"-?\d+(?:\.\d+)?[^-\d.]+(-?\d+(?:\.\d+)?)", 1)
    flag = F.when(second != "", (F.abs(second.cast("double")) > 90).cast("int"))
    share = df.select(flag.alias("f")).agg(F.avg("f")).scalar()
    j = df.withColumn("_share", share)
    swapped = F.expr(f"named_struct('type', {geom}.type, 'coords', transform({geom}.coords, p -> transform(p, r -> "
                     f"transform(r, q -> named_struct('x', q.y, 'y', q.x)))))")
    return j.withColumn(geom, F.when(F.col("_share") > 0.5, swapped).otherwise(F.col(geom))).drop("_share")


def srid_from_text(text: Column, default: int | None = 4326) -> Column:
    """S10: 'EPSG:n', 'urn:ogc:def:crs:EPSG::n', '...EPSG/0/n' -> n, else default."""
    n = F.regexp_extract(text, r"(?i)EPSG\D{0,3}(?:0/)?(\d+)", 1)
    v = F.when(n != "", n.cast("int"))
    return F.coalesce(v, F.lit(default).cast("int")) if default is not None else v


def normalise_crs(code: Column) -> Column:
    """Any CRS spelling -> 'EPSG:n' (NULL when none)."""
    n = srid_from_text(code, default=None)
    return F.when(n.isNotNull(), F.concat(F.lit("EPSG:"), n.cast("string")))


# ----------------------------------------------------------- CSV / XML ----

def read_csv(spark: SparkSession, path: str, id_col: str | None = None, srid: int = 4326) -> DataFrame:
    """Header CSV with inferred types; geometry from a WKT/GeoJSON text
    column (S6, S7, S9) or from lon/lat columns (S5)."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return with_fid(attach_geometry(df, srid), id_col)


def attach_geometry(df: DataFrame, srid: int = 4326) -> DataFrame:
    """Pick the geometry source of a plain table.  Numeric lon/lat
    columns go before a geometry text column; texts whose second number says
    latitude first are swapped (S8).  The candidate list is a
    one-row-per-column aggregate collected to the driver (tiny)."""
    lon, lat = detect_lonlat(df.columns)
    if lon and lat:
        out = from_lonlat(df, lon, lat)
    else:
        cands = [r["column"] for r in geometry_candidates(df).orderBy("how", "pos").collect()]
        if cands:
            c = cands[0]
            out = swap_if_latlon(df.withColumn("geom", F.coalesce(decode_geometry_text(F.col(c)), wkt_geometry(c))), c)
        else:
            out = df.withColumn("geom", F.lit(None).cast(_geom_type()))
    return out.withColumn("srid", F.lit(srid)).where("geom IS NOT NULL")   # S11


def _geom_type():
    from vectorlint.model import GEOMETRY
    return GEOMETRY


# Element text patterns; a namespace prefix may stand before each name.
def _inner(name: str) -> str:
    return rf"(?s)<(?:\\w+:)?{name}(?:\\s[^>]*)?>(.*?)</(?:\\w+:)?{name}>"


def _all(text: str, name: str) -> str:
    return f"regexp_extract_all({text}, '{_inner(name)}', 1)"


def _shapes(raw: str, polygon: str, line: str, point: str, outer: str, inner: str, coords: list[str], to_points: str) -> Column:
    """Geometry of an element's raw XML: all polygons with all their rings,
    else all lines, else all points.  ``to_points`` turns {t}, a coordinate
    text, into points."""
    texts = lambda x: "concat(" + ", ".join(_all(x, c) for c in coords) + ")"
    points = lambda t: to_points.format(t=t)
    rings = f"concat(transform({texts(f'array_join({_all('p', outer)}, chr(10))')}, t -> {points('t')}), transform({texts(f'array_join({_all('p', inner)}, chr(10))')}, t -> {points('t')}))"
    bare = f"transform({texts('p')}, t -> {points('t')})"           # a polygon that is its one ring
    polygons = f"transform({_all(raw, polygon)}, p -> CASE WHEN size({_all('p', outer)}) > 0 THEN {rings} ELSE {bare} END)"
    flat = lambda name: f"transform(flatten(transform({_all(raw, name)}, p -> {texts('p')})), t -> array({points('t')}))"
    kinds = []
    for many, parts in ((("Polygon", "MultiPolygon"), polygons), (("LineString", "MultiLineString"), flat(line)), (("Point", "MultiPoint"), flat(point))):
        kinds.append((f"size({parts}) > 0", f"named_struct('type', if(size({parts}) > 1, '{many[1]}', '{many[0]}'), 'coords', {parts})"))
    return F.expr("CASE " + " ".join(f"WHEN {c} THEN {g}" for c, g in kinds) + " END")


_KML_POINTS = ("transform(filter(split(trim({t}), '\\\\s+'), s -> s <> ''), s -> named_struct("
               "'x', try_cast(split(s, ',')[0] AS DOUBLE), 'y', try_cast(get(split(s, ','), 1) AS DOUBLE)))")
_GML_POINTS = ("transform(sequence(0, greatest(size(filter(split(trim(replace({t}, ',', ' ')), '\\\\s+'), s -> s <> '')) div 2 - 1, 0)), i -> named_struct("
               "'x', try_cast(get(filter(split(trim(replace({t}, ',', ' ')), '\\\\s+'), s -> s <> ''), 2 * i) AS DOUBLE), "
               "'y', try_cast(get(filter(split(trim(replace({t}, ',', ' ')), '\\\\s+'), s -> s <> ''), 2 * i + 1) AS DOUBLE)))")


def _raw_rows(spark: SparkSession, path: str, row_tag: str, columns: list[str]) -> DataFrame:
    """Rows of an XML file, cut at the row's end tag (so a large file is still
    read in splits): ``columns``, the text of its simple elements, and
    ``__raw``, its XML."""
    name = row_tag.rpartition(":")[2]
    raw = F.regexp_extract("value", rf"(?s)<(?:\w+:)?{name}(?:\s[^>]*)?>(.*)$", 1)
    df = spark.read.option("lineSep", f"</{row_tag}>").text(path).select(raw.alias("__raw")).where("__raw <> ''")
    text = lambda c: F.regexp_extract("__raw", rf"(?s)<(?:\w+:)?{c}(?:\s[^>]*)?>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</(?:\w+:)?{c}>", 1)
    plain = lambda c: F.replace(F.replace(F.replace(text(c), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return df.select(*[F.nullif(plain(c), F.lit("")).alias(c) for c in columns], "__raw")


def read_gml(spark: SparkSession, path: str, row_tag: str, id_col: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """S3: GML features: every polygon (or line, or point) of a row element
    with all its rings (``posList`` / ``pos`` / ``coordinates``); CRS from
    ``srsName``.  URN and URI names of EPSG:4326, 4283 and 7844 put latitude
    first, so their pairs are swapped.  ``columns`` are the simple elements to
    keep (by default the text fields that Spark's XML source infers)."""
    if columns is None:
        inferred = spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", False).option("ignoreNamespace", True).load(path).schema
        columns = [f.name for f in inferred if f.dataType.typeName() == "string" and not f.name.startswith("_") and f.name.isidentifier()]
    df = _raw_rows(spark, path, row_tag, columns)
    srs = F.regexp_extract("__raw", 'srsName="([^"]*)"', 1)
    # Old-style boundaries read like new ones.
    raw = F.regexp_replace(F.regexp_replace("__raw", "outerBoundaryIs", "exterior"), "innerBoundaryIs", "interior")
    df = df.withColumn("__raw", raw).withColumn("srid", srid_from_text(srs, 4326)).withColumn("__srs", srs).withColumn(
        "geom", _shapes("__raw", "Polygon", "LineString", "Point", "exterior", "interior", ["posList", "pos", "coordinates"], _GML_POINTS))
    turned = F.expr("named_struct('type', geom.type, 'coords', transform(geom.coords, p -> transform(p, r -> transform(r, q -> named_struct('x', q.y, 'y', q.x)))))")
    latitude_first = F.col("srid").isin(4326, 4283, 7844) & F.col("__srs").rlike("^(urn:|http)")
    return with_fid(df.withColumn("geom", F.when(latitude_first, turned).otherwise(F.col("geom"))).drop("__raw", "__srs").where("geom IS NOT NULL"), id_col)


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """KML Placemarks with all parts and rings; ``coordinates`` text
    "x,y[,z] x,y[,z] ..."."""
    df = _raw_rows(spark, path, "Placemark", ["name", "description"])
    geom = _shapes("__raw", "Polygon", "LineString", "Point", "outerBoundaryIs", "innerBoundaryIs", ["coordinates"], _KML_POINTS)
    return with_fid(df.select("name", "description", geom.alias("geom")).withColumn("srid", F.lit(4326)).where("geom IS NOT NULL"))


# ------------------------------------------------------------- cleaning ----

def dataset_guard(df: DataFrame, dataset_type: str) -> DataFrame:
    """One row ``ok`` = some row has a type allowed for the dataset
    (roads: lines; others: polygons).  Mixed types pass."""
    allowed = ["LineString", "MultiLineString"] if dataset_type == "road" else ["Polygon", "MultiPolygon"]
    return df.agg(F.coalesce(F.bool_or(F.col("geom.type").isin(allowed)), F.lit(False)).alias("ok"),
                  F.array_sort(F.collect_set("geom.type")).alias("types"))


def coord_range_check(df: DataFrame, min_share: float = 0.95) -> DataFrame:
    """Share of centroids with lat in [-90, 90] and lon in [-180, 180];
    ``ok`` when both shares exceed ``min_share``."""
    cx, cy = G.centroid_xy("geom")
    c = df.select(F.expr(cx).alias("cx"), F.expr(cy).alias("cy")).where("cx IS NOT NULL")
    a = c.agg(F.avg(F.col("cy").between(-90, 90).cast("double")).alias("lat_share"),
              F.avg(F.col("cx").between(-180, 180).cast("double")).alias("lon_share"))
    return a.withColumn("ok", (F.col("lat_share") > min_share) & (F.col("lon_share") > min_share))


def clean_geometry(df: DataFrame) -> DataFrame:
    """Drop null/empty geometries, drop repeated consecutive vertices,
    and orient rings canonically (exterior CCW, holes CW).  Overlay repair
    of self-crossing rings is not done (those are reported by F2)."""
    dedup = ("transform(r, (q, i) -> named_struct('q', q, 'keep', i = 0 OR q.x <> r[i - 1].x OR q.y <> r[i - 1].y))")
    ring = f"transform(filter({dedup}, s -> s.keep), s -> s.q)"
    area = G.ring_signed_area("rr")
    fix = (f"named_struct('type', geom.type, 'coords', transform(geom.coords, p -> transform(p, (r, j) -> "
           f"aggregate(array({ring}), CAST(NULL AS array<struct<x:double,y:double>>), (acc, rr) -> "
           f"CASE WHEN geom.type IN ('Polygon', 'MultiPolygon') AND ((j = 0) <> ({area} > 0)) THEN reverse(rr) ELSE rr END))))")
    return df.where(f"NOT {G.geom_is_empty('geom')}").withColumn("geom", F.expr(fix))


def representative_lonlat(df: DataFrame) -> DataFrame:
    """Points keep their own x/y, others their centroid; rows without a
    number are dropped."""
    cx, cy = G.centroid_xy("geom")
    out = df.withColumn("lon", F.expr(f"CASE WHEN geom.type = 'Point' THEN geom.coords[0][0][0].x ELSE {cx} END")).withColumn(
        "lat", F.expr(f"CASE WHEN geom.type = 'Point' THEN geom.coords[0][0][0].y ELSE {cy} END"))
    return out.where("lon IS NOT NULL AND lat IS NOT NULL AND NOT isnan(lon) AND NOT isnan(lat)")


def point_file_fallback(df: DataFrame, text_cols: list[str]) -> DataFrame:
    """When every geometry is a point, try to re-derive geometry from
    a text column; keep the new geometry only if some row becomes a line or
    polygon (decided by one aggregate used as a scalar subquery)."""
    if not text_cols:
        return df
    c = text_cols[0]
    alt = df.withColumn("__alt", F.coalesce(decode_geometry_text(F.col(c)), wkt_geometry(c)))
    dec = alt.agg(F.bool_and(F.col("geom.type").isin("Point", "MultiPoint")).alias("all_pts"),
                  F.bool_or(~F.col("__alt.type").isin("Point", "MultiPoint")).alias("alt_better"))
    d = dec.select(F.struct("all_pts", "alt_better")).scalar()
    j = alt.withColumn("all_pts", d["all_pts"]).withColumn("alt_better", d["alt_better"])
    use = F.coalesce(F.col("all_pts") & F.col("alt_better"), F.lit(False))
    gt = _geom_type()
    return j.withColumn("geom", F.when(use, F.col("__alt").cast(gt)).otherwise(F.col("geom").cast(gt))).drop("__alt", "all_pts", "alt_better")


# ----------------------------------------------------------------- sinks ----

def write_report(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Violations to CSV (header) / JSON lines / parquet; geometry
    columns are written as GeoJSON text for CSV and JSON."""
    out = df
    for f in df.schema.fields:
        if f.name == "geom":
            out = out.withColumn("geom", to_geojson("geom"))
        elif isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType)) and fmt == "csv":
            out = out.withColumn(f.name, F.to_json(F.col(f.name)))
    w = out.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)


def write_geojson_features(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """GeoJSONSeq sink - one Feature per line (properties = the scalar
    columns), written in parallel by every task."""
    props = [f.name for f in df.schema.fields if f.name not in ("geom",) and
             not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))]
    feat = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*props)),
                    F.lit(',"geometry":'), F.coalesce(to_geojson("geom"), F.lit("null")), F.lit("}"))
    df.select(feat.alias("value")).write.mode(mode).text(path)
