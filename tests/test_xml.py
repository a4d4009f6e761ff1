"""GML and KML: all parts, holes, lines, points and axis order."""

from vectorlint.sources import ingest as I


def shape(r):
    return r.geom.type, [[[(q.x, q.y) for q in ring] for ring in part] for part in r.geom.coords]


def test_kml(spark, tmp_path):
    ring = lambda s: f"<LinearRing><coordinates>{s}</coordinates></LinearRing>"
    a = "0,0 9,0 9,9 0,9 0,0"
    b = "1,1 2,1 2,2 1,1"
    polygon = f"<Polygon><outerBoundaryIs>{ring(a)}</outerBoundaryIs><innerBoundaryIs>{ring(b)}</innerBoundaryIs></Polygon>"
    (tmp_path / "k.kml").write_text(f"""<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>
<Placemark><name>one</name>{polygon}</Placemark>
<Placemark><name>two</name><MultiGeometry>{polygon}<Polygon><outerBoundaryIs>{ring("20,0,5 21,0,5 21,1,5 20,0,5")}</outerBoundaryIs></Polygon></MultiGeometry></Placemark>
<Placemark><name>line</name><LineString><coordinates>0,0
 3,4</coordinates></LineString></Placemark>
<Placemark><name>point</name><Point><coordinates>7,8</coordinates></Point></Placemark>
<Placemark><name>none</name></Placemark></Document></kml>""")
    got = {r["name"]: shape(r) for r in I.read_kml(spark, str(tmp_path / "k.kml")).collect()}
    A, B = [(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)]
    assert got == {"one": ("Polygon", [[A, B]]), "two": ("MultiPolygon", [[A, B], [[(20, 0), (21, 0), (21, 1), (20, 0)]]]),
                   "line": ("LineString", [[[(0, 0), (3, 4)]]]), "point": ("Point", [[[(7, 8)]]])}


def test_gml(spark, tmp_path):
    poly = lambda outer, inner="": f"<gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>{outer}</gml:posList></gml:LinearRing></gml:exterior>{inner}</gml:Polygon>"
    hole = "<gml:interior><gml:LinearRing><gml:posList>1 1 2 1 2 2 1 1</gml:posList></gml:LinearRing></gml:interior>"
    row = lambda i, g: f"<place><id>{i}</id><geometry>{g}</geometry></place>"
    (tmp_path / "g.xml").write_text('<set xmlns:gml="http://www.opengis.net/gml">' + "".join([
        row(1, poly("0 0 9 0 9 9 0 0", hole).replace("<gml:Polygon>", '<gml:Polygon srsName="EPSG:3107">')),
        row(2, '<gml:MultiSurface srsName="urn:ogc:def:crs:EPSG::4326">' + poly("-37 145 -36 145 -36 146 -37 145") + poly("-30 140 -29 140 -29 141 -30 140") + "</gml:MultiSurface>"),
        row(3, "<gml:LineString><gml:posList>1 2 3 4</gml:posList></gml:LineString>"), row(4, "<gml:Point><gml:pos>5 6</gml:pos></gml:Point>")]) + "</set>")
    got = {r.id: (r.srid, *shape(r)) for r in I.read_gml(spark, str(tmp_path / "g.xml"), "place").collect()}
    assert got["1"] == (3107, "Polygon", [[[(0, 0), (9, 0), (9, 9), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)]]])
    assert got["2"] == (4326, "MultiPolygon", [[[(145, -37), (145, -36), (146, -36), (145, -37)]], [[(140, -30), (140, -29), (141, -29), (140, -30)]]])
    assert got["3"][1:] == ("LineString", [[[(1, 2), (3, 4)]]]) and got["4"][1:] == ("Point", [[[(5, 6)]]])
