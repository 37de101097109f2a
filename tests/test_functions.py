"""Small cases with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from landloom.functions import dates, overlay, properties, text, urls
from landloom.functions import geometry as G


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("given, wanted", [("Đất ở đô thị", "dat o do thi"), ("  NINH   BÌNH ", "ninh binh"), (None, ""), ("", "")])
def test_fold(spark, given, wanted):
    assert one(spark, text.vn_normalize(F.lit(given).cast("string")))[0] == wanted


@pytest.mark.parametrize("given, wanted", [("20.9, 105.8", (105.8, 20.9)), ("105.8 20.9", (105.8, 20.9)), ("https://x/#map=10/20.95/105.82", (105.82, 20.95)), ("x?lat=1.5&lon=2", (2.0, 1.5)), ("hello", None), (None, None),
    ("", None), (" 105.8 ;\t20.9 ", (105.8, 20.9)), ("-5,-10.25", (-5.0, -10.25)), ("1,,2", None), ("1 2 3", None), ("1e2, 3", None), ("1000, 2", None), ("5., 2", None), (".5, 2", None), ("--5, 2", None), ("5-, 2", None), ("NaN, 1", None),
    ("http://m/?y=20.5,x&z=1&lng=105.5z", (105.5, 20.5)), ("http://m/?lat=-1&lat=2&x=3", (3.0, -1.0)), ("http://m/lat=1&lon=2", None), ("http://m/#map=9.5/-20.95/105.8&layers=N", (105.8, -20.95)), ("http://m/?lat=abc&lon=2", None)])
def test_coordinates(spark, given, wanted):
    got = one(spark, text.parse_coordinates(F.lit(given).cast("string")))[0]
    assert (tuple(got) if got else None) == wanted


def test_candidates_carry_page_and_evidence(spark):
    pages = spark.createDataFrame([(1, 2, "Thay thế Quyết định số 5/QD"), (1, 1, "QUYẾT ĐỊNH số: 001/QD-UBND ngày 1 tháng 3 năm 2024, thời kỳ 2021-2030"), (2, 1, None)], "doc_id long, page long, text string")
    got = {r.name: r for r in text.text_candidates(pages).collect()}
    assert got["decision_number"].value == "001/QD-UBND" and got["decision_number"].page == 1
    assert got["signed_date"].value == "2024-03-01" and "ngay 1 thang 3" in got["signed_date"].snippet
    assert got["supersedes_decision"].value == "5/QD" and got["planning_period"].value == "2021-2030"


@pytest.mark.parametrize("given, wanted", [("HTTP://Ex.COM:80/a?b=2&a=1&b=3#f", "http://ex.com/a?a=1&b=3"), ("https://e.x/p", "https://e.x/p"),
    ("http://h/p?b=a+c&a=a%20c", "http://h/p?a=a+c&b=a+c"), ("http://h/?b&a=&&b=%C3%A9*~%2f", "http://h/?a=&b=%C3%A9%2A~%2F"), ("http://h/?x=%zz%4", "http://h/?x=%25zz%254"), ("//W.example/x", "https://w.example/x"), ("/only/path?q", "https:///only/path?q="),
    (" \thttps://H:443/a\n;#f", "https://h/a"), ("http://h/a;b;", "http://h/a;b;"), ("http://h:8080", "http://h:8080"), ("HTTPS://h?%62=1&b=2", "https://h?b=2"), ("http://h/p?a=1=2", "http://h/p?a=1%3D2"), (None, None)])
def test_canonical_url(spark, given, wanted):
    assert one(spark, urls.canonicalize_url(F.lit(given).cast("string")))[0] == wanted


def test_canonical_url_by_rules(spark):
    url = F.lit("http://h/?b=1&a%62=2&c=3")
    r = one(spark, urls.canonicalize_url(url, strip_params=("ab",)), urls.canonicalize_url(url, keep_params=("ab", "c")), urls.canonicalize_url(url, strip_query=True))
    assert tuple(r) == ("http://h/?b=1&c=3", "http://h/?ab=2&c=3", "http://h/")


@pytest.mark.parametrize("href, wanted", [("b.pdf", "http://h/x/b.pdf"), ("/c", "http://h/c"), ("//z/q", "http://z/q"), ("https://o/p", "https://o/p"), ("?n=2", "http://h/x/y?n=2")])
def test_url_join(spark, href, wanted):
    assert one(spark, urls.url_join(F.lit("http://h/x/y?k=1"), F.lit(href)))[0] == wanted


def test_dates(spark):
    r = one(spark, dates.parse_date(F.lit("2024-02-30")), dates.strict_date(F.lit("2024-02")), dates.vietnamese_date(F.lit("ngày 5 tháng 4 năm 2023")), dates.vietnamese_date(F.lit("31/12/2020")))
    assert r[0] is None and r[1] is None and str(r[2]) == "2023-04-05" and str(r[3]) == "2020-12-31"


def test_backoff_is_capped(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    at = dates.next_check_at(now, F.lit(86400), F.lit(True), F.lit(6), F.lit(1), jitter_s=0)
    assert one(spark, (F.unix_micros(at) - F.unix_micros(now)) / 1e6)[0] == 6 * 3600


def test_groups_and_json(spark):
    r = one(spark, properties.group_name(F.lit(None).cast("string")), properties.group_name(F.lit(" Quy Hoach ")), properties.group_name(F.lit("x")), properties.unwrap_json(F.lit('"{\\"a\\":1}"')))
    assert tuple(r) == ("hoso_gis", "quy_hoach", "other", '{"a":1}')


def test_area_of_the_reference_box(spark):
    b = G.box(*[F.lit(v) for v in (105.0, 20.0, 105.01, 20.01)])
    assert one(spark, G.area_m2(b))[0] == pytest.approx(1158452.188, rel=1e-9)


def test_inside_distance_and_holes(spark):
    text_ = '{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4],[0,0]],[[1,1],[1,3],[3,3],[3,1],[1,1]]]}'
    g = G.from_geojson(F.lit(text_))
    r = one(spark, G.contains_point(g, F.lit(0.5), F.lit(0.5)), G.contains_point(g, F.lit(2.0), F.lit(2.0)), G.distance_3857(g, F.lit(0.5), F.lit(0.5)), G.distance_3857(g, F.lit(5.0), F.lit(0.0)), G.structure_issue(g))
    assert r[0] and not r[1] and r[2] == 0 and r[3] == pytest.approx(math.radians(1) * G.A) and r[4] is None


def test_rings_are_equal_wherever_they_start(spark):
    a = G.from_geojson(F.lit('{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}'))
    b = G.from_geojson(F.lit('{"type":"Polygon","coordinates":[[[1,1],[1,0],[0,0],[1,1]]]}'))
    c = G.from_geojson(F.lit('{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,2],[0,0]]]}'))
    assert tuple(one(spark, G.equal_exact(a, b), G.equal_exact(a, c))) == (True, False)


def test_hilbert_numbers(spark):
    got = [r[0] for r in spark.createDataFrame([(0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 0), (2, 0, 0), (1, 2, 0)], "z int, x int, y int").select(G.hilbert_id(F.col("z"), F.col("x"), F.col("y"))).collect()]
    assert got == [0, 1, 2, 3, 4, 5, None]


def test_projection_is_inverted(spark):
    r = one(spark, G.to_degrees(F.lit(32648), F.lit(500000.0), F.lit(0.0)), G.to_degrees(F.lit(9999), F.lit(1.0), F.lit(1.0)))
    assert r[0].x == pytest.approx(105.0) and r[0].y == pytest.approx(0.0, abs=1e-9) and r[1] is None


def _ring(*points):
    return [[[{"x": float(x), "y": float(y)} for x, y in points]]]


def test_overlay_closed_forms():
    box, ell = _ring((0, 0), (2, 0), (2, 2), (0, 2), (0, 0)), _ring((1, 1), (3, 1), (3, 3), (1, 3), (1, 1))
    tri = _ring((0, 0), (2, 0), (0, 2), (0, 0))
    assert overlay.overlap_area(overlay.edges(box), overlay.edges(ell)) == pytest.approx(1.0)
    assert overlay.overlap_area(overlay.edges(box), overlay.edges(tri)) == pytest.approx(2.0)
    assert overlay.overlap_area(overlay.edges(box), overlay.edges(None)) == 0
    assert overlay.self_crossing(_ring((0, 0), (1, 1), (1, 0), (0, 1), (0, 0))) and not overlay.self_crossing(box)
    assert len(overlay.clip_ring(box[0][0], 0.5, 0.5, 1, 1)) >= 4
