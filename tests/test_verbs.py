"""The query verbs with parameters, on small pages built by hand."""

import pytest

from screenrel.plans import verbs

COMPONENTS = "page_id long, ord long, id string, type string, text string, x0 int, y0 int, x1 int, y1 int, w int, h int, tier string, weight string, confidence double"


@pytest.fixture(scope="module")
def page(spark):
    rows = [
        (1, 0, "t0", "text", "To Do (4)", 10, 10, 110, 30, 100, 20, "heading", "heavy", 0.9),
        (1, 1, "c0", "card", None, 0, 300, 300, 500, 300, 200, None, None, 0.8),
        (1, 2, "t1", "text", "done", 10, 320, 60, 340, 50, 20, "body", "regular", 0.9),
        (1, 3, "t2", "text", "TODAY", 10, 350, 60, 370, 50, 20, "body", None, 0.9),
        (2, 0, "t0", "text", "other", 10, 10, 110, 30, 100, 20, "heading", None, 0.9),
    ]
    return spark.createDataFrame(rows, COMPONENTS)


@pytest.fixture(scope="module")
def colors(spark):
    rows = [(1, 0, 255, 0, 0, 10, 10, 110, 30), (1, 1, 0, 0, 255, 10, 10, 110, 30), (1, 2, 0, 255, 0, 10, 320, 40, 340)]
    return spark.createDataFrame(rows, "page_id long, ord long, r int, g int, b int, x0 int, y0 int, x1 int, y1 int")


def ids(df):
    return [(r["page_id"], r["id"]) for r in df.orderBy("page_id", "position").collect()]


def test_components(page):
    assert ids(verbs.get_components(page, type="text", text="to")) == [(1, "t0"), (1, "t2")]
    assert ids(verbs.get_components(page, has="weight")) == [(1, "t0"), (1, "t1")]
    assert ids(verbs.get_components(page, has="nothing")) == []
    assert ids(verbs.get_components(page, tier="heading", region="top")) == [(1, "t0"), (2, "t0")]
    assert len(ids(verbs.get_components(page, region="middle"))) == 5
    assert ids(verbs.get_components(page, region="top", width=0)) == []
    part = verbs.get_components(page, limit=1, offset=2, fields=["id", "confidence", "colour"])
    assert ids(part) == [(1, "t1")] and part.first()["total_matched"] == 4 and part.columns[3:] == ["id", "confidence"]
    assert len(ids(verbs.get_components(page, offset=-5))) == 5 and ids(verbs.get_components(page, offset=9)) == []


def test_texts(page, colors):
    rows = {r["id"]: r["color"] for r in verbs.query_text(page, colors).where("page_id = 1").collect()}
    assert rows == {"t0": "#FF0000", "t1": "#00FF00", "t2": None}
    assert ids(verbs.query_text(page, colors, near_color="#F00000")) == [(1, "t0")]
    assert ids(verbs.query_text(page, colors, near_color="#F00000", color_tol=5)) == []
    assert len(ids(verbs.query_text(page, colors, near_color="reddish"))) == 4
    assert ids(verbs.query_text(page, colors, contains="D", weight="regular")) == [(1, "t1")]


def test_children(page):
    assert sorted(r["id"] for r in verbs.get_container_children(page, "c0").collect()) == ["t1", "t2"]
    with pytest.raises(ValueError):
        verbs.get_container_children(page)


def test_measures(spark, page):
    pixels = spark.sql("select 1L page_id, cast(a.id as int) x, cast(b.id as int) y, 7 r, if(a.id < 20, 138, 130) g, 82 b, 255 a from range(40) a, range(30) b")
    rects = spark.createDataFrame([(1, 0, -5, 0, 10, 10), (1, 1, 8, 8, 8, 9), (1, 2, 90, 0, 99, 9)], "page_id long, rect_id long, x0 int, y0 int, x1 int, y1 int")
    rows = {r["rect_id"]: r for r in verbs.measure_region(pixels, rects, expect="#078A52").collect()}
    assert rows[0]["hex"] == "#078A52" and rows[0]["matches"] and rows[0]["distance"] == 0 and rows[0]["error"] is None
    assert rows[1]["error"] == "degenerate bbox" and rows[2]["error"] == "bbox outside image"
    assert verbs.measure_fill(pixels, rects=rects).where("rect_id = 0").first()["hex"] == "#078A52"
    assert verbs.measure_fill(pixels, page, "t0", pad_px=2).where("page_id = 1").first()["grounded"] == 1
    with pytest.raises(ValueError):
        verbs.measure_fill(pixels)
