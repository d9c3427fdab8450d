import duckdb
import pytest

from screenrel import engine
from screenrel.operators import folds


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in engine.TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 7) if isinstance(v, (int, float)) else v


@pytest.mark.parametrize("name", [*engine.OPERATORS, *engine.ORACLES])
def test_equals_oracle(spark, duck, sf, name):
    df = engine.over_tables(spark, sf, name)
    columns = sorted(df.columns)
    mine = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=str)
    result = duck.sql(engine.oracle(name))
    names = result.columns
    theirs = sorted(([plain(dict(zip(names, r, strict=True))[c]) for c in columns] for r in result.fetchall()), key=str)
    assert mine == theirs


@pytest.mark.parametrize("name", ["spatial_relations", "layout_parent", "query_text", "text_coverage", "iou_pairs"])
def test_pages_join_by_key(spark, sf, name):
    plan = engine.over_tables(spark, sf, name)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def streams(spark, sf, name):
    """Pixels, which Spark takes to be as few as pages, are neither broadcast nor sorted, and are made in more partitions than a DISTINCT has."""
    df = engine.over_tables(spark, sf, name)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ShuffledHashJoin [page_id") == 1 and ", 16), REPARTITION_BY_NUM" in plan


def test_given_pixels_have_no_hint():
    assert "SHUFFLE_HASH" not in engine.OPERATORS["measure_region"].sql(engine.Spark()) and "/*+" not in engine.oracle("measure_region")


@pytest.mark.parametrize("name", ["component_colors", "fill_excluding_ink", "measure_fill", "measure_region", "region_coverage", "sample_region", "dominant_colors", "corner_style", "bar_chart_gate"])
def test_derived_pixels_stream(spark, sf, name):
    streams(spark, sf, name)


def test_reconcile_keeps_first_id():
    rows = [{"id": "a", "type": "button", "text": None, "confidence": 0.8, "box": (0, 0, 100, 50)}, {"id": "b", "type": "button", "text": None, "confidence": 0.9, "box": (20, 10, 120, 60)}]
    kept = folds.reconcile_page(rows, 0.3)
    assert [k["id"] for k in kept] == ["a"] and kept[0]["box"] == (0, 0, 120, 60)


def test_reconcile_keeps_the_surer_type():
    row = lambda i, kind, sure, meaning: {"id": i, "type": kind, "text": "Save", "confidence": 0.5, "type_confidence": sure, "semantic": meaning, "box": (0, 0, 100, 50)}
    (kept,) = folds.reconcile_page([row("a", "region", 0.4, None), row("b", "button", 0.9, "save"), row("c", "card", 0.6, "x")])
    assert (kept["id"], kept["type"], kept["semantic"]) == ("a", "button", "save")


def test_blend():
    box = (0, 0, 10, 10)
    assert folds.blend(box, 0.8, box, 0.99, 0) == pytest.approx(0.895)
    assert folds.blend(box, 0.8, box, 0.99, 0.1) == pytest.approx(0.1 * 0.895 + 0.9 * 0.99)
    assert folds.blend(box, 0.8, box, 0.99, 2) == pytest.approx(0.895)


@pytest.mark.parametrize("heights, names", [([54, 22, 21, 23, 12, 11], ["heading", "body", "body", "body", "caption", "caption"]), ([34, 18, 18, 19, 17], ["heading", "body", "body", "body", "body"]), ([18, 18, 18, 19, 17], ["body"] * 5)])
def test_tiers(heights, names):
    centres = folds.bands(heights)
    assert [folds.tier(h, centres)[0] for h in heights] == names


def test_boxes():
    assert folds.keep_outer([(0, 0, 100, 100), (1, 1, 99, 99), (200, 0, 300, 100)]) == [0, 2]
    assert folds.united([(0, 0, 100, 100)], [(0, 0, 99, 99), (200, 0, 300, 100), (201, 0, 300, 100)]) == [1]


def test_repeated_cards():
    cards = [(100, 100 + 350 * k, 660, 400 + 350 * k) for k in range(3)]
    assert folds.axis_groups(cards, [0, 1, 2], "x") == [([0, 1, 2], 350)]


def test_engine_runs_on_own_relations(spark):
    rows = [(1, 0, "outer", 0, 0, 200, 200), (1, 1, "inner", 20, 20, 100, 100), (2, 0, "x", 0, 0, 5, 5)]
    df = spark.createDataFrame(rows, "page_id long, ord long, id string, x0 long, y0 long, x1 long, y1 long")
    got = engine.Engine(spark, {"components": df}).run("spatial_relations", page_id=1).collect()
    assert [(r.a, r.relation, r.b) for r in got] == [("outer", "contains", "inner")]


COMPONENTS = "page_id long, ord long, id string, type string, text string, x0 long, y0 long, x1 long, y1 long, confidence double"


def components(spark, boxes):
    """Boxes (type, text, x0, y0, x1, y1) of page 1, named c0, c1, ..."""
    return spark.createDataFrame([(1, k, f"c{k}", *box, 0.5) for k, box in enumerate(boxes)], COMPONENTS)


def run(spark, df, name, *columns):
    return sorted(tuple(r[c] for c in columns) for r in engine.Engine(spark, {"components": df}).run(name).collect())


def test_groups_hold_every_member(spark):
    column = [("card", None, 40, 100 + 140 * k, 340, 220 + 140 * k) for k in range(3)] + [("card", None, 40, 540, 340, 660)]
    icons = [("icon", None, 600, 100 + 30 * k, 620, 120 + 30 * k) for k in range(3)]
    others = [("text", "t7", 40, 70, 140, 90), ("text", "t8", 600, 60, 650, 80), ("panel", None, 590, 90, 650, 210), ("label", None, 40, 0, 49, 9), ("label", None, 40, 50, 49, 59)]
    df = components(spark, column + icons + others)
    assert run(spark, df, "repeated_groups", "type", "axis", "spacing", "member_ids") == [("card", "x", 146, "c0,c1,c2,c3"), ("icon", "x", 30, "c4,c5,c6")]
    assert run(spark, df, "group_gaps", "type", "gap_median", "gap_spread") == [("card", 20, 20), ("icon", 10, 0)]
    assert run(spark, df, "even_groups", "page_id", "even") == [(1, 1)]
    assert run(spark, df, "inferred_containers", "type", "members", "y0", "y1", "confidence", "kind", "label") == [("icon", 3, 100, 180, 1.0, "column", "t8")]
    assert run(spark, df, "group_headers", "type", "header_id") == [("card", "c7"), ("icon", "c8")]
    assert run(spark, df, "inferred_parent", "id", "parent") == [("L:icon:1", "c9")]


def test_layout_shares(spark):
    df = components(spark, [("panel", None, 0, 0, 300, 400), ("text", "header", 10, 10, 290, 50), ("panel", None, 10, 60, 290, 390)])
    tree = {r.id: r for r in folds.layout_tree(df).collect()}
    assert [tree[k].depth for k in ("c0", "c1", "c2")] == [0, 1, 1] and tree["c1"].axis == "y" and tree["c2"].fraction > tree["c1"].fraction
    assert (tree["c1"].fraction, tree["c2"].fraction, tree["c2"].gap_before, tree["c1"].tiling) == (0.11, 0.87, 0.03, 0.95)


def test_layout_of_an_even_column(spark):
    cards = [("card", None, 100, 100 + 60 * k, 200, 150 + 60 * k) for k in range(3)]
    df = components(spark, [("text", "TO DO (3)", 100, 60, 200, 90), *cards, ("icon", None, 110, 110, 120, 120)])
    tree = [(r.id, r.parent, r.inferred, r.label) for r in folds.layout_tree(df).orderBy("seq").collect()]
    # what lies in a card of the column is in no tree
    assert tree == [("c0", None, 0, None), ("L:card:1", None, 1, "TO DO (3)"), ("c1", "L:card:1", 0, None), ("c2", "L:card:1", 0, None), ("c3", "L:card:1", 0, None)]
    assert [r.id for r in folds.container_children(df, label="to do").orderBy("seq").collect()] == ["c1", "c2", "c3"]
    dom = folds.dom_tree(df).first().dom
    assert '<div class="column" data-inferred="true" data-conf="1.00" aria-label="TO DO (3)">' in dom and dom.count("<section") == 3 and 'data-share="29%"' in dom
    uneven = [("card", None, 100, y, 200, y + 50) for y in (100, 160, 520)]
    assert folds.layout_containers(components(spark, uneven)).count() == 0


def test_layout_is_as_deep_as_the_page(spark):
    df = components(spark, [("text", None, k, k, 400 - k, 400 - k) for k in range(0, 180, 6)])
    assert max(r.depth for r in folds.layout_tree(df).collect()) == 29


def bars(spark, heights, base=60):
    """A page of 64 x 64 with bars of these heights on a base."""
    at = [(x, y) for k, h in enumerate(heights) for x in range(6 + 10 * k, 11 + 10 * k) for y in range(base - h, base)]
    df = spark.createDataFrame([(1, x, y, *((7, 138, 82) if (x, y) in set(at) else (240, 240, 240)), 255) for x in range(64) for y in range(64)], "page_id long, x long, y long, r long, g long, b long, a long")
    rects = spark.createDataFrame([(1, 0, "chart", 0, 0, 64, 64), (1, 1, "chart", 0, 0, 64, 20)], "page_id long, rect_id long, type string, x0 long, y0 long, x1 long, y1 long")
    return {r.rect_id: (r.bars, r.bar_chart) for r in engine.Engine(spark, {"pixels": df, "rects": rects}).run("bar_chart_gate").collect()}


def test_bar_geometry(spark):
    assert bars(spark, [20, 30, 45, 25]) == {0: (4, 1), 1: (0, 0)}
    assert bars(spark, [30, 30, 30, 30])[0] == (4, 0) and bars(spark, [20, 40])[0] == (2, 0)


def test_claims_count_repeats(spark):
    says = "The #FF0000 and #FF0000 box, \"cost\" and \"none here\", “cost”, 1234 cards, 0 icons, two\tcards, code 12ab34 and 77."
    frames = {
        "summaries": spark.createDataFrame([(1, 0, says)], "page_id long, turn long, summary string"),
        "colors": spark.createDataFrame([(1, 0, 250, 0, 0, 0, 0, 9, 9)], "page_id long, ord long, r long, g long, b long, x0 long, y0 long, x1 long, y1 long"),
        "tokens": spark.createDataFrame([(1, 0, 0, "Cost 77", 0, 0, 9, 9, 0.9)], "page_id long, turn long, pos long, text string, x0 long, y0 long, x1 long, y1 long, confidence double"),
        "components": components(spark, [("card", None, 0, 0, 9, 9), ("card", None, 20, 0, 29, 9), ("card", None, 40, 0, 49, 9)]),
    }
    e = engine.Engine(spark, frames)
    assert [(r.hex, r.supported) for r in e.run("hex_claims").collect()] == [("#FF0000", 1)] * 2
    assert sorted((r.quote, r.supported) for r in e.run("quoted_claims").collect()) == [("cost", 1), ("cost", 1), ("none here", 0)]
    assert [(r.claim, r.claimed, r.measured, r.supported) for r in e.run("count_claims").collect()] == [("two\tcards", 2, 3, 1)]
    assert sorted((r.value, r.supported) for r in e.run("number_claims").collect()) == [("1234", 0), ("77", 1)]
    g, c = e.run("grounding_report").first(), e.run("crosscheck_report").first()
    assert (g.color_mentions, g.color_supported, g.text_mentions, g.text_supported, g.grounded) == (2, 2, 2, 1, 0)
    assert (c.text_mentions, c.count_mentions, c.agreement) == (3, 1, pytest.approx(5 / 6))


def test_folds_over_many_batches(spark):
    """Pages go on from batch to batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(p, k, 10 * k, 0, 10 * k + 5, 5) for p in range(9) for k in range(5 + p)]
        df = spark.createDataFrame(rows, "page_id long, ord long, x0 long, y0 long, x1 long, y1 long")
        assert sorted(tuple(r) for r in folds.dedupe_boxes(df).collect()) == sorted((r[0], r[1]) for r in rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_oracles_notice_a_wrong_threshold(spark, duck, sf):
    want = duck.sql(engine.oracle("dedupe_boxes")).fetchall()
    boxes = engine.relation(spark, sf, "boxes")
    wrong = folds.per_page(boxes.select("page_id", "ord", "x0", "y0", "x1", "y1"), ["ord"], "page_id bigint, ord bigint", lambda page, r: [(page, r["ord"][i]) for i in folds.keep_outer(folds.boxes_of(r), 0.3)])
    assert sorted(tuple(r) for r in wrong.collect()) != sorted(want)


def test_accepted_labels_are_capped_by_page(spark):
    """Of ten runs, seven or more must agree; twelve places a page; equal element ids on two pages are two elements."""
    agreeing = {1: [7] * 14 + [6], 2: [6, 10, 7]}
    rows = [(page, e, run, "gear" if run < n else "trash") for page, ns in agreeing.items() for e, n in enumerate(ns) for run in range(10)]
    df = spark.createDataFrame(rows, "page_id long, element_id long, run long, raw_label string")
    got = sorted((r.page_id, r.k, r.element_id, r.concept) for r in engine.Engine(spark, {"label_samples": df}).run("accepted_labels").collect())
    assert got == [(1, k + 1, k, "settings") for k in range(12)] + [(2, 1, 1, "settings"), (2, 2, 2, "settings")]


def test_sources(spark, tmp_path):
    from screenrel.sources import files

    (tmp_path / "page.json").write_text('{"components":[{"id":"a","type":{"value":"text"},"text":{"value":"hi"},"bbox":[1,2,3,4],"confidence":0.5},{"id":"b","bbox":{"x0":1,"y0":2,"x1":3,"y1":4}}]}')
    got = files.scan_components(spark, str(tmp_path / "page.json")).orderBy("ord").collect()
    assert [tuple(r.bbox) for r in got] == [(1, 2, 3, 4)] * 2 and got[0].text == "hi"
    window = files.artifact_window(spark, str(tmp_path), "page.json", 2, 10).first()
    assert window.text == "components" and window.truncated
    with pytest.raises(ValueError):
        files.artifact_window(spark, str(tmp_path / ".."), "page.json")
    (tmp_path / "i.png").write_bytes(b"\x89PNG\r\n\x1a\n00")
    assert {r.format for r in files.scan_images(spark, str(tmp_path)).collect()} == {"png", "unknown"}


def test_imports_without_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['screenrel.llm'] = None; import __spark_entry__ as e; assert not any(k.startswith('op') and k[2].isdigit() for k in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
