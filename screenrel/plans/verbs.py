"""The query verbs with a user's parameters, as lazy DataFrames over all pages at once.

Every verb takes relations keyed by page_id with `ord` as the order of a page's rows; paging is per page, and total_matched
counts before paging. Parameters that are None (or, for limits and tolerances, 0 or less) take their defaults.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenrel.engine import Engine
from screenrel.operators import folds
from screenrel.operators.catalog import iou, overlaps

LIMIT, TOLERANCE, NEAR = 40, 60, 24
FIELDS = ("id", "type", "text", "bbox", "weight", "tier", "semantic", "corner_style", "padding", "confidence")


def contains_text(column: str, part: str) -> Column:
    return F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(part.lower()))


def rgb(code: str) -> tuple[int, int, int] | None:
    """Channels of #RRGGBB; None for anything else."""
    found = re.fullmatch(r"#?([0-9A-Fa-f]{6})", code.strip())
    return tuple(bytes.fromhex(found[1])) if found else None


def distance(channels: Sequence[Column], to: tuple[int, int, int]) -> Column:
    """Euclidean, without its fraction."""
    return F.floor(F.sqrt(sum((((c - v) * (c - v)) for c, v in zip(channels, to, strict=True)), F.lit(0)).cast("double")))


def in_region(region: str, width: int, height: int) -> Column:
    """Whether a box's centre is in an outer third; names that are not known let every box through, pages without size none."""
    if width <= 0 or height <= 0:
        return F.lit(False)
    tests = {"top": f"(y0 + y1) div 2 < {height // 3}", "bottom": f"(y0 + y1) div 2 > {2 * height // 3}", "left": f"(x0 + x1) div 2 < {width // 3}", "right": f"(x0 + x1) div 2 > {2 * width // 3}"}
    return F.expr(tests.get(region, "x1 > x0 AND y1 > y0"))


def paged(rows: DataFrame, limit: int | None, offset: int) -> DataFrame:
    """Rows offset .. offset + limit of each page, with position and total_matched."""
    page = Window.partitionBy("page_id")
    rows = rows.withColumn("total_matched", F.count("*").over(page)).withColumn("position", F.row_number().over(page.orderBy("ord")) - 1)
    first, many = max(0, offset), limit if limit and limit > 0 else LIMIT
    return rows.where((F.col("position") >= first) & (F.col("position") < first + many))


def get_components(components: DataFrame, type: str = "", has: str = "", text: str = "", tier: str = "", region: str = "", fields: Sequence[str] = (), limit: int | None = None, offset: int = 0, width: int = 1280, height: int = 1100) -> DataFrame:
    """Components that pass all given filters, with the wanted fields; fields that are not known or not there are left out."""
    rows = components
    if type:
        rows = rows.where(F.col("type") == type)
    if has:
        rows = rows.where(F.col(has).isNotNull() if has in rows.columns else F.lit(False))
    if tier:
        rows = rows.where(F.col("tier") == tier)
    if text:
        rows = rows.where(contains_text("text", text))
    if region:
        rows = rows.where(in_region(region, width, height))
    rows = paged(rows, limit, offset)
    boxes = F.struct("x0", "y0", "x1", "y1").alias("bbox")
    wanted = [f for f in dict.fromkeys(fields or FIELDS[:4]) if f == "bbox" or (f in FIELDS and f in rows.columns)]
    return rows.select("page_id", "position", "total_matched", *[boxes if f == "bbox" else F.col(f) for f in wanted])


def best_colors(texts: DataFrame, colors: DataFrame) -> DataFrame:
    """The colour sample of highest overlap ratio for each text (page_id, id, r, g, b); the first wins ties, no overlap gives no row."""
    pairs = texts.alias("t").join(colors.alias("c"), F.expr(f"t.page_id = c.page_id AND {overlaps('t', 'c')}"))
    best = F.max(F.struct(F.expr(iou("t", "c")).alias("score"), (-F.col("c.ord")).alias("first"), "c.r", "c.g", "c.b")).alias("best")
    return pairs.groupBy("t.page_id", "t.id").agg(best).where("best.score > 0").select("page_id", "id", "best.r", "best.g", "best.b")


def query_text(components: DataFrame, colors: DataFrame, contains: str = "", tier: str = "", weight: str = "", near_color: str = "", color_tol: int | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Texts with tier, weight and measured colour. A near_color that is no colour is ignored; texts without colour are far from any."""
    rows = components.where("type = 'text' AND text <> ''")
    if contains:
        rows = rows.where(contains_text("text", contains))
    for column, value in (("tier", tier), ("weight", weight)):
        if value:
            rows = rows.where(F.col(column) == value)
    found = rows.join(best_colors(rows, colors), ["page_id", "id"], "left")
    target = rgb(near_color) if near_color else None
    if target:
        found = found.where(distance([F.col(c) for c in "rgb"], target) <= (color_tol if color_tol and color_tol > 0 else TOLERANCE))
    code = F.when(F.col("r").isNotNull(), F.format_string("#%02X%02X%02X", *[F.col(c).cast("int") for c in "rgb"])).alias("color")
    return paged(found, limit, offset).select("page_id", "position", "total_matched", "id", "text", "tier", "weight", code, F.struct("x0", "y0", "x1", "y1").alias("bbox"))


def get_container_children(components: DataFrame, container_id: str = "", label: str = "") -> DataFrame:
    """Children, in layout order, of the first node of each page's layout that has the id, or whose header holds the label, with their share of the container."""
    if not container_id and not label:
        raise ValueError("container_id or label is required")
    return folds.container_children(components, container_id, label)


def _measured(name: str, pixels: DataFrame, rects: DataFrame) -> DataFrame:
    """A measure over rectangles cut to their image; those without area inside it report an error instead."""
    size = pixels.groupBy("page_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    cut = rects.join(size, "page_id", "left").select("page_id", "rect_id", F.greatest("x0", F.lit(0)).alias("x0"), F.greatest("y0", F.lit(0)).alias("y0"), F.least("x1", "width").alias("x1"), F.least("y1", "height").alias("y1"), F.when(F.expr("x1 <= x0 OR y1 <= y0"), "degenerate bbox").when(F.expr("width IS NULL"), "no image").when(F.expr("x0 >= width OR y0 >= height OR x1 <= 0 OR y1 <= 0"), "bbox outside image").alias("error"))
    good = cut.where("error IS NULL").drop("error")
    found = Engine(pixels.sparkSession, {"pixels": pixels, "rects": good}).run(name)
    return cut.select("page_id", "rect_id", "error").join(found, ["page_id", "rect_id"], "left")


def measure_region(pixels: DataFrame, rects: DataFrame, expect: str = "", tolerance: int | None = None) -> DataFrame:
    """Median colour, coverage and grounding of rectangles (page_id, rect_id, x0, y0, x1, y1), and whether the expected colour is met."""
    found = _measured("measure_region", pixels, rects).drop("distance", "matches")
    target = rgb(expect) if expect else None
    if target is None:
        return found
    far = distance([F.conv(F.substring("hex", k, 2), 16, 10).cast("int") for k in (2, 4, 6)], target)
    return found.withColumn("distance", far).withColumn("matches", far <= (tolerance if tolerance and tolerance > 0 else NEAR))


def measure_fill(pixels: DataFrame, components: DataFrame | None = None, component_id: str = "", rects: DataFrame | None = None, pad_px: int | None = None, pad_frac: float = 0.6) -> DataFrame:
    """Fill colour without ink, around one text component (padded by pixels, else by a share of its own size) or inside rectangles; exactly one of the two."""
    if bool(component_id) == (rects is not None):
        raise ValueError("exactly one of component_id and rects")
    if component_id:
        pads = [F.lit(pad_px) if pad_px and pad_px > 0 else F.floor((F.col(f"{c}1") - F.col(f"{c}0")) * F.lit(float(pad_frac))) for c in "xy"]
        rects = components.where(F.col("id") == component_id).select("page_id", F.col("id").alias("rect_id"), *[(F.col(f"{c}0") - p).alias(f"{c}0") for c, p in zip("xy", pads, strict=True)], *[(F.col(f"{c}1") + p).alias(f"{c}1") for c, p in zip("xy", pads, strict=True)])
    return _measured("measure_fill", pixels, rects)
