"""Measures over pixel tables: medians from histograms, coverage, fill without ink, bars, corners.

Each operator reads the pixels of its rectangles once. Rectangles are joined with pixels by page, most measures then need only the
number of pixels of each colour, and medians are running counts over these, so what a window holds is one rectangle's colours.
"""

from __future__ import annotations

from screenrel.operators.catalog import hex_of, operator, rounded

INSIDE = "p.page_id = q.page_id AND p.x >= q.x0 AND p.x < q.x1 AND p.y >= q.y0 AND p.y < q.y1"
BY = "PARTITION BY page_id, rect_id"
#: Types whose corners are measured.
CORNERED = "'card', 'region', 'panel', 'container'"


def histogram(d, rects: str = "rects") -> str:
    """Opaque pixels of each colour by rectangle."""
    return f"SELECT {d.small('q', 'pixels')}q.page_id, q.rect_id, p.r, p.g, p.b, count(*) AS n FROM {rects} q JOIN pixels p ON {INSIDE} AND p.a >= 128 GROUP BY q.page_id, q.rect_id, p.r, p.g, p.b"


def centred(d, rows: str, weight: str = "n", name: str = "m") -> str:
    """rows with the upper median of each channel of the rectangle, each row counted by its weight: columns mr, mg, mb and the total mt."""
    running = ", ".join(f"sum({weight}) OVER ({BY} ORDER BY {c}) AS {name}u{c}" for c in "rgb")
    picks = ", ".join(f"min(CASE WHEN {name}u{c} > {d.div(f'{name}t', '2')} THEN {c} END) OVER ({BY}) AS {name}{c}" for c in "rgb")
    return f"SELECT *, {picks} FROM (SELECT *, {running}, sum({weight}) OVER ({BY}) AS {name}t FROM ({rows}) {name}h) {name}w"


def far(name: str = "m") -> str:
    """Squared distance of a row's colour from a median."""
    return "(" + " + ".join(f"({c} - {name}{c}) * ({c} - {name}{c})" for c in "rgb") + ")"


def trimmed(d) -> str:
    """Rectangles without 0.15 of their size at each edge."""
    tx, ty = d.div("(x1 - x0) * 15", "100"), d.div("(y1 - y0) * 15", "100")
    return f"(SELECT page_id, rect_id, x0 + {tx} AS x0, y0 + {ty} AS y0, x1 - {tx} AS x1, y1 - {ty} AS y1 FROM rects)"


def medians(d, rows: str) -> str:
    return f"SELECT page_id, rect_id, max(mr) AS r, max(mg) AS g, max(mb) AS b FROM ({centred(d, rows)}) c GROUP BY page_id, rect_id"


@operator("pixels", "rects")
def sample_region(d):
    return f"SELECT page_id, rect_id, r, g, b, {hex_of(d)} AS hex FROM ({medians(d, histogram(d, trimmed(d)))}) m"


@operator("pixels", "rects")
def component_colors(d):
    """The colour of each component's interior, as a measured fact."""
    return f"SELECT page_id, rect_id, 'background' AS name, {hex_of(d)} AS hex, 'pixel_sampler' AS source, CAST(0.997 AS DOUBLE) AS confidence FROM ({medians(d, histogram(d, trimmed(d)))}) m"


def coverage(d) -> str:
    return f"SELECT page_id, rect_id, max(mr) AS r, max(mg) AS g, max(mb) AS b, CAST(max(mt) AS BIGINT) AS n, CAST(sum(CASE WHEN {far()} <= 576 THEN n ELSE 0 END) AS DOUBLE) / CAST(max(mt) AS DOUBLE) AS coverage FROM ({centred(d, histogram(d))}) c GROUP BY page_id, rect_id"


@operator("pixels", "rects")
def region_coverage(d):
    return f"SELECT page_id, rect_id, n, {rounded('coverage', 6)} AS coverage FROM ({coverage(d)}) c"


@operator("pixels", "rects")
def measure_region(d):
    away = "floor(sqrt(CAST((r - 7) * (r - 7) + (g - 138) * (g - 138) + (b - 82) * (b - 82) AS DOUBLE)))"
    return f"SELECT page_id, rect_id, {hex_of(d)} AS hex, {rounded('coverage', 3)} AS coverage, CASE WHEN coverage >= CAST(0.9 AS DOUBLE) AND n >= 16 THEN 1 ELSE 0 END AS grounded, CASE WHEN n < 16 THEN least(coverage, CAST(0.5 AS DOUBLE)) ELSE {rounded('coverage', 3)} END AS confidence, CAST({away} AS BIGINT) AS distance, CASE WHEN {away} <= 24 THEN 1 ELSE 0 END AS matches FROM ({coverage(d)}) c"


def fill(d) -> str:
    """Medians of the pixels within 90 of the first medians, and the share of these within 24 of theirs."""
    body = f"CASE WHEN {far()} <= 8100 THEN n ELSE 0 END"
    twice = centred(d, f"SELECT page_id, rect_id, r, g, b, n, mt, {body} AS f FROM ({centred(d, histogram(d))}) c", "f", "k")
    return f"SELECT page_id, rect_id, max(kr) AS r, max(kg) AS g, max(kb) AS b, CAST(max(kt) AS BIGINT) AS fill_pixels, CAST(max(mt) AS BIGINT) AS opaque_pixels, CAST(sum(CASE WHEN {far('k')} <= 576 THEN f ELSE 0 END) AS DOUBLE) / CAST(max(kt) AS DOUBLE) AS coverage, 1 - CAST(max(kt) AS DOUBLE) / CAST(max(mt) AS DOUBLE) AS ink_fraction FROM ({twice}) t GROUP BY page_id, rect_id HAVING max(kt) > 0"


@operator("pixels", "rects")
def fill_excluding_ink(d):
    return f"SELECT page_id, rect_id, {hex_of(d)} AS hex, fill_pixels, opaque_pixels, {rounded('coverage', 6)} AS coverage, {rounded('ink_fraction', 6)} AS ink_fraction FROM ({fill(d)}) f"


@operator("pixels", "rects")
def measure_fill(d):
    return f"SELECT page_id, rect_id, {hex_of(d)} AS hex, {rounded('coverage', 3)} AS coverage, CASE WHEN coverage >= CAST(0.9 AS DOUBLE) AND fill_pixels >= 16 THEN 1 ELSE 0 END AS grounded FROM ({fill(d)}) f"


@operator("pixels", "rects")
def dominant_colors(d):
    """The six most frequent colours of a grid of points, twelve or so each way, in each rectangle."""
    steps = f"(p.x - q.x0) % greatest(1, {d.div('q.x1 - q.x0', '12')}) = 0 AND (p.y - q.y0) % greatest(1, {d.div('q.y1 - q.y0', '12')}) = 0"
    points = f"SELECT {d.small('q', 'pixels')}q.page_id, q.rect_id, {hex_of(d, 'p.r', 'p.g', 'p.b')} AS hex FROM rects q JOIN pixels p ON {INSIDE} AND p.a >= 128 AND {steps}"
    return f"SELECT page_id, rect_id, hex, n, k FROM (SELECT page_id, rect_id, hex, count(*) AS n, row_number() OVER ({BY} ORDER BY count(*) DESC, hex) AS k FROM ({points}) c GROUP BY page_id, rect_id, hex) q WHERE k <= 6"


@operator("pixels")
def inspect_image(d):
    whole = "SELECT page_id, 0 AS rect_id, r, g, b, sum(CASE WHEN a >= 128 THEN 1 ELSE 0 END) AS n, max(x) AS x, max(y) AS y FROM pixels GROUP BY page_id, r, g, b"
    return f"SELECT page_id, width, height, {hex_of(d)} AS dominant FROM (SELECT page_id, max(x) + 1 AS width, max(y) + 1 AS height, max(mr) AS r, max(mg) AS g, max(mb) AS b FROM ({centred(d, whole)}) c GROUP BY page_id) m WHERE r IS NOT NULL"


@operator("pixels")
def mean_luminance(d):
    """Over a grid of 64 points or so each way."""
    steps = f"x % greatest(1, {d.div('w', '64')}) = 0 AND y % greatest(1, {d.div('h', '64')}) = 0"
    sized = "SELECT page_id, x, y, r, g, b, max(x) OVER (PARTITION BY page_id) + 1 AS w, max(y) OVER (PARTITION BY page_id) + 1 AS h FROM pixels"
    return f"SELECT page_id, {rounded('CAST(sum(299 * r + 587 * g + 114 * b) AS DOUBLE) / 1000 / count(*)', 6)} AS luminance FROM ({sized}) s WHERE {steps} GROUP BY page_id"


@operator("pixels", "rects")
def bar_chart_gate(d):
    """Whether a region shows three bars or more: columns with ink (48 or more from the region's median colour) over a quarter of its height, of differing heights, on one baseline."""
    rows = f"SELECT {d.small('q', 'pixels')}q.page_id, q.rect_id, q.x1 - q.x0 AS w, q.y1 - q.y0 AS h, p.x, p.y - q.y0 AS y, p.r, p.g, p.b, CASE WHEN p.a >= 128 THEN 1 ELSE 0 END AS n FROM rects q JOIN pixels p ON {INSIDE} WHERE q.x1 - q.x0 >= 12 AND q.y1 - q.y0 >= 24 AND q.x1 - q.x0 <= 6 * (q.y1 - q.y0)"
    ink = "abs(r - mr) + abs(g - mg) + abs(b - mb) >= 48"
    columns = f"SELECT page_id, rect_id, x, max(h) AS h, count(CASE WHEN {ink} THEN 1 END) AS ink, max(CASE WHEN {ink} THEN y END) AS low FROM ({centred(d, rows)}) c GROUP BY page_id, rect_id, x"
    islands = f"SELECT page_id, rect_id, h, ink, low, x - row_number() OVER ({BY} ORDER BY x) AS island FROM ({columns}) c WHERE ink >= greatest(3, {d.div('h', '4')})"
    bars = f"SELECT page_id, rect_id, max(h) AS h, max(ink) AS height, max(low) AS base FROM ({islands}) i GROUP BY page_id, rect_id, island"
    mean = f"SELECT *, {d.div(f'sum(base) OVER ({BY})', f'count(*) OVER ({BY})')} AS mean FROM ({bars}) b"
    found = f"SELECT page_id, rect_id, count(*) AS bars, CASE WHEN count(*) >= 3 AND 100 * (max(height) - min(height)) >= 20 * max(height) AND count(CASE WHEN abs(base - mean) <= greatest(4, {d.div('h', '8')}) THEN 1 END) = count(*) THEN 1 ELSE 0 END AS bar_chart FROM ({mean}) m GROUP BY page_id, rect_id"
    return f"SELECT q.page_id, q.rect_id, coalesce(f.bars, 0) AS bars, coalesce(f.bar_chart, 0) AS bar_chart FROM rects q LEFT JOIN ({found}) f ON q.page_id = f.page_id AND q.rect_id = f.rect_id"


@operator("pixels", "rects")
def corner_style(d):
    """Whether corners show the page (rounded) or the region's fill (square); withheld where these are too alike, or two corners go each way."""
    inset, probe = 3, 6
    sx, sy = (f"greatest(1, {d.div(f'q.{c}1 - q.{c}0 - {8 * inset}', '16')})" for c in "xy")
    inner = f"p.x >= q.x0 + {4 * inset} AND p.x < q.x1 - {4 * inset} AND p.y >= q.y0 + {4 * inset} AND p.y < q.y1 - {4 * inset} AND (p.x - q.x0 - {4 * inset}) % {sx} = 0 AND (p.y - q.y0 - {4 * inset}) % {sy} = 0"
    middle = d.div("q.x0 + q.x1", "2")
    spots = {"up": (middle, f"q.y0 - {probe}"), "down": (middle, f"q.y1 + {probe}")}
    spots |= {f"c{k}": (x, y) for k, (x, y) in enumerate((x, y) for y in (f"q.y0 + {inset}", f"q.y1 - {1 + inset}") for x in (f"q.x0 + {inset}", f"q.x1 - {1 + inset}"))}
    picks = ", ".join(f"max(CASE WHEN p.x = {x} AND p.y = {y} THEN p.{c} END) AS {name}{c}" for name, (x, y) in spots.items() for c in "rgb")
    sums = ", ".join(f"{d.div(f'sum(CASE WHEN {inner} THEN p.{c} ELSE 0 END)', f'greatest(1, count(CASE WHEN {inner} THEN 1 END))')} AS i{c}" for c in "rgb")
    rows = f"SELECT {d.small('q', 'pixels')}q.page_id, q.rect_id, {sums}, {picks} FROM rects q JOIN pixels p ON p.page_id = q.page_id AND p.x >= q.x0 AND p.x < q.x1 AND p.y >= q.y0 - {probe} AND p.y <= q.y1 + {probe} WHERE q.type IN ({CORNERED}) AND q.x1 - q.x0 > {8 * inset} AND q.y1 - q.y0 > {8 * inset} GROUP BY q.page_id, q.rect_id"
    outer = ", ".join(f"CASE WHEN upr IS NULL THEN down{c} ELSE up{c} END AS page{c}" for c in "rgb")
    away = lambda a, b: "(" + " + ".join(f"abs({a}{c} - {b}{c})" for c in "rgb") + ")"
    votes = " + ".join(f"CASE WHEN {away(f'c{k}', 'page')} < {away(f'c{k}', 'i')} THEN 1 ELSE 0 END" for k in range(4))
    apart = " + ".join(f"coalesce(abs({away(f'c{k}', 'i')} - {away(f'c{k}', 'page')}), 0)" for k in range(4))
    voted = f"SELECT page_id, rect_id, {away('i', 'page')} AS base, {votes} AS rounded_corners, {apart} AS sep FROM (SELECT *, {outer} FROM ({rows}) r) s WHERE {away('i', 'page')} >= 30"
    return f"SELECT page_id, rect_id, CASE WHEN rounded_corners >= 3 THEN 'rounded' ELSE 'square' END AS style, rounded_corners, {rounded('greatest(CAST(0.1 AS DOUBLE), least(CAST(1 AS DOUBLE), CAST(sep AS DOUBLE) / 4 / base))', 6)} AS confidence FROM ({voted}) v WHERE rounded_corners <> 2"
