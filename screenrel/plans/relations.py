"""Relations that the driver's tables yield: interface pages made by integer arithmetic alone, so every engine makes the same rows."""

from __future__ import annotations

from collections.abc import Callable


def components(d) -> str:
    k, s = "o_orderkey", d.string
    return f"""SELECT *, x0 + w AS x1, y0 + h AS y1 FROM (SELECT {d.div(k, '60')} AS page_id, {k} % 60 AS ord, concat('c', CAST({k} AS {s})) AS id,
 CASE WHEN {k} % 10 < 4 THEN 'text' WHEN {k} % 10 < 6 THEN 'card' WHEN {k} % 10 = 6 THEN 'panel' WHEN {k} % 10 = 7 THEN 'icon' WHEN {k} % 10 = 8 THEN 'region' ELSE 'image' END AS type,
 CASE WHEN {k} % 10 IN (4,5) THEN 40 + ({k} % 3) * 330 ELSE ({k} * 37) % 1100 END AS x0,
 CASE WHEN {k} % 10 IN (4,5) THEN 100 + ({d.div(k, '10')} % 6) * 140 ELSE ({k} * 91) % 900 END AS y0,
 CASE WHEN {k} % 10 < 4 THEN 40 + (o_custkey * 13) % 160 WHEN {k} % 10 < 6 THEN 300 WHEN {k} % 10 = 7 THEN 16 + {k} % 25 ELSE 60 + (o_custkey * 13) % 340 END AS w,
 CASE WHEN {k} % 10 < 4 THEN 8 + ({k} % 5) * 6 WHEN {k} % 10 < 6 THEN 120 WHEN {k} % 10 = 7 THEN 16 + {k} % 25 ELSE 40 + (o_custkey * 7) % 260 END AS h,
 CASE WHEN {k} % 10 >= 4 THEN NULL WHEN {k} % 16 = 0 THEN concat('PH-', CAST({k} % 1000 AS {s})) WHEN {k} % 16 = 1 THEN concat('feat/PH-', CAST({k} AS {s})) WHEN {k} % 16 = 2 THEN concat('mail user', CAST(o_custkey AS {s}), '@example.com now') WHEN {k} % 16 = 3 THEN 'Apr 25 (Overdue)' WHEN {k} % 16 = 5 THEN concat(CAST({k} % 5 AS {s}), '/5') WHEN {k} % 16 = 6 THEN concat('Total $1,', CAST(100 + {k} % 800 AS {s})) WHEN {k} % 16 = 7 THEN concat(CAST({k} % 100 AS {s}), '%') WHEN {k} % 16 = 8 THEN concat('IN PROGRESS (', CAST({k} % 50 AS {s}), ')') ELSE concat('Label ', CAST({k} % 97 AS {s})) END AS text,
 CAST(50 + {k} % 50 AS DOUBLE) / 100 AS confidence,
 CASE WHEN {k} % 10 < 4 THEN CASE {k} % 3 WHEN 0 THEN 'heading' WHEN 1 THEN 'body' ELSE 'caption' END END AS tier, CASE WHEN {k} % 10 < 4 THEN CASE {k} % 4 WHEN 0 THEN 'heavy' WHEN 1 THEN 'regular' END END AS weight,
 CASE WHEN {k} % 10 IN (4,5,6) THEN CASE {k} % 3 WHEN 0 THEN 'rounded' WHEN 1 THEN 'square' END END AS corner_style FROM {d.table('orders')}) c"""


def tokens(d) -> str:
    words = d.words("text")
    return f"""SELECT page_id, turn, pos, word AS text, 20 + (pos % 10) * 110 AS x0, turn * 400 + {d.div('pos', '10')} * 24 + (pos * 5) % 7 AS y0, 20 + (pos % 10) * 110 + 8 * length(word) AS x1, turn * 400 + {d.div('pos', '10')} * 24 + (pos * 5) % 7 + 12 + pos % 4 AS y1, CAST((page_id * 31 + pos * 17) % 100 AS DOUBLE) / 100 AS confidence
 FROM (SELECT page_id, turn, pos, {d.item('ws', 'pos')} AS word FROM (SELECT conv_id AS page_id, turn, ws, {d.explode}({d.series('0', d.size('ws') + ' - 1')}) AS pos FROM (SELECT conv_id, turn, {words} AS ws FROM {d.table('conversations')}) a) b) w WHERE word <> ''"""


def colors(d) -> str:
    return "SELECT page_id, ord, (ord * 31 + page_id) % 256 AS r, (ord * 57 + page_id) % 256 AS g, (ord * 83 + page_id) % 256 AS b, x0 + ord % 5 AS x0, y0 + ord % 3 AS y0, x1, y1 FROM components WHERE ord % 7 <> 0"


def pixels(d) -> str:
    """An image of 64 x 48 for each page: a gradient on top, a panel with ink on it and round, half round or square corners, and three bars."""
    inner = "least(x - 4, 35 - x) + least(y - 10, 41 - y)"
    panel = f"x >= 4 AND x < 36 AND y >= 10 AND y < 42 AND NOT ({inner} < 8 AND (page_id % 3 = 0 OR (page_id % 3 = 1 AND x < 20)))"
    ink = "x >= 16 AND x < 24 AND y >= 20 AND y < 26 AND (x + y) % 3 = 0"
    bar = f"x >= 41 AND x < 62 AND (x - 41) % 7 < 4 AND y < 40 AND y >= 30 - (page_id * 7 + {d.div('x - 41', '7')} * 11) % 20"
    colour = lambda strip, on, body, stroke, page: f"CASE WHEN y < 8 THEN {strip} WHEN {panel} THEN CASE WHEN {ink} THEN {on} ELSE {body} END WHEN {bar} THEN {stroke} ELSE {page} END"
    r, g, b = colour("(x * 4 + page_id) % 256", "250", "page_id * 37 % 120", "7", "200 + page_id * 5 % 40"), colour("(x * 2 + y) % 256", "245", "60 + page_id * 11 % 60", "138", "200 + page_id * 3 % 40"), colour("(y * 30) % 256", "240", "30 + page_id * 7 % 90", "82", "200 + page_id % 40")
    places = f"SELECT page_id, n % 64 AS x, {d.div('n', '64')} AS y, n FROM (SELECT page_id, {d.explode}({d.series('0', '3071')}) AS n FROM (SELECT {d.dealt('page_id')}DISTINCT page_id FROM components) p) e"
    return f"SELECT page_id, x, y, {r} AS r, {g} AS g, {b} AS b, CASE WHEN n % 97 = 0 THEN 0 ELSE 255 END AS a FROM ({places}) q"


def rects(d) -> str:
    """Five regions of each page's image: the panel, the bars, the gradient, one across the panel's ink, and a very small one."""
    sides = lambda *values: "CASE k " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"
    kinds = sides("'panel'", "'chart'", "'region'", "'button'", "'icon'")
    x0, y0, x1, y1 = sides("4", "40", "0", "12 + page_id % 5", "page_id % 60"), sides("10", "8", "0", "16 + page_id % 4", "page_id % 44"), sides("36", "63", "64", "30", "page_id % 60 + 3"), sides("42", "42", "8", "28", "page_id % 44 + 2")
    return f"SELECT page_id, page_id * 5 + k AS rect_id, {kinds} AS type, {x0} AS x0, {y0} AS y0, {x1} AS x1, {y1} AS y1 FROM (SELECT page_id, {d.explode}({d.series('0', '4')}) AS k FROM (SELECT {d.dealt('page_id')}DISTINCT page_id FROM components) p) e"


def images(d) -> str:
    """Widths and heights of pages."""
    return "SELECT page_id, 600 + page_id * 97 % 3000 AS w, 500 + page_id * 61 % 2000 AS h FROM (SELECT DISTINCT page_id FROM components) p"


def triples(d) -> str:
    """Relations that a model states between components, some of them of none."""
    return f"SELECT page_id, id AS a, concat('c', CAST(page_id * 60 + (ord + 1) % 60 AS {d.string})) AS b, 'contains' AS relation FROM components"


def label_samples(d) -> str:
    return f"SELECT {d.div('user_id', '60')} AS page_id, user_id AS element_id, event_id AS run, CASE event_type WHEN 'click' THEN 'magnifier icon' WHEN 'view' THEN 'search' WHEN 'error' THEN '<svg' ELSE event_type END AS raw_label FROM {d.table('events')}"


def summaries(d) -> str:
    """Whole texts of assistants, with a sentence of claims: colours, some of them twice, quotes of both kinds, amounts and counts."""
    hexes = "CASE WHEN conv_id % 2 = 0 THEN '1F2E3D' ELSE 'FFFFFF' END"
    counted = f"CASE conv_id % 4 WHEN 0 THEN 'two panels' WHEN 1 THEN concat(CAST(conv_id % 40 AS {d.string}), '  cards') WHEN 2 THEN '1234 cards and 0 icons' ELSE '6 icons, six icons' END"
    return f"""SELECT conv_id AS page_id, turn, concat(text, ' The panel is blue, not grey, #', {hexes}, ' and #', {hexes}, ' or #0A0B0C, with "', substr(text, 1, 12), '", "', substr(text, 1, 12), '" and “nothing here”, code 12ab34, $1,', CAST(100 + conv_id % 800 AS {d.string}), ' over ', {counted}, ', fade on hover.') AS summary FROM {d.table('conversations')} WHERE role = 'assistant'"""


def strokes(d) -> str:
    return f"SELECT {d.div('l_orderkey', '60')} AS page_id, l_orderkey % 60 AS ord, min(CAST(l_quantity AS DOUBLE) / 10 + 0.5) AS stroke FROM {d.table('lineitem')} GROUP BY l_orderkey"


def boxes(d) -> str:
    """Detected boxes with area and fill."""
    return "SELECT page_id, ord, x0, y0, x1, y1, CAST(w * h AS DOUBLE) / (1280 * 1100) AS area_frac, CAST(50 + (ord * 7) % 50 AS DOUBLE) / 100 AS fill_ratio FROM components WHERE type <> 'text'"


def vision(d) -> str:
    """What a vision model says of a crop: some rows lack an id or a box."""
    return f"SELECT page_id, concat('tile', CAST({d.div('ord', '15')} AS {d.string})) AS crop_id, ord % 15 AS idx, ord, CASE WHEN ord % 4 = 0 THEN '' ELSE id END AS id, type, text, CASE WHEN ord % 3 = 0 THEN 0 ELSE x0 END AS x0, CASE WHEN ord % 3 = 0 THEN 0 ELSE y0 END AS y0, CASE WHEN ord % 3 = 0 THEN 0 ELSE x1 END AS x1, CASE WHEN ord % 3 = 0 THEN 0 ELSE y1 END AS y1, ({d.div('ord', '15')} % 2) * 640 AS cx0, {d.div('ord', '30')} * 550 AS cy0 FROM components"


def edges(d) -> str:
    v = "CAST(greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS DOUBLE) / greatest(1, least(a.y1 - a.y0, b.y1 - b.y0))"
    h = "CAST(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS DOUBLE) / greatest(1, least(a.x1 - a.x0, b.x1 - b.x0))"
    return f"""SELECT page_id, a, b, relation, CASE relation WHEN 'contains' THEN 0.8D ELSE 0.7D END AS confidence FROM (SELECT a.page_id, a.id AS a, b.id AS b,
 CASE WHEN a.x0 <= b.x0 AND a.y0 <= b.y0 AND a.x1 >= b.x1 AND a.y1 >= b.y1 AND (a.x1 - a.x0) * (a.y1 - a.y0) > 3 * (b.x1 - b.x0) * (b.y1 - b.y0) THEN 'contains'
 WHEN {v} > 0.5 AND (b.x0 > a.x1 OR a.x0 > b.x1) THEN 'same_row' WHEN a.x1 <= b.x0 AND {v} > 0.3 THEN 'left_of' WHEN a.y1 <= b.y0 AND {h} > 0.3 THEN 'below' END AS relation
 FROM components a JOIN components b ON a.page_id = b.page_id AND a.ord <> b.ord) r WHERE relation IS NOT NULL""".replace("0.8D", "CAST(0.8 AS DOUBLE)").replace("0.7D", "CAST(0.7 AS DOUBLE)")


def parents(d) -> str:
    """Smallest strictly larger container of each component."""
    return """SELECT page_id, id, parent FROM (SELECT c.page_id, c.id, p.id AS parent, row_number() OVER (PARTITION BY c.page_id, c.id ORDER BY (p.x1 - p.x0) * (p.y1 - p.y0), p.ord) AS k
 FROM components c LEFT JOIN components p ON c.page_id = p.page_id AND c.ord <> p.ord AND p.x0 <= c.x0 AND p.y0 <= c.y0 AND p.x1 >= c.x1 AND p.y1 >= c.y1 AND 100 * (p.x1 - p.x0) * (p.y1 - p.y0) > 105 * (c.x1 - c.x0) * (c.y1 - c.y0)) x WHERE k = 1"""


def members(d) -> str:
    """Members of repeated groups: boxes of a type and of about the size of a first one, in line on an axis, 20 or more apart on average along the other. `ordinal` numbers a type's groups on its page, `place` the members of a group."""
    boxes = "SELECT page_id, type, id, ord, x0, y0, x1, y1, x1 - x0 AS w, y1 - y0 AS h FROM components WHERE type NOT IN ('text', 'label', '')"
    cx, cy = d.div("x0 + x1", "2"), d.div("y0 + y1", "2")
    both = " UNION ALL ".join(f"SELECT page_id, type, cluster, '{axis}' AS axis, id, ord, x0, y0, x1, y1, {a} AS a, {b} AS b FROM ({d.seeded(boxes, 'page_id, type', 50)}) s" for axis, a, b in (("x", cx, cy), ("y", cy, cx)))
    line = "PARTITION BY page_id, type, cluster, axis ORDER BY a, ord"
    fresh = f"SELECT *, CASE WHEN a - lag(a) OVER ({line}) > 80 THEN 1 ELSE 0 END AS fresh FROM ({both}) u"
    runs = f"SELECT *, sum(fresh) OVER ({line} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM ({fresh}) f"
    group = "PARTITION BY page_id, type, cluster, axis, run"
    spaced = f"SELECT *, count(*) OVER ({group}) AS n, max(b) OVER ({group}) - min(b) OVER ({group}) AS reach FROM ({runs}) r"
    kept = f"SELECT page_id, type, cluster, axis, run, id, ord, x0, y0, x1, y1, b, n, {d.div('reach', 'n - 1')} AS spacing FROM ({spaced}) s WHERE n >= 2 AND {d.div('reach', 'greatest(1, n - 1)')} >= 20"
    return f"SELECT page_id, type, axis, CAST(dense_rank() OVER (PARTITION BY page_id, type ORDER BY cluster, axis, run) AS BIGINT) AS ordinal, id, ord, x0, y0, x1, y1, CAST(n AS BIGINT) AS n, CAST(spacing AS BIGINT) AS spacing, row_number() OVER ({group} ORDER BY b, ord) AS place FROM ({kept}) k"


def groups(d) -> str:
    """Repeated groups with their boxes, the gaps between neighbours, and whether they form a column."""
    near = lambda c: f"max(CASE WHEN place = 1 THEN {c}0 END) AS a{c}0, max(CASE WHEN place = 1 THEN {c}1 END) AS a{c}1, max(CASE WHEN place = 2 THEN {c}0 END) AS b{c}0, max(CASE WHEN place = 2 THEN {c}1 END) AS b{c}1"
    start, end = "CASE axis WHEN 'x' THEN y0 ELSE x0 END", "CASE axis WHEN 'x' THEN y1 ELSE x1 END"
    by = "PARTITION BY page_id, type, ordinal"
    gaps = f"SELECT page_id, type, ordinal, {start} - lag({end}) OVER ({by} ORDER BY {start}, place) AS gap FROM members"
    ranked = f"SELECT page_id, type, ordinal, greatest(0, gap) AS gap, row_number() OVER ({by} ORDER BY greatest(0, gap)) AS k, count(*) OVER ({by}) AS m FROM ({gaps}) g WHERE gap IS NOT NULL"
    gapped = f"SELECT page_id, type, ordinal, max(CASE WHEN k = {d.div('m', '2')} + 1 THEN gap END) AS gap_median, max(gap) - min(gap) AS gap_spread FROM ({ranked}) r GROUP BY page_id, type, ordinal"
    boxed = f"SELECT page_id, type, ordinal, max(axis) AS axis, max(n) AS members, max(spacing) AS spacing, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, {near('x')}, {near('y')} FROM members GROUP BY page_id, type, ordinal"
    shared = lambda c: f"greatest(0, least(b.a{c}1, b.b{c}1) - greatest(b.a{c}0, b.b{c}0))"
    trust = "CASE WHEN g.gap_median = 0 THEN CAST(1 AS DOUBLE) ELSE greatest(CAST(0 AS DOUBLE), 1 - CAST(g.gap_spread AS DOUBLE) / g.gap_median) END"
    return f"SELECT b.page_id, b.type, b.ordinal, b.axis, b.members, b.spacing, b.x0, b.y0, b.x1, b.y1, g.gap_median, g.gap_spread, {trust} AS trust, CASE WHEN {shared('x')} > {shared('y')} THEN 'column' ELSE 'row' END AS kind FROM ({boxed}) b JOIN ({gapped}) g ON b.page_id = g.page_id AND b.type = g.type AND b.ordinal = g.ordinal"


def headers(d) -> str:
    """The text that stands closest above each group along the x axis."""
    over = "least(g.x1, t.x1) - greatest(g.x0, t.x0)"
    ranked = f"SELECT g.page_id, g.type, g.ordinal, t.id AS header_id, t.text AS header, row_number() OVER (PARTITION BY g.page_id, g.type, g.ordinal ORDER BY g.y0 - t.y1, -({over}), t.ord) AS k FROM groups g JOIN components t ON g.page_id = t.page_id AND t.type = 'text' AND t.text IS NOT NULL AND g.y0 - t.y1 BETWEEN 0 AND 120 AND {over} > 0 WHERE g.axis = 'x'"
    return f"SELECT page_id, type, ordinal, header_id, header FROM ({ranked}) r WHERE k = 1"


def owners(d) -> str:
    """The first even enough group that each of its members is in."""
    return "SELECT page_id, type, id, min(ordinal) AS ordinal FROM (SELECT m.page_id, m.type, m.id, m.ordinal FROM members m JOIN groups g ON m.page_id = g.page_id AND m.type = g.type AND m.ordinal = g.ordinal WHERE g.trust >= CAST(0.5 AS DOUBLE)) o GROUP BY page_id, type, id"


def containers(d) -> str:
    """Inferred containers: even enough groups that own two members or more, under the smallest larger component around them that they do not own."""
    area = "(({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0))"
    name = f"concat('L:', g.type, ':', CAST(g.ordinal AS {d.string}))"
    own = f"SELECT g.page_id, {name} AS id, g.type, g.ordinal, g.kind, g.trust, g.members, g.x0, g.y0, g.x1, g.y1 FROM groups g JOIN (SELECT page_id, type, ordinal FROM owners GROUP BY page_id, type, ordinal HAVING count(*) >= 2) o ON g.page_id = o.page_id AND g.type = o.type AND g.ordinal = o.ordinal"
    ranked = f"SELECT i.*, c.id AS parent, row_number() OVER (PARTITION BY i.page_id, i.id ORDER BY {area.format('c')}, c.ord) AS k FROM ({own}) i LEFT JOIN (SELECT c.*, o.ordinal AS own FROM components c LEFT JOIN owners o ON c.page_id = o.page_id AND c.id = o.id) c ON i.page_id = c.page_id AND c.x0 <= i.x0 AND c.y0 <= i.y0 AND c.x1 >= i.x1 AND c.y1 >= i.y1 AND {area.format('c')} > {area.format('i')} AND NOT (c.type = i.type AND coalesce(c.own, 0) = i.ordinal)"
    return f"SELECT r.page_id, r.id, r.type, r.ordinal, r.kind, floor(r.trust * 100 + CAST(0.5 AS DOUBLE)) / CAST(100 AS DOUBLE) AS confidence, r.members, r.x0, r.y0, r.x1, r.y1, r.parent, h.header AS label FROM ({ranked}) r LEFT JOIN headers h ON r.page_id = h.page_id AND r.type = h.type AND r.ordinal = h.ordinal WHERE r.k = 1"


def nodes(d) -> str:
    """Nodes of the layout: components that no group owns, inferred containers, and their members, which are leaves; each with its place among its siblings and its share of them."""
    real = "SELECT c.page_id, c.id, p.parent, 0 AS leaf, 0 AS inferred, c.type AS kind, CAST(NULL AS VARCHAR(1)) AS label, c.confidence, c.text, c.ord, c.x0, c.y0, c.x1, c.y1 FROM components c JOIN parents p ON c.page_id = p.page_id AND c.id = p.id LEFT JOIN owners o ON c.page_id = o.page_id AND c.id = o.id WHERE o.id IS NULL".replace("VARCHAR(1)", d.string)
    boxes = f"SELECT page_id, id, parent, 0 AS leaf, 1 AS inferred, kind, label, confidence, CAST(NULL AS {d.string}) AS text, 1000000 + ordinal AS ord, x0, y0, x1, y1 FROM containers"
    owned = f"SELECT c.page_id, c.id, n.id AS parent, 1 AS leaf, 0 AS inferred, c.type AS kind, CAST(NULL AS {d.string}) AS label, c.confidence, c.text, c.ord, c.x0, c.y0, c.x1, c.y1 FROM owners o JOIN containers n ON o.page_id = n.page_id AND o.type = n.type AND o.ordinal = n.ordinal JOIN components c ON o.page_id = c.page_id AND o.id = c.id"
    return f"SELECT * FROM ({real}) a UNION ALL SELECT * FROM ({boxes}) b UNION ALL SELECT * FROM ({owned}) c"


#: In order of need: a relation uses only tables and those before it.
RELATIONS: dict[str, Callable] = {f.__name__: f for f in (components, tokens, colors, pixels, rects, images, triples, label_samples, summaries, strokes, boxes, vision, edges, parents, members, groups, headers, owners, containers, nodes)}
USES = {name: ("components",) for name in ("colors", "pixels", "rects", "images", "triples", "boxes", "vision", "edges", "parents", "members")}
USES |= {"groups": ("members",), "headers": ("groups", "components"), "owners": ("members", "groups"), "containers": ("groups", "owners", "headers", "components"), "nodes": ("components", "parents", "owners", "containers")}
