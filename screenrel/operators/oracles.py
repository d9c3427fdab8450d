"""Folds once more, as recursion over rows in the other engine's SQL: an independent reading, for checks alone."""

from __future__ import annotations

from screenrel.operators.catalog import rounded

BOX = "{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}"


def ratio(a: str, b: str) -> str:
    """Intersection over union of boxes a and b, 0 where they are apart."""
    both = f"greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"
    size = "greatest(0, {0}.x1 - {0}.x0) * greatest(0, {0}.y1 - {0}.y0)"
    return f"CASE WHEN {both} = 0 THEN 0.0 ELSE CAST({both} AS DOUBLE) / ({size.format(a)} + {size.format(b)} - {both}) END"


def steps(rows: str, order: str, state: str, first: str, then: str) -> str:
    """The last state of each page: `first` of its first row n, then `then` of each next row n and the state so far, r."""
    numbered = f"SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY {order}) AS seq FROM ({rows}) q"
    return f"""(WITH RECURSIVE n AS ({numbered}), r AS (SELECT n.page_id, n.seq, {first} AS {state} FROM n WHERE n.seq = 1
 UNION ALL SELECT n.page_id, n.seq, {then} AS {state} FROM r JOIN n ON n.page_id = r.page_id AND n.seq = r.seq + 1)
 SELECT page_id, {state} FROM (SELECT *, max(seq) OVER (PARTITION BY page_id) AS most FROM r) z WHERE seq = most)"""


def reconcile() -> str:
    value = "{'id': n.id, 'type': n.type, 'text': n.text, 'confidence': n.confidence, 'certain': n.confidence, 'x0': n.x0, 'y0': n.y0, 'x1': n.x1, 'y1': n.y1}"
    surer = "n.type <> k.type AND n.confidence > k.certain"
    alike = f"({ratio('k', 'n')}) > 0.65 AND (coalesce(lower(trim(n.text)), '') <> '' AND lower(trim(n.text)) = coalesce(lower(trim(k.text)), '') OR n.type = k.type)"
    place = f"list_position(list_transform(r.kept, lambda k: coalesce({alike}, false)), true)"
    hull = {"x0": "least(k.x0, n.x0)", "y0": "least(k.y0, n.y0)", "x1": "greatest(k.x1, n.x1)", "y1": "greatest(k.y1, n.y1)"}
    grown, own = f"({hull['x1']} - {hull['x0']}) * ({hull['y1']} - {hull['y0']})", "(n.x1 - n.x0) * (n.y1 - n.y0)"
    blend = f"0.5 * ((k.confidence * ({grown}) + n.confidence * ({own})) / (({grown}) + ({own}))) + 0.5 * greatest(k.confidence, n.confidence)"
    merged = f"{{'id': k.id, 'type': CASE WHEN {surer} THEN n.type ELSE k.type END, 'text': CASE WHEN coalesce(k.text, '') = '' THEN n.text ELSE k.text END, 'confidence': {blend}, 'certain': CASE WHEN {surer} THEN n.confidence ELSE k.certain END, " + ", ".join(f"'{c}': {x}" for c, x in hull.items()) + "}"
    then = f"CASE WHEN coalesce({place}, 0) = 0 THEN list_append(r.kept, {value}) ELSE list_transform(r.kept, lambda k, i: CASE WHEN i = {place} THEN {merged} ELSE k END) END"
    rows = "SELECT * FROM components WHERE x1 > x0 AND y1 > y0"
    return f"SELECT page_id, k.id, k.type, k.text, k.confidence, k.x0, k.y0, k.x1, k.y1 FROM (SELECT page_id, unnest(kept) AS k FROM {steps(rows, 'ord, id', 'kept', f'[{value}]', then)} s) u"


def dedupe_boxes() -> str:
    value = "{'ord': n.ord, 'x0': n.x0, 'y0': n.y0, 'x1': n.x1, 'y1': n.y1}"
    then = f"CASE WHEN len(list_filter(r.kept, lambda k: ({ratio('k', 'n')}) >= 0.8)) = 0 THEN list_append(r.kept, {value}) ELSE r.kept END"
    return f"SELECT page_id, k.ord FROM (SELECT page_id, unnest(kept) AS k FROM {steps('SELECT * FROM boxes', '-(x1 - x0) * (y1 - y0), ord', 'kept', f'[{value}]', then)} s) u"


def union_boxes() -> str:
    value = "{'ord': n.ord, 'x0': n.x0, 'y0': n.y0, 'x1': n.x1, 'y1': n.y1}"
    then = f"CASE WHEN n.ord % 2 = 0 OR len(list_filter(r.kept, lambda k: ({ratio('k', 'n')}) >= 0.6)) = 0 THEN list_append(r.kept, {value}) ELSE r.kept END"
    return f"SELECT page_id, k.ord FROM (SELECT page_id, unnest(kept) AS k FROM {steps('SELECT * FROM boxes', 'ord % 2, ord', 'kept', f'[{value}]', then)} s) u"


def lines(tokens: str, enough: str) -> str:
    """Tokens with their line: the first with a member that reaches over enough of the lower of the two heights."""
    over = "least(m.y1, n.y1) - greatest(m.y0, n.y0)"
    value = lambda line: f"{{'turn': n.turn, 'pos': n.pos, 'y0': n.y0, 'y1': n.y1, 'line': {line}}}"
    found = f"list_min(list_transform(list_filter(r.held, lambda m: {over} > 0 AND {enough.format(over=over)}), lambda m: m.line))"
    then = f"list_append(r.held, {value(f'CAST(coalesce({found}, list_max(list_transform(r.held, lambda m: m.line)) + 1) AS BIGINT)')})"
    return f"SELECT page_id, m.turn, m.pos, m.line FROM (SELECT page_id, unnest(held) AS m FROM {steps(tokens, 'y0, x0, turn, pos', 'held', '[' + value('CAST(0 AS BIGINT)') + ']', then)} s) u"


LINE = "{over} >= 0.4 * greatest(1, least(m.y1 - m.y0, n.y1 - n.y0))"


def ocr_lines() -> str:
    return lines("SELECT * FROM tokens", LINE)


def token_rows() -> str:
    return f"SELECT page_id, turn, pos, line AS row FROM ({lines('SELECT * FROM tokens', 'true')}) l"


def text_components() -> str:
    good = "SELECT * FROM tokens WHERE trim(text) <> '' AND x1 > x0 AND y1 > y0 AND NOT (confidence > 0 AND confidence < 0.3)"
    lined = f"SELECT g.*, l.line FROM ({good}) g JOIN ({lines(good, LINE)}) l ON g.page_id = l.page_id AND g.turn = l.turn AND g.pos = l.pos"
    heights = f"SELECT page_id, list_sort(list(y1 - y0)) AS hs FROM ({good}) g GROUP BY page_id"
    gaps = f"SELECT a.*, CASE WHEN a.x0 - lag(a.x1) OVER w > 1.5 * greatest(1, h.hs[len(h.hs) // 2 + 1]) THEN 1 ELSE 0 END AS fresh FROM ({lined}) a JOIN ({heights}) h ON a.page_id = h.page_id WINDOW w AS (PARTITION BY a.page_id, a.line ORDER BY a.x0, a.turn, a.pos)"
    runs = f"SELECT *, sum(fresh) OVER (PARTITION BY page_id, line ORDER BY x0, turn, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM ({gaps}) g"
    merged = f"SELECT page_id, line, run, string_agg(text, ' ' ORDER BY x0, turn, pos) AS text, avg(confidence) AS mean, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ({runs}) r GROUP BY page_id, line, run"
    return f"SELECT page_id, concat('t', lpad(CAST(row_number() OVER (PARTITION BY page_id ORDER BY line, run) - 1 AS VARCHAR), 4, '0')) AS id, text, CASE WHEN mean > 0 THEN mean ELSE 0.5 END AS confidence, x0, y0, x1, y1 FROM ({merged}) m"


def horizontal_bands() -> str:
    rows = f"SELECT t.page_id, r.row, min(t.y0) AS top, max(t.y1) AS bottom FROM tokens t JOIN ({token_rows()}) r ON t.page_id = r.page_id AND t.turn = r.turn AND t.pos = r.pos GROUP BY t.page_id, r.row"
    before = f"SELECT page_id, top, coalesce(max(bottom) OVER (PARTITION BY page_id ORDER BY top, bottom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS until FROM ({rows}) r"
    found = f"SELECT page_id, until AS y0, top AS y1 FROM ({before}) b WHERE top > until UNION ALL SELECT page_id, max(y1), max(y1) + 40 FROM tokens GROUP BY page_id"
    return f"SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY y0) - 1 AS band, y0, y1 FROM ({found}) f"


def plan_adaptive() -> str:
    sized = f"SELECT b.*, s.w, greatest(s.w, b.y1 - b.y0) <= 1100 AS fits FROM ({horizontal_bands()}) b JOIN (SELECT page_id, max(x1) + 20 AS w FROM tokens GROUP BY page_id) s ON b.page_id = s.page_id"
    down = f"SELECT *, unnest(CASE WHEN fits THEN [y0] ELSE range(y0, y1, 880) END) AS y FROM ({sized}) s"
    tiles = f"SELECT *, unnest(CASE WHEN fits THEN [0] ELSE range(0, w, 880) END) AS x FROM ({down}) d"
    crops = f"SELECT page_id, concat('c', lpad(CAST(row_number() OVER (PARTITION BY page_id ORDER BY band, y, x) - 1 AS VARCHAR), 4, '0')) AS id, x AS x0, y AS y0, CASE WHEN fits THEN w ELSE least(w, x + 1100) END AS x1, CASE WHEN fits THEN y1 ELSE least(y1, y + 1100) END AS y1 FROM ({tiles}) t"
    return f"SELECT page_id, 'ov' AS id, 0 AS x0, 0 AS y0, max(x1) + 20 AS x1, max(y1) + 40 AS y1 FROM tokens GROUP BY page_id UNION ALL {crops}"


def layout_tree() -> str:
    siblings = "SELECT c.*, p.x1 - p.x0 AS pw, p.y1 - p.y0 AS ph, count(*) OVER w AS sibs, max(c.y1) OVER w - min(c.y0) OVER w AS tall, max(c.x1) OVER w - min(c.x0) OVER w AS wide FROM nodes c JOIN nodes p ON c.page_id = p.page_id AND c.parent = p.id AND p.leaf = 0 WINDOW w AS (PARTITION BY c.page_id, c.parent)"
    along = f"SELECT *, sibs >= 2 AND greatest(tall, wide) > 0 AS dealt, tall >= wide AS upright FROM ({siblings}) s"
    sides = f"SELECT *, CASE WHEN upright THEN y0 ELSE x0 END AS a, CASE WHEN upright THEN y1 ELSE x1 END AS z, greatest(tall, wide) AS span, CASE WHEN upright THEN ph ELSE pw END AS extent, CASE WHEN leaf = 1 THEN id ELSE lpad(CAST(ord AS VARCHAR), 12, '0') END AS base FROM ({along}) l"
    cents = lambda x: rounded(x, 2)
    placed = f"SELECT *, row_number() OVER o AS place, lag(z) OVER o AS until FROM ({sides}) s WINDOW o AS (PARTITION BY page_id, parent ORDER BY CASE WHEN dealt THEN a ELSE 0 END, base)"
    shared = f"SELECT page_id, id, parent, leaf, inferred, kind, label, confidence, text, place, CASE WHEN dealt THEN CASE WHEN upright THEN 'y' ELSE 'x' END END AS axis, CASE WHEN dealt THEN {cents('CAST(z - a AS DOUBLE) / span')} END AS fraction, CASE WHEN dealt THEN CASE WHEN until >= 0 AND a > until THEN {cents('CAST(a - until AS DOUBLE) / span')} ELSE 0.0 END END AS gap_before, CASE WHEN dealt THEN CASE WHEN extent > 0 THEN {cents('CAST(span AS DOUBLE) / extent')} ELSE 0.0 END END AS tiling, x0, y0, x1, y1 FROM ({placed}) p"
    roots = "SELECT page_id, id, parent, leaf, inferred, kind, label, confidence, text, row_number() OVER (PARTITION BY page_id ORDER BY y0, x0, ord, id) AS place, CAST(NULL AS VARCHAR) AS axis, CAST(NULL AS DOUBLE) AS fraction, CAST(NULL AS DOUBLE) AS gap_before, CAST(NULL AS DOUBLE) AS tiling, x0, y0, x1, y1 FROM nodes WHERE parent IS NULL"
    tree = f"(WITH RECURSIVE s AS ({shared}), t AS (SELECT *, [place] AS path, 0 AS depth FROM ({roots}) r UNION ALL SELECT s.*, list_append(t.path, s.place), t.depth + 1 FROM t JOIN s ON s.page_id = t.page_id AND s.parent = t.id AND t.leaf = 0) SELECT * FROM t)"
    return f"SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY path) - 1 AS seq, depth, id, parent, inferred, kind, label, confidence, text, axis, fraction, gap_before, tiling, x0, y0, x1, y1 FROM {tree} z"


def find_container() -> str:
    return f"SELECT page_id, id, inferred, kind, label FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY seq) AS k FROM ({layout_tree()}) t WHERE id = 'L:card:4' OR lower(label) LIKE '%/5%') f WHERE k = 1"


def container_children() -> str:
    return f"SELECT t.page_id, t.parent, f.label AS container_label, t.seq, t.id, CASE WHEN t.inferred = 0 THEN t.kind END AS type, CASE WHEN t.inferred = 1 THEN t.kind END AS kind, t.text, t.axis, round(t.fraction * 100, 1) AS share_percent, t.x0, t.y0, t.x1, t.y1 FROM ({layout_tree()}) t JOIN ({find_container()}) f ON t.page_id = f.page_id AND t.parent = f.id"


def occupancy_shares() -> str:
    return f"SELECT page_id, id, parent, axis, fraction, gap_before, tiling FROM ({layout_tree()}) t WHERE axis IS NOT NULL"


def layout_containers() -> str:
    return f"SELECT t.page_id, t.id, t.kind, t.label, t.confidence, count(*) AS children FROM ({layout_tree()}) t JOIN ({layout_tree()}) c ON t.page_id = c.page_id AND c.parent = t.id WHERE t.inferred = 1 GROUP BY t.page_id, t.id, t.kind, t.label, t.confidence"


def text_tiers() -> str:
    """Means of three, else two bands by at most fifty steps from quantiles, else of all; nearest centres, the lower index on ties."""
    texts = "SELECT page_id, id, y1 - y0 AS h FROM components WHERE type = 'text' AND y1 > y0"
    lists = f"SELECT page_id, list_sort(list(CAST(h AS DOUBLE))) AS hs FROM ({texts}) t GROUP BY page_id"
    large = "list_filter(hs, lambda h: h >= hs[len(hs) // 2 + 1] * 0.35)"
    kept = f"SELECT page_id, CASE WHEN len({large}) >= 2 THEN {large} ELSE hs END AS hs FROM ({lists}) l"
    start = "list_transform(range(0, k), lambda i: hs[least(len(hs), CAST(floor((i + 0.5) / k * len(hs)) AS BIGINT) + 1)])"
    seeds = f"SELECT page_id, hs, k, {start} AS cs, 0 AS step, false AS same FROM ({kept}) q, (VALUES (2), (3)) z(k) WHERE len(list_distinct(hs)) >= k"
    nearest = "list_position(list_transform({cs}, lambda c: abs({h} - c)), list_min(list_transform({cs}, lambda c: abs({h} - c))))"
    own = f"list_filter(hs, lambda h: {nearest.format(cs='cs', h='h')} = i)"
    moved = f"list_transform(range(1, k + 1), lambda i: CASE WHEN len({own}) > 0 THEN list_sum({own}) / len({own}) ELSE cs[i] END)"
    runs = f"(WITH RECURSIVE r AS ({seeds} UNION ALL SELECT page_id, hs, k, nxt, step + 1, nxt = cs FROM (SELECT *, {moved} AS nxt FROM r WHERE NOT same AND step < 50) m) SELECT page_id, k, list_reverse_sort(cs) AS cs FROM (SELECT *, row_number() OVER (PARTITION BY page_id, k ORDER BY step DESC) AS last FROM r) z WHERE last = 1)"
    good = f"SELECT page_id, k, cs FROM {runs} c WHERE list_min(list_transform(range(1, k), lambda i: (cs[i] - cs[i + 1]) / greatest(cs[i], 1e-9))) >= 0.18"
    best = f"SELECT l.page_id, coalesce(g.cs, [list_sum(l.hs) / len(l.hs)]) AS cs FROM ({kept}) l LEFT JOIN (SELECT page_id, arg_max(cs, k) AS cs FROM ({good}) g GROUP BY page_id) g ON l.page_id = g.page_id"
    placed = f"SELECT t.page_id, t.id, t.h, b.cs, {nearest.format(cs='b.cs', h='t.h')} AS own FROM ({texts}) t JOIN ({best}) b ON t.page_id = b.page_id"
    other = "list_min(list_transform(list_filter(range(1, len(cs) + 1), lambda i: i <> own), lambda i: abs(h - cs[i])))"
    return f"SELECT page_id, id, CASE len(cs) WHEN 1 THEN 'body' ELSE ['heading', 'body', 'caption'][own] END AS tier, CASE WHEN len(cs) = 1 THEN 1.0 WHEN {other} > 0 THEN greatest(0.0, least(1.0, ({other} - abs(h - cs[own])) / ({other} + abs(h - cs[own])))) ELSE 0.0 END AS confidence, len(cs) AS levels FROM ({placed}) p"


def dom_tree() -> str:
    """Opening and closing lines as events in order: a tag closes after the last node under it, inner ones first."""
    until = "SELECT t.page_id, t.id, min(n.seq) AS until FROM tree t JOIN tree n ON t.page_id = n.page_id AND n.seq > t.seq AND n.depth <= t.depth GROUP BY t.page_id, t.id"
    tag = "CASE WHEN inferred = 1 THEN 'div' WHEN kind IN ('button', 'button_primary') THEN 'button' WHEN kind IN ('input', 'text_field') THEN 'input' WHEN kind = 'navigation' THEN 'nav' WHEN kind IN ('card', 'container', 'panel', 'region') THEN 'section' WHEN kind = 'label' THEN 'label' WHEN kind = 'image' THEN 'img' ELSE 'div' END"
    pad = "repeat('  ', CAST(depth + 1 AS BIGINT))"
    attributes = "concat(' class=\"', kind, '\"', CASE WHEN inferred = 1 THEN ' data-inferred=\"true\"' ELSE '' END, ' data-conf=\"', printf('%.2f', confidence), '\"', CASE WHEN inferred = 1 AND label <> '' THEN concat(' aria-label=', CAST(to_json(label) AS VARCHAR)) ELSE '' END, CASE WHEN fraction IS NOT NULL THEN concat(' data-share=\"', printf('%.0f', fraction * 100), '%\"') ELSE '' END)"
    body = f"CASE WHEN inferred = 0 AND text <> '' THEN concat({pad}, '  ', text, chr(10)) ELSE '' END"
    opened = f"SELECT page_id, seq * 2 AS spot, 0 AS deep, concat({pad}, '<', {tag}, {attributes}, '>', chr(10), {body}) AS line FROM tree"
    closed = f"SELECT t.page_id, coalesce(u.until * 2 - 1, 1000000000) AS spot, -depth AS deep, concat({pad}, '</', {tag}, '>', chr(10)) AS line FROM tree t LEFT JOIN ({until}) u ON t.page_id = u.page_id AND t.id = u.id"
    return f"WITH tree AS ({layout_tree()}) SELECT p.page_id, concat('<!-- This DOM is INFERRED from screenshot analysis', CASE WHEN p.nested THEN ' (layout tree)' ELSE '' END, ', not observed HTML. -->', chr(10), '<div class=\"page\">', chr(10), e.body, '</div>', chr(10)) AS dom FROM (SELECT page_id, max(depth) > 0 AS nested FROM tree GROUP BY page_id) p JOIN (SELECT page_id, string_agg(line, '' ORDER BY spot, deep) AS body FROM ({opened} UNION ALL {closed}) v GROUP BY page_id) e ON p.page_id = e.page_id"


#: Name of the fold: the relations that its SQL reads, and the SQL.
ORACLES = {f.__name__: ((reads,), f) for reads, some in (("components", (reconcile, text_tiers)), ("boxes", (dedupe_boxes, union_boxes)), ("tokens", (ocr_lines, token_rows, text_components, horizontal_bands, plan_adaptive)), ("nodes", (layout_tree, find_container, container_children, occupancy_shares, layout_containers, dom_tree))) for f in some}
