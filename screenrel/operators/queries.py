"""Filters, projections, joins, rollups and windows over components, tokens and colours."""

from __future__ import annotations

from screenrel.operators.catalog import contains, hex_of, iou, operator, overlaps, rounded, values

W, H = 1280, 1100


def band(d, name: str, box: str = "") -> str:
    """Whether a box's centre is in an outer third of the page."""
    cx, cy = d.div(f"{box}x0 + {box}x1", "2"), d.div(f"{box}y0 + {box}y1", "2")
    return {"top": f"{cy} < {d.div(str(H), '3')}", "bottom": f"{cy} > {d.div(str(2 * H), '3')}", "left": f"{cx} < {d.div(str(W), '3')}", "right": f"{cx} > {d.div(str(2 * W), '3')}"}[name]


@operator("components")
def get_components(d):
    return f"SELECT page_id, id, type, text, total_matched FROM (SELECT *, count(*) OVER (PARTITION BY page_id) AS total_matched, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS k FROM components WHERE type = 'text' AND tier = 'heading' AND lower(text) LIKE '%label%' AND {band(d, 'top')}) q WHERE k > 0 AND k <= 40"


@operator("components")
def project_fields(d):
    return "SELECT page_id, id, type, text, tier, confidence FROM components"


@operator("components")
def region_band(d):
    return "SELECT page_id, id, " + ", ".join(f"CASE WHEN {band(d, b)} THEN 1 ELSE 0 END AS in_{b}" for b in ("top", "bottom", "left", "right")) + " FROM components"


@operator("components")
def paginate(d):
    return "SELECT page_id, id, k, total FROM (SELECT page_id, id, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS k, count(*) OVER (PARTITION BY page_id) AS total FROM components) q WHERE k > least(greatest(15, 0), total) AND k <= 15 + 20"


def distance(r, g, b, to=(7, 138, 82)):
    return f"floor(sqrt(CAST((({r}) - {to[0]}) * (({r}) - {to[0]}) + (({g}) - {to[1]}) * (({g}) - {to[1]}) + (({b}) - {to[2]}) * (({b}) - {to[2]}) AS DOUBLE)))"


@operator("components", "colors")
def near_color(d):
    return f"SELECT page_id, ord, CAST({distance('r', 'g', 'b')} AS BIGINT) AS dist FROM colors WHERE {distance('r', 'g', 'b')} <= 60"


@operator("components", "colors")
def rgb_distance(d):
    return f"SELECT page_id, ord, CAST({distance('r', 'g', 'b')} AS BIGINT) AS euclid, abs(r - 7) + abs(g - 138) + abs(b - 82) AS l1 FROM colors"


@operator("components", "colors")
def rgb_to_hex(d):
    return f"SELECT page_id, ord, {hex_of(d)} AS hex FROM colors"


@operator("components", "colors")
def hex_to_rgb(d):
    return f"SELECT page_id, ord, {d.hexpair('substr(hex, 2, 2)')} AS r, {d.hexpair('substr(hex, 4, 2)')} AS g, {d.hexpair('substr(hex, 6, 2)')} AS b FROM (SELECT page_id, ord, {hex_of(d)} AS hex FROM colors) q WHERE {d.like('hex', '^#[0-9A-Fa-f]{6}$')}"


@operator("tokens")
def ocr_filter(d):
    return "SELECT page_id, turn, pos, text FROM tokens WHERE trim(text) <> '' AND x1 > x0 AND y1 > y0 AND NOT (confidence > 0 AND confidence < CAST(0.30 AS DOUBLE))"


@operator("tokens")
def normalize_token(d):
    core = d.replace("text", "[.,:;)]+$", "")
    return f"SELECT page_id, turn, pos, CASE WHEN lower({core}) IN ('usp', 'uso', 'usd') THEN concat('USD', substr(text, length({core}) + 1)) ELSE text END AS text FROM tokens"


@operator("tokens")
def is_wordy(d):
    letters, solid = f"length({d.replace('text', '[^A-Za-z]', '')})", "length(replace(text, ' ', ''))"
    return f"SELECT page_id, turn, pos, CASE WHEN {letters} >= 2 AND 100 * {letters} >= 55 * {solid} THEN 1 ELSE 0 END AS wordy FROM tokens"


@operator("tokens")
def redact_text(d):
    return f"SELECT page_id, turn, pos, {d.replace('text', '[^ \\n\\t,.!?()\\[\\]_:;/@#-]', '█')} AS text FROM tokens"


@operator("components", "boxes")
def region_bands(d):
    return f"SELECT page_id, ord, CASE WHEN main THEN 'main' ELSE 'icon' END AS band FROM (SELECT *, (x1 - x0 >= 24 AND y1 - y0 >= 24 AND area_frac BETWEEN CAST(0.004 AS DOUBLE) AND CAST(0.6 AS DOUBLE)) AS main, (x1 - x0 BETWEEN 12 AND 44 AND y1 - y0 BETWEEN 12 AND 44 AND 10 * greatest(x1 - x0, y1 - y0) <= 16 * least(x1 - x0, y1 - y0)) AS icon FROM boxes) q WHERE icon OR (main AND fill_ratio >= CAST(0.75 AS DOUBLE))"


@operator("components")
def graphic_elements(d):
    return "SELECT page_id, id, type FROM components WHERE type IN ('icon', 'logo', 'chart', 'image')"


@operator("components")
def unresolved(d):
    return "SELECT page_id, count(CASE WHEN confidence < CAST(0.8 AS DOUBLE) THEN 1 END) AS below_threshold, count(CASE WHEN confidence < CAST(0.5 AS DOUBLE) THEN 1 END) AS below_half FROM components GROUP BY page_id"


SIGNALS = f"""SELECT a.page_id, a.ord, a.x0, a.y0, a.x1, a.y1, a.area_frac, a.fill_ratio, greatest(a.x1 - a.x0, a.y1 - a.y0) AS max_side, least(a.x1 - a.x0, a.y1 - a.y0) AS min_side,
 CAST(greatest(a.x1 - a.x0, a.y1 - a.y0) AS DOUBLE) / greatest(1, least(a.x1 - a.x0, a.y1 - a.y0)) AS aspect, (a.y0 + a.y1) * 10 <= 3 * {H} AS header_band, coalesce(e.encloses, 0) AS encloses, coalesce(t.cover, CAST(0 AS DOUBLE)) AS ocr_overlap
 FROM boxes a LEFT JOIN (SELECT a.page_id, a.ord, count(*) AS encloses FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.ord <> b.ord AND {contains('a', 'b')} AND NOT ({contains('b', 'a')}) GROUP BY a.page_id, a.ord) e ON a.page_id = e.page_id AND a.ord = e.ord
 LEFT JOIN (SELECT a.page_id, a.ord, least(CAST(1 AS DOUBLE), CAST(sum((least(a.x1, t.x1) - greatest(a.x0, t.x0)) * (least(a.y1, t.y1) - greatest(a.y0, t.y0))) AS DOUBLE) / max((a.x1 - a.x0) * (a.y1 - a.y0))) AS cover FROM boxes a JOIN components t ON a.page_id = t.page_id AND t.type = 'text' AND {overlaps('a', 't')} GROUP BY a.page_id, a.ord) t ON a.page_id = t.page_id AND a.ord = t.ord"""
KIND = "CASE WHEN max_side > 0 AND max_side <= 48 AND aspect <= CAST(1.6 AS DOUBLE) AND encloses = 0 THEN 'icon' WHEN ocr_overlap < CAST(0.05 AS DOUBLE) AND header_band AND encloses = 0 AND fill_ratio < CAST(0.85 AS DOUBLE) THEN 'logo' WHEN encloses >= 2 THEN 'container' WHEN fill_ratio >= CAST(0.85 AS DOUBLE) AND area_frac >= CAST(0.02 AS DOUBLE) THEN 'card' WHEN area_frac >= CAST(0.02 AS DOUBLE) THEN 'panel' WHEN ocr_overlap < CAST(0.05 AS DOUBLE) AND encloses = 0 THEN 'image' ELSE 'region' END"
TRUST = "least(CAST(0.9 AS DOUBLE), CAST(5 + CASE WHEN fill_ratio >= CAST(0.85 AS DOUBLE) THEN 2 ELSE 0 END + CASE WHEN encloses >= 2 THEN 1 ELSE 0 END AS DOUBLE) / 10)"


@operator("components", "boxes")
def region_signals(d):
    return f"SELECT page_id, ord, max_side, min_side, {rounded('aspect', 6)} AS aspect, CASE WHEN header_band THEN 1 ELSE 0 END AS header_band, encloses, {rounded('ocr_overlap', 6)} AS ocr_overlap FROM ({SIGNALS}) s"


@operator("components", "boxes")
def classify_region(d):
    return f"SELECT page_id, ord, {KIND} AS type, {TRUST} AS confidence FROM ({SIGNALS}) s"


@operator("components", "boxes")
def region_components(d):
    k = f"row_number() OVER (PARTITION BY page_id ORDER BY ord)"
    return f"SELECT page_id, concat('r', CASE WHEN {k} < 10000 THEN lpad(CAST({k} AS {d.string}), 4, '0') ELSE CAST({k} AS {d.string}) END) AS id, {KIND} AS type, {TRUST} AS confidence, x0, y0, x1, y1 FROM ({SIGNALS}) s"


@operator("components")
def clamp_box(d):
    return "SELECT page_id, id, greatest(0, least(x0, 900)) AS x0, greatest(0, least(y0, 700)) AS y0, greatest(0, least(x1, 900)) AS x1, greatest(0, least(y1, 700)) AS y1 FROM components WHERE least(x1, 900) > least(x0, 900) AND least(y1, 700) > least(y0, 700)"


@operator("components")
def pad_box(d):
    px, py = d.div("w * 15", "100"), d.div("h * 15", "100")
    return f"SELECT page_id, id, greatest(0, x0 - {px}) AS x0, greatest(0, y0 - {py}) AS y0, least({W}, x1 + {px}) AS x1, least({H}, y1 + {py}) AS y1 FROM components"


@operator("components")
def fit_within(d):
    return f"SELECT page_id, id, CASE WHEN greatest(w, h) <= 128 THEN w WHEN w >= h THEN 128 ELSE greatest(1, {d.div('w * 128', 'h')}) END AS w, CASE WHEN greatest(w, h) <= 128 THEN h WHEN w >= h THEN greatest(1, {d.div('h * 128', 'w')}) ELSE 128 END AS h FROM components"


@operator("components", "vision")
def synth_ids(d):
    return f"SELECT page_id, ord, CASE WHEN trim(id) = '' THEN concat(crop_id, '-', CAST(idx AS {d.string})) ELSE id END AS id FROM vision"


@operator("components", "edges")
def spatial_relations(d):
    return "SELECT page_id, a, b, relation, confidence FROM edges"


@operator("components")
def iou_pairs(d):
    return f"SELECT a.page_id, a.id AS a, b.id AS b, {rounded(iou('a', 'b'), 9)} AS iou FROM components a JOIN components b ON a.page_id = b.page_id AND a.ord < b.ord AND {overlaps('a', 'b')}"


BEST = f"SELECT page_id, id, ord, text, tier, weight, r, g, b FROM (SELECT t.page_id, t.id, t.ord, t.text, t.tier, t.weight, c.r, c.g, c.b, row_number() OVER (PARTITION BY t.page_id, t.id ORDER BY CASE WHEN c.ord IS NULL THEN CAST(-1 AS DOUBLE) ELSE {iou('t', 'c')} END DESC, c.ord) AS k FROM components t LEFT JOIN colors c ON t.page_id = c.page_id AND {overlaps('t', 'c')} WHERE t.type = 'text') q WHERE k = 1"


@operator("components", "colors")
def query_text(d):
    return f"SELECT page_id, id, text, tier, weight, CASE WHEN r IS NULL THEN NULL ELSE {hex_of(d)} END AS color FROM ({BEST}) b"


@operator("components", "colors")
def query_text_near(d):
    return f"SELECT page_id, id, text, {hex_of(d)} AS color, total FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS k, count(*) OVER (PARTITION BY page_id) AS total FROM ({BEST}) b WHERE weight = 'heavy' AND {distance('r', 'g', 'b', (100, 100, 100))} <= 120) q WHERE k <= 40"


@operator("components", "vision")
def tokens_in_box(d):
    return f"SELECT v.page_id, v.crop_id, t.id FROM (SELECT DISTINCT page_id, crop_id, cx0 AS x0, cy0 AS y0, cx0 + 640 AS x1, cy0 + 550 AS y1 FROM vision) v JOIN components t ON v.page_id = t.page_id AND t.type = 'text' AND {overlaps('v', 't')}"


@operator("components", "vision")
def match_ocr_box(d):
    return "SELECT v.page_id, v.ord, min(t.ord) AS token FROM vision v JOIN components t ON v.page_id = t.page_id AND t.type = 'text' AND trim(v.text) <> '' AND trim(t.text) <> '' AND (instr(lower(trim(v.text)), lower(trim(t.text))) > 0 OR instr(lower(trim(t.text)), lower(trim(v.text))) > 0) GROUP BY v.page_id, v.ord"


@operator("components", "parents")
def layout_parent(d):
    return "SELECT page_id, id, parent FROM parents"


@operator("components")
def encloses_count(d):
    return f"SELECT a.page_id, a.id, count(b.id) AS encloses FROM components a LEFT JOIN components b ON a.page_id = b.page_id AND a.ord <> b.ord AND {contains('a', 'b')} AND NOT ({contains('b', 'a')}) GROUP BY a.page_id, a.id"


@operator("components", "boxes")
def filter_nested(d):
    inter = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
    return f"SELECT a.page_id, a.ord FROM boxes a LEFT JOIN boxes b ON a.page_id = b.page_id AND a.ord <> b.ord AND (b.x1 - b.x0) * (b.y1 - b.y0) > (a.x1 - a.x0) * (a.y1 - a.y0) AND 10 * ({inter}) >= 9 * (a.x1 - a.x0) * (a.y1 - a.y0) WHERE b.ord IS NULL"


@operator("components", "vision")
def crop_sections(d):
    return "SELECT page_id, crop_id, type, text FROM (SELECT *, row_number() OVER (PARTITION BY page_id, crop_id ORDER BY ord) AS k FROM vision) q WHERE k = 1"


@operator("components", "edges", "triples")
def augment_edges(d):
    """A model's triples whose ends are known components, without those that geometry has given already."""
    return "SELECT DISTINCT m.page_id, m.a, m.b, m.relation, CAST(0.6 AS DOUBLE) AS confidence FROM triples m JOIN components x ON m.page_id = x.page_id AND m.a = x.id JOIN components y ON m.page_id = y.page_id AND m.b = y.id LEFT JOIN edges e ON m.page_id = e.page_id AND m.a = e.a AND m.b = e.b AND m.relation = e.relation WHERE e.a IS NULL"


@operator("components")
def merge_pair(d):
    """Two boxes of equal type or text as one: the union, the more certain type, the text that there is, and their confidence at weight 0.5."""
    grown = "(greatest(a.x1, b.x1) - least(a.x0, b.x0)) * (greatest(a.y1, b.y1) - least(a.y0, b.y0))"
    area = "(b.x1 - b.x0) * (b.y1 - b.y0)"
    mean = f"(a.confidence * ({grown}) + b.confidence * ({area})) / (({grown}) + ({area}))"
    return f"SELECT a.page_id, a.id AS a, b.id AS b, CASE WHEN a.type <> b.type AND b.confidence > a.confidence THEN b.type ELSE a.type END AS type, coalesce(a.text, b.text) AS text, least(a.x0, b.x0) AS x0, least(a.y0, b.y0) AS y0, greatest(a.x1, b.x1) AS x1, greatest(a.y1, b.y1) AS y1, {rounded(f'({mean}) / 2 + greatest(a.confidence, b.confidence) / 2', 9)} AS confidence FROM components a JOIN components b ON a.page_id = b.page_id AND a.ord < b.ord AND (a.type = b.type OR (trim(a.text) <> '' AND lower(trim(a.text)) = lower(trim(b.text)))) AND {overlaps('a', 'b')} AND {iou('a', 'b')} > CAST(0.65 AS DOUBLE)"


@operator("components", "vision")
def repair_components(d):
    empty = "(v.x1 <= v.x0 OR v.y1 <= v.y0)"
    token = "SELECT v.page_id, v.ord, min(t.ord) AS token FROM vision v JOIN components t ON v.page_id = t.page_id AND t.type = 'text' AND (instr(lower(trim(v.text)), lower(trim(t.text))) > 0 OR instr(lower(trim(t.text)), lower(trim(v.text))) > 0) WHERE trim(v.text) <> '' GROUP BY v.page_id, v.ord"
    pick = lambda c, crop: f"least(greatest(CASE WHEN NOT {empty} THEN v.{c} WHEN t.id IS NOT NULL THEN t.{c} ELSE {crop} END, 0), {W if c[0] == 'x' else H})"
    return f"SELECT v.page_id, v.ord, CASE WHEN trim(v.id) = '' THEN concat(v.crop_id, '-', CAST(v.idx AS {d.string})) ELSE v.id END AS id, {pick('x0', 'v.cx0')} AS x0, {pick('y0', 'v.cy0')} AS y0, {pick('x1', 'v.cx0 + 640')} AS x1, {pick('y1', 'v.cy0 + 550')} AS y1, CASE WHEN {empty} THEN 1 ELSE 0 END AS bbox_repaired, CASE WHEN trim(v.id) = '' THEN 1 ELSE 0 END AS id_repaired FROM vision v LEFT JOIN ({token}) m ON v.page_id = m.page_id AND v.ord = m.ord LEFT JOIN components t ON m.page_id = t.page_id AND m.token = t.ord"


@operator("components")
def sample_headings(d):
    return "SELECT page_id, text, k FROM (SELECT page_id, text, row_number() OVER (PARTITION BY page_id ORDER BY min(ord)) AS k FROM components WHERE tier = 'heading' AND text <> '' GROUP BY page_id, text) q WHERE k <= 8"


@operator("components")
def text_coverage(d):
    return f"SELECT a.page_id, a.id, {rounded('least(CAST(1 AS DOUBLE), coalesce(CAST(sum((least(a.x1, t.x1) - greatest(a.x0, t.x0)) * (least(a.y1, t.y1) - greatest(a.y0, t.y0))) AS DOUBLE), CAST(0 AS DOUBLE)) / max((a.x1 - a.x0) * (a.y1 - a.y0)))', 9)} AS coverage FROM components a LEFT JOIN components t ON a.page_id = t.page_id AND t.type = 'text' AND {overlaps('a', 't')} WHERE a.type <> 'text' GROUP BY a.page_id, a.id"


@operator("components")
def chart_gate(d):
    return f"SELECT page_id, id, CASE WHEN coverage <= CAST(0.1 AS DOUBLE) THEN 1 ELSE 0 END AS sparse_text FROM ({text_coverage(d)}) q"


@operator("components")
def count_by_type(d):
    return "SELECT page_id, type, count(*) AS n FROM components GROUP BY page_id, type"


@operator("components")
def corner_rollup(d):
    return "SELECT page_id, count(CASE WHEN corner_style = 'rounded' THEN 1 END) AS rounded, count(CASE WHEN corner_style = 'square' THEN 1 END) AS square, count(corner_style) AS measured FROM components GROUP BY page_id"


@operator("components", "edges")
def padding_count(d):
    return "SELECT page_id, count(DISTINCT a) AS with_padding FROM edges WHERE relation = 'contains' GROUP BY page_id"


@operator("components")
def weight_rollup(d):
    sample = d.joined("CASE WHEN weight = 'heavy' AND k <= 5 THEN text END", "|", "ord")
    return f"SELECT page_id, count(CASE WHEN weight = 'heavy' THEN 1 END) AS heavy, count(CASE WHEN weight = 'regular' THEN 1 END) AS regular, {sample} AS heavy_sample FROM (SELECT *, row_number() OVER (PARTITION BY page_id, weight ORDER BY ord) AS k FROM components) q GROUP BY page_id"


@operator("components", "colors")
def top_colors(d):
    return f"SELECT page_id, hex, n, k FROM (SELECT page_id, hex, count(*) AS n, row_number() OVER (PARTITION BY page_id ORDER BY count(*) DESC, min(ord)) AS k FROM (SELECT page_id, ord, {hex_of(d)} AS hex FROM colors) c GROUP BY page_id, hex) q WHERE k <= 8"


@operator("components")
def tier_bands(d):
    """Bands by level, the largest first; the name is the first one seen in a band."""
    level = "CASE tier WHEN 'heading' THEN 0 WHEN 'body' THEN 1 ELSE 2 END"
    return f"SELECT page_id, level, max(CASE WHEN k = 1 THEN tier END) AS tier, count(*) AS n, min(h) AS min_height, max(h) AS max_height FROM (SELECT page_id, tier, h, {level} AS level, row_number() OVER (PARTITION BY page_id, {level} ORDER BY ord) AS k FROM components WHERE tier IS NOT NULL) t GROUP BY page_id, level"


@operator("components")
def page_confidence(d):
    return f"SELECT page_id, {rounded('coalesce(avg(CAST(100 * confidence AS DOUBLE)) / 100, CAST(0.5 AS DOUBLE))', 6)} AS confidence FROM components GROUP BY page_id"


@operator("components", "vision")
def needs_escalation(d):
    """Low confidence, many unresolved components, or boxes that can't be recovered for more than 0.3 a crop."""
    lost = "SELECT v.page_id, v.crop_id, v.ord, CASE WHEN (v.x1 <= v.x0 OR v.y1 <= v.y0) AND count(t.id) = 0 THEN 1 ELSE 0 END AS lost FROM vision v LEFT JOIN components t ON v.page_id = t.page_id AND t.type = 'text' AND trim(v.text) <> '' AND trim(t.text) <> '' AND (instr(lower(trim(v.text)), lower(trim(t.text))) > 0 OR instr(lower(trim(t.text)), lower(trim(v.text))) > 0) GROUP BY v.page_id, v.crop_id, v.ord, v.x0, v.y0, v.x1, v.y1"
    rate = f"SELECT page_id, CAST(sum(lost) AS DOUBLE) / count(DISTINCT crop_id) AS disagreement FROM ({lost}) l GROUP BY page_id"
    pages = "SELECT page_id, avg(CAST(100 * confidence AS DOUBLE)) / 100 AS mean, count(CASE WHEN confidence < CAST(0.8 AS DOUBLE) THEN 1 END) AS unresolved FROM components GROUP BY page_id"
    return f"SELECT p.page_id, p.unresolved, {rounded('coalesce(r.disagreement, CAST(0 AS DOUBLE))', 6)} AS disagreement, CASE WHEN p.mean < CAST(0.8 AS DOUBLE) OR p.unresolved > 20 OR coalesce(r.disagreement, CAST(0 AS DOUBLE)) > CAST(0.3 AS DOUBLE) THEN 1 ELSE 0 END AS escalate FROM ({pages}) p LEFT JOIN ({rate}) r ON p.page_id = r.page_id"


@operator("components")
def median_heights(d):
    return f"SELECT page_id, max(CASE WHEN k = {d.div('n', '2')} + 1 THEN h END) AS upper_median, CAST(sum(CASE WHEN k IN ({d.div('n + 1', '2')}, {d.div('n', '2')} + 1) THEN h END) AS DOUBLE) / sum(CASE WHEN k IN ({d.div('n + 1', '2')}, {d.div('n', '2')} + 1) THEN 1 END) AS median FROM (SELECT page_id, h, row_number() OVER (PARTITION BY page_id ORDER BY h, ord) AS k, count(*) OVER (PARTITION BY page_id) AS n FROM components WHERE type = 'text') q GROUP BY page_id"


@operator("components", "edges")
def container_padding(d):
    return "SELECT e.page_id, e.a AS id, min(b.x0) - max(a.x0) AS pad_left, min(b.y0) - max(a.y0) AS pad_top, max(a.x1) - max(b.x1) AS pad_right, max(a.y1) - max(b.y1) AS pad_bottom, CASE WHEN 10 * (max(b.x1) - min(b.x0)) >= 6 * max(a.x1 - a.x0) AND 10 * (max(b.y1) - min(b.y0)) >= 6 * max(a.y1 - a.y0) THEN 1 ELSE 0 END AS content_fills FROM edges e JOIN components a ON e.page_id = a.page_id AND e.a = a.id JOIN components b ON e.page_id = b.page_id AND e.b = b.id WHERE e.relation = 'contains' GROUP BY e.page_id, e.a"


@operator("components")
def axis_clusters(d):
    gap = f"CASE WHEN {d.div('x0 + x1', '2')} - lag({d.div('x0 + x1', '2')}) OVER (PARTITION BY page_id, type ORDER BY {d.div('x0 + x1', '2')}, ord) > 80 THEN 1 ELSE 0 END"
    return f"SELECT page_id, type, cluster, count(*) AS members, min(x0) AS x0, max(x1) AS x1 FROM (SELECT *, sum(gap) OVER (PARTITION BY page_id, type ORDER BY {d.div('x0 + x1', '2')}, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cluster FROM (SELECT *, {gap} AS gap FROM components WHERE type NOT IN ('text', 'label')) a) b GROUP BY page_id, type, cluster HAVING count(*) >= 2"


@operator("groups")
def group_gaps(d):
    return "SELECT page_id, type, ordinal, axis, gap_median, gap_spread FROM groups"


@operator("groups")
def even_groups(d):
    return "SELECT page_id, count(CASE WHEN gap_median > 0 AND 4 * gap_spread < gap_median THEN 1 END) AS even FROM groups GROUP BY page_id"


@operator("members")
def repeated_groups(d):
    return f"SELECT page_id, type, axis, ordinal, max(spacing) AS spacing, {d.joined('id', ',', 'place')} AS member_ids FROM members GROUP BY page_id, type, axis, ordinal"


@operator("containers")
def inferred_containers(d):
    return "SELECT page_id, id, type, kind, label, members, x0, y0, x1, y1, confidence FROM containers"


@operator("headers")
def group_headers(d):
    return "SELECT page_id, type, ordinal, header_id, header FROM headers"


@operator("containers")
def inferred_parent(d):
    return "SELECT page_id, id, parent FROM containers"


@operator("components")
def position_order(d):
    return "SELECT page_id, id, row_number() OVER (PARTITION BY page_id ORDER BY y0, x0, ord) AS place FROM components"


@operator("components")
def dom_tags(d):
    return "SELECT page_id, id, CASE WHEN type IN ('button', 'button_primary') THEN 'button' WHEN type IN ('input', 'text_field') THEN 'input' WHEN type = 'navigation' THEN 'nav' WHEN type IN ('card', 'container', 'panel', 'region') THEN 'section' WHEN type = 'label' THEN 'label' WHEN type = 'image' THEN 'img' ELSE 'div' END AS tag FROM components"


@operator("components")
def dom_flat(d):
    """Components from the top as a flat list of tags; there, of the boxes only cards are sections."""
    tag = f"SELECT t.page_id, CASE WHEN t.tag = 'section' AND c.type <> 'card' THEN 'div' ELSE t.tag END AS tag, c.type, c.text, c.confidence, c.ord, c.y0, c.x0 FROM ({dom_tags(d)}) t JOIN components c ON t.page_id = c.page_id AND t.id = c.id"
    line = f"concat('  <', tag, ' class=\"', type, '\" data-conf=\"', {d.fixed('confidence', 2)}, '\">', {d.newline()}, CASE WHEN text IS NULL THEN '' ELSE concat('    ', text, {d.newline()}) END, '  </', tag, '>', {d.newline()})"
    return f"SELECT page_id, {d.joined(line, '', 'y0, x0, ord')} AS dom FROM ({tag}) q GROUP BY page_id"


@operator("components")
def assemble_page(d):
    return f"SELECT page_id, {d.joined('text', ' ', 'y0, x0, ord')} AS body FROM components WHERE text IS NOT NULL GROUP BY page_id"


@operator("components", "boxes", "vision")
def component_union(d):
    return f"SELECT page_id, 0 AS source_rank, ord, type FROM vision UNION ALL SELECT page_id, 1, ord, type FROM components WHERE type = 'text' UNION ALL SELECT page_id, 2, ord, 'region' FROM boxes"


@operator("components")
def distinct_heights(d):
    return "SELECT DISTINCT page_id, h FROM components WHERE type = 'text'"


@operator("components", "strokes")
def text_weight(d):
    rows = "SELECT c.page_id, c.id, c.h, s.stroke FROM components c JOIN strokes s ON c.page_id = s.page_id AND c.ord = s.ord WHERE c.type = 'text' AND c.h >= 10"
    med = f"SELECT page_id, median(CAST(h AS DOUBLE)) AS mid, count(*) AS n FROM ({rows}) r GROUP BY page_id"
    base = f"SELECT r.page_id, median(r.stroke) AS base FROM ({rows}) r JOIN ({med}) m ON r.page_id = m.page_id AND 10 * r.h <= 13 * m.mid AND m.n >= 4 GROUP BY r.page_id"
    return f"SELECT r.page_id, r.id, CASE WHEN stroke >= CAST(1.45 AS DOUBLE) * base THEN 'heavy' ELSE 'regular' END AS weight, {rounded('least(CAST(1 AS DOUBLE), abs(stroke - CAST(1.45 AS DOUBLE) * base) / base)', 2)} AS confidence FROM ({rows}) r JOIN ({base}) b ON r.page_id = b.page_id WHERE stroke <= 3 * base AND (stroke >= CAST(1.45 AS DOUBLE) * base OR stroke < CAST(1.45 AS DOUBLE) * base * CAST(0.88 AS DOUBLE))"


@operator("components")
def tier_confidence(d):
    """How clearly a text's height belongs to its tier: by the distances to the mean height of its own and of the nearest other tier of its page."""
    centres = "SELECT page_id, tier, CAST(sum(h) AS DOUBLE) / count(*) AS centre FROM components WHERE type = 'text' AND tier IS NOT NULL GROUP BY page_id, tier"
    rows = f"SELECT t.page_id, t.id, t.tier, max(CASE WHEN c.tier = t.tier THEN abs(t.h - c.centre) END) AS own, min(CASE WHEN c.tier <> t.tier THEN abs(t.h - c.centre) END) AS other FROM components t JOIN ({centres}) c ON t.page_id = c.page_id WHERE t.type = 'text' AND t.tier IS NOT NULL GROUP BY t.page_id, t.id, t.tier"
    margin = "greatest(CAST(0 AS DOUBLE), (other - own) / (other + own))"
    return f"SELECT page_id, id, tier, CASE WHEN other IS NULL THEN CAST(1 AS DOUBLE) WHEN other <= 0 THEN CAST(0 AS DOUBLE) ELSE {rounded(margin, 6)} END AS confidence FROM ({rows}) r"


@operator("tokens")
def ocr_runs(d):
    return f"SELECT page_id, turn, line, run, {d.joined('text', ' ', 'pos')} AS text, min(x0) AS x0, max(x1) AS x1 FROM (SELECT *, sum(fresh) OVER (PARTITION BY page_id, turn, line ORDER BY x0, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY page_id, turn, line ORDER BY x0, pos) > 60 THEN 1 ELSE 0 END AS fresh FROM (SELECT *, {d.div('pos', '10')} AS line FROM tokens) l) a) b GROUP BY page_id, turn, line, run"


@operator("images")
def plan_fixed(d):
    pages = "images"
    return f"SELECT page_id, 409 * i AS x0, 409 * j AS y0, least(w, 409 * i + 512) AS x1, least(h, 409 * j + 512) AS y1 FROM (SELECT page_id, w, h, i, {d.explode}({d.series('0', d.div('h - 1', '409'))}) AS j FROM (SELECT page_id, w, h, {d.explode}({d.series('0', d.div('w - 1', '409'))}) AS i FROM {pages} p) a) b"


@operator("images")
def plan_grid(d):
    pages = "images"
    px, py = d.div(d.div("w", "2") + " * 20", "100"), d.div(d.div("h", "2") + " * 20", "100")
    return f"SELECT page_id, 'ov' AS id, 0 AS x0, 0 AS y0, w AS x1, h AS y1 FROM {pages} p UNION ALL SELECT page_id, concat('g', CAST(i AS {d.string}), '-', CAST(j AS {d.string})), greatest(0, j * {d.div('w', '2')} - {px}), greatest(0, i * {d.div('h', '2')} - {py}), least(w, CASE j WHEN 1 THEN w ELSE {d.div('w', '2')} END + {px}), least(h, CASE i WHEN 1 THEN h ELSE {d.div('h', '2')} END + {py}) FROM (SELECT page_id, w, h, i, {d.explode}({d.series('0', '1')}) AS j FROM (SELECT page_id, w, h, {d.explode}({d.series('0', '1')}) AS i FROM {pages} p) a) b"


@operator("components")
def cache_key(d):
    return f"SELECT page_id, id, {d.sha256(f'concat(id, {d.nul()}, type, {d.nul()})')} AS cache_key FROM components"


@operator("components")
def artifact_window(d):
    return "SELECT page_id, id, substr(text, 4, 6) AS piece, CASE WHEN length(text) > 9 THEN 1 ELSE 0 END AS truncated FROM components WHERE text IS NOT NULL"


@operator("components")
def description_confidence(d):
    n = d.size(d.words("trim(text)"))
    return f"SELECT page_id, id, CASE WHEN trim(text) = '' THEN CAST(0 AS DOUBLE) WHEN {n} < 3 THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END AS confidence FROM components WHERE text IS NOT NULL"


def legible_side(d, reach: int = 480, least: int = 14) -> str:
    """For each page, the greatest side of a crop that keeps the upper median text height at the least after a resize to reach."""
    ranked = "SELECT page_id, h, row_number() OVER (PARTITION BY page_id ORDER BY h, ord) AS k, count(*) OVER (PARTITION BY page_id) AS n FROM components WHERE type = 'text'"
    return f"SELECT page_id, h AS median, least({reach}, greatest(1, {d.div(f'h * {reach}', str(least))})) AS side FROM ({ranked}) r WHERE k = {d.div('n', '2')} + 1 AND h > 0"


@operator("components", "boxes")
def needs_subdivision(d):
    """Whether a resize of a region to 480 would bring the page's median text below 14."""
    return f"SELECT b.page_id, b.ord, CASE WHEN b.y1 > b.y0 AND s.median * 480 < 14 * (b.y1 - b.y0) THEN 1 ELSE 0 END AS needed FROM boxes b LEFT JOIN ({legible_side(d)}) s ON b.page_id = s.page_id"


@operator("components", "boxes")
def subdivide(d):
    """Crops of each region: the region itself where it fits the legible side, else tiles of that side that overlap by 0.2."""
    step = f"greatest(1, {d.div('side * 8', '10')})"
    sized = f"SELECT b.page_id, b.ord, b.x0, b.y0, b.x1, b.y1, coalesce(s.side, 480) AS side FROM boxes b LEFT JOIN ({legible_side(d)}) s ON b.page_id = s.page_id"
    fitted = f"SELECT *, {step} AS step, CASE WHEN greatest(x1 - x0, y1 - y0) <= side THEN 1 ELSE 2 END AS level FROM ({sized}) z"
    down = f"SELECT *, {d.explode}({d.series('0', 'CASE level WHEN 1 THEN 0 ELSE ' + d.div('y1 - y0 - 1', 'step') + ' END')}) AS j FROM ({fitted}) f WHERE x1 > x0 AND y1 > y0"
    both = f"SELECT *, {d.explode}({d.series('0', 'CASE level WHEN 1 THEN 0 ELSE ' + d.div('x1 - x0 - 1', 'step') + ' END')}) AS i FROM ({down}) w"
    return f"SELECT page_id, ord, row_number() OVER (PARTITION BY page_id, ord ORDER BY j, i) AS crop, level, x0 + i * step AS x0, y0 + j * step AS y0, CASE level WHEN 1 THEN x1 ELSE least(x1, x0 + i * step + side) END AS x1, CASE level WHEN 1 THEN y1 ELSE least(y1, y0 + j * step + side) END AS y1 FROM ({both}) t"
