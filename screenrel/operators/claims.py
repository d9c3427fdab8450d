"""Text meaning and claim checks: hints, page types, labels, and whether written claims rest on measured evidence."""

from __future__ import annotations

from screenrel.operators.catalog import operator, values

#: Colour words and their representative colours.
NAMED_COLORS = [("black", 0, 0, 0), ("white", 255, 255, 255), ("gray", 128, 128, 128), ("red", 200, 40, 40), ("green", 40, 160, 60), ("blue", 40, 80, 200), ("yellow", 230, 210, 40), ("orange", 230, 140, 40), ("purple", 130, 60, 180), ("pink", 230, 120, 170), ("brown", 120, 80, 50)]
#: Behaviours that a still image cannot show.
BEHAVIORS = ["hover", "animation", "animated", "transition", "on click", "onclick", "page load", "loads", "scrolling animation", "fade", "slide in", "subtly change", "changes with each"]
#: Words of structure, which need not appear on the page.
STRUCTURAL = "header footer sidebar nav navigation menu button buttons panel card cards list row column columns grid section sections region regions chart charts table input field form icon icons image images logo text label labels title value background foreground layout page top bottom left right center content area bar link links summary displays contains shows".split()
#: Number words, and nouns whose counts are checked.
NUMBERS = [("one", 1), ("two", 2), ("three", 3), ("four", 4), ("five", 5), ("six", 6), ("seven", 7), ("eight", 8), ("nine", 9), ("ten", 10)]
CONTAINER_NOUNS = ["card", "column", "panel", "section", "container", "region", "tile", "box"]
ELEMENT_NOUNS = ["icon", "button", "logo", "image", "chart", "avatar"]
#: Page types and the keywords that tell them, with weight 2 for structure and 1 for content.
STRUCTURE_KEYWORDS = {
    "task_detail": ["checklists", "due date", "labels", "assignee", "add a comment", "write a comment", "linked cards", "attachments", "branch name", "overdue"],
    "kanban": ["to do", "in progress", "in review", "backlog", "sprint board"],
    "settings": ["danger zone", "deactivate account", "delete account", "language", "theme"],
    "invite": ["invitation", "you have been invited", "accept invitation", "decline"],
    "error_state": ["access denied", "permission denied", "not found", "403", "404", "500", "error occurred", "go to dashboard"],
    "confirmation": ["success", "verified", "email sent", "account created"],
    "verify_email": ["verify your email", "verification email", "resend verification", "check your inbox"],
    "forgot_password": ["forgot your password", "reset password", "reset link", "password reset"],
    "project_home": ["boards", "configure", "kanban"],
}
CONTENT_KEYWORDS = {
    "login": ["sign in", "signin", "login", "log in", "password", "username"],
    "pricing": ["pricing", "per month", "per year", "/mo", "subscribe", "free trial"],
    "billing": ["billing", "invoice", "payment", "top up", "balance", "total cost", "usd", "$"],
    "usage": ["usage", "api requests", "tokens", "requests", "quota", "consumption", "rate limit"],
    "analytics": ["analytics", "metrics", "cost(usd)", "last 30 days", "trend"],
    "api": ["api key", "api keys", "endpoint", "secret key", "access token"],
    "dashboard": ["dashboard", "overview", "kpi", "revenue", "active initiatives"],
    "ecommerce": ["cart", "add to cart", "checkout", "shop", "products"],
    "settings": ["settings", "preferences", "profile", "account"],
}
#: Marks of unusable labels, and words that carry no meaning in them.
GARBAGE = ["<svg", "```", "viewbox", "{", "http", "path fill"]
STOPWORDS = "icon button a an the of with gray grey image symbol glyph small dark on in it is this that appears to be represents and or for".split()
#: The engine's own small table of label aliases: alias, concept, 1 for weak ones.
ALIASES = [("magnifier", "search", 0), ("magnifying glass", "search", 0), ("search", "search", 0), ("gear", "settings", 0), ("cog", "settings", 0), ("trash", "delete", 0), ("purchase", "cart", 0), ("cart", "cart", 0), ("close", "close", 1), ("signup", "user", 1), ("user", "user", 1)]


@operator("components")
def semantic_hints(d):
    kinds = [("task_id", "^[A-Z]{2,5}-[0-9]{1,6}$", 0), ("git_branch_ref", "^(?:feat|fix|chore|refactor|docs|test|ci|build|perf|style)/[A-Za-z0-9_./-]+$", 0), ("email", "([A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+[.][A-Za-z0-9_.-]*[A-Za-z0-9_])", 1), ("overdue_deadline", "(?i)overdue", None), ("completion_ratio", "(?:^|[ \t\n])([0-9]{1,3}/[0-9]{1,3})(?:[ \t\n]|$)", 1), ("currency_amount", "([$][0-9][0-9,]*(?:[.][0-9]+)?)", 1), ("percentage", "(?:^|[ \t\n])([0-9]{1,3}%)", 1), ("count_badge", "[(]([0-9]{1,4})[)]", 1)]
    kind = "CASE " + " ".join(f"WHEN {d.like('t', r)} THEN '{k}'" for k, r, _ in kinds) + " END"
    value = "CASE " + " ".join(f"WHEN {d.like('t', r)} THEN {'NULL' if g is None else d.extract('t', r, g)}" for _, r, g in kinds) + " END"
    return f"SELECT page_id, id, kind, value FROM (SELECT page_id, id, {kind} AS kind, {value} AS value FROM (SELECT page_id, id, trim(text) AS t FROM components WHERE text IS NOT NULL) a) b WHERE kind IS NOT NULL"


@operator("components")
def page_type(d):
    rows = [(t, k, 2) for t, ks in STRUCTURE_KEYWORDS.items() for k in ks] + [(t, k, 1) for t, ks in CONTENT_KEYWORDS.items() for k in ks]
    words = values(rows, "type, keyword, weight")
    pages = f"SELECT page_id, lower({d.joined('text', ' ', 'ord')}) AS body, max(CASE WHEN {d.like('trim(text)', '^[A-Z]{2,5}-[0-9]{1,6}$')} THEN 1 ELSE 0 END) AS task FROM components WHERE text IS NOT NULL GROUP BY page_id"
    hits = f"SELECT page_id, type, weight FROM ({pages}) p JOIN {words} w ON instr(p.body, w.keyword) > 0 UNION ALL SELECT page_id, 'task_detail', 1 FROM ({pages}) p WHERE task = 1"
    scored = f"SELECT page_id, type, sum(weight) AS score, row_number() OVER (PARTITION BY page_id ORDER BY sum(weight) DESC, type) AS k FROM ({hits}) h GROUP BY page_id, type"
    size = f"SELECT type, count(*) AS n FROM {words} w GROUP BY type"
    return f"SELECT p.page_id, coalesce(s.type, 'generic') AS type, CASE WHEN s.type IS NULL THEN CAST(0 AS DOUBLE) ELSE greatest(CAST(0.1 AS DOUBLE), least(CAST(1 AS DOUBLE), CAST(s.score AS DOUBLE) / (2 * z.n))) END AS confidence FROM ({pages}) p LEFT JOIN ({scored}) s ON p.page_id = s.page_id AND s.k = 1 LEFT JOIN ({size}) z ON s.type = z.type"


def canonical(d, keys: tuple[str, ...] = ("element_id",)) -> str:
    """keys, run, raw_label, concept ('' for garbage): by the first of strong phrase, strong pair of words, strong word, weak phrase, weak word."""
    bad = " OR ".join(f"instr(lower(raw_label), '{g}') > 0" for g in GARBAGE)
    clean = f"concat(' ', {d.replace('lower(raw_label)', '[^a-z]+', '  ')}, ' ')"  # each word between spaces of its own
    for word in STOPWORDS:
        clean = f"replace({clean}, ' {word} ', '')"
    clean = f"concat(' ', trim({d.replace(clean, ' +', ' ')}), ' ')"
    labels = f"SELECT raw_label, clean FROM (SELECT raw_label, {clean} AS clean FROM (SELECT DISTINCT raw_label FROM label_samples) r WHERE NOT ({bad})) c WHERE trim(clean) <> '' AND length(trim(clean)) - length(replace(trim(clean), ' ', '')) < 4"
    words = "length(alias) - length(replace(alias, ' ', ''))"
    rank = f"CASE WHEN alias = trim(clean) THEN 3 * weak WHEN weak = 0 AND {words} = 1 THEN 1 WHEN weak = 0 AND {words} = 0 THEN 2 WHEN {words} = 0 THEN 4 END"
    found = f"SELECT raw_label, concept, row_number() OVER (PARTITION BY raw_label ORDER BY quality, place, concept) AS k FROM (SELECT raw_label, concept, instr(clean, concat(' ', alias, ' ')) AS place, {rank} AS quality FROM ({labels}) l JOIN {values(ALIASES, 'alias, concept, weak')} a ON instr(l.clean, concat(' ', a.alias, ' ')) > 0) m WHERE quality IS NOT NULL"
    return f"SELECT {', '.join(f's.{k}' for k in keys)}, s.run, s.raw_label, coalesce(f.concept, '') AS concept FROM label_samples s LEFT JOIN ({found}) f ON s.raw_label = f.raw_label AND f.k = 1"


@operator("label_samples")
def canonical_label(d):
    return canonical(d)


def vote(d, keys: tuple[str, ...] = ("element_id",)) -> str:
    by = ", ".join(keys)
    counted = f"SELECT {by}, concept, count(*) AS n, row_number() OVER (PARTITION BY {by} ORDER BY CASE WHEN concept = '' THEN 1 ELSE 0 END, count(*) DESC, concept) AS k, sum(count(*)) OVER (PARTITION BY {by}) AS runs FROM ({canonical(d, keys)}) c GROUP BY {by}, concept"
    return f"SELECT {by}, concept, n, runs, CAST(n AS DOUBLE) / runs AS agreement FROM ({counted}) q WHERE k = 1 AND concept <> ''"


@operator("label_samples")
def label_vote(d):
    return f"SELECT element_id, concept, CAST(n AS BIGINT) AS n, CAST(runs AS BIGINT) AS runs, agreement FROM ({vote(d)}) v"


@operator("label_samples")
def accepted_labels(d):
    """Labels that at least 0.7 of an element's runs agree on, and their places on the page, of which there are 12."""
    return f"SELECT page_id, element_id, concept, k FROM (SELECT page_id, element_id, concept, row_number() OVER (PARTITION BY page_id ORDER BY element_id) AS k FROM ({vote(d, ('page_id', 'element_id'))}) v WHERE 10 * n >= 7 * runs) q WHERE k <= 12"


@operator("summaries")
def behavior_claims(d):
    return f"SELECT page_id, turn, phrase FROM summaries JOIN {values([(b,) for b in BEHAVIORS], 'phrase')} b ON instr(lower(summary), phrase) > 0"


def palette(d) -> str:
    return "(SELECT DISTINCT page_id, r, g, b FROM colors)"


@operator("components", "colors")
def nearest_color_name(d):
    neutral = "greatest(m.r, m.g, m.b) - least(m.r, m.g, m.b) <= 20"
    return f"SELECT page_id, r, g, b, name, l1 FROM (SELECT m.page_id, m.r, m.g, m.b, n.name, abs(m.r - n.nr) + abs(m.g - n.ng) + abs(m.b - n.nb) AS l1, row_number() OVER (PARTITION BY m.page_id, m.r, m.g, m.b ORDER BY abs(m.r - n.nr) + abs(m.g - n.ng) + abs(m.b - n.nb), n.name) AS k FROM {palette(d)} m JOIN {values(NAMED_COLORS, 'name, nr, ng, nb')} n ON NOT ({neutral}) OR n.name IN ('black', 'gray', 'white')) q WHERE k = 1"


def mentions(d, found: str, name: str, source: str = "summaries") -> str:
    """Each item of a list found in a summary, with its place among them: repeats are claims of their own."""
    listed = f"SELECT page_id, turn, {found} AS found FROM {source}"
    return f"SELECT page_id, turn, pos, {d.item('found', 'pos')} AS {name} FROM (SELECT page_id, turn, found, {d.explode}({d.series('0', d.size('found') + ' - 1')}) AS pos FROM ({listed}) l WHERE {d.size('found')} > 0) e"


def hex_mentions(d) -> str:
    return f"SELECT page_id, turn, pos, upper(hex) AS hex, {d.hexpair('substr(hex, 2, 2)')} AS r, {d.hexpair('substr(hex, 4, 2)')} AS g, {d.hexpair('substr(hex, 6, 2)')} AS b FROM ({mentions(d, d.extract_all('summary', '#[0-9a-fA-F]{6}', 0), 'hex')}) h"


@operator("components", "colors", "summaries")
def hex_claims(d):
    return f"SELECT h.page_id, h.turn, h.pos, max(h.hex) AS hex, max(CASE WHEN c.r IS NOT NULL THEN 1 ELSE 0 END) AS supported FROM ({hex_mentions(d)}) h LEFT JOIN {palette(d)} c ON h.page_id = c.page_id AND abs(h.r - c.r) + abs(h.g - c.g) + abs(h.b - c.b) <= 72 GROUP BY h.page_id, h.turn, h.pos"


def supported_names(d) -> str:
    neutral, lum = "greatest(r, g, b) - least(r, g, b) <= 20", d.div("r + g + b", "3")
    return f"SELECT DISTINCT page_id, name FROM (SELECT page_id, name FROM ({nearest_color_name(d)}) n WHERE NOT ({neutral}) UNION ALL SELECT page_id, 'gray' FROM colors WHERE {neutral} UNION ALL SELECT page_id, 'black' FROM colors WHERE {neutral} AND {lum} <= 90 UNION ALL SELECT page_id, 'white' FROM colors WHERE {neutral} AND {lum} >= 170) u"


@operator("components", "colors", "summaries")
def named_color_claims(d):
    words = f"SELECT DISTINCT page_id, turn, CASE WHEN word = 'grey' THEN 'gray' ELSE word END AS name FROM (SELECT page_id, turn, {d.explode}({d.extract_all('lower(summary)', '[a-z]+', 0)}) AS word FROM summaries) w"
    return f"SELECT w.page_id, w.turn, w.name, CASE WHEN s.name IS NULL THEN 0 ELSE 1 END AS supported FROM ({words}) w JOIN {values([(n[0],) for n in NAMED_COLORS], 'known')} k ON w.name = k.known LEFT JOIN ({supported_names(d)}) s ON w.page_id = s.page_id AND w.name = s.name"


@operator("tokens")
def ocr_corpus(d):
    return f"SELECT DISTINCT page_id, word FROM (SELECT page_id, {d.explode}({d.extract_all('lower(text)', '[a-z]+', 0)}) AS word FROM tokens) w"


def quotes(d, curly: bool = False) -> str:
    """Quoted spans that have words, in straight and, if asked for, in curly quotes."""
    spans = mentions(d, d.extract_all("summary", '"[^"]+"|“[^”]+”', 0), "span")
    kept = "" if curly else " WHERE substr(span, 1, 1) = '\"'"
    words = f"SELECT page_id, turn, pos, quote, {d.explode}({d.extract_all('lower(quote)', '[a-z]+', 0)}) AS word FROM (SELECT page_id, turn, pos, substr(span, 2, length(span) - 2) AS quote FROM ({spans}) s{kept}) q"
    return f"SELECT w.page_id, w.turn, w.pos, max(w.quote) AS quote, min(CASE WHEN c.word IS NOT NULL OR s.known IS NOT NULL THEN 1 ELSE 0 END) AS supported FROM ({words}) w LEFT JOIN ({ocr_corpus(d)}) c ON w.page_id = c.page_id AND w.word = c.word LEFT JOIN {values([(x,) for x in STRUCTURAL], 'known')} s ON w.word = s.known GROUP BY w.page_id, w.turn, w.pos"


@operator("tokens", "summaries")
def quoted_claims(d):
    return quotes(d, curly=True)


def normal(d, text: str) -> str:
    bare = d.replace(text, "[$,+-]", "")
    return f"CASE WHEN instr({bare}, '.') > 0 THEN {d.replace(bare, '[.]?0*$', '')} ELSE {bare} END"


@operator("summaries")
def normalize_number(d):
    return f"SELECT DISTINCT page_id, turn, raw, {normal(d, 'raw')} AS value FROM (SELECT page_id, turn, {d.explode}({d.extract_all('summary', '[$]?-?[0-9][0-9,]*(?:[.][0-9]+)?', 0)}) AS raw FROM summaries) n"


def numbers(d) -> str:
    body = d.replace("summary", "#?\\b[0-9a-fA-F]{6}\\b", " ")
    regex = "[$]?-?[0-9][0-9,]*(?:[.][0-9]+)?"
    claimed = f"SELECT DISTINCT page_id, turn, {normal(d, 'raw')} AS value FROM (SELECT page_id, turn, {d.explode}({d.extract_all(body, regex, 0)}) AS raw FROM summaries) n"
    known = f"SELECT DISTINCT page_id, {normal(d, 'raw')} AS value FROM (SELECT page_id, {d.explode}({d.extract_all('text', regex, 0)}) AS raw FROM tokens) n"
    return f"SELECT c.page_id, c.turn, c.value, CASE WHEN k.value IS NULL THEN 0 ELSE 1 END AS supported FROM ({claimed}) c LEFT JOIN ({known}) k ON c.page_id = k.page_id AND c.value = k.value WHERE NOT {d.like('c.value', '^[0-9]$')}"


@operator("tokens", "summaries")
def number_claims(d):
    return numbers(d)


def counts(d) -> str:
    phrases = mentions(d, d.extract_all("lower(summary)", "\\b(?:[0-9]{1,3}|one|two|three|four|five|six|seven|eight|nine|ten)\\s+[a-z]+\\b", 0), "claim")
    phrase = f"SELECT page_id, turn, pos, claim, {d.extract('claim', '^([a-z0-9]+)', 1)} AS amount, {d.replace(d.extract('claim', '([a-z]+)$', 1), 's$', '')} AS noun FROM ({phrases}) c"
    nouns = values([(n, 1) for n in CONTAINER_NOUNS] + [(n, 0) for n in ELEMENT_NOUNS], "known, container")
    value = f"CASE WHEN w.value IS NOT NULL THEN w.value ELSE CAST(concat('0', {d.extract('p.amount', '^([0-9]+)$', 1)}) AS BIGINT) END"
    claim = f"SELECT * FROM (SELECT p.page_id, p.turn, p.pos, p.claim, p.noun, n.container, {value} AS claimed FROM ({phrase}) p JOIN {nouns} n ON p.noun = n.known LEFT JOIN {values(NUMBERS, 'word, value')} w ON p.amount = w.word) v WHERE claimed > 0"
    measured = "SELECT page_id, type, count(*) AS n FROM components GROUP BY page_id, type"
    return f"SELECT c.page_id, c.turn, c.pos, max(c.claim) AS claim, max(c.claimed) AS claimed, CAST(coalesce(sum(m.n), 0) AS BIGINT) AS measured, CASE WHEN abs(coalesce(sum(m.n), 0) - max(c.claimed)) <= 1 THEN 1 ELSE 0 END AS supported FROM ({claim}) c LEFT JOIN ({measured}) m ON c.page_id = m.page_id AND ((c.container = 1 AND m.type NOT IN ('text', 'label')) OR (c.container = 0 AND instr(lower(m.type), c.noun) > 0)) GROUP BY c.page_id, c.turn, c.pos"


@operator("components", "summaries")
def count_claims(d):
    return counts(d)


def report(d, kinds: list[tuple[str, str]], more: str = "") -> str:
    union = " UNION ALL ".join(f"SELECT page_id, turn, '{k}' AS kind, supported FROM ({sql}) x{i}" for i, (k, sql) in enumerate(kinds))
    columns = ", ".join(f"count(CASE WHEN c.kind = '{k}' THEN 1 END) AS {k}_mentions, coalesce(sum(CASE WHEN c.kind = '{k}' THEN c.supported END), 0) AS {k}_supported, CASE WHEN count(CASE WHEN c.kind = '{k}' THEN 1 END) = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(sum(CASE WHEN c.kind = '{k}' THEN c.supported END) AS DOUBLE) / count(CASE WHEN c.kind = '{k}' THEN 1 END) END AS {k}_support" for k in dict(kinds))
    return f"SELECT s.page_id, s.turn, {columns}, {more}CASE WHEN min(coalesce(c.supported, 1)) = 1 THEN 1 ELSE 0 END AS grounded FROM summaries s LEFT JOIN ({union}) c ON s.page_id = c.page_id AND s.turn = c.turn GROUP BY s.page_id, s.turn"


def color_claims(d) -> str:
    return f"SELECT page_id, turn, supported FROM ({hex_claims(d)}) h UNION ALL SELECT page_id, turn, supported FROM ({named_color_claims(d)}) n"


@operator("components", "tokens", "colors", "summaries")
def grounding_report(d):
    behaviors = f"SELECT page_id, turn, 0 AS supported FROM ({behavior_claims(d)}) b"
    return report(d, [("behavior", behaviors), ("color", color_claims(d)), ("text", quotes(d)), ("number", numbers(d))])


@operator("components", "tokens", "colors", "summaries")
def crosscheck_report(d):
    """agreement is the share of supported claims among all that were checked, 1 where there are none."""
    share = "CASE WHEN count(c.kind) = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(sum(c.supported) AS DOUBLE) / count(c.kind) END AS agreement, "
    return report(d, [("color", color_claims(d)), ("text", quotes(d, curly=True)), ("count", counts(d))], share)
