"""Order-dependent folds and clusterings, one page at a time: rows of a page are sorted by an explicit order, then folded.

A page has at most a few thousand rows; pages are spread by page_id, and a task folds its pages batch by batch, holding one batch
and the page that it ends in. Everything else in the library is declarative.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

Box = tuple[int, int, int, int]


def area(b: Box) -> int:
    return max(0, b[2] - b[0]) * max(0, b[3] - b[1])


def iou(a: Box, b: Box) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0, w) * max(0, h)
    union = area(a) + area(b) - both
    return both / union if both and union > 0 else 0.0


def hull(a: Box, b: Box) -> Box:
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def blend(grown: Box, mine: float, other: Box, theirs: float, weight: float) -> float:
    """Area-weighted mean and maximum, blended; weights outside (0, 1] mean the mean alone."""
    total = area(grown) + area(other)
    mean = (mine * area(grown) + theirs * area(other)) / total if total else (mine + theirs) / 2
    return mean if weight <= 0 else min(weight, 1.0) * mean + (1 - min(weight, 1.0)) * max(mine, theirs)


def reconcile_page(rows: list[dict], threshold: float = 0.65, weight: float = 0.5) -> list[dict]:
    """Each row joins the first kept one that it overlaps enough and shares text or type with. Kept boxes grow, types that differ go to the more certain one, and text and meaning are filled in where there are none."""
    kept: list[dict] = []
    for row in rows:
        box = row["box"]
        if box[2] <= box[0] or box[3] <= box[1]:
            continue
        row = {**row, "given": row["confidence"]}
        text = (row.get("text") or "").strip().lower()
        for k in kept:
            same_text = bool(text) and text == (k.get("text") or "").strip().lower()
            if iou(k["box"], box) > threshold and (same_text or (row.get("type") and row["type"] == k["type"])):
                k["box"] = hull(k["box"], box)
                k["confidence"] = blend(k["box"], k["confidence"], box, row["confidence"], weight)
                certain = row.get("type_confidence") or row["given"]
                if row.get("type") and k.get("type") and row["type"] != k["type"] and certain > k["certain"]:
                    k["type"], k["certain"] = row["type"], certain
                for name in ("text", "semantic"):
                    if not k.get(name):
                        k[name] = row.get(name)
                break
        else:
            kept.append({**row, "certain": row.get("type_confidence") or row["given"]})
    return kept


def keep_outer(boxes: list[Box], threshold: float = 0.8) -> list[int]:
    """Largest first, each box that overlaps none of the kept ones by the threshold."""
    kept: list[int] = []
    for i in sorted(range(len(boxes)), key=lambda i: (-area(boxes[i]), i)):
        if all(iou(boxes[i], boxes[k]) < threshold for k in kept):
            kept.append(i)
    return kept


def united(keep: list[Box], add: list[Box], threshold: float = 0.6) -> list[int]:
    """Of the added boxes, those that overlap neither a kept nor an earlier accepted one by the threshold."""
    have, out = list(keep), []
    for i, box in enumerate(add):
        if all(iou(box, h) < threshold for h in have):
            have.append(box)
            out.append(i)
    return out


def lines_of(boxes: list[Box], least: float = 0.4) -> list[int]:
    """Line of each box: boxes in reading order join the first line with a member that overlaps them by the share of the lower height."""
    lines: list[list[Box]] = []
    out = [0] * len(boxes)
    for i in sorted(range(len(boxes)), key=lambda i: (boxes[i][1], boxes[i][0], i)):
        b = boxes[i]
        for n, line in enumerate(lines):
            if any((min(m[3], b[3]) - max(m[1], b[1])) > 0 and (min(m[3], b[3]) - max(m[1], b[1])) >= least * max(1, min(m[3] - m[1], b[3] - b[1])) for m in line):
                line.append(b)
                out[i] = n
                break
        else:
            lines.append([b])
            out[i] = len(lines) - 1
    return out


def rows_of(boxes: list[Box]) -> list[int]:
    """Row of each box: any vertical overlap with a member of the first such row."""
    return lines_of(boxes, 1e-9)


def runs_of(boxes: list[Box], lines: list[int], factor: float = 1.5) -> list[tuple[int, int]]:
    """(line, run) of each box: a gap over the factor times the page's upper median height starts a run."""
    heights = sorted(b[3] - b[1] for b in boxes)
    median = max(1, heights[len(heights) // 2]) if heights else 1
    out, last = [(0, 0)] * len(boxes), {}
    for i in sorted(range(len(boxes)), key=lambda i: (lines[i], boxes[i][0], i)):
        end, run = last.get(lines[i], (None, 0))
        if end is not None and boxes[i][0] - end > factor * median:
            run += 1
        last[lines[i]] = (boxes[i][2], run)
        out[i] = (lines[i], run)
    return out


def size_clusters(boxes: list[Box], tolerance: int = 50) -> list[list[int]]:
    """Clusters around seeds: in order, each free box takes all free boxes of about its width and height."""
    free, out = list(range(len(boxes))), []
    while free:
        b = boxes[free[0]]
        mine = [i for i in free if abs((boxes[i][2] - boxes[i][0]) - (b[2] - b[0])) <= tolerance and abs((boxes[i][3] - boxes[i][1]) - (b[3] - b[1])) <= tolerance]
        taken = set(mine)
        free = [i for i in free if i not in taken]
        out.append(mine)
    return out


def axis_groups(boxes: list[Box], members: list[int], axis: str, gap: int = 80, least: int = 2, spacing: int = 20) -> list[tuple[list[int], int]]:
    """Members aligned on an axis, and their mean spacing along the other one."""
    a, b = (0, 1) if axis == "x" else (1, 0)
    centre = lambda i, k: (boxes[i][k] + boxes[i][k + 2]) // 2
    order, groups = sorted(members, key=lambda i: (centre(i, a), i)), []
    for i in order:
        if groups and centre(i, a) - centre(groups[-1][-1], a) <= gap:
            groups[-1].append(i)
        else:
            groups.append([i])
    out = []
    for g in groups:
        along = sorted(centre(i, b) for i in g)
        if len(g) >= least and (mean := (along[-1] - along[0]) // (len(g) - 1)) >= spacing:
            out.append((sorted(g, key=lambda i: (centre(i, b), i)), mean))
    return out


def bands(heights: list[float], separation: float = 0.18, iterations: int = 50, least: float = 0.35) -> list[float]:
    """Centres, largest first: three, else two bands by 1-D k-means if neighbours differ enough, else the mean."""
    heights = sorted(h for h in heights if h > 0)
    if not heights:
        return []
    half = heights[len(heights) // 2] * least
    large = [h for h in heights if h >= half]
    heights = large if len(large) >= 2 else heights
    for k in (3, 2):
        if len(set(heights)) < k:
            continue
        centres = [float(heights[min(len(heights) - 1, int((i + 0.5) / k * len(heights)))]) for i in range(k)]
        for _ in range(iterations):
            own: list[list[float]] = [[] for _ in centres]
            for h in heights:
                own[min(range(k), key=lambda c: (abs(h - centres[c]), c))].append(h)
            new = [sum(o) / len(o) if o else c for o, c in zip(own, centres, strict=True)]
            if new == centres:
                break
            centres = new
        centres = sorted(centres, reverse=True)
        if all((a - b) / max(a, 1e-9) >= separation for a, b in zip(centres[:-1], centres[1:], strict=True)):
            return centres
    return [sum(heights) / len(heights)]


def tier(height: float, centres: list[float]) -> tuple[str, float]:
    """Band name and how clearly the height is in it."""
    own = min(range(len(centres)), key=lambda c: (abs(height - centres[c]), c))
    names = {1: ("body",), 2: ("heading", "body"), 3: ("heading", "body", "caption")}[len(centres)]
    if len(centres) == 1:
        return names[0], 1.0
    mine, other = abs(height - centres[own]), min(abs(height - c) for i, c in enumerate(centres) if i != own)
    return names[own], max(0.0, min(1.0, (other - mine) / (other + mine))) if other > 0 else 0.0


def gap_bands(boxes: list[Box], height: int) -> list[tuple[int, int]]:
    """White space between rows of text, and below the last one."""
    rows: dict[int, tuple[int, int]] = {}
    for b, r in zip(boxes, rows_of(boxes), strict=True):
        top, bottom = rows.get(r, (b[1], b[3]))
        rows[r] = (min(top, b[1]), max(bottom, b[3]))
    out, at = [], 0
    for top, bottom in sorted(rows.values()):
        if top > at:
            out.append((at, top))
        at = max(at, bottom)
    return out + ([(at, height)] if height > at else [])


def tiles(x0: int, y0: int, x1: int, y1: int, side: int, overlap: float = 0.2) -> list[Box]:
    """One crop if the region fits the side, else overlapping tiles of that side."""
    if x1 - x0 <= side and y1 - y0 <= side:
        return [(x0, y0, x1, y1)]
    step = max(1, int(side * (1 - overlap)))
    return [(x, y, min(x1, x + side), min(y1, y + side)) for y in range(y0, y1, step) for x in range(x0, x1, step)]


Rows = dict[str, list]


def boxes_of(rows: Rows) -> list[Box]:
    return list(zip(rows["x0"], rows["y0"], rows["x1"], rows["y1"], strict=True))


def per_page(df: DataFrame, order: list[str], schema: str, fold: Callable[[int, Rows], list[tuple]]) -> DataFrame:
    """fold(page, columns of its rows in order) for each page. Pages come sorted, many in an Arrow batch; a page that goes on in the next batch waits for it."""
    kind = StructType.fromDDL(schema)
    names, types = kind.names, [to_arrow_type(f.dataType) for f in kind.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Rows | None = None
        for batch in itertools.chain(batches, [None]):
            rows = {n: [] for n in held or ()} if batch is None else {n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
            held = rows if held is None else {n: held[n] + rows[n] for n in held}
            pages = held.get("page_id", [])
            cuts = [0, *(i for i in range(1, len(pages)) if pages[i] != pages[i - 1])] + ([len(pages)] if batch is None and pages else [])
            out = [row for i, j in itertools.pairwise(cuts) for row in fold(pages[i], {n: c[i:j] for n, c in held.items()})]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
            held = {n: c[cuts[-1] :] for n, c in held.items()}

    return df.repartition("page_id").sortWithinPartitions("page_id", *order).mapInArrow(run, schema)


BOX = "x0 bigint, y0 bigint, x1 bigint, y1 bigint"
PLACE = ["page_id", "turn", "pos"]


def reconcile(components: DataFrame) -> DataFrame:
    """Components without duplicates; type_confidence (else the confidence) and semantic are used where components have them."""
    more = [c for c in ("type_confidence", "semantic") if c in components.columns]
    names = ["id", "type", "text", "confidence", *more]

    def fold(page, r):
        rows = [dict(zip((*names, "box"), x, strict=True)) for x in zip(*(r[n] for n in names), boxes_of(r), strict=True)]
        return [(page, k["id"], k["type"], k["text"], k["confidence"], *k["box"], *([k["semantic"]] if "semantic" in more else [])) for k in reconcile_page(rows)]

    schema = f"page_id bigint, id string, type string, text string, confidence double, {BOX}" + (", semantic string" if "semantic" in more else "")
    return per_page(components.select("page_id", "ord", *names, "x0", "y0", "x1", "y1"), ["ord", "id"], schema, fold)


def dedupe_boxes(boxes: DataFrame) -> DataFrame:
    return per_page(boxes.select("page_id", "ord", "x0", "y0", "x1", "y1"), ["ord"], "page_id bigint, ord bigint", lambda page, r: [(page, r["ord"][i]) for i in keep_outer(boxes_of(r))])


def union_boxes(boxes: DataFrame) -> DataFrame:
    """Even rows are kept, odd ones added."""

    def fold(page, r):
        boxes = list(zip(r["ord"], boxes_of(r), strict=True))
        keep, add = [x for x in boxes if x[0] % 2 == 0], [x for x in boxes if x[0] % 2 == 1]
        return [(page, o) for o, _ in keep] + [(page, add[i][0]) for i in united([b for _, b in keep], [b for _, b in add])]

    return per_page(boxes.select("page_id", "ord", "x0", "y0", "x1", "y1"), ["ord"], "page_id bigint, ord bigint", fold)


def token_boxes(tokens: DataFrame) -> DataFrame:
    return tokens.select(*PLACE, "x0", "y0", "x1", "y1")


def ocr_lines(tokens: DataFrame) -> DataFrame:
    return per_page(token_boxes(tokens), PLACE[1:], "page_id bigint, turn bigint, pos bigint, line bigint", lambda page, r: [(page, *x) for x in zip(r["turn"], r["pos"], lines_of(boxes_of(r)), strict=True)])


def text_components(tokens: DataFrame) -> DataFrame:
    """Runs of tokens as components: filtered, grouped to lines, split at gaps and merged."""
    good = tokens.where("trim(text) <> '' and x1 > x0 and y1 > y0 and not (confidence > 0 and confidence < 0.3)")

    def fold(page, r):
        boxes = boxes_of(r)
        runs: dict[tuple[int, int], list[int]] = {}
        for i, key in enumerate(runs_of(boxes, lines_of(boxes))):
            runs.setdefault(key, []).append(i)
        out = []
        for n, key in enumerate(sorted(runs)):
            mine = sorted(runs[key], key=lambda i: (boxes[i][0], i))
            box = boxes[mine[0]]
            for i in mine[1:]:
                box = hull(box, boxes[i])
            mean = sum(r["confidence"][i] for i in mine) / len(mine)
            out.append((page, f"t{n:04d}", " ".join(r["text"][i] for i in mine), mean if mean > 0 else 0.5, *box))
        return out

    return per_page(good.select(*PLACE, "text", "confidence", "x0", "y0", "x1", "y1"), PLACE[1:], f"page_id bigint, id string, text string, confidence double, {BOX}", fold)


def token_rows(tokens: DataFrame) -> DataFrame:
    return per_page(token_boxes(tokens), PLACE[1:], "page_id bigint, turn bigint, pos bigint, row bigint", lambda page, r: [(page, *x) for x in zip(r["turn"], r["pos"], rows_of(boxes_of(r)), strict=True)])


def text_tiers(components: DataFrame) -> DataFrame:
    def fold(page, r):
        heights = [b - a for a, b in zip(r["y0"], r["y1"], strict=True)]
        centres = bands(heights)
        return [(page, i, *tier(h, centres), len(centres)) for i, h in zip(r["id"], heights, strict=True) if h > 0]

    return per_page(components.where("type = 'text'").select("page_id", "ord", "id", "y0", "y1"), ["ord"], "page_id bigint, id string, tier string, confidence double, levels bigint", fold)


def horizontal_bands(tokens: DataFrame) -> DataFrame:
    return per_page(token_boxes(tokens), PLACE[1:], "page_id bigint, band bigint, y0 bigint, y1 bigint", lambda page, r: [(page, n, a, b) for n, (a, b) in enumerate(gap_bands(boxes_of(r), max(r["y1"]) + 40))])


def plan_adaptive(tokens: DataFrame) -> DataFrame:
    """An overview, then the tiles of each band."""

    def fold(page, r):
        width, height = max(r["x1"]) + 20, max(r["y1"]) + 40
        parts = [t for a, b in gap_bands(boxes_of(r), height) for t in tiles(0, a, width, b, 1100)]
        return [(page, "ov", 0, 0, width, height)] + [(page, f"c{n:04d}", *t) for n, t in enumerate(parts)]

    return per_page(token_boxes(tokens), PLACE[1:], f"page_id bigint, id string, {BOX}", fold)


def cents(x: float) -> float:
    return int(x * 100 + 0.5) / 100


@dataclass
class Node:
    """A node of the layout with its children in order, and what it takes of its parent."""

    row: int
    box: Box
    id: str
    children: list[Node] = field(default_factory=list)
    share: tuple[str, float, float, float] | None = None
    parent: str | None = None
    group: Group | None = None

    def share_out(self) -> None:
        """Orders two children or more along the axis on which they reach further, with the share, the gap before and the tiling of each."""
        if len(self.children) < 2:
            return
        box = self.children[0].box
        for child in self.children[1:]:
            box = hull(box, child.box)
        a = 1 if box[3] - box[1] >= box[2] - box[0] else 0
        span, extent = box[a + 2] - box[a], self.box[a + 2] - self.box[a]
        if span <= 0:
            return
        self.children.sort(key=lambda c: c.box[a])
        end = -1
        for child in self.children:
            start = child.box[a]
            child.share = ("xy"[a], cents((child.box[a + 2] - start) / span), cents((start - end) / span) if 0 <= end < start else 0.0, cents(span / extent) if extent > 0 else 0.0)
            end = child.box[a + 2]


@dataclass
class Group:
    """Repeated siblings: member rows in order along the axis that they vary on, and how even the gaps between them are."""

    members: list[int]
    box: Box
    trust: float
    kind: str
    label: str | None


def median_gap(boxes: list[Box], members: list[int], a: int) -> tuple[int, int]:
    """Upper median and spread of the gaps between neighbours along axis a (0 or 1)."""
    order = sorted(members, key=lambda i: boxes[i][a])
    gaps = sorted(max(0, boxes[j][a] - boxes[i][a + 2]) for i, j in itertools.pairwise(order))
    return gaps[len(gaps) // 2], gaps[-1] - gaps[0]


def header_of(r: Rows, boxes: list[Box], box: Box) -> str | None:
    """The text closest above a box, at most 120 away; the one that reaches over more of it, then the first."""
    best = None
    for i, b in enumerate(boxes):
        over = min(b[2], box[2]) - max(b[0], box[0])
        if r["type"][i] == "text" and r["text"][i] is not None and 0 <= box[1] - b[3] <= 120 and over > 0:
            best = min(best or (121, 0, 0), (box[1] - b[3], -over, i))
    return r["text"][best[2]] if best else None


def groups_of(r: Rows, boxes: list[Box]) -> list[tuple[str, list[Group]]]:
    """Groups of each type, by seed, axis and place."""
    by_type: dict[str, list[int]] = {}
    for i, kind in enumerate(r["type"]):
        if kind and kind not in ("text", "label"):
            by_type.setdefault(kind, []).append(i)
    out = []
    for kind, rows in by_type.items():
        groups = []
        for cluster in size_clusters([boxes[i] for i in rows]):
            mine = [rows[k] for k in cluster]
            for axis in "xy":
                for members, _ in axis_groups(boxes, mine, axis):
                    median, spread = median_gap(boxes, members, 1 if axis == "x" else 0)
                    box = boxes[members[0]]
                    for i in members[1:]:
                        box = hull(box, boxes[i])
                    one, two = boxes[members[0]], boxes[members[1]]
                    over = [max(0, min(one[k + 2], two[k + 2]) - max(one[k], two[k])) for k in (0, 1)]
                    groups.append(Group(members, box, max(0.0, 1 - spread / median) if median > 0 else 1.0, "column" if over[0] > over[1] else "row", header_of(r, boxes, box) if axis == "x" else None))
        out.append((kind, groups))
    return out


def smallest_around(boxes: list[Box], box: Box, least: float, but: set[int]) -> int | None:
    """The smallest box that holds this one, has more than the least area and is none of these; the first of equals."""
    found = [(area(b), j) for j, b in enumerate(boxes) if j not in but and b[0] <= box[0] and b[1] <= box[1] and b[2] >= box[2] and b[3] >= box[3] and area(b) > least]
    return min(found)[1] if found else None


def layout_of(r: Rows, tolerance: float = 0.5) -> tuple[list[Node], list[Node]]:
    """Roots of a page's layout, from the top and the left, and all nodes, out of components in order.

    Even groups of two members or more become containers, and hold their members as leaves; a component is in the first even group
    that has it. Others hang under the smallest component around them. What lies under a leaf, or in a group that others leave with
    a single member, is in no tree.
    """
    boxes = boxes_of(r)
    nodes, owner, containers = [Node(i, b, r["id"][i]) for i, b in enumerate(boxes)], {}, []
    for kind, groups in groups_of(r, boxes):
        for k, group in enumerate(groups):
            if group.trust >= tolerance:
                own = [i for i in group.members if i not in owner]
                owner |= dict.fromkeys(own, (kind, k))
                if len(own) >= 2:
                    containers.append((f"L:{kind}:{k + 1}", group, own))
    roots = []
    for node in nodes:
        if node.row not in owner:
            box = node.box
            up = smallest_around(boxes, box, area(box) * 1.05, {node.row})
            if up is None:
                roots.append(node)
            else:
                node.parent = r["id"][up]
                if up not in owner:
                    nodes[up].children.append(node)
    for name, group, own in containers:
        node = Node(-1, group.box, name, group=group)
        node.children = sorted((nodes[i] for i in own), key=lambda n: n.id)
        for child in node.children:
            child.parent = name
        up = smallest_around(boxes, group.box, area(group.box), set(own))
        if up is None:
            roots.append(node)
        else:
            node.parent = r["id"][up]
            if up not in owner:
                nodes[up].children.append(node)
        nodes.append(node)
    for node in nodes:
        node.share_out()
    return sorted(roots, key=lambda n: (n.box[1], n.box[0])), nodes


COLUMNS = ["page_id", "ord", "id", "type", "text", "confidence", "x0", "y0", "x1", "y1"]
LAYOUT = f"page_id bigint, seq bigint, depth bigint, id string, parent string, inferred bigint, kind string, label string, confidence double, text string, axis string, fraction double, gap_before double, tiling double, {BOX}"


def layout_tree(components: DataFrame) -> DataFrame:
    """All nodes of each page's layout in pre-order, with their depth and share."""

    def fold(page, r):
        out, stack = [], [(n, 0) for n in reversed(layout_of(r)[0])]
        while stack:
            node, depth = stack.pop()
            i, g = node.row, node.group
            about = (1, g.kind, g.label, cents(g.trust), None) if g else (0, r["type"][i], None, r["confidence"][i], r["text"][i])
            out.append((page, len(out), depth, node.id, node.parent, *about, *(node.share or (None,) * 4), *node.box))
            stack += [(c, depth + 1) for c in reversed(node.children)]
        return out

    return per_page(components.select(*COLUMNS), ["ord", "id"], LAYOUT, fold)


def find_container(components: DataFrame, container_id: str = "", label: str = "") -> DataFrame:
    """The first node of each page, in pre-order, that has the id or whose label holds the given one in any case."""
    wanted = F.col("id") == container_id if container_id else F.lit(False)
    if label:
        wanted = wanted | (F.instr(F.lower("label"), label.lower()) > 0)
    tree = layout_tree(components).where(wanted)
    return tree.groupBy("page_id").agg(F.min_by(F.struct("id", "inferred", "kind", "label"), "seq").alias("n")).select("page_id", "n.*")


def container_children(components: DataFrame, container_id: str = "", label: str = "") -> DataFrame:
    """Children, in layout order, of the container that find_container gives, with their share in percent."""
    found = find_container(components, container_id, label).select("page_id", F.col("id").alias("parent"), F.col("label").alias("container_label"))
    children = layout_tree(components).join(found, ["page_id", "parent"])
    kind = F.when(F.col("inferred") == 1, F.col("kind"))
    return children.select("page_id", "parent", "container_label", "seq", "id", F.when(F.col("inferred") == 0, F.col("kind")).alias("type"), kind.alias("kind"), "text", "axis", F.round(F.col("fraction") * 100, 1).alias("share_percent"), "x0", "y0", "x1", "y1")


def occupancy_shares(components: DataFrame) -> DataFrame:
    return layout_tree(components).where("axis is not null").select("page_id", "id", "parent", "axis", "fraction", "gap_before", "tiling")


def layout_containers(components: DataFrame) -> DataFrame:
    """Inferred containers that the layout reaches, with their label and the number of their children."""
    tree = layout_tree(components)
    children = tree.groupBy("page_id", F.col("parent").alias("id")).agg(F.count("*").alias("children"))
    return tree.where("inferred = 1").join(children, ["page_id", "id"]).select("page_id", "id", "kind", "label", "confidence", "children")


#: Tags of the types that have one of their own; others are div.
TAGS = {"button": "button", "button_primary": "button", "input": "input", "text_field": "input", "navigation": "nav", "card": "section", "container": "section", "panel": "section", "region": "section", "label": "label", "image": "img"}
NOTE = "<!-- This DOM is INFERRED from screenshot analysis{}, not observed HTML. -->\n"


def dom_tree(components: DataFrame) -> DataFrame:
    """The layout as nested tags with confidences, shares and labels; a page without any nesting as a flat list."""
    quoted = lambda x: json.dumps(x, ensure_ascii=False)

    def fold(page, r):
        roots, _ = layout_of(r)
        nested = any(n.children for n in roots)
        lines = [NOTE.format(" (layout tree)" if nested else ""), '<div class="page">\n']

        def write(node, depth):
            i, g, pad = node.row, node.group, "  " * depth
            share = f' data-share="{node.share[1] * 100:.0f}%"' if node.share else ""
            if g:
                tag, label = "div", f" aria-label={quoted(g.label)}" if g.label else ""
                lines.append(f'{pad}<div class="{g.kind}" data-inferred="true" data-conf="{cents(g.trust):.2f}"{label}{share}>\n')
            else:
                tag = TAGS.get(r["type"][i], "div")
                lines.append(f'{pad}<{tag} class="{r["type"][i]}" data-conf="{r["confidence"][i]:.2f}"{share}>\n')
                if r["text"][i]:
                    lines.append(f"{pad}  {r['text'][i]}\n")
            for child in node.children:
                write(child, depth + 1)
            lines.append(f"{pad}</{tag}>\n")

        for root in roots:
            write(root, 1)
        return [(page, "".join([*lines, "</div>\n"]))]

    return per_page(components.select(*COLUMNS), ["ord", "id"], "page_id bigint, dom string", fold)


#: Name: the relation that it folds, and the fold.
FOLDS = {"reconcile": ("components", reconcile), "dedupe_boxes": ("boxes", dedupe_boxes), "union_boxes": ("boxes", union_boxes), "ocr_lines": ("tokens", ocr_lines), "text_components": ("tokens", text_components), "token_rows": ("tokens", token_rows), "text_tiers": ("components", text_tiers), "horizontal_bands": ("tokens", horizontal_bands), "plan_adaptive": ("tokens", plan_adaptive)}
FOLDS |= {f.__name__: ("components", f) for f in (layout_tree, occupancy_shares, layout_containers, dom_tree)}
FOLDS |= {f.__name__: ("components", partial(f, container_id="L:card:4", label="/5")) for f in (find_container, container_children)}
