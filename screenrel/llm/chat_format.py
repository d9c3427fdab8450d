"""Chat formatting: minimum-cost role repair by dynamic programming over a legal-turn automaton, then rendering.

A legal conversation is an optional system turn, then user and assistant turns in turn, ending with the assistant. A turn
may keep its role (cost 0), be merged into the turn before (cost MERGE), or be relabelled (cost RELABEL, or UNKNOWN where
its role is none of the three); empty turns may be inserted before it or at the end (cost INSERT each). The cheapest
repair is found over four states; on ties the option listed first wins.

Rows are dealt into ranges of conversation and turn, and numbered in chunks of SPAN rows at most of one conversation. The costs of
a chunk form a (min, +) matrix over the states; the matrices of a conversation are chained, and each chunk is then repaired
for its own first and last state. So one conversation with very many turns, or very many equal ones, is spread over
many tasks, and no task holds more than a chunk's turns.

Each row comes back with its role, the action, the roles of empty turns inserted before it, and its piece of the rendered
text: concatenated in the order of place, the pieces of a conversation are the rendered conversation.

Defined cases: null text is empty; null, blank or unknown roles are relabelled, and role names are compared trimmed and in
lower case; turns with equal numbers are ordered by role, then a hash of the text, nulls first; null turn numbers come first; rows with
null conv_id are one conversation; other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenrel.llm.shared import written

SPAN = 4096
MERGE, RELABEL, UNKNOWN, INSERT = 1.0, 2.0, 1.5, 3.0
ROLES = ("system", "user", "assistant")
STATES = 4  # nothing yet, then the last turn's role in the order of ROLES
NEVER = float("inf")
#: The legal next roles of each state.
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}


def insertions() -> dict[tuple[int, int], tuple[int, ...]]:
    """Fewest empty turns that lead from a state to one after which the other state's role is legal."""
    out = {}
    for state in range(STATES):
        paths = [(state, ())]
        for here, path in paths:
            for role in NEXT[here]:
                out.setdefault((state, role), path)
                if len(path) < 2:
                    paths.append((role, (*path, role)))
    return out


BETWEEN = insertions()
#: Cost and inserted roles to end from each state.
ENDING = {0: (0.0, ()), 1: (2 * INSERT, (2, 3)), 2: (INSERT, (3,)), 3: (0.0, ())}


def options(role: str | None) -> dict[int, list[tuple[int, float, str, tuple[int, ...]]]]:
    """By state: (new state, cost, action, inserted roles) of a turn with this role, best first for each new state."""
    name = (role or "").strip().lower()
    own = ROLES.index(name) + 1 if name in ROLES else 0
    out = {}
    for state in range(STATES):
        found: dict[int, tuple[int, float, str, tuple[int, ...]]] = {}
        for new in (1, 2, 3):
            change = 0.0 if new == own else RELABEL if own else UNKNOWN
            action = "keep" if new == own else "relabel"
            choices = []
            if (state, new) in BETWEEN:
                choices.append((new, change + INSERT * len(BETWEEN[state, new]), action, BETWEEN[state, new]))
            if state == new:
                choices.append((new, change + MERGE, "merge", ()))
            if choices:
                found[new] = min(choices, key=lambda c: c[1])
        out[state] = sorted(found.values(), key=lambda c: (c[1], c[0]))
    return out


_options: dict[str | None, dict] = {}


def options_of(role: str | None) -> dict:
    if role not in _options:
        if len(_options) > 1000:
            _options.clear()
        _options[role] = options(role)
    return _options[role]


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of sorted batches by equal values of the first columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:keys] != held[0][:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def transfer(rows: list[str | None]) -> list[float]:
    """Least cost from each state to each state over some turns, row by row."""
    out = []
    for start in range(STATES):
        cost = {start: 0.0}
        for role in rows:
            table, new = options_of(role), {}
            for state, spent in cost.items():
                for to, price, _, _ in table[state]:
                    if spent + price < new.get(to, NEVER):
                        new[to] = spent + price
            cost = new
        out += [cost.get(s, NEVER) for s in range(STATES)]
    return out


def numbered(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, turn, role, text) in order, each with its partition, its chunk in it and its place in the chunk."""
    part, seq, place, last = TaskContext.get().partitionId(), -1, 0, object()
    for batch in batches:
        seqs, places = [], []
        for conv in batch.column(0).to_pylist():
            if conv != last or place == span:
                seq, place, last = seq + 1, 0, conv
            seqs.append(seq)
            places.append(place)
            place += 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int64()), pa.array(seqs, pa.int64()), pa.array(places, pa.int64())], [*batch.schema.names, "part", "seq", "place"])


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (part, seq, conv_id, role) in order: one row a chunk."""
    part, seq, conv, costs, size = [], [], [], [], []
    for rows in groups(batches, 2):
        part.append(rows[0][0])
        seq.append(rows[0][1])
        conv.append(rows[0][2])
        costs.append(transfer([r[3] for r in rows]))
        size.append(len(rows))
    yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(part, pa.int64()), pa.array(seq, pa.int64()), pa.array(costs, pa.list_(pa.float64())), pa.array(size, pa.int64())], ["conv_id", "part", "seq", "costs", "size"])


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last state of each chunk on the cheapest way, the number of rows before it, and whether it ends the conversation."""
    columns: list[list] = [[] for _ in range(6)]
    for rows in groups(batches, 1):
        best, ways = {0: 0.0}, []
        for row in rows:
            new, way = {}, {}
            for a in sorted(best):
                for b in range(STATES):
                    if (spent := best[a] + row[3][a * STATES + b]) < new.get(b, NEVER):
                        new[b], way[b] = spent, a
            best = new
            ways.append(way)
        state = min(sorted(best), key=lambda s: best[s] + ENDING[s][0])
        ends = []
        for way in reversed(ways):
            ends.append((way[state], state))
            state = way[state]
        before = 0
        for k, (row, (a, b)) in enumerate(zip(rows, reversed(ends), strict=True)):
            for column, value in zip(columns, (row[1], row[2], a, b, before, k == len(rows) - 1), strict=True):
                column.append(value)
            before += row[4]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["part", "seq", "entry", "exit", "before", "final"])


def opened(role: int) -> str:
    return f"<|{ROLES[role - 1]}|>\n"


CLOSE = "<|end|>\n"
REPAIRED = "conv_id bigint, place bigint, turn bigint, role_in string, role string, action string, inserted array<string>, appended array<string>, rendered string"


def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "place", "turn", "role_in", "role", "action", "inserted", "appended", "rendered"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
    columns: list[list] = [[] for _ in names]
    for rows in ([r[2:] for r in some] for some in groups(batches, 2)):
        entry, last, before, final = rows[0][4:8]
        cost, backs = {entry: 0.0}, []
        for row in rows:
            table, new, back = options_of(row[2]), {}, {}
            for state in sorted(cost):
                for option in table[state]:
                    if cost[state] + option[1] < new.get(option[0], NEVER):
                        new[option[0]], back[option[0]] = cost[state] + option[1], (state, option)
            cost = new
            backs.append(back)
        path, state = [], last
        for back in reversed(backs):
            path.append(back[state])
            state = back[state][0]
        for k, (row, (state, (new, _, action, between))) in enumerate(zip(rows, reversed(path), strict=True)):
            text = row[3] or ""
            if action == "merge":
                piece = "\n" + text
            else:
                piece = (CLOSE if state else "") + "".join(opened(r) + CLOSE for r in between) + opened(new) + text
            ending = ENDING[new][1] if final and k == len(rows) - 1 else ()
            if final and k == len(rows) - 1:
                piece += CLOSE + "".join(opened(r) + CLOSE for r in ending)
            values = (row[0], before + k, row[1], row[2], ROLES[new - 1], action, [ROLES[r - 1] for r in between], [ROLES[r - 1] for r in ending], piece)
            for column, value in zip(columns, values, strict=True):
                column.append(value)
        if len(columns[0]) >= SPAN:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
            columns = [[] for _ in names]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def format_chats(conversations: DataFrame) -> DataFrame:
    """Each row of conversations (conv_id, turn, role, text) repaired and rendered."""
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    order = ["conv_id", "turn", "role", "tie"]
    dealt = rows.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *order, "row").sortWithinPartitions(*order)
    dealt = dealt.select("conv_id", "turn", "role", "text")
    turns = written(dealt.mapInArrow(partial(numbered, span=SPAN), "conv_id bigint, turn bigint, role string, text string, part bigint, seq bigint, place bigint"), "turns")
    light = turns.select("part", "seq", "place", "conv_id", "role").repartition(parts, "part", "seq").sortWithinPartitions("part", "seq", "place")
    costs = light.select("part", "seq", "conv_id", "role").mapInArrow(matrices, "conv_id bigint, part bigint, seq bigint, costs array<double>, size bigint")
    ends = costs.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(chained, "part bigint, seq bigint, entry int, exit int, before bigint, final boolean")
    both = turns.join(written(ends, "chunks"), ["part", "seq"]).repartition(parts, "part", "seq").sortWithinPartitions("part", "seq", "place")
    return both.select("part", "seq", "conv_id", "turn", "role", "text", "entry", "exit", "before", "final").mapInArrow(repaired, REPAIRED)
