"""Registry of operators: name, the relations it reads, and its SQL as a function of the dialect."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Operator:
    name: str
    reads: tuple[str, ...]
    sql: Callable


OPERATORS: dict[str, Operator] = {}


def operator(*reads: str):
    def register(f):
        OPERATORS[f.__name__] = Operator(f.__name__, reads, f)
        return f

    return register


def iou(a: str, b: str) -> str:
    """Intersection over union of two boxes as columns of two row names; 0 where they are apart."""
    inter = f"(greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0)))"
    area = "(({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0))"
    union = f"({area.format(a)} + {area.format(b)} - {inter})"
    return f"CASE WHEN {union} <= 0 THEN CAST(0 AS DOUBLE) ELSE CAST({inter} AS DOUBLE) / {union} END"


def overlaps(a: str, b: str) -> str:
    return f"{a}.x0 < {b}.x1 AND {b}.x0 < {a}.x1 AND {a}.y0 < {b}.y1 AND {b}.y0 < {a}.y1"


def contains(a: str, b: str) -> str:
    return f"{a}.x0 <= {b}.x0 AND {a}.y0 <= {b}.y0 AND {a}.x1 >= {b}.x1 AND {a}.y1 >= {b}.y1"


def rounded(x: str, digits: int) -> str:
    """Half up, for values of 0 or more."""
    n = 10**digits
    return f"(floor(CAST({x} AS DOUBLE) * {n} + CAST(0.5 AS DOUBLE)) / CAST({n} AS DOUBLE))"


def hex_of(d, r: str = "r", g: str = "g", b: str = "b") -> str:
    return f"concat('#', {d.hex2(r)}, {d.hex2(g)}, {d.hex2(b)})"


def values(rows: list[tuple], names: str) -> str:
    """A literal dimension table."""
    lit = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({names}))"
