"""The few places where Spark SQL and ANSI SQL as other engines run it differ. Operators are declarative SQL over relations."""

from __future__ import annotations


class Spark:
    string, explode = "STRING", "explode"

    def __init__(self, made: frozenset[str] = frozenset(), parts: int = 0):
        """made: the relations that the query derives itself, which Spark takes to be as small as what they are exploded from; parts: partitions of these."""
        self.made, self.parts = made, parts

    def dealt(self, key: str) -> str:
        """A hint that rows about to be exploded are dealt to all partitions by key: a list that is small itself would end in one."""
        return f"/*+ REPARTITION({self.parts}, {key}) */ " if self.parts else ""

    def small(self, name: str, large: str) -> str:
        """A hint that the larger relation streams past a hash table of name in each partition: where it is derived here, Spark would broadcast it."""
        return f"/*+ SHUFFLE_HASH({name}) */ " if large in self.made else ""

    def table(self, name: str) -> str:
        return name

    def div(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))"

    def series(self, a: str, b: str) -> str:
        return f"sequence(CAST({a} AS BIGINT), CAST({b} AS BIGINT))"

    def like(self, text: str, regex: str) -> str:
        return f"({text} rlike r'{regex}')"

    def extract(self, text: str, regex: str, group: int = 0) -> str:
        return f"regexp_extract({text}, r'{regex}', {group})"

    def extract_all(self, text: str, regex: str, group: int = 0) -> str:
        return f"regexp_extract_all({text}, r'{regex}', {group})"

    def replace(self, text: str, regex: str, by: str) -> str:
        return f"regexp_replace({text}, r'{regex}', '{by}')"

    def words(self, text: str) -> str:
        return f"split({text}, r'\\s+')"

    def joined(self, value: str, sep: str, order: str) -> str:
        return f"listagg({value}, '{sep}') WITHIN GROUP (ORDER BY {order})"

    def numbers(self, n: int) -> str:
        return f"(SELECT id AS n FROM range({n}))"

    def item(self, array: str, k: str) -> str:
        return f"get({array}, CAST({k} AS INT))"

    def size(self, array: str) -> str:
        return f"size({array})"

    def hexpair(self, text: str) -> str:
        return f"CAST(conv({text}, 16, 10) AS BIGINT)"

    def hex2(self, value: str) -> str:
        return f"lpad(hex({value}), 2, '0')"

    def sha256(self, text: str) -> str:
        return f"sha2({text}, 256)"

    def nul(self) -> str:
        return "decode(X'00', 'UTF-8')"

    def newline(self) -> str:
        return "decode(X'0A', 'UTF-8')"

    def fixed(self, value: str, digits: int) -> str:
        return f"format_string('%.{digits}f', {value})"

    def sorted_list(self, value: str) -> str:
        return f"array_sort(collect_list({value}))"

    def seeded(self, rows: str, by: str, tolerance: int) -> str:
        """rows (by, ord, w, h, ...) with `cluster`: in the order of ord, each joins the first seed of about its size, or becomes one."""
        near = f"abs(s.w - b.w) <= {tolerance} AND abs(s.h - b.h) <= {tolerance}"
        none = "named_struct('seeds', CAST(array() AS ARRAY<STRUCT<w: BIGINT, h: BIGINT>>), 'own', CAST(array() AS ARRAY<BIGINT>))"
        found = f"array_position(transform(acc.seeds, s -> {near}), true)"
        step = f"CASE WHEN {found} = 0 THEN named_struct('seeds', concat(acc.seeds, array(named_struct('w', b.w, 'h', b.h))), 'own', concat(acc.own, array(CAST(size(acc.seeds) + 1 AS BIGINT)))) ELSE named_struct('seeds', acc.seeds, 'own', concat(acc.own, array({found}))) END"
        listed = f"SELECT {by}, array_sort(collect_list(named_struct('ord', CAST(ord AS BIGINT), 'w', CAST(w AS BIGINT), 'h', CAST(h AS BIGINT)))) AS bs FROM ({rows}) r GROUP BY {by}"
        owned = f"SELECT {by}, inline(arrays_zip(bs.ord, aggregate(bs, {none}, (acc, b) -> {step}, acc -> acc.own))) AS (ord, cluster) FROM ({listed}) l"
        same = " AND ".join(f"r.{c.strip()} = o.{c.strip()}" for c in by.split(","))
        return f"SELECT r.*, o.cluster FROM ({rows}) r JOIN ({owned}) o ON {same} AND r.ord = o.ord"


class Duck(Spark):
    """For the oracle."""

    string, explode = "VARCHAR", "unnest"

    def div(self, a, b):
        return f"(({a}) // ({b}))"

    def series(self, a, b):
        return f"generate_series(CAST({a} AS BIGINT), CAST({b} AS BIGINT))"

    def like(self, text, regex):
        return f"regexp_matches({text}, '{regex}')"

    def extract(self, text, regex, group=0):
        return f"regexp_extract({text}, '{regex}', {group})"

    def extract_all(self, text, regex, group=0):
        return f"regexp_extract_all({text}, '{regex}', {group})"

    def replace(self, text, regex, by):
        return f"regexp_replace({text}, '{regex}', '{by}', 'g')"

    def words(self, text):
        return f"string_split_regex({text}, '\\s+')"

    def joined(self, value, sep, order):
        return f"string_agg({value}, '{sep}' ORDER BY {order})"

    def numbers(self, n):
        return f"(SELECT range AS n FROM range(0, {n}))"

    def item(self, array, k):
        return f"{array}[CAST({k} AS BIGINT) + 1]"

    def size(self, array):
        return f"len({array})"

    def hexpair(self, text):
        return f"CAST(concat('0x', {text}) AS BIGINT)"

    def hex2(self, value):
        return f"upper(printf('%02x', CAST({value} AS BIGINT)))"

    def sha256(self, text):
        return f"sha256({text})"

    def nul(self):
        return "chr(0)"

    def newline(self):
        return "chr(10)"

    def fixed(self, value, digits):
        return f"printf('%.{digits}f', {value})"

    def sorted_list(self, value):
        return f"list_sort(list({value}))"

    def seeded(self, rows, by, tolerance):
        """By recursion over places, one row a step."""
        keys = [c.strip() for c in by.split(",")]
        same = " AND ".join(f"n.{c} = r.{c}" for c in keys)
        mine = ", ".join(f"n.{c}" for c in keys)
        found = f"list_position(list_transform(r.seeds, lambda s: abs(s.w - n.w) <= {tolerance} AND abs(s.h - n.h) <= {tolerance}), true)"
        return f"""WITH RECURSIVE numbered AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY ord) AS seq FROM ({rows}) r0),
 r AS (SELECT {by}, ord, seq, [{{'w': w, 'h': h}}] AS seeds, CAST(1 AS BIGINT) AS cluster FROM numbered WHERE seq = 1
 UNION ALL SELECT {mine}, n.ord, n.seq, CASE WHEN coalesce({found}, 0) = 0 THEN list_append(r.seeds, {{'w': n.w, 'h': n.h}}) ELSE r.seeds END, CASE WHEN coalesce({found}, 0) = 0 THEN CAST(len(r.seeds) + 1 AS BIGINT) ELSE CAST({found} AS BIGINT) END FROM r JOIN numbered n ON {same} AND n.seq = r.seq + 1)
 SELECT n.* EXCLUDE (seq), r.cluster FROM numbered n JOIN r ON {same} AND n.seq = r.seq"""
