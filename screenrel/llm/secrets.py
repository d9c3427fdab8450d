"""Secret scans by a trigram inverted index, by DataFrame functions only.

From each rule's regex a Boolean trigram query is derived: an OR of ANDs of trigrams that any match must contain. One pass cuts
each lower-cased text into its trigrams and keeps the distinct ones of the queries' vocabulary; these postings (trigram,
document) are joined with the queries' ANDs and intersected by counting, and candidates are verified by the regex. Rules
without mandatory trigrams scan every text.

Positions come from what stands between matches: splitting a text at the matches gives the lengths before each.

Defined cases: a null text is empty and has no spans; equal spans of different rules are all listed; rows that repeat are
scanned alike; other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

parser = re._parser  # the standard library's own regex parser


@dataclass(frozen=True)
class Rule:
    """A match counts if the given group has at least `least` characters. Base rules come first in the order of kinds."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The base rules; access and hex carry their least lengths in the regex, which finds the same spans.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """ORed sets of lower-case trigrams, one of which a matching text must contain whole; None if some match needs no trigram."""

    def walk(items, states):
        for op, value in items:
            name = str(op)
            if name == "LITERAL":
                states = [(tri | {(run + chr(value))[-3:].lower()} if len(run) >= 2 else tri, (run + chr(value))[-2:]) for tri, run in states]
            elif name == "SUBPATTERN":
                states = walk(value[3], states)
            elif name == "BRANCH":
                states = [s for branch in value[1] for s in walk(branch, states)]
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
                for _ in range(min(value[0], 8)):
                    states = walk(value[2], states)
                states = [(tri, run if value[0] == value[1] <= 8 else "") for tri, run in states]
            else:
                states = [(tri, "") for tri, _ in states]
        return states

    sets = {frozenset(t for t in tri if len(t) == 3) for tri, _ in walk(parser.parse(regex), [(frozenset(), "")])}
    return None if frozenset() in sets else sorted(sets, key=sorted)


def matches(rule: Rule) -> Column:
    """array<struct<start,stop>> of a rule's counting matches in `text`, in code points."""
    regex = rule.regex.replace("\\", "\\\\").replace("'", "\\'")
    found = f"regexp_extract_all(text, '{regex}', 0)"
    group = f"regexp_extract_all(text, '{regex}', {rule.group})"
    walk = (
        f"aggregate(zip_with(zip_with(split(text, '{regex}', -1), {found}, (gap, hit) -> struct(length(gap) as gap, length(hit) as hit)), {group}, (x, g) -> struct(x.gap as gap, x.hit as hit, length(g) as size)), "
        "named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,stop:int>>)), (acc, x) -> case when x.hit is null then acc else named_struct('at', acc.at + x.gap + x.hit, 'spans', "
        f"case when x.size >= {rule.least} then concat(acc.spans, array(named_struct('start', acc.at + x.gap, 'stop', acc.at + x.gap + x.hit))) else acc.spans end) end, acc -> acc.spans)"
    )
    return F.expr(f"case when text rlike '{regex}' then {walk} else cast(array() as array<struct<start:int,stop:int>>) end")


def cutter(grams: list[str]) -> str:
    """A regex whose first group is, at each position of a text where one begins, the trigram of this list."""
    heads: dict[str, list[str]] = {}
    for gram in grams:
        heads.setdefault(gram[0], []).append(re.escape(gram[1:]))
    return "(?=(" + "|".join(f"{re.escape(head)}(?:{'|'.join(tails)})" for head, tails in heads.items()) + "))"


def candidates(docs: DataFrame, queries: dict[int, list[frozenset[str]]]) -> DataFrame:
    """doc_id, tag, rules: numbers of the rules whose trigram query the document's postings satisfy."""
    grams = sorted({t for query in queries.values() for some in query for t in some})
    postings = docs.select("doc_id", "tag", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(cutter(grams)), F.lit(1)))).alias("gram")).distinct()
    terms = [(t, rule * 1000 + k, len(some), rule) for rule, query in queries.items() for k, some in enumerate(query) for t in some]
    ands = docs.sparkSession.createDataFrame(terms, "gram string, part int, size int, rule int")  # as many rows as the rules have trigrams
    met = postings.join(F.broadcast(ands), "gram").groupBy("doc_id", "tag", "part", "size", "rule").agg(F.count("*").alias("n")).where("n = size")
    return met.groupBy("doc_id", "tag").agg(F.collect_set("rule").alias("rules"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, counts of the rules' spans, base_sha256, spans (kind:start:end by start, then kind)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tag", F.xxhash64("text"))
    queries = {k: q for k, r in enumerate(rules) if (q := trigram_query(r.regex)) is not None}
    found = candidates(docs, queries).select(F.col("doc_id").alias("_doc"), F.col("tag").alias("_tag"), "rules")
    rows = docs.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tag") == F.col("_tag")), "left")
    none = F.expr("cast(array() as array<struct<start:int,stop:int>>)")
    spans = [F.when(F.array_contains("rules", k), matches(r)).otherwise(none) if k in queries else matches(r) for k, r in enumerate(rules)]
    rows = rows.select("doc_id", *[s.alias(f"_{r.kind}") for s, r in zip(spans, rules, strict=True)])

    def listed(some: list[tuple[int, Rule]]) -> Column:
        tagged = ", ".join(f"transform(_{r.kind}, x -> struct(x.start as start, {k} as place, concat('{r.kind}:', x.start, ':', x.stop) as name))" for k, r in some)
        return F.expr(f"array_join(transform(array_sort(concat({tagged})), x -> x.name), ',')")

    numbered = [*enumerate(rules)]
    return rows.select("doc_id", *[F.size(f"_{r.kind}").cast("bigint").alias(f"n_{r.kind}") for r in rules], F.sha2(listed([x for x in numbered if x[1].base]), 256).alias("base_sha256"), listed(numbered).alias("spans"))
