"""URL filters by a path-template tree.

Stated rules judge the urls that they fit. All urls grow a tree per host, level by level over path segments: where a node
has many children of few urls each, the segment is variable and becomes the wildcard `*`; elsewhere, children whose shares
of blocked, allowed and unjudged urls do not differ significantly (chi-square) from their siblings' become one branch `~`.
A leaf is a template. Urls that no rule fits are blocked if their template's smoothed purity of blocked among judged urls
reaches the threshold, else allowed.

Every level is one grouped count with a map-side combine and an equi-join of the urls with the nodes that generalise. These
nodes are broadcast if they are counted to be SMALL at most; beyond, they are copied to SALTS salts and the urls dealt
over them, so a hot host is neither collected nor handled by one task.

Defined cases: a null url, or one without "://", has an empty host and path, no rule, and is allowed; of rules of equal
length the first in text order wins; rows that repeat are judged alike; other columns are ignored. Empty tables give no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenrel.llm.shared import written

#: Verdict, host and path of each rule.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MAX_RULES = 1000
MANY = 8
SMALL, SALTS = 100_000, 32
FEW = 4.0
CHI_SQUARE = 9.21
PRIOR, WEIGHT, PURE = 0.2, 5.0, 0.8


def parsed(url: str = "url") -> tuple[Column, Column]:
    """Host and path."""
    rest = f"case when instr({url}, '://') > 0 then substring({url}, instr({url}, '://') + 3) else '' end"
    host = F.expr(f"translate(regexp_extract({rest}, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    return host, F.expr(f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)")


def ruled(rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """Rule and its verdict from columns host and path, null where none fits; the longest rule is tried first."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def looked_up(rows: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the other columns of nodes, which has no keys twice; rows without a node get nulls."""
    nodes = written(nodes, "nodes")
    if nodes.count() <= SMALL:
        return rows.join(F.broadcast(nodes), keys, "left")
    copies = nodes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(copies, [*keys, "_salt"], "left").drop("_salt")


def templates(urls: DataFrame) -> DataFrame:
    """urls (host, path, ruled, ...) with template: its leaf in the tree of its host."""
    rows = urls.withColumn("_parts", F.filter(F.split("path", "/"), lambda x: x != "")).withColumn("template", F.lit(""))
    deepest = rows.agg(F.max(F.size("_parts"))).first()[0] or 0
    for level in range(deepest):
        rows = rows.withColumn("_part", F.get("_parts", F.lit(level)))
        counts = rows.where("_part is not null").groupBy("host", "template", "_part").agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "block").alias("b"), F.count_if(F.col("ruled") == "allow").alias("a"))
        nodes = counts.groupBy("host", "template").agg(F.count("*").alias("kinds"), F.sum("n").alias("total"), F.sum("b").alias("all_b"), F.sum("a").alias("all_a"))
        wild = nodes.where((F.col("kinds") > MANY) & (F.col("total") < F.col("kinds") * FEW)).select("host", "template", F.lit("*").alias("_wild"))
        # a child against the other children of its node, over the counts (blocked, allowed, unjudged)
        pairs = [("b", "all_b"), ("a", "all_a"), ("n - b - a", "total - all_b - all_a")]
        chi = " + ".join(f"case when {t} = 0 then 0D else pow(({c}) - n * ({t}) / total, 2) / (n * ({t}) / total) * total / greatest(total - n, 1) end" for c, t in ((f"({c})", f"({t})") for c, t in pairs))
        alike = counts.join(nodes.where(f"kinds > 1 and not (kinds > {MANY} and total < kinds * {FEW})"), ["host", "template"]).where(f"{chi} <= {CHI_SQUARE}").select("host", "template", "_part", F.lit("~").alias("_like"))
        rows = looked_up(rows, wild, ["host", "template"])
        rows = looked_up(rows, alike, ["host", "template", "_part"])
        rows = rows.withColumn("template", F.when(F.col("_part").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), F.coalesce("_wild", "_like", "_part")))).drop("_wild", "_like", "_part")
        rows = written(rows, "urls")  # else the plan would grow as a power of the level
    return rows.drop("_parts")


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of each row of pages (page_id, url)."""
    host, path = parsed()
    urls = pages.select("page_id", "url").withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))
    rule, verdict = ruled(rules)
    rows = templates(urls.withColumn("rule", rule).withColumn("ruled", verdict))
    purity = rows.groupBy("host", "template").agg(((F.count_if(F.col("ruled") == "block") + WEIGHT * PRIOR) / (F.count("ruled") + WEIGHT)).alias("purity"))
    rows = looked_up(rows, purity, ["host", "template"])
    own = F.when((F.col("purity") >= PURE) & (F.col("host") != ""), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "template", "purity")
