"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of paragraphs, by DataFrame functions only.

Sections end at blank lines, paragraphs at line ends, pieces after eight words; each keeps its separators. A paragraph's node is
the SHA-256 of its text, a section's that of its paragraphs' nodes and the root that of the sections' nodes, so equal roots mean
equal texts; where roots differ, differing sections and paragraphs locate the edits. The fingerprint is the root, and as a
listing the section nodes and the hashes of the pieces, both cut to SHORT digits: about 0.3 of the text's length. Likeness is
the Dice coefficient of the distinct pieces as listed.

The next document in descending doc_id is found by dealing documents into ranges of ids (bounds from quantiles), as many
as the rows need: within a range by a window, across ranges through the ranges' first documents, which are found by a
window for each of COARSE parts. Texts are shuffled once.

Defined cases: a null text is the empty text; empty texts have the root of no sections, and are alike only to empty
texts; rows that repeat a doc_id are ordered by the hash of their text; rows without doc_id come last; a single document
is its own next one; other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COARSE = 64
ROWS_PER_RANGE = 512
PIECE = r"(?:\\S++\\s*+){1,8}+|\\s++"
SHORT = 12


def tree(text: str) -> Column:
    """array<array<struct<node, pieces>>> of a text column: paragraphs by section, each with its node and its pieces' hashes."""
    return F.expr(
        f"case when {text} = '' then cast(array() as array<array<struct<node: string, pieces: array<string>>>>) else transform(filter(split({text}, '(?<=\n\n)(?!\n)'), s -> s <> ''), s -> transform(filter(split(s, '(?<=\n)'), p -> p <> ''), "
        f"p -> named_struct('node', sha2(p, 256), 'pieces', transform(regexp_extract_all(p, '{PIECE}', 0), x -> left(sha2(x, 256), {SHORT}))))) end"
    )


def sections(tree_column: str) -> Column:
    """Section nodes of a tree column."""
    return F.expr(f"transform({tree_column}, s -> sha2(array_join(transform(s, p -> p.node), ','), 256))")


def leaves(tree_column: str) -> Column:
    """Hashes of all pieces of a tree column, in order."""
    return F.expr(f"flatten(transform({tree_column}, s -> flatten(transform(s, p -> p.pieces))))")


def fingerprint(pieces: str, nodes: str) -> Column:
    """root:section nodes (shortened):piece hashes."""
    return F.concat_ws(":", F.sha2(F.array_join(nodes, ","), 256), F.expr(f"array_join(transform({nodes}, s -> left(s, {SHORT})), '')"), F.array_join(pieces, ""))


def likeness(a: str, b: str) -> Column:
    """Dice coefficient of two arrays of distinct pieces; 1 for two empty ones."""
    return F.expr(f"case when size({a}) + size({b}) = 0 then 1D else 2D * size(array_intersect({a}, {b})) / (size({a}) + size({b})) end")


def differing_paragraphs(a: str, b: str) -> Column:
    """Of two tree columns: places (section, paragraph), from 0, where the first has a branch that differs from the second's at that place; sections with equal nodes aren't descended into."""
    return F.expr(
        f"flatten(transform({a}, (s, i) -> case when transform(s, p -> p.node) <=> transform(get({b}, i), p -> p.node) then cast(array() as array<struct<section:int,paragraph:int>>) else "
        f"filter(transform(s, (p, j) -> case when p.node <=> get(get({b}, i), j).node then null else named_struct('section', i, 'paragraph', j) end), x -> x is not null) end))"
    )


def ranged(docs: DataFrame) -> DataFrame:
    """docs with range: higher ids have higher ranges, and ranges hold about ROWS_PER_RANGE rows where ids are spread evenly between quantiles."""
    count = docs.count()
    bounds = [int(x) for x in sorted({*docs.approxQuantile("doc_id", [k / COARSE for k in range(COARSE + 1)], 0.002)})] if count else []
    if not bounds:
        return docs.withColumn("part", F.lit(0)).withColumn("range", F.lit(0).cast("bigint"))
    fine = max(1, count // ROWS_PER_RANGE // COARSE)
    widths = [max(1, -(-(b - a) // fine)) for a, b in zip(bounds, [*bounds[1:], bounds[-1] + 1], strict=True)]
    places, steps = (f"array({','.join(f'{x}L' for x in xs)})" for xs in (bounds, widths))
    docs = docs.withColumn("_at", F.expr(f"greatest(1, size(filter({places}, x -> x <= doc_id)))"))
    inside = f"greatest(0L, least({fine - 1}L, (doc_id - element_at({places}, _at)) div element_at({steps}, _at)))"
    return docs.withColumn("range", F.expr(f"coalesce(_at * {fine}L + {inside}, -1L)")).withColumn("part", F.expr("case when doc_id is null then 0 else _at end")).drop("_at")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text (last half replaced by the start of the next document), and likenesses."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = ranged(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    # a range's successor is the next lower one that has rows, in its part or else the next lower part; the last one's is the first
    ids = rows.groupBy("part", "range").agg(F.max("doc_id").alias("top"))
    by_part = Window.orderBy(F.desc("part"))  # COARSE + 2 rows at most
    tops = ids.groupBy("part").agg(F.max("range").alias("most"))
    tops = tops.select("part", F.coalesce(F.lead("most").over(by_part), F.first("most").over(by_part)).alias("lower"))
    order = ids.withColumn("within", F.lead("range").over(Window.partitionBy("part").orderBy(F.desc("range")))).join(F.broadcast(tops), "part").select("range", F.coalesce("within", "lower").alias("after"))
    rows = rows.drop("part")
    firsts = rows.repartition(parts, "range").groupBy("range").agg(F.max_by("text", F.struct("doc_id", F.xxhash64("text"))).alias("head"))
    heads = order.join(firsts.withColumnRenamed("range", "after"), "after").select("range", "head")
    dealt = rows.repartition(parts, "range").withColumn("tie", F.xxhash64("text")).withColumn("tree", tree("text"))
    dealt = dealt.withColumn("all", leaves("tree")).withColumn("pieces", F.array_distinct("all"))
    down = Window.partitionBy("range").orderBy(F.desc_nulls_last("doc_id"), F.desc("tie"))
    pairs = dealt.withColumn("next", F.lead("text").over(down)).withColumn("next_pieces", F.lead("pieces").over(down)).join(heads, "range")
    pairs = pairs.withColumn("n_chars", F.length("text").cast("bigint")).withColumn("after", F.coalesce("next", "head"))
    pairs = pairs.withColumn("edited", F.expr("concat(left(text, cast(n_chars - n_chars div 2 as int)), left(after, cast(n_chars div 2 as int)))"))
    pairs = pairs.withColumn("edited_tree", tree("edited")).withColumn("after_tree", F.when(F.col("next").isNull(), tree("after")))
    pairs = pairs.withColumn("next_pieces", F.coalesce("next_pieces", F.array_distinct(leaves("after_tree")))).withColumn("edited_all", leaves("edited_tree"))
    pairs = pairs.withColumn("edited_pieces", F.array_distinct("edited_all")).withColumn("nodes", sections("tree")).withColumn("edited_nodes", sections("edited_tree"))
    return pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("all", "nodes").alias("fingerprint"), fingerprint("edited_all", "edited_nodes").alias("edited_fingerprint"),
        likeness("pieces", "edited_pieces").alias("near_edited"), likeness("pieces", "next_pieces").alias("near_next"), differing_paragraphs("edited_tree", "tree").alias("edits"),
    )
