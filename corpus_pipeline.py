"""A training-corpus pipeline over `documents`: language ID, line dedup, near-duplicate removal, decontamination, BPE ids.

Each stage works on all that its predecessor kept. All but the last return the columns of documents, which may include others
of any name beside doc_id, text, lang and n_chars.

Defined cases, for every stage: a row is known by its doc_id (null counts as an id) and its text, so rows that share a doc_id and
differ in text are judged by themselves, and rows equal in both alike; an empty table gives an empty table. What a stage does
with null and empty texts, ties and repeated rows is stated there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from screenrel.llm import bpe, decontaminate, jaccard_join, language_id, line_dedup
from screenrel.llm.queries import tokenizer_file
from screenrel.llm.shared import free, table, written

#: SQL for run()'s rows: none, as no stage but the first is expressible; tests hold run() against a brute-force version.
ORACLE_SQL = None
#: Documents without doc_id get ids from here on in the near-duplicate stage, by the hash of their text.
UNNAMED = 1 << 61


def boxed(docs: DataFrame) -> DataFrame:
    """Each row as one column, row, beside doc (its doc_id) and tag (a hash of its text), so that no other names can clash."""
    return docs.select(F.struct("*").alias("row")).withColumn("doc", F.col("row.doc_id").cast("bigint")).withColumn("tag", F.xxhash64("row.text"))


def unboxed(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select(*[F.col("row")[c].alias(c) for c in names])


def same_row(found: DataFrame) -> Column:
    """That a row of boxed() is the one that found (doc_, tag_) names."""
    return F.col("doc").eqNullSafe(found["doc_"]) & (F.col("tag") == found["tag_"])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without any letter (null and empty texts too), and sets lang to the predicted language; repeated rows stay."""
    lang, score = free("lang_pred", docs.columns), free("score", docs.columns)
    known = language_id.with_language(docs, docs, lang, score).where(F.col(lang) != "und")
    return known.select(*[F.col(lang).alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later copies of repeated runs of lines; documents that lose lines and of which nothing but white space is left go. Null and empty texts stay; repeated rows are edited alike."""
    n_lines = free("_n_lines", docs.columns)
    removed = free("_removed", [*docs.columns, n_lines])
    kept = line_dedup.dedup_lines(docs, n_lines=n_lines, removed=removed).where((F.size(removed) == 0) | (F.expr("trim(both ' \t\r\n' from text)") != ""))
    return kept.select(*[F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group, documents without doc_id (which count as ids from 2**61 on) last, by the hash of their text; of rows equal in doc_id and text, the one whose hash is least. Texts without words (null too) are a group each by doc_id."""
    rows = boxed(docs).withColumn("id", F.coalesce("doc", F.lit(UNNAMED) + F.shiftrightunsigned("tag", 4)))
    found = jaccard_join.jaccard_components(rows.select(F.col("id").alias("doc_id"), "row.text"))
    later = found.where("doc_id <> component_id").select(F.col("doc_id").alias("doc_"), F.col("tag").alias("tag_")).distinct()
    kept = rows.join(later, (F.col("id") == later["doc_"]) & (F.col("tag") == later["tag_"]), "left_anti")
    kept = kept.withColumn("k", F.row_number().over(Window.partitionBy("id", "tag").orderBy(F.xxhash64("row")))).where("k = 1")
    return unboxed(kept, docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item; null and empty texts and repeated rows stay."""
    hit = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), tagged=True).where("contaminated")
    hit = hit.select(F.col("doc_id").alias("doc_"), F.col("tag").alias("tag_")).distinct()
    rows = boxed(docs)
    return unboxed(rows.join(hit, same_row(hit), "left_anti"), docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and byte-level BPE ids of each row, with the digests that tests and readers check them by; a null text is empty."""
    return bpe.round_trip(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
