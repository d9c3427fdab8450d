"""The operators' queries over whole tables, and SQL where it can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenrel.llm import bpe, chat_format, decontaminate, jaccard_join, language_id, line_dedup, merkle, secrets, token_store, url_filter
from screenrel.llm.shared import table


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """A tokenizer's file in folder, else where the installed vocabulary package has it; the same place on every machine."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_ids(token_store.write_ids(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), 1))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), 5, 80).drop("tag")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents")).drop("edits")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hit_spans")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "text", F.col("_n_lines").cast("bigint").alias("n_lines"), F.size("_removed").cast("bigint").alias("n_removed"), F.array_join(F.col("_removed").cast("array<string>"), ",").alias("removed_lines"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify(docs.select("doc_id", "text"), docs.where(~held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3_fingerprints that SQL can give."""
    return op3_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8_secret_scan that SQL can give."""
    return op8_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9_url_filter that SQL can give."""
    return op9_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule")


QUERIES = {f.__name__: f for f in (op1_token_binary, op2_ngram_jaccard, op3_fingerprints, op4_bpe, op5_decontamination, op6_chat_format, op7_line_dedup, op8_secret_scan, op9_url_filter, op10_language_id, edited_texts, secret_counts, url_rules)}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = rf"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({LOWER.format('text')}, '[^\x20\x09-\x0D]+') AS w FROM documents),
 shingles AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 4), chr(1)) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM words WHERE len(w) > 0) x),
 sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
 links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
 reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
 SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN sizes z ON d.doc_id = z.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON d.doc_id = m.a"""

LEAKS = rf"""WITH words AS (SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents
 UNION ALL SELECT 'b', CAST(item_id AS VARCHAR), regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') FROM benchmark),
 items AS (SELECT DISTINCT id AS item, least(10, len(w)) AS n, array_to_string(list_slice(w, k, k + 9), ' ') AS g FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS k FROM words WHERE kind = 'b' AND len(w) > 0) x),
 lengths AS (SELECT DISTINCT n FROM items),
 grams AS (SELECT id, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS g FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM words, lengths WHERE kind = 'd' AND len(w) >= n) x),
 found AS (SELECT g.id, g.k, i.n, i.item FROM grams g JOIN items i ON g.g = i.g AND g.n = i.n),
 hit AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(range(k, k + n)) AS p FROM found) x GROUP BY id),
 named AS (SELECT id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT id, item FROM found) x GROUP BY id)
 SELECT d.doc_id, len(w.w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items, sha256(coalesce(m.list, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
 FROM documents d JOIN words w ON w.kind = 'd' AND w.id = CAST(d.doc_id AS VARCHAR) LEFT JOIN hit h ON h.id = w.id LEFT JOIN named m ON m.id = w.id"""

EDITED = """SELECT doc_id, length(t) AS n_chars, sha256(concat(left(t, CAST(length(t) - length(t) // 2 AS BIGINT)), left(after, CAST(length(t) // 2 AS BIGINT)))) AS edited_sha256
 FROM (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS after FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) d) x"""

SECRETS = """SELECT doc_id, len(list_filter(regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) AS n_assign,
 len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 32)) AS n_hex
 FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) d"""

RULED = [(host + path, host, path) for _, host, path in sorted(url_filter.RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))]
URLS = f"""SELECT page_id, host, path, CASE {' '.join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{name}'" for name, h, p in RULED)} END AS rule
 FROM (SELECT page_id, {LOWER.format("regexp_extract(rest, '^[^/?#]*', 0)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages) p) q"""

#: The rest can't be given in SQL, or not fast enough on whole tables; tests/llm holds each against a brute-force version.
ORACLE_SQL: dict[str, str] = {"op2_ngram_jaccard": JACCARD, "op5_decontamination": LEAKS, "edited_texts": EDITED, "secret_counts": SECRETS, "url_rules": URLS}
