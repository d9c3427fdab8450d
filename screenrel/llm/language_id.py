"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams (1 to 3 characters of letters, with word edges) for each label over all labelled rows,
adds the counts up with a map-side combine, and broadcasts the log-probability matrix: BUCKETS x labels, at most
MAX_LABELS labels, so at most BUCKETS * MAX_LABELS * 4 bytes. Scoring adds the log share of a label among the labelled
rows to the sum of the matrix rows of a text's n-grams, in numpy.

Defined cases: a text that is null or has no letter is `und` with score 0; ties go to the label that sorts first; with no
labelled row at all every text is `und`. Rows that repeat are predicted alike. Other columns are ignored. Empty tables
give no rows. The score is the posterior of the label with per-text evidence tempered by the square root of its length.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from screenrel.llm import textvec

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
MAX_LABELS = 256
#: Bytes of text at a time: each takes about 150 bytes for its n-grams.
CHUNK = 1 << 17
_U = np.uint64


@cache
def letters() -> np.ndarray:
    """By code point: its lower-case form if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for k in range(0x110000):
        c = chr(k)
        if not 0xD800 <= k < 0xE000 and unicodedata.category(c)[0] == "L":
            low = c.lower()
            out[k] = ord(low[0])
    return out


def grams(chunk: textvec.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of a chunk, the text of each and the letters of each text. Runs of other characters count as one edge."""
    text = chunk.data.tobytes().decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    heads = (chunk.data & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(heads)])
    if len(points) != before[-1]:  # broken UTF-8: character places are counted text by text
        parts = [chunk.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(chunk.offsets[:-1], chunk.offsets[1:], strict=True)]
        points = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), np.uint32)
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    else:
        at = before[chunk.offsets]
    low = letters()[points]
    owner = np.repeat(np.arange(chunk.size, dtype=np.int64), np.diff(at))
    count = np.bincount(owner[low > 0], minlength=chunk.size)
    edge = low == 0
    keep = ~edge
    keep[:-1] |= edge[:-1] & ~edge[1:]
    keep[1:] |= ~edge[:-1] & edge[1:]
    low, owner = low[keep].astype(_U), owner[keep]
    values, owners = [], []
    for order in ORDERS:
        m = max(0, len(low) - order + 1)
        total = np.full(m, order, _U)
        inside = owner[:m] == owner[order - 1 :]
        for k in range(order):
            total = total * _U(0x9E3779B97F4A7C15) + low[k : k + m]
        if order == 1:
            inside = inside & (low > 0)
        values.append((textvec.mix(total[inside]) % _U(BUCKETS)).astype(np.int64))
        owners.append(owner[:m][inside])
    return np.concatenate(values), np.concatenate(owners), count


@textvec.handing_back
def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (lang, text): one row a label and bucket of the whole task."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        names = batch.column(0).to_pylist()
        for chunk in textvec.chunks(batch.column(1), CHUNK):
            value, owner, _ = grams(chunk)
            own = names[chunk.first : chunk.first + chunk.size]
            labels = sorted({*own})
            code = np.array([labels.index(x) for x in own], np.int64)
            part = np.bincount(code[owner] * BUCKETS + value, minlength=len(labels) * BUCKETS).reshape(-1, BUCKETS)
            for k, x in enumerate(labels):
                sums[x] = sums[x] + part[k] if x in sums else part[k]
    for x, total in sums.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at), pa.array(total[at].astype(np.int64))], ["lang", "bucket", "n"])


def train(rows: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Labels in order, their log priors and the log-probability matrix, from all rows (lang, text)."""
    found = rows.groupBy("lang").count().orderBy("lang").limit(MAX_LABELS + 1).collect()
    if len(found) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    labels, share = [r["lang"] for r in found], np.array([r["count"] for r in found], np.float64)
    prior = np.log(share / share.sum()) if labels else share
    counts = np.full((len(labels), BUCKETS), 0.5)
    sums = rows.mapInArrow(count_grams, "lang string, bucket bigint, n bigint").groupBy("bucket", "lang").agg(F.sum("n").alias("n"))
    place = {x: k for k, x in enumerate(labels)}
    for r in sums.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n")).toLocalIterator():  # at most BUCKETS entries a label
        counts[place[r.lang], r.b] += r.n
    return labels, prior, np.ascontiguousarray(np.log(counts / counts.sum(1, keepdims=True)).T.astype(np.float32))


@textvec.handing_back
def predict(batches: Iterator[pa.RecordBatch], model, place: int, schema: list[str]) -> Iterator[pa.RecordBatch]:
    """Each batch with two columns more; the text is the column at place."""
    labels, prior, matrix = model.value
    for batch in batches:
        picks, scores = [], []
        for chunk in textvec.chunks(batch.column(place), CHUNK):
            value, owner, count = grams(chunk)
            size = np.bincount(owner, minlength=chunk.size)
            total = np.stack([np.bincount(owner, matrix[value, k], chunk.size) for k in range(len(labels))], 1) + prior if labels else np.zeros((chunk.size, 0))
            scaled = total / np.sqrt(np.maximum(size, 1))[:, None]
            for i in range(chunk.size):
                if not labels or not count[i]:
                    picks.append("und")
                    scores.append(0.0)
                    continue
                best = int(np.argmax(total[i]))
                picks.append(labels[best])
                scores.append(float(1 / np.exp(scaled[i] - scaled[i, best]).sum()))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(picks, pa.string()), pa.array(scores, pa.float64())], schema)


def with_language(docs: DataFrame, labelled: DataFrame, lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Each row of docs (text and whatever else) with two columns more, learnt from labelled (lang, text); they take the place of columns of their names."""
    model = docs.sparkSession.sparkContext.broadcast(train(labelled.where("lang is not null and text is not null").select("lang", "text")))
    names = [c for c in docs.columns if c not in (lang_pred, score)]
    docs = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])  # names with dots can't be mapped
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    found = docs.mapInArrow(partial(predict, model=model, place=names.index("text"), schema=schema.names), schema)
    return found.toDF(*names, lang_pred, score)


def identify(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """doc_id, lang_pred, score of each row of docs (doc_id, text), learnt from labelled (lang, text)."""
    rows = with_language(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), labelled)
    return rows.select("doc_id", "lang_pred", "score")
