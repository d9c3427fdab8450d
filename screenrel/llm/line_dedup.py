"""Line dedup by winnowing over line hashes.

A gram is the shortest run of lines from a line on that has half of min_words words; a window is the shortest run from a line on, or up
to a line, that has min_words words. The least gram hash inside a window is its fingerprint. Equal windows have equal
fingerprints, so a run of min_words words or more that is repeated anywhere is guaranteed to hold a fingerprint that is found in both
places, though most grams are never selected. Positions of equal fingerprints are joined; a fingerprint with one position
drops out with its windows. The others are extended both ways, to all windows that they stand for on either side.

A run of min_words words or more is the union of the windows within it: those from its lines on leave fewer words at its end,
and the one up to its last line holds these. So a line is in a repeated run just if a window around it has an earlier position (by
doc_id, then text hash, then line) in whichever document; windows are equal by a 128-bit digest of their lines that
is no polynomial. Positions of a digest are ranked in salted groups, then the groups' firsts, so that one very common
passage is spread over tasks.

Defined cases: null and empty texts stay as they are; blank lines count as lines without words; copies of one document
lose all lines but in the first; rows equal in doc_id and text are one document, and are edited alike; a null doc_id is an id
of its own, before all others; runs of fewer than min_words words are never deleted by themselves, so a licence line of ten words
stays in every document; other columns pass through untouched, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenrel.llm import textvec
from screenrel.llm.shared import free, probable, written

MIN_WORDS = 50
WINDOW = pa.struct([("d1", pa.int64()), ("d2", pa.int64()), ("first", pa.int32()), ("stop", pa.int32())])
MARK = pa.struct([("print", pa.int64()), ("places", pa.int32()), ("windows", pa.list_(WINDOW))])
MARKS = "doc_id bigint, tag bigint, marks array<struct<print: bigint, places: int, windows: array<struct<d1: bigint, d2: bigint, first: int, stop: int>>>>"


def least_in(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Index of the least value (the first of equals) in each range, none of which is empty."""
    size = stops - starts
    bits = np.frexp(size.astype(float))[1] - 1  # the greatest power of two within each range
    out, level, step = starts.copy(), np.arange(len(values)), 1
    for k in range(int(bits.max(initial=-1)) + 1):
        here = np.flatnonzero(bits == k)
        a, b = level[starts[here]], level[stops[here] - step]
        out[here] = np.where(values[b] < values[a], b, a)
        if len(level) > step:
            a, b = level[:-step], level[step:]
            level = np.where(values[b] < values[a], b, a)
        step *= 2
    return out


def windows_of(words: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end line of the windows of some texts, whose lines start at `at`; ordered by first line."""
    total = np.concatenate([[0], np.cumsum(words)])
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    stop = np.searchsorted(total, total[:-1] + least, "left")  # end line of each window
    first = np.flatnonzero(stop <= at[text + 1])
    begin = np.searchsorted(total, total[1:] - least, "right") - 1  # first line of the window up to each line
    last = np.flatnonzero(begin >= at[text])
    last = last[stop[begin[last]] != last + 1]  # others are windows from their first line on as well
    first, stop = np.concatenate([first, begin[last]]), np.concatenate([stop[first], last + 1])
    order = np.argsort(first, kind="stable")
    return first[order], stop[order]


def fingerprints(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, tag, text) to one row a text: its fingerprints, the number of their places in it, and the windows of each."""
    for batch in batches:
        for chunk in textvec.chunks(batch.column(2)):
            data, offsets = chunk.data, chunk.offsets
            breaks = np.flatnonzero(data == 0x0A)
            full = np.diff(offsets) > 0
            starts = np.sort(np.concatenate([breaks + 1, offsets[:-1][full]]))
            ends = np.sort(np.concatenate([breaks, offsets[1:][full]]))
            # one line a text that isn't empty, and one more for each break in it
            at = np.concatenate([[0], np.cumsum(np.diff(np.searchsorted(breaks, offsets)) + full)])
            lines = [chunk.hashes(starts, ends, textvec.EXACT, seed) for seed in (0, 1)]
            heads, _ = chunk.runs(~textvec.SPACES[data])
            words = np.searchsorted(heads, ends) - np.searchsorted(heads, starts)
            first, stop = windows_of(words, at, least)
            total = np.concatenate([[0], np.cumsum(words)])
            gram = np.searchsorted(total, total[:-1] + max(1, least // 2), "left")  # end line of each line's gram
            inside = np.searchsorted(gram, stop, "right")  # the grams of a window are those from its first line up to here
            hashes = textvec.hash_runs(lines[0], np.arange(len(gram)), np.minimum(gram, len(gram)))
            place = least_in(hashes, first, inside)
            digests = [textvec.hash_runs(x, first, stop) for x in lines]
            owner = np.searchsorted(at, first, "right") - 1
            order = np.lexsort((place, hashes[place], owner))
            owner, place, first, stop = owner[order], place[order], first[order], stop[order]
            value = hashes[place]
            fresh = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])])) if len(order) else order
            moved = np.concatenate([[0], np.cumsum(np.concatenate([[1], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])]))]) if len(order) else np.zeros(1, np.int64)
            cut = np.concatenate([fresh, [len(order)]])
            base = at[owner]
            windows = pa.StructArray.from_arrays([pa.array(digests[0][order].view(np.int64)), pa.array(digests[1][order].view(np.int64)), pa.array((first - base).astype(np.int32)), pa.array((stop - base).astype(np.int32))], fields=list(WINDOW))
            marks = pa.StructArray.from_arrays([pa.array(value[fresh].view(np.int64)), pa.array(np.diff(moved[cut]).astype(np.int32)), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), windows)], fields=list(MARK))
            rows = batch.slice(chunk.first, chunk.size)
            per_text = np.searchsorted(owner[fresh], np.arange(chunk.size + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), rows.column(1), pa.ListArray.from_arrays(pa.array(per_text), marks)], ["doc_id", "tag", "marks"])


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tag, windows of a text in any order) to the same with windows that overlap or touch made into one run, in order."""
    kind = pa.struct([("first", pa.int64()), ("stop", pa.int64())])
    for batch in batches:
        sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
        first, stop = (x.to_numpy(zero_copy_only=False) for x in batch.column(2).flatten().flatten())
        base = np.repeat(np.arange(len(sizes)), sizes) * (int(stop.max(initial=0)) + 1)  # so that texts lie apart
        order = np.argsort(first + base, kind="stable")
        reach = np.maximum.accumulate((stop + base)[order])
        heads = np.flatnonzero(np.concatenate([[True], (first + base)[order][1:] > reach[:-1]]) | (base[order] != np.concatenate([[-1], base[order][:-1]]))) if len(first) else np.zeros(0, np.int64)
        tails = np.concatenate([heads[1:], [len(first)]])[: len(heads)] - 1
        runs = pa.StructArray.from_arrays([pa.array(first[order][heads]), pa.array(reach[tails] - base[order][tails])], fields=list(kind))
        cut = np.searchsorted(heads, np.concatenate([[0], np.cumsum(sizes)])).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(cut), runs)], ["doc_id", "tag", "runs"])


def deleted_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, tag, runs: the line ranges (first, stop) that repeat an earlier run; tag is xxhash64 of the text."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tag"), "text").where("text is not null and text <> ''")
    marks = written(rows.mapInArrow(partial(fingerprints, least=min_words), MARKS), "lines")
    marks = marks.select("doc_id", "tag", F.explode("marks").alias("m")).select("doc_id", "tag", "m.*")
    repeated = marks.groupBy("print").agg(F.sum("places").alias("n")).where("n > 1").select("print")
    places = probable(marks, "print", written(repeated, "prints")).select("doc_id", "tag", F.explode("windows").alias("w")).select("doc_id", "tag", "w.*")
    places = places.withColumn("salt", F.pmod(F.xxhash64("doc_id", "tag"), F.lit(max(16, parts // 2))))
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "tag", "first")]
    ranked = places.withColumn("k", F.rank().over(Window.partitionBy("d1", "d2", "salt").orderBy(*order)))
    ranked = written(ranked, "windows")
    firsts = ranked.where("k = 1").drop("k").withColumn("k", F.rank().over(Window.partitionBy("d1", "d2").orderBy(*order)))
    later = ranked.where("k > 1").select("doc_id", "tag", "first", "stop").union(firsts.where("k > 1").select("doc_id", "tag", "first", "stop"))
    later = later.groupBy("doc_id", "tag").agg(F.collect_list(F.struct(F.col("first").cast("bigint").alias("first"), F.col("stop").cast("bigint").alias("stop"))).alias("runs"))
    return later.mapInArrow(united, "doc_id bigint, tag bigint, runs array<struct<first: bigint, stop: bigint>>")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, n_lines: str = "_n_lines", removed: str = "_removed") -> DataFrame:
    """docs with text without its later repeated runs, and two columns more: the number of lines, and the numbers of the deleted ones (from 0).

    Where docs has a column of such a name, the new one gets underscores before its name until it is free.
    """
    n_lines = free(n_lines, docs.columns)
    removed = free(removed, [*docs.columns, n_lines])
    rows = docs.select(F.struct("*").alias("row")).withColumn("doc", F.col("row.doc_id").cast("bigint")).withColumn("tag", F.xxhash64("row.text"))
    found = deleted_runs(docs, min_words).select(F.col("doc_id").alias("doc_"), F.col("tag").alias("tag_"), "runs")
    joined = rows.join(found, F.col("doc").eqNullSafe(F.col("doc_")) & (F.col("tag") == F.col("tag_")), "left")
    numbers = "case when runs is null then cast(array() as array<int>) else filter(sequence(0, size(split(row.text, '\\n', -1)) - 1), i -> exists(runs, r -> i >= r.first and i < r.stop)) end"
    kept = "case when runs is null then row.text else array_join(filter(split(row.text, '\\n', -1), (x, i) -> not exists(runs, r -> i >= r.first and i < r.stop)), '\\n') end"
    size = "case when row.text is null or row.text = '' then 0 else length(row.text) - length(replace(row.text, '\\n', '')) + 1 end"
    columns = [F.expr(kept).alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    return joined.select(*columns, F.expr(size).alias(n_lines), F.expr(numbers).alias(removed))
