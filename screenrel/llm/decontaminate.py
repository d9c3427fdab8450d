"""Benchmark decontamination by an FM-index per training shard.

A shard is one Arrow batch of documents. Its words are mapped to the vocabulary of the test phrases; words outside it
cannot be part of an occurrence, so they only separate runs. Over the runs the shard builds a suffix array, its
Burrows-Wheeler transform and a wavelet tree; test phrases are searched backwards through wavelet ranks, occurrences are
located by walking to sampled suffix positions, and overlapping spans are merged.

The test phrases reach the tasks in broadcast blocks of at most BLOCK_BYTES of text each (a larger item is a block of
its own). At most ROUND blocks are broadcast at a time: a larger benchmark is searched for in rounds, whose spans
are written, their blocks destroyed, and all spans of a document merged at the end. Words equal by hash are compared by bytes.

Defined cases: null, empty and word-free texts have no words and are clean; items without words and rows without item_id
match nothing; items that repeat an item_id are one item; rows that repeat are judged alike; other columns are ignored.
Empty tables give no rows, or clean documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenrel.llm import textvec
from screenrel.llm.shared import written

WINDOW = 10
BLOCK_BYTES = 16 << 20
ROUND = 8
SAMPLE = 16
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class WaveletTree:
    """Ranks over a sequence of small integers; one bit vector a level, stored level by level."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before the position."""
        first = np.zeros_like(at)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbols >> (self.bits - 1 - level)) & 1 == 1
            at = np.where(bit, zeros + ones[at], at - ones[at])
            first = np.where(bit, zeros + ones[first], first - ones[first])
        return at - first

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[at + 1] - ones[at]
            out = out * 2 + bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return out


class ShardIndex:
    """FM-index over symbols >= 1, with 0 between runs. Separators compare by position, so no occurrence crosses one."""

    def __init__(self, symbols: np.ndarray):
        self.size = n = len(symbols)
        gaps = symbols == 0
        rank = np.where(gaps, np.cumsum(gaps) - 1, symbols + int(gaps.sum()))
        step = 1
        while True:
            further = np.zeros(n, np.int64)
            further[:-step or None] = rank[step:] + 1 if step < n else 0
            order = np.lexsort((further, rank))
            a, b = rank[order], further[order]
            fresh = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))]) if n else np.zeros(0, np.int64)
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            if not n or fresh[-1] == n - 1 or step >= n:
                break
            step *= 2
        previous = np.where(order > 0, symbols[order - 1], 0) if n else order
        self.tree = WaveletTree(previous, max(1, int(symbols.max(initial=0)).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1))])
        # every SAMPLE-th position is kept, and the start of each run, so that walks stay inside runs
        self.sampled = (order % SAMPLE == 0) | (previous == 0)
        self.place = np.where(self.sampled, order, -1)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that start with each phrase (right-aligned symbols)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for k in range(phrases.shape[1]):
            live = np.flatnonzero((k < lengths) & (low < high))
            symbols = phrases[live, phrases.shape[1] - 1 - k]
            known = symbols < len(self.before) - 1
            start = self.before[np.where(known, symbols, 0)]
            symbols = np.where(known, symbols, 0)
            low[live], high[live] = (np.where(known, start + self.tree.rank(symbols, x[live]), 0) for x in (low, high))
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        while len(live := np.flatnonzero(~self.sampled[rows])):
            symbols = self.tree.symbol(rows[live])
            rows[live] = self.before[symbols] + self.tree.rank(symbols, rows[live])
            steps[live] += 1
        return self.place[rows] + steps


def item_words(texts: list[str]) -> tuple[list[np.ndarray], dict]:
    """Words of each text as symbols from 1 on, and the vocabulary: sorted hashes with the bytes of the word that has each."""
    data = textvec.FOLDED[np.frombuffer("".join(texts).encode(), np.uint8)]
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    starts, ends = textvec.Chunk(0, data, offsets).runs(WORD[data])
    seed, padded = 0, np.concatenate([data, np.zeros(8, np.uint8)])
    while True:
        hashes, first, symbol = np.unique(textvec.hash_ranges(data, starts, ends, seed), return_index=True, return_inverse=True)
        alike = ends - starts == (ends - starts)[first][symbol]
        if alike.all() and textvec.same_bytes(data, starts, ends - starts, padded, starts[first][symbol]).all():
            break
        seed += 1  # two words of the benchmark shared a hash
    words = np.split(symbol.astype(np.int64) + 1, np.searchsorted(starts, offsets[1:-1]))[: len(texts)]
    return words, {"seed": seed, "vocabulary": hashes, "bytes": padded, "starts": starts[first], "sizes": (ends - starts)[first]}


def phrase_block(items: list[tuple[str, str]]) -> dict:
    """Vocabulary and distinct windows of some items, with the items that have each window."""
    words, block = item_words([text for _, text in items])
    windows: dict[bytes, set[str]] = {}
    for (item, _), symbols in zip(items, words, strict=True):
        for i in range(max(1, len(symbols) - WINDOW + 1) if len(symbols) else 0):
            windows.setdefault(symbols[i : i + WINDOW].tobytes(), set()).add(item)
    lengths = np.array([len(k) // 8 for k in windows], np.int64)
    phrases = np.zeros((len(windows), WINDOW), np.int64)
    for i, k in enumerate(windows):
        phrases[i, WINDOW - lengths[i] :] = np.frombuffer(k, np.int64)
    coarse = np.zeros(1 << 16, bool)
    coarse[(block["vocabulary"] & np.uint64(0xFFFF)).astype(np.int64)] = True
    return block | {"coarse": coarse, "phrases": phrases, "lengths": lengths, "items": [sorted(x) for x in windows.values()]}


def shard_spans(column: pa.Array, block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n_words of each row; row, first word, end word and window of each occurrence."""
    vocabulary, least = block["vocabulary"], int(block["lengths"].min(initial=WINDOW))
    counts, symbols, owners, places = [], [], [], []
    for chunk in textvec.chunks(column):
        starts, ends = chunk.runs(WORD[chunk.data])
        data = textvec.FOLDED[chunk.data]
        words = textvec.hash_ranges(data, starts, ends, block["seed"])
        at = np.searchsorted(starts, chunk.offsets)
        counts.append(np.diff(at))
        maybe = np.flatnonzero(block["coarse"][(words & np.uint64(0xFFFF)).astype(np.int64)])
        found = np.searchsorted(vocabulary, words[maybe])
        hit = vocabulary[np.minimum(found, max(0, len(vocabulary) - 1))] == words[maybe] if len(vocabulary) else np.zeros(0, bool)
        inside, known = maybe[hit], found[hit]
        size = (ends - starts)[inside]
        same = size == block["sizes"][known]
        same[same] = textvec.same_bytes(data, starts[inside[same]], size[same], block["bytes"], block["starts"][known[same]])
        inside, symbol = inside[same], known[same] + 1
        owner = np.searchsorted(at, inside, "right") - 1
        new = np.concatenate([[True], (np.diff(inside) != 1) | (np.diff(owner) != 0)]) if len(inside) else np.zeros(0, bool)
        cut = np.flatnonzero(new)
        length = np.diff(np.concatenate([cut, [len(inside)]]))
        keep = np.repeat(length >= least, length)  # a shorter run holds no window
        inside, symbol, owner, new = inside[keep], symbol[keep], owner[keep], new[keep]
        slot = np.arange(len(inside)) + np.cumsum(new)  # a separator before each run
        total = len(inside) + int(new.sum())
        for out, values in ((symbols, symbol), (owners, owner + chunk.first), (places, inside - at[owner])):
            spread = np.zeros(total, np.int64)
            spread[slot] = values
            out.append(spread)
    flat, owner, place = (np.concatenate([*x, np.zeros(1, np.int64)]) for x in (symbols, owners, places))
    n_words = np.concatenate([*counts, np.zeros(0, np.int64)])
    if not len(block["lengths"]) or len(flat) == 1:
        return (n_words, *(np.zeros(0, np.int64),) * 4)
    index = ShardIndex(flat)
    low, high = index.search(block["phrases"], block["lengths"])
    size = np.maximum(high - low, 0)
    window = np.repeat(np.arange(len(size)), size)
    rows = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
    at = index.locate(rows)
    return n_words, owner[at], place[at], place[at] + block["lengths"][window], window


RESULT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, hit_spans string"
NAMES = [c.split()[0] for c in RESULT.split(", ")]


def merged_spans(spans: np.ndarray) -> np.ndarray:
    """Rows (row, first, end) with overlapping and touching spans of a row made one, in order."""
    row, first, end = spans[:, np.lexsort((spans[1], spans[0]))]
    reach = np.maximum.accumulate(end + row * (1 << 40)) if len(row) else end
    fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (first[1:] + row[1:] * (1 << 40) > reach[:-1])]) if len(row) else np.zeros(0, bool)
    cut = np.flatnonzero(fresh)
    last = np.concatenate([cut[1:], [len(row)]]) - 1 if len(row) else cut
    return np.stack([row[cut], first[cut], reach[last] - row[last] * (1 << 40)])


def columns(n_words: np.ndarray, spans: np.ndarray, items: dict[int, set[str]]) -> list[pa.Array]:
    """The result's columns from n_words on."""
    n = len(n_words)
    row, first, end = merged_spans(spans)
    n_hit = np.bincount(row, end - first, n).astype(np.int64)
    at = np.searchsorted(row, np.arange(n + 1))
    texts = [",".join(f"{a}:{b}" for a, b in zip(first[i:j].tolist(), end[i:j].tolist(), strict=True)) for i, j in zip(at[:-1], at[1:], strict=True)]
    names = [sorted(items.get(i, ())) for i in range(n)]
    digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
    return [pa.array(n_words, pa.int64()), pa.array(n_hit), pa.array([len(x) for x in names], pa.int64()), pa.array(digest, pa.string()), pa.array(n_hit > 0), pa.array(texts, pa.string())]


def searched(column: pa.Array, blocks: list) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]]]:
    """n_words of each row of a shard, its spans and the items of each row."""
    items: dict[int, set[str]] = {}
    found = []
    for block in blocks:
        n_words, row, first, end, window = shard_spans(column, block.value)
        found.append(np.stack([row, first, end]))
        for r, w in {*zip(row.tolist(), window.tolist(), strict=True)}:
            items.setdefault(r, set()).update(block.value["items"][w])
    return n_words, np.concatenate(found, axis=1), items


def scan(batches: Iterator[pa.RecordBatch], blocks: list) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns(*searched(batch.column(batch.num_columns - 1), blocks))], [*batch.schema.names[:-1], *NAMES])


def scan_round(batches: Iterator[pa.RecordBatch], blocks: list) -> Iterator[pa.RecordBatch]:
    """Of (doc_id, tag, text): the texts that are hit, with their merged spans as flat pairs and their items."""
    for batch in batches:
        _, spans, items = searched(batch.column(2), blocks)
        row, first, end = merged_spans(spans)
        own, at = np.unique(row, return_index=True)
        flat = [x.ravel() for x in np.split(np.stack([first, end], 1), at[1:])] if len(own) else []
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)), pa.array(flat, pa.list_(pa.int64())), pa.array([sorted(items[r]) for r in own.tolist()], pa.list_(pa.string()))], ["doc_id", "tag", "spans", "items"])


def merge_rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tag, text, spans of all rounds, items of all rounds) to the result."""
    for batch in batches:
        n_words = np.concatenate([*(np.bincount(np.searchsorted(c.offsets, c.runs(WORD[c.data])[0], "right") - 1, minlength=c.size) for c in textvec.chunks(batch.column(2))), np.zeros(0, np.int64)])
        spans, items = [np.zeros((0, 3), np.int64)], {}
        for r, (pairs, names) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
            flat = np.array([x for some in pairs or () for x in some], np.int64).reshape(-1, 2)
            spans.append(np.concatenate([np.full((len(flat), 1), r), flat], 1))
            items[r] = {x for some in names or () for x in some}
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns(n_words.astype(np.int64), np.concatenate(spans).T, items)], ["doc_id", "tag", *NAMES])


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, tagged: bool = False) -> DataFrame:
    """For each row of docs (doc_id, text): its words inside occurrences of windows of benchmark (item_id, text); hit_spans are merged word spans start:end. With tagged, xxhash64 of the text follows doc_id as tag."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tag"), "text")
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    blocks, rounds, some, size = [], [], [], 0
    for item in items.toLocalIterator():  # the driver holds one block's items at a time
        if some and size + len(item.text) > block_bytes:
            blocks.append(context.broadcast(phrase_block(some)))
            some, size = [], 0
            if len(blocks) == ROUND:
                rounds.append(written(rows.mapInArrow(partial(scan_round, blocks=blocks), "doc_id bigint, tag bigint, spans array<bigint>, items array<string>"), "hits"))
                for block in blocks:
                    block.destroy()
                blocks = []
        some.append((item.item_id, item.text))
        size += len(item.text)
    blocks.append(context.broadcast(phrase_block(some)))
    head = "doc_id bigint, tag bigint, "
    if not rounds:
        rows = rows if tagged else rows.drop("tag")
        return rows.mapInArrow(partial(scan, blocks=blocks), (head if tagged else "doc_id bigint, ") + RESULT)
    hits = rows.mapInArrow(partial(scan_round, blocks=blocks), "doc_id bigint, tag bigint, spans array<bigint>, items array<string>")
    for more in rounds:
        hits = hits.union(more)
    # rows equal in doc_id and text have equal hits, so that repeats add nothing
    hits = hits.groupBy(F.col("doc_id").alias("doc_"), F.col("tag").alias("tag_")).agg(F.collect_set("spans").alias("spans"), F.collect_set("items").alias("items"))
    both = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("doc_")) & (F.col("tag") == F.col("tag_")), "left").select("doc_id", "tag", "text", "spans", "items")
    found = both.mapInArrow(merge_rounds, head + RESULT)
    return found if tagged else found.drop("tag")
