"""Vectorised text primitives over Arrow string columns: words, hashes and prefix sums, in bounded chunks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 1 << 20
LONG = 64
_U = np.uint64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


@cache
def trim() -> Callable[[int], int]:
    """The C library's malloc_trim, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def handing_back(task: Callable) -> Callable:
    """A function over a task's batches that gives free memory back at the end: workers are kept, and later tasks of other queries need it."""

    @wraps(task)
    def run(*args, **kwargs):
        try:
            yield from task(*args, **kwargs)
        finally:
            pa.default_memory_pool().release_unused()
            trim()(0)

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


#: What each byte counts as in hashes: itself, or with A-Z as a-z.
EXACT = np.arange(256, dtype=np.uint8)
FOLDED = EXACT + np.where((EXACT >= 65) & (EXACT < 91), 32, 0).astype(np.uint8)


def words_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on (zeros after the end) as one little-endian integer, without a copy for each."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded.data, 0, (1,))


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range. Eight bytes at a time go through a full mix, so it is no polynomial, and ranges of equal
    length up to eight bytes never collide; ranges of more than LONG bytes go through xxh3."""
    size = ends - starts
    eight = words_of(data)
    out = mix(mix(size.astype(_U) + _U(0xD6E8FEB86659FD93 + seed)) ^ (eight[starts] & _MASKS[np.minimum(size, 8)]))
    live, done = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(live):
        left = size[live] - done
        out[live] = mix(out[live] ^ (eight[starts[live] + done] & _MASKS[np.minimum(left, 8)]))
        live, done = live[left > 8], done + 8
    if len(live := np.flatnonzero(size > LONG)):
        raw = memoryview(np.ascontiguousarray(data))
        out[live] = [xxhash.xxh3_64_intdigest(raw[a:b], seed) for a, b in zip(starts[live].tolist(), ends[live].tolist(), strict=True)]
    return out


def same_bytes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, other: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Whether each byte range of data equals the one of the same size in other, of which eight bytes more than the last range can be read."""
    out = np.ones(len(starts), bool)
    mine, theirs = words_of(data), np.ndarray(max(0, len(other) - 7), "<u8", other.data, 0, (1,))
    long = sizes > LONG
    for i in np.flatnonzero(long).tolist():
        out[i] = np.array_equal(data[starts[i] : starts[i] + sizes[i]], other[there[i] : there[i] + sizes[i]])
    live, done = np.flatnonzero(~long & (sizes > 0)), 0
    while len(live):
        mask = _MASKS[np.minimum(sizes[live] - done, 8)]
        out[live] &= ((mine[starts[live] + done] ^ theirs[there[live] + done]) & mask) == 0
        live, done = live[sizes[live] > done + 8], done + 8
    return out


def hash_runs(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of 64-bit values: runs are cut into lengths of powers of two, whose hashes are made by doubling."""
    size = stops - starts
    out, at = mix(size.astype(_U) + _U(0xA0761D6478BD642F)), starts.copy()
    level, step, most = values, 1, int(size.max(initial=0))
    while step <= most:
        live = np.flatnonzero(size & step)
        out[live] = mix(out[live] * _U(0x9E3779B97F4A7C15) ^ level[at[live]])
        at[live] += step
        level = mix(level[:-step] * _U(0x9E3779B97F4A7C15) ^ level[step:]) if len(level) > step else level[:0]
        step *= 2
    return out


class Chunk:
    """Some whole texts, concatenated: data holds the bytes, offsets where each text starts; rows are row numbers in the batch."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets

    @property
    def size(self) -> int:
        return len(self.offsets) - 1

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs where inside holds; runs never cross texts."""
        n = len(inside)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends

    def hashes(self, starts: np.ndarray, ends: np.ndarray, table: np.ndarray, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each byte range, equal for equal bytes under the table."""
        return hash_ranges(self.data if table is EXACT else table[self.data], starts, ends, seed)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and 64-bit offsets of a string or binary column; nulls count as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if len(column) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Consecutive groups of whole texts of about limit bytes; a longer text is a group of its own."""
    raw, offsets = buffers(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(rows, max(last, first + 1))
        yield Chunk(first, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def shingles(chunk: Chunk, width: int, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words with their hashes: first word and number of words of each run of `width` words (all words, if a text has fewer), and the hash of the run."""
    at = np.searchsorted(starts, chunk.offsets)  # first word of each text
    n, size = len(words), np.diff(at)
    stop = np.repeat(at[1:], size)
    index = np.arange(n)
    total = np.zeros(n, _U)
    for k in range(width):
        shifted = np.full(n, 0x632BE59BD9B4E019, _U)
        shifted[: max(0, n - k)] = words[k:]
        shifted[index + k >= stop] = 0x632BE59BD9B4E019
        total = (total ^ shifted) * _U(0x9E3779B97F4A7C15)
        total ^= total >> _U(32)
    keep = index + width <= stop
    keep[at[:-1][(size > 0) & (size < width)]] = True
    picked = np.flatnonzero(keep)
    return np.stack([picked, np.minimum(width, stop[picked] - picked)]), mix(total[picked])


def shingle_sets(chunk: Chunk, width: int) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its shingles; words are cut at ASCII space, with A-Z as a-z."""
    starts, ends = chunk.runs(~SPACES[chunk.data])
    runs, values = shingles(chunk, width, chunk.hashes(starts, ends, FOLDED), starts)
    cut = np.searchsorted(starts[runs[0]], chunk.offsets)
    return [np.unique(values[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
