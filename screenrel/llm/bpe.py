"""BPE encoding and decoding of whole texts by a pair occurrence index.

Texts are cut into pieces by the byte-level pattern (vectorised over code points), and each distinct piece is merged
once per worker. The merger maps each adjacent symbol pair that has a rank to all its positions over all new pieces,
takes the active ranks in ascending order from a heap, merges every position of a rank from left to right, and adds the
pairs that this makes to the lists of their own ranks. Pieces share no pair, so this equals merging each piece alone.

Defined cases: null is the empty text, with no ids; the strings of added tokens in a text are those tokens; repeated rows
are encoded alike; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from screenrel.llm import textvec
from screenrel.llm.piece_cache import PieceCache, spread

SPACE, LETTER, NUMBER, OTHER = 3, 1, 2, 0
#: The endings that the byte-level pattern cuts after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Unicode white space.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@cache
def classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for k in range(0x110000):
        kind = unicodedata.category(chr(k))[0]
        out[k] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    out[list(WHITE)] = SPACE
    return out


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        letters = byte_letters()
        model, added = spec["model"], spec.get("added_tokens", [])
        size = max([*model["vocab"].values(), *(t["id"] for t in added)]) + 1
        self.special = {t["content"].encode(): t["id"] for t in added}
        texts = [b""] * size
        for token, k in model["vocab"].items():
            texts[k] = token.encode() if any(c not in letters for c in token) else bytes(letters[c] for c in token)
        for text, k in self.special.items():
            texts[k] = text
        self.single = {letters[t]: k for t, k in model["vocab"].items() if len(t) == 1 and t in letters}
        self.ranks, self.merges = {}, []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b, new = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            self.ranks.setdefault(a << 32 | b, rank)
            self.merges.append((a, b, new))
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)

    def merged(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece, by the pair occurrence index over all of them."""
        ranks, merges, single = self.ranks, self.merges, self.single
        symbol: list[int] = []
        bounds = [0]
        for piece in pieces:
            symbol += [self.special[piece]] if piece in self.special else [single[b] for b in piece]
            bounds.append(len(symbol))
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            if e > s:
                before[s], after[e - 1] = -1, -1
        places: dict[int, list[int]] = {}
        for p in range(n):
            q = after[p]
            if q >= 0 and (r := ranks.get(symbol[p] << 32 | symbol[q])) is not None:
                places.setdefault(r, []).append(p)
        active = list(places)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            a, b, new = merges[rank]
            found = places.pop(rank)
            found.sort()
            for p in found:
                q = after[p]
                if symbol[p] != a or q < 0 or symbol[q] != b:
                    continue
                symbol[p], symbol[q] = new, -1
                after[p] = c = after[q]
                if c >= 0:
                    before[c] = p
                    if (r := ranks.get(new << 32 | symbol[c])) is not None:
                        if r not in places:
                            places[r] = []
                            heapq.heappush(active, r)
                        places[r].append(p)
                c = before[p]
                if c >= 0 and (r := ranks.get(symbol[c] << 32 | new)) is not None:
                    if r not in places:
                        places[r] = []
                        heapq.heappush(active, r)
                    places[r].append(c)
        return [[x for x in symbol[s:e] if x >= 0] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]


_tools: dict[str, tuple[Vocabulary, PieceCache]] = {}


def tools(path: str) -> tuple[Vocabulary, PieceCache]:
    if path not in _tools:
        _tools[path] = (Vocabulary(path), PieceCache(digits=True))
    return _tools[path]


def pieces(chunk: textvec.Chunk, special: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where pieces start, in order with the end of data; and the number of pieces before each text."""
    data = chunk.data
    raw = data.tobytes()
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(points)
    byte_at = np.concatenate([np.flatnonzero((data & 0xC0) != 0x80), [len(data)]])
    cuts, fixed = list(chunk.offsets[:-1][chunk.offsets[:-1] < len(data)]), []
    for token in special:
        at = raw.find(token)
        while at >= 0:
            k = int(np.searchsorted(chunk.offsets, at, "right"))
            if at + len(token) <= chunk.offsets[k]:
                fixed.append((at, at + len(token)))
                at += len(token) - 1
            at = raw.find(token, at + 1)
    cuts += [x for pair in fixed for x in pair if x < len(data)]
    edge = np.zeros(n + 1, bool)
    edge[n] = True
    edge[np.searchsorted(byte_at, np.array(cuts, np.int64))] = True
    kind = classes()[points]
    change = np.ones(n, bool)
    change[1:] = (kind[1:] != kind[:-1]) | edge[1:n]
    s = np.flatnonzero(change)
    e = np.concatenate([s[1:], [n]]) if n else s
    k = kind[s]
    start = np.zeros(n + 1, bool)
    start[s] = True
    # white space before other text leaves its last character to itself, or to the next piece if it is U+0020
    gap = (k == SPACE) & ~edge[e]
    start[e[gap] - 1] = True
    taken = gap & (points[e - 1] == 0x20) if n else gap
    start[e[taken]] = False
    lone = np.flatnonzero((k[:-1] == OTHER) & (k[1:] == LETTER) & (points[s[:-1]] == 0x27) & (e[:-1] - s[:-1] == 1) & ~edge[e[:-1]] & start[s[:-1]]) if len(s) else s
    if len(lone):
        a, stop = s[lone + 1], e[lone + 1]
        c, d = points[a], np.where(a + 1 < stop, points[np.minimum(a + 1, n - 1)], 0)
        length = np.zeros(len(a), np.int64)
        for ending in reversed(ENDINGS):
            fits = (c == ord(ending[0])) & ((d == ord(ending[1])) if len(ending) == 2 else True)
            length[fits] = len(ending)
        a, stop, length = a[length > 0], stop[length > 0], length[length > 0]
        start[a] = False
        start[a + length] = True  # the end of the run of letters starts a piece anyway
        _ = stop
    starts = byte_at[np.flatnonzero(start[:n])]
    if fixed:
        inside = np.zeros(len(data) + 1, bool)
        for a, b in fixed:
            inside[a + 1 : b] = True
        starts = starts[~inside[starts]]
    return np.concatenate([starts, [len(data)]]), np.searchsorted(starts, chunk.offsets)


#: Bytes of text at a time.
CHUNK = 1 << 18
RESULT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encoded_chunks(column: pa.Array, path: str) -> Iterator[tuple[textvec.Chunk, PieceCache, np.ndarray, np.ndarray]]:
    """For each chunk: known pieces, the slot of each of its pieces, and the number of pieces before each text."""
    vocabulary, known = tools(path)
    for chunk in textvec.chunks(column, CHUNK):
        at, before = pieces(chunk, vocabulary.special)
        raw = chunk.data.tobytes()
        hashes = chunk.hashes(at[:-1], at[1:], textvec.EXACT)

        def encode(some):
            lists = vocabulary.merged([raw[at[i] : at[i + 1]] for i in some.tolist()])  # noqa: B023
            return np.array([x for ids in lists for x in ids], np.int32), np.array([len(ids) for ids in lists], np.int64)

        yield chunk, known, known.slots_of(chunk.data, at[:-1], at[1:], hashes, encode), before


@textvec.handing_back
def digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    vocabulary, _ = tools(path)
    for batch in batches:
        counts, ids_sha, text_sha = [], [], []
        for chunk, known, slots, before in encoded_chunks(batch.column(1), path):
            (ids, n), (digits, d) = known.ids_of(slots), known.digits_of(slots)
            digits = digits.tobytes()
            at = np.concatenate([[0], np.cumsum(n)])[before]
            digit_at = np.concatenate([[0], np.cumsum(d)])[before]
            size = vocabulary.lengths[ids]
            decoded = vocabulary.bytes[spread(vocabulary.starts[ids], size)].tobytes()
            text_at = np.concatenate([[0], np.cumsum(size)])[at]
            counts += np.diff(at).tolist()
            for i in range(chunk.size):
                ids_sha.append(hashlib.sha256(digits[digit_at[i] : max(digit_at[i], digit_at[i + 1] - 1)]).hexdigest())
                text_sha.append(hashlib.sha256(decoded[text_at[i] : text_at[i + 1]].decode("utf-8", "replace").encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


@textvec.handing_back
def encode_ids(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, ids)."""
    for batch in batches:
        for chunk, known, slots, before in encoded_chunks(batch.column(1), path):
            ids, n = known.ids_of(slots)
            at = np.concatenate([[0], np.cumsum(n)])[before].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.size).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(ids))], ["doc_id", "ids"])


@textvec.handing_back
def decode_ids(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids) to (doc_id, text)."""
    vocabulary, _ = tools(path)
    for batch in batches:
        texts = []
        for ids in batch.column(1).to_pylist():
            ids = np.array(ids or [], np.int64)
            texts.append(vocabulary.bytes[spread(vocabulary.starts[ids], vocabulary.lengths[ids])].tobytes().decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(partial(encode_ids, path=path), "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    return encoded.select("doc_id", "ids").mapInArrow(partial(decode_ids, path=path), "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of docs (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(partial(digest, path=path), RESULT)
