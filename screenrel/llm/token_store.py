"""Token ids in binary files, coded by an adaptive context-mixing range coder (id_coder).

File format. Documents in ascending doc_id are packed into frames of whole documents; a frame is one row of a Parquet
file (part, seq, n_ids, payload), so any store that Spark writes can hold it. A payload is

    header     "TIDS", version, documents, ids, blocks (little-endian unsigned 32-bit each after the magic)
    documents  1 or 0 for each, as it has a doc_id or not (a byte each), then doc_id (signed 64-bit), then ids (unsigned 32-bit)
    blocks     coded bytes of each (unsigned 32-bit)
    streams    the blocks, one after the other, each with the crc32 of its ids first

Every block has BLOCK ids (the last of a frame may have fewer), starts with fresh models and is checked when read.

Defined cases: a null text is empty and has only the end id; rows that repeat a doc_id are ordered by the hash of their
text; rows without doc_id come first and keep none; other columns are ignored; ids must be below 65,536. Empty tables give
no frames.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenrel.llm import id_coder, textvec
from screenrel.llm.piece_cache import PieceCache
from screenrel.llm.shared import written

MAGIC, VERSION = b"TIDS", 4
BLOCK = 1 << 22
#: Ids from which a frame ends: with the chunk that comes to it, it still is one block as a rule.
FRAME = BLOCK - (1 << 19)


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    blocks = [id_coder.encode(ids[k : k + BLOCK]) for k in range(0, len(ids), BLOCK)]
    head = MAGIC + struct.pack("<4I", VERSION, len(doc_ids), len(ids), len(blocks))
    known = np.array([x is not None for x in doc_ids], np.uint8)
    return b"".join([head, known.tobytes(), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), lengths.astype("<u4").tobytes(), np.array([*map(len, blocks)], "<u4").tobytes(), *blocks])


def unpack(payload: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a frame."""
    version, docs, n, blocks = struct.unpack_from("<4I", payload, 4)
    if payload[:4] != MAGIC or version != VERSION:
        raise ValueError("not a frame of token ids")
    at, parts = 20, []
    for kind, count in (("u1", docs), ("<i8", docs), ("<u4", docs), ("<u4", blocks)):
        parts.append(np.frombuffer(payload, kind, count, at))
        at += parts[-1].nbytes
    found = []
    for k, size in enumerate(parts[3].tolist()):
        found.append(id_coder.decode(payload[at : at + size], min(BLOCK, n - k * BLOCK)))
        at += size
    return pa.array(parts[1].astype(np.int64), mask=parts[0] == 0), parts[2].astype(np.int64), np.concatenate([*found, np.zeros(0, np.uint32)])


#: 1 for ASCII letters, 2 for ASCII marks at which a word can be cut: next to a letter they always begin or end a piece of their own.
KINDS = np.zeros(256, np.uint8)
KINDS[[*range(65, 91), *range(97, 123)]] = 1
KINDS[[*b'.,;:!?$%&#*()"/-']] = 2
WORD_SPACE = np.zeros(256, bool)
WORD_SPACE[[0x20, 0x09, 0x0A, 0x0D]] = True
_tokenizers: dict = {}


class WordTokenizer:
    """The tokenizers library's encoder, which sees each distinct word once: it drops white space, and words are independent.

    Words of ASCII and Latin-1 letters alone are each one piece, which lower case is all that the normaliser changes in. They are
    encoded many at a time without normaliser and pattern; a piece's last id is one that ends a word.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for tok in (self.whole, self.bare):
            tok.no_truncation()
            tok.no_padding()
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.whole.get_vocab_size() + 1, bool)
        self.ends[[k for token, k in self.whole.get_vocab().items() if token.endswith("</w>")]] = True
        self.lettered, self.other = PieceCache(), PieceCache()

    def one_by_one(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in self.whole.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        return np.array([x for ids in lists for x in ids], np.int32), np.array([len(ids) for ids in lists], np.int64)

    def together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, n = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for k in range(0, len(words), 256):
            some = words[k : k + 256]
            found = np.array(self.bare.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, np.int32)
            stops = np.flatnonzero(self.ends[found]) + 1
            if len(stops) != len(some) or stops[-1] != len(found):
                found, counts = self.one_by_one(some)
            else:
                counts = np.diff(stops, prepend=0)
            ids.append(found)
            n.append(counts)
        return np.concatenate(ids), np.concatenate(n)

    def chunk_ids(self, chunk: textvec.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk's texts, one after the other, and the number of each."""
        data = chunk.data
        kind, low = KINDS[data], textvec.FOLDED[data]
        pairs = np.flatnonzero(data[:-1] == 0xC3)
        pairs = pairs[(data[pairs + 1] != 0x97) & (data[pairs + 1] != 0xB7)]  # the two signs among these letters
        kind[pairs] = kind[pairs + 1] = 1
        low[pairs + 1] += np.where(data[pairs + 1] < 0x9F, 32, 0).astype(np.uint8)
        solid = ~WORD_SPACE[data]
        parted = np.zeros(len(data) + 1, bool)  # before these bytes a word ends if one is there
        parted[chunk.offsets] = True
        parted[1:-1] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        parted[:-1] |= ~solid
        parted[1:] |= ~solid
        starts, ends = np.flatnonzero(solid & parted[:-1]), np.flatnonzero(solid & parted[1:]) + 1
        strange = np.concatenate([[0], np.cumsum(kind != 1, dtype=np.int32)])
        plain = strange[ends] == strange[starts]
        n, flat = np.zeros(len(starts), np.int64), []
        for which, text, cache, encode in ((plain, low, self.lettered, self.together), (~plain, data, self.other, self.one_by_one)):
            a, b = starts[which], ends[which]
            raw = text.tobytes()
            slots = cache.slots_of(text, a, b, textvec.hash_ranges(text, a, b), lambda some: encode([raw[x:y] for x, y in zip(a[some].tolist(), b[some].tolist(), strict=True)]))  # noqa: B023
            found, n[which] = cache.ids_of(slots)
            flat.append(found)
        own = np.repeat(plain, n)
        ids = np.empty(len(own), np.int32)
        ids[own], ids[~own] = flat
        return ids, np.diff(np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, chunk.offsets)])


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def token_ids(column: pa.Array, path: str, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of some texts, with the end id after each, and ids of each text."""
    for chunk in textvec.chunks(column):
        ids, n = tokenizer(path).chunk_ids(chunk)
        yield np.insert(ids, np.cumsum(n), end), n + 1


FRAMES = "part bigint, seq bigint, n_ids bigint, payload binary"


def frames(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    part, seq = TaskContext.get().partitionId(), 0
    docs, sizes, ids, held = [], [], [], 0

    def flush():
        nonlocal docs, sizes, ids, held, seq
        flat, lengths = np.concatenate(ids), np.concatenate(sizes)
        batch = pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([len(flat)], pa.int64()), pa.array([pack(docs, lengths, flat)], pa.binary())], ["part", "seq", "n_ids", "payload"])
        docs, sizes, ids, held, seq = [], [], [], 0, seq + 1
        return batch

    for batch in batches:
        names, first = batch.column(0).to_pylist(), 0
        for flat, lengths in token_ids(batch.column(1), path, end):
            docs += names[first : first + len(lengths)]
            first += len(lengths)
            sizes.append(lengths)
            ids.append(flat)
            held += len(flat)
            if held >= FRAME:
                yield flush()
    if docs:
        yield flush()


def write_ids(docs: DataFrame, path: str, end: int = 1) -> DataFrame:
    """The frames of docs (doc_id, text), written in the shared folder in ascending doc_id order."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(parts, "doc_id")
    rows = rows.sortWithinPartitions("doc_id", F.xxhash64("text"))
    return written(rows.mapInArrow(partial(frames, path=path, end=end), FRAMES), "token-ids")


def read_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            docs, lengths, ids = unpack(payload.as_py())
            ends = np.cumsum(lengths)
            raw = memoryview(ids.tobytes())
            checks = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([docs, pa.array(base + ends - lengths), pa.array(lengths), pa.array(checks, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_ids(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the frames."""
    sizes = stored.select("part", "seq", "n_ids")
    totals = sizes.groupBy("part").agg(F.sum("n_ids").alias("all"))  # a row a partition of the writer
    totals = totals.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    inside = sizes.select("part", "seq", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("inside"))
    bases = inside.join(totals, "part").select("part", "seq", (F.col("inside") + F.col("before")).alias("base"))
    return stored.join(bases, ["part", "seq"]).select("base", "payload").mapInArrow(read_frames, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
