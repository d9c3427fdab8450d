"""N-gram Jaccard join: a count-vector R-tree over the documents' shingle sets.

Method. Each distinct shingle set is a point: its hashes are dealt into groups, one for two hashes or more (a power of two, GROUPS at
least), and the group counts, of four bits each, are the coordinates. Trees have GROUPS coordinates, to which the others fold by
addition. The overlap of two sets is at most the sum of the coordinate minima, so a tree node whose box bounds that sum below the
overlap that the threshold asks for is pruned, and so is a pair by all coordinates that both have. One tree over all points would
not scale, so the tree is sharded: under any fixed order of hashes, sets above the threshold share one of their first hashes
(prefix), each of which names a shard. The order puts frequent hashes last, so that passages which many texts hold name few
shards. What is found frequent (FREQUENT hashes at most, of counts over all texts) changes the work and never the links.
Surviving pairs are verified on the whole sets, whose words and shingles are then compared by themselves, not by hash.

No pairs are listed within groups of copies: equal sets are one point, and the first round compares each point of a shard
with two of its points only, verifies and merges components. The second round compares whatever is still in
different components, which makes the result complete. There, shards above HOT points are ordered by size, cut into chunks of HOT
points, and dealt into cells of two chunks each whose sizes allow links. Where the bounds allow more than DENSE pairs a point of a
cell, as in large groups of near copies, only the BEST pairs of each point by their bounds are verified, and the shard
comes again with the components that these links make, until it is not dense or no component has grown; then all of its
pairs are verified. Shards are read sorted, so a task holds one at a time.

Defined cases: null, empty and blank texts have no shingles and link with nothing (component_id is the own doc_id).
doc_ids are below 2**62. Rows that repeat a doc_id are separate texts that report the same doc_id. Of rows without doc_id, the component is the least doc_id of
the others in it, null if it has none; they link others all the same. An empty table gives no rows. Other columns of the
input are ignored and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenrel.llm import textvec
from screenrel.llm.shared import forget, probable, release, written

GROUPS = 64
HOT = 4096
FANOUT = 16
SALTS = (0x51, 0xA7)
FREQUENT = 1 << 16
RUN = 1 << 20
DENSE, BEST = 4, 2
FEW = 4
MOST_GROUPS = 1 << 16
UNNAMED = 1 << 62
TOP = 15
_U = np.uint64

POINTS = "doc_id bigint, tag bigint, n_shingles bigint, sig1 bigint, sig2 bigint, counts binary, prefix array<bigint>"
PAIRS = "a bigint, b bigint"


def count_vectors(flat: np.ndarray, n: np.ndarray) -> list[bytes]:
    """The count vector of each of some sets, whose hashes follow one another: four bits a group, the even one of two in the lower half."""
    dims = np.maximum(GROUPS, 1 << np.ceil(np.log2(np.maximum(n, 2) / 2)).astype(np.int64))
    dims = np.minimum(dims, MOST_GROUPS)
    groups, owner = (flat >> _U(20)).astype(np.int64) & (MOST_GROUPS - 1), np.repeat(np.arange(len(n)), n)
    while True:
        at = np.concatenate([[0], np.cumsum(dims)])
        counts = np.bincount(at[owner] + (groups & (dims[owner] - 1)), minlength=at[-1])
        full = np.zeros(len(n), bool)
        full[np.searchsorted(at, np.flatnonzero(counts > TOP), "right") - 1] = True
        full &= dims < MOST_GROUPS
        if not full.any():
            break
        dims = np.where(full, 2 * dims, dims)
    counts = np.minimum(counts, TOP).astype(np.uint8)
    packed = (counts[::2] | counts[1::2] << 4).tobytes()
    return [packed[a // 2 : b // 2] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def needed(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap that a set of this size must have with any partner: ceil(percent * size / 100)."""
    return -(-sizes * percent // 100)


def pair_needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of two linked sets: 100 * o >= percent * (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


def frequent(batches: Iterator[pa.RecordBatch], width: int, few: int) -> Iterator[pa.RecordBatch]:
    """Of texts, the hashes that a few texts or more of about RUN shingles share, with the number of these texts."""
    sets, held = [], 0

    def counted():
        keys, n = np.unique(np.concatenate(sets), return_counts=True)
        keep = n >= few
        return pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64)), pa.array(n[keep])], ["key", "n"])

    for batch in batches:
        for chunk in textvec.chunks(batch.column(0)):
            found = textvec.shingle_sets(chunk, width)
            sets += found
            held += sum(map(len, found))
            if held >= RUN:
                yield counted()
                sets, held = [], 0
    if sets:
        yield counted()


def last_in_order(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent hashes, sorted, and the place of each in the order after all others (from 1, the rarer first)."""
    counts = docs.select("text").mapInArrow(partial(frequent, width=width, few=FEW), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    keys = np.array([r["key"] for r in counts.orderBy(F.desc("n"), "key").limit(FREQUENT).collect()], np.int64).view(_U)
    order = np.argsort(keys)
    return keys[order], (len(keys) - np.arange(len(keys)))[order]


def make_points(batches: Iterator[pa.RecordBatch], width: int, percent: int, last: Broadcast) -> Iterator[pa.RecordBatch]:
    known, places = last.value
    for batch in batches:
        ids = batch.column(0)
        for chunk in textvec.chunks(batch.column(2)):
            sets = textvec.shingle_sets(chunk, width)
            n = np.array([len(s) for s in sets], np.int64)
            owner = np.repeat(np.arange(len(sets)), n)
            flat = np.concatenate(sets) if len(sets) else np.zeros(0, _U)
            ends = np.concatenate([[0], np.cumsum(n)])
            vectors = count_vectors(flat, n)
            sums = [np.concatenate([np.zeros(1, _U), np.cumsum(textvec.mix(flat ^ _U(salt)), dtype=_U)]) for salt in SALTS]
            sig1, sig2 = ((s[ends[1:]] - s[ends[:-1]]).view(np.int64) for s in sums)
            if len(known):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                flat = flat[np.argsort(owner * (2 * FREQUENT) + np.where(known[at] == flat, places[at], 0), kind="stable")]
            take = np.where(n > 0, n - needed(n, percent) + 1, 0)
            starts = np.concatenate([[0], np.cumsum(take)])
            picked = np.repeat(ends[:-1] - starts[:-1], take) + np.arange(starts[-1])
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(chunk.first, len(sets)).cast(pa.int64()),
                    batch.column(1).slice(chunk.first, len(sets)),
                    pa.array(n),
                    pa.array(sig1),
                    pa.array(sig2),
                    pa.array(vectors, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat[picked].view(np.int64))),
                ],
                ["doc_id", "tag", "n_shingles", "sig1", "sig2", "counts", "prefix"],
            )


SHARDS = "key bigint, chunk bigint, points array<bigint>, sizes array<int>, head bigint, head_n bigint, tail bigint, tail_n bigint, shard_size bigint, low bigint, high bigint"


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Sorted batches cut anew, so that rows equal in the first columns are never parted; about this many rows at a time."""
    held, size, enough = [], 0, rows
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size < enough:
            continue
        table = pa.Table.from_batches(held)
        last = np.flatnonzero(np.logical_and.reduce([table.column(k).to_numpy() == table.column(k)[-1].as_py() for k in range(keys)]))[0]
        if last:
            yield table.slice(0, last)
            held = table.slice(last).to_batches()
            size = table.num_rows - last
        enough = max(rows, 2 * size)  # a large group is looked through a few times only
    if held:
        yield pa.Table.from_batches(held)


def shared_keys(batches: Iterator[pa.RecordBatch], percent: int, hot: int) -> Iterator[pa.RecordBatch]:
    """Of rows (key, point, n) in the order of keys: shards of two points or more, ordered by size and cut into chunks of `hot` points, a row each, with the shard's first and last point, its size, and the first and last chunk whose sizes allow links with the row's own.

    Near copies share many shards of the same points, so the key becomes a hash of these: one such shard is enough.
    """
    for table in whole_groups(batches, 1):
        key, point, n = (table.column(i).to_numpy() for i in range(3))
        order = np.lexsort((point, n, key))
        key, point, n = key[order], point[order], n[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([start, [len(key)]]))
        keep = np.repeat(size, size) > 1
        point, n, size = point[keep], n[keep], size[size > 1]
        if not len(point):
            continue
        start = np.cumsum(size) - size
        by_point = np.lexsort((point, np.repeat(start, size)))
        head, tail = by_point[start], by_point[start + size - 1]
        members = np.add.reduceat(textvec.mix(point.view(_U) ^ _U(0x3D)), start).view(np.int64)
        chunks = -(-size // hot)
        shard = np.repeat(np.arange(len(size)), chunks)
        chunk = np.arange(len(shard)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        first = start[shard] + chunk * hot
        last = np.minimum(first + hot, start[shard] + size[shard])
        low, high = np.zeros(len(shard), np.int64), np.zeros(len(shard), np.int64)
        for k in np.flatnonzero(chunks > 1).tolist():
            own = shard == k
            least, most = n[first[own]], n[last[own] - 1]
            high[own] = np.searchsorted(least * percent, most * 100, "right") - 1
            low[own] = np.searchsorted(most * 100, least * percent, "left")
        cut = np.concatenate([first, last[-1:]]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in (point, n.astype(np.int32))]
        rest = [x[shard] for x in (point[head], n[head], point[tail], n[tail], size)]
        yield pa.RecordBatch.from_arrays([pa.array(members[shard]), pa.array(chunk), *lists, *(pa.array(x.astype(np.int64)) for x in (*rest, low, high))], [c.split()[0] for c in SHARDS.split(", ")])


def live_shards(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows (key, label, n, ...) in the order of keys: those whose shard has a point of another component and of a size that allows a link."""
    for table in whole_groups(batches, 1):
        key, label, n = (table.column(k).to_numpy() for k in range(3))
        order = np.lexsort((n, key))
        key, label, n = key[order], label[order], n[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        shard = np.repeat(np.arange(len(start)), np.diff(np.concatenate([start, [len(key)]])))
        # rows of the shard with sizes from percent of the own one to where the own one is percent of theirs
        wide = int(n.max()) * 100 // percent + 2
        place = shard * wide + n
        first = np.searchsorted(place, shard * wide + -(-n * percent // 100))
        last = np.searchsorted(place, shard * wide + n * 100 // percent, "right")
        change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        keep = change[last - 1] != change[first]
        yield from table.take(pa.array(order[keep])).to_batches(max_chunksize=1 << 16)


def runs(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive items, from at[k] to at[k + 1] each, in runs of about RUN elements; a longer item is a run of its own."""
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + RUN, "right")) - 1)
        yield first, last
        first = last


class Points:
    """Count vectors of some points."""

    def __init__(self, column: pa.Array, sizes: np.ndarray):
        raw, offsets = textvec.buffers(column)
        self.raw, self.at = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
        self.dims, self.sizes = 2 * np.diff(self.at), sizes

    def rows(self, which: np.ndarray, dims: int, to: int) -> np.ndarray:
        """Vectors of points that all have dims coordinates, folded to fewer."""
        packed = self.raw[self.at[which][:, None] + np.arange(dims // 2)]
        out = np.empty((len(which), dims), np.uint8)
        out[:, ::2], out[:, 1::2] = packed & 15, packed >> 4
        return out if to == dims else out.reshape(len(which), dims // to, to).sum(1, dtype=np.uint16)

    def coarse(self) -> np.ndarray:
        """All vectors folded to GROUPS coordinates."""
        out = np.zeros((len(self.sizes), GROUPS), np.int32)
        for dims in np.unique(self.dims).tolist():
            which, step = np.flatnonzero(self.dims == dims), max(1, RUN // dims)
            for i in range(0, len(which), step):
                out[which[i : i + step]] = self.rows(which[i : i + step], dims, GROUPS)
        return out

    def margins(self, coarse: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """By how much the summed coordinate minima, first of folded vectors and then of all coordinates that both have, exceed the overlap that a link needs; -1 where they or the sizes allow none."""
        score, out = np.full(len(a), -1, np.int64), np.zeros(len(a), bool)
        for i in range(0, len(a), 8192):
            x, y = a[i : i + 8192], b[i : i + 8192]
            need = pair_needed(self.sizes[x], self.sizes[y], percent)
            out[i : i + 8192] = (np.minimum(self.sizes[x], self.sizes[y]) >= need) & (np.minimum(coarse[x], coarse[y]).sum(1) >= need)
        left = np.flatnonzero(out)
        shapes = self.dims[a[left]] << 32 | self.dims[b[left]]
        for shape in np.unique(shapes).tolist():
            first, second = shape >> 32, shape & 0xFFFFFFFF
            to, some = min(first, second), left[shapes == shape]
            step = max(1, RUN // max(first, second))
            for i in range(0, len(some), step):
                part = some[i : i + step]
                x, y = a[part], b[part]
                both = np.minimum(self.rows(x, first, to), self.rows(y, second, to)).sum(1, dtype=np.int64)
                score[part] = np.maximum(both - pair_needed(self.sizes[x], self.sizes[y], percent), -1)
        # where so many hashes share a group that its count is cut off at MOST_GROUPS groups, nothing is bounded
        whole = np.flatnonzero(self.dims == MOST_GROUPS)
        cut = whole[[(self.rows(np.array([k]), MOST_GROUPS, MOST_GROUPS) == TOP).any() for k in whole.tolist()]] if len(whole) else whole
        return np.where(np.isin(a, cut) | np.isin(b, cut), np.maximum(score, 0), score) if len(cut) else score


def tree_pairs(vectors: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of points of one shard that a packed R-tree search leaves: points are packed by size, boxes hold the coordinate maxima and the size range."""
    order = np.argsort(sizes, kind="stable")
    v, s = vectors[order], sizes[order]
    levels = [(v, s, s)]
    while len(levels[-1][1]) > FANOUT:
        high, low, top = levels[-1]
        cut = np.arange(0, len(low), FANOUT)
        levels.append((np.maximum.reduceat(high, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(top, cut)))
    left, right = [], []
    for q in range(0, len(s), 256):
        query = np.arange(q, min(q + 256, len(s)))
        query, node = (x.ravel() for x in np.meshgrid(query, np.arange(len(levels[-1][1])), indexing="ij"))
        for depth in range(len(levels) - 1, -1, -1):
            high, low, top = levels[depth]
            # a partner comes later in size order; of those in the box, the least one asks for the least overlap
            need = pair_needed(s[query], np.maximum(low[node], s[query]), percent)
            fits = (top[node] >= s[query]) & (s[query] >= need)
            query, node = query[fits], node[fits]
            keep = np.zeros(len(query), bool)
            for i in range(0, len(query), 8192):
                x, y = query[i : i + 8192], node[i : i + 8192]
                keep[i : i + 8192] = np.minimum(v[x], high[y]).sum(1) >= pair_needed(s[x], np.maximum(low[y], s[x]), percent)
            query, node = query[keep], node[keep]
            if depth:
                below = len(levels[depth - 1][1])
                child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                query = np.repeat(query, FANOUT)
                query, node = query[child < below], child[child < below]
        later = node > query
        left.append(order[query[later]])
        right.append(order[node[later]])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def within_bounds(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, a's size, b's size, a's counts, b's counts) the pairs that the bound allows."""
    for batch in batches:
        sizes = np.concatenate([batch.column(i).to_numpy() for i in (2, 3)])
        points = Points(pa.concat_arrays([batch.column(4), batch.column(5)]), sizes)
        first = np.arange(batch.num_rows)
        yield batch.select([0, 1]).filter(pa.array(points.margins(points.coarse(), first, first + batch.num_rows, percent) >= 0))


def best_pairs(a: np.ndarray, b: np.ndarray, score: np.ndarray, count: int) -> np.ndarray:
    """Which pairs are among the best of either point."""
    keep = np.zeros(len(a), bool)
    ends, pair = np.concatenate([a, b]), np.tile(np.arange(len(a)), 2)
    order = np.lexsort((pair, -score[pair], ends))
    ends, pair = ends[order], pair[order]
    start = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]])) if len(ends) else order
    rank = np.arange(len(ends)) - np.repeat(start, np.diff(np.concatenate([start, [len(ends)]])))
    keep[pair[rank < count]] = True
    return keep


FOUND = "a bigint, b bigint, again boolean"


def shard_pairs(batches: Iterator[pa.RecordBatch], percent: int, complete: bool) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that the trees of shards (or cells of hot shards) leave, in the order of key and cell; unless complete, the best ones of dense cells, whose (key, cell) comes with again. Points of one component are never paired."""
    for table in whole_groups(batches, 2, 1 << 13):
        key, cell, point, size, label, half = (table.column(c).to_numpy() for c in ("key", "cell", "point", "n", "label", "half"))
        counts = table.column("counts").combine_chunks()
        counts = counts.chunk(0) if isinstance(counts, pa.ChunkedArray) else counts
        start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])]))
        stop = np.concatenate([start[1:], [len(key)]])
        for i, j in runs(np.concatenate([start, stop[-1:]]) * GROUPS):
            rows = np.arange(start[i], stop[j - 1])
            length = stop[i:j] - start[i:j]
            n, ids, tags, side = size[rows], point[rows], label[rows], half[rows]
            points = Points(counts.slice(int(start[i]), len(rows)), n)
            vec = points.coarse()
            base = np.concatenate([[0], np.cumsum(length)])
            pairs = [(np.zeros(0, np.int64),) * 2]
            for m in np.unique(length[length <= FANOUT]):
                x, y = np.triu_indices(m, 1)
                at = base[:-1][length == m]
                pairs.append(((at[:, None] + x).ravel(), (at[:, None] + y).ravel()))
            for k in np.flatnonzero(length > FANOUT):
                x, y = tree_pairs(vec[base[k] : base[k + 1]], n[base[k] : base[k + 1]], percent)
                pairs.append((x + base[k], y + base[k]))
            a, b = (np.concatenate(p) for p in zip(*pairs, strict=True))
            keep = (tags[a] != tags[b]) & ((side[a] != side[b]) | (side[a] == 2))
            a, b = a[keep], b[keep]
            score = points.margins(vec, a, b, percent)
            keep = score >= 0
            a, b, score = a[keep], b[keep], score[keep]
            again = np.zeros((0, 2), np.int64)
            if not complete:
                shard = np.searchsorted(base, a, "right") - 1
                dense = np.bincount(shard, minlength=len(length)) > DENSE * length
                again = np.stack([key[start[i:j][dense]], cell[start[i:j][dense]]], 1)
                keep = ~dense[shard] | best_pairs(a, b, score, BEST)
                a, b = a[keep], b[keep]
            x, y = ids[a], ids[b]
            both = np.concatenate([np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0), again])
            flags = np.arange(len(both)) >= len(both) - len(again)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(flags)], ["a", "b", "again"])


def exact_sets(texts: pa.Array, width: int) -> list[np.ndarray] | list[set]:
    """Shingle sets of some texts, comparable with one another: hashes if no two different words or shingles of these share one, else the shingles."""
    raw, offsets = textvec.buffers(texts)
    chunk = textvec.Chunk(0, textvec.FOLDED[raw[offsets[0] : offsets[-1]]], offsets - offsets[0])
    starts, ends = chunk.runs(~textvec.SPACES[chunk.data])
    words = chunk.hashes(starts, ends, textvec.EXACT)
    _, first, symbol = np.unique(words, return_index=True, return_inverse=True)
    size = ends - starts
    alike = bool((size == size[first][symbol]).all()) and bool(textvec.same_bytes(chunk.data, starts, size, np.concatenate([chunk.data, np.zeros(8, np.uint8)]), starts[first][symbol]).all())
    if alike:
        at, values = textvec.shingles(chunk, width, words, starts)
        rows = np.stack([np.where(k < at[1], symbol[np.minimum(at[0] + k, len(symbol) - 1)], -1) for k in range(width)], 1) if len(values) else np.zeros((0, width), np.int64)
        _, first, inverse = np.unique(values, return_index=True, return_inverse=True)
        if (rows == rows[first][inverse]).all():
            return textvec.shingle_sets(chunk, width)
    parts = [[x.tobytes() for x in (chunk.data[s:e] for s, e in zip(starts[i:j], ends[i:j], strict=True))] for i, j in zip(np.searchsorted(starts, chunk.offsets[:-1]), np.searchsorted(starts, chunk.offsets[1:]), strict=True)]
    return [{tuple(p[k : k + width]) for k in range(max(1, len(p) - width + 1))} if p else set() for p in parts]


def verify(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose whole shingle sets link."""
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        keep = np.zeros(len(a), bool)
        for i in range(0, len(a), 64):
            part = batch.slice(i, 64)
            sets = exact_sets(pa.concat_arrays([part.column(k).cast(pa.large_string()) for k in (2, 3)]), width)
            for k, (x, y) in enumerate(zip(sets[: part.num_rows], sets[part.num_rows :], strict=True)):
                both = len(x & y) if isinstance(x, set) else len(np.intersect1d(x, y, assume_unique=True))
                keep[i + k] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Smallest reachable node for each node (columns point, label -> point, label): labels of linked components are merged round by round, always on written tables."""
    labels = nodes
    while True:
        raised = edges.join(labels.select(F.col("point").alias("a"), F.col("label").alias("x")), "a").join(labels.select(F.col("point").alias("b"), F.col("label").alias("y")), "b")
        hooks = written(raised.where("x <> y").select(F.greatest("x", "y").alias("from"), F.least("x", "y").alias("to")).groupBy("from").agg(F.min("to").alias("to")), "hooks")
        if hooks.isEmpty():
            return labels
        while True:  # chains of hooks are halved until each ends in a root
            nxt = hooks.select(F.col("from").alias("to"), F.col("to").alias("further"))
            jumped = written(hooks.join(nxt, "to", "left").select("from", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "hooks")
            hooks = jumped.select("from", "to")
            if jumped.where("moved").isEmpty():
                break
        labels = written(labels.join(hooks, labels["label"] == hooks["from"], "left").select("point", F.coalesce("to", "label").alias("label")), "labels")


def own_text(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Of (point, sig1, sig2, text), (point, text) of the rows whose text has the shingle set of these sums, once a point and task."""
    seen: set[int] = set()
    for batch in batches:
        sums = [[int(textvec.mix(s ^ _U(salt)).sum(dtype=_U)) for salt in SALTS] for c in textvec.chunks(batch.column(3)) for s in textvec.shingle_sets(c, width)]
        found = np.array(sums, _U).view(np.int64).reshape(-1, 2)
        fits = (found[:, 0] == batch.column(1).to_numpy()) & (found[:, 1] == batch.column(2).to_numpy())
        keep = []
        for k, point in zip(np.flatnonzero(fits).tolist(), batch.column(0).to_numpy()[fits].tolist(), strict=True):
            if point not in seen:
                seen.add(point)
                keep.append(k)
        yield batch.select([0, 3]).take(pa.array(keep, pa.int64()))


def verified(pairs: DataFrame, points: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of some pairs of points whose whole shingle sets link; only the texts of these pairs are fetched."""
    wanted = pairs.select(F.col("a").alias("point")).union(pairs.select("b")).distinct()
    wanted = written(points.join(wanted, "point", "left_semi").select("point", "doc_id", "sig1", "sig2"), "wanted")
    texts = probable(docs, "doc_id", wanted.select("doc_id")).join(wanted, "doc_id").select("point", "sig1", "sig2", "text")
    # both sides read one exchange of the texts, which are written nowhere
    texts = texts.mapInArrow(partial(own_text, width=width), "point bigint, text string").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "point")
    both = pairs.join(texts.select(F.col("point").alias("a"), F.col("text").alias("left")), "a").join(texts.select(F.col("point").alias("b"), F.col("text").alias("right")), "b")
    links = written(both.select("a", "b", "left", "right").mapInArrow(partial(verify, width=width, percent=percent), PAIRS), "links")
    release(docs.sparkSession)
    return links


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links of similarity >= percent/100) and tag (xxhash64 of the text) for each row of docs (doc_id, text)."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(UNNAMED) + F.shiftrightunsigned(F.xxhash64("text"), 3)).alias("doc_id"), "text")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = spark.sparkContext.broadcast(last_in_order(docs, width))
    points = written(docs.select("doc_id", F.xxhash64("text").alias("tag"), "text").mapInArrow(partial(make_points, width=width, percent=percent, last=last), POINTS), "points")
    sets = written(points.select("doc_id", "tag", "n_shingles", "sig1", "sig2"), "sets")
    classes = sets.where("n_shingles > 0").groupBy("sig1", "sig2").agg(F.min("doc_id").alias("first"))
    classes = written(classes.withColumn("point", F.monotonically_increasing_id()), "classes")
    own = classes.select("sig1", "sig2", F.col("first").alias("doc_id"), "point")
    firsts = points.select("sig1", "sig2", "doc_id", F.col("n_shingles").alias("n"), "prefix").join(own, ["sig1", "sig2", "doc_id"])
    entries = firsts.select(F.explode("prefix").alias("key"), "point", "n").repartition(parts, "key").sortWithinPartitions("key")
    shards = written(entries.mapInArrow(partial(shared_keys, percent=percent, hot=HOT), SHARDS).dropDuplicates(["key", "chunk"]), "shards")
    release(spark)
    chosen = own.join(shards.select(F.explode("points").alias("point")).distinct(), "point", "left_semi")
    suspects = points.select("sig1", "sig2", "doc_id", F.col("n_shingles").alias("n"), "counts").join(chosen, ["sig1", "sig2", "doc_id"])
    suspects = written(suspects.dropDuplicates(["point"]), "suspects")
    forget(points)
    release(spark)
    labels = suspects.select("point", F.col("point").alias("label"))

    placed = shards.select("key", "chunk", "head", "head_n", "tail", "tail_n", "shard_size", "low", "high", F.explode(F.arrays_zip("points", "sizes")).alias("p")).select("*", F.col("p.points").alias("point"), F.col("p.sizes").cast("bigint").alias("n"))
    stars = placed.select("point", "n", F.explode(F.array(F.struct(F.col("head").alias("other"), F.col("head_n").alias("size")), F.struct(F.col("tail").alias("other"), F.col("tail_n").alias("size")))).alias("o"))
    stars = stars.where(f"point <> o.other and 100 * least(n, o.size) >= {percent} * greatest(n, o.size)").select(F.least("point", "o.other").alias("a"), F.greatest("point", "o.other").alias("b")).distinct()
    sides = [suspects.select(F.col("point").alias(x), F.col("n").alias(f"n_{x}"), F.col("counts").alias(f"counts_{x}")) for x in ("a", "b")]
    stars = stars.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "n_b", "counts_a", "counts_b")
    stars = written(stars.mapInArrow(partial(within_bounds, percent=percent), PAIRS), "pairs")
    release(spark)
    labels = components(verified(stars, suspects, docs, width, percent), labels)

    # the stars hold all pairs of a shard of three points
    todo, complete, grown = placed.where("shard_size > 3").select("key", "n", "point", "chunk", "low", "high"), False, None
    while True:
        live = todo.join(labels, "point").select("key", "label", "n", "point", "chunk", "low", "high").repartition(parts, "key").sortWithinPartitions("key")
        live = written(live.mapInArrow(partial(live_shards, percent=percent), "key bigint, label bigint, n bigint, point bigint, chunk bigint, low bigint, high bigint"), "live")
        if shards is not None:
            forget(shards)
            shards = None
        release(spark)
        # a shard of more than HOT points is dealt into cells of two chunks each; half tells the chunks apart, 2 is a cell of one chunk
        rows = live.withColumn("other", F.explode(F.expr("sequence(low, high)"))).join(suspects.select("point", "counts"), "point")
        cell = F.least("chunk", "other") * 1000003 + F.greatest("chunk", "other")
        half = F.when(F.col("chunk") == F.col("other"), 2).when(F.col("chunk") < F.col("other"), 0).otherwise(1)
        rows = rows.select("key", cell.alias("cell"), "point", "n", "label", half.cast("bigint").alias("half"), "counts")
        found = rows.repartition(parts, "key", "cell").sortWithinPartitions("key", "cell").mapInArrow(partial(shard_pairs, percent=percent, complete=complete), FOUND)
        found = written(found.distinct(), "pairs")
        release(spark)
        labels = components(verified(found.where("not again").select("a", "b"), suspects, docs, width, percent), labels)
        dense = found.where("again").select(F.col("a").alias("key")).distinct()
        if complete or dense.isEmpty():
            break
        count = labels.select("label").distinct().count()
        complete, grown = count == grown, count
        todo = live.join(dense, "key", "left_semi").drop("label")

    least = labels.join(classes.select("point", "first"), "point").groupBy("label").agg(F.min("first").alias("least"))
    merged = labels.join(least, "label").select("point", "least")
    found = classes.join(merged, "point", "left").select("sig1", "sig2", F.coalesce("least", "first").alias("component_id"))
    found = sets.join(found, ["sig1", "sig2"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    doc, component = (F.when(F.col(c) < UNNAMED, F.col(c)).alias(c) for c in ("doc_id", "component_id"))
    return found.select(doc, "n_shingles", component, "tag")
