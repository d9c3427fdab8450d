"""An adaptive context-mixing range coder for blocks of token ids below 65,536.

A block is cut into lanes of consecutive ids, one range coder each; all lanes are coded in step and share one set of models,
which starts fresh in every block. Models see the ids of a step after it, in the order of lanes, so decoding follows encoding.

Order 2 and order 1 predict the id that followed the two ids (the id) before, with a count of how often it came. Per id one
symbol of three says whether order 2, order 1 or neither is right. Its probabilities mix, in the logistic domain with learnt
weights, the rate of the pair of counts, the rate of the order's own count and the rate of all. If neither is right, the id is coded
by order 0: frequencies of ids so coded before, with an escape to sixteen plain bits. All arithmetic is on integers, so
files decode alike everywhere.

The range coder has a range of at most 48 bits, moves 16 bits out when it falls below 32, and settles carries at the end.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np

LANES = 8192
STEPS = 512
PAIR_BITS = 18
CHANCE_BITS, FREQ_BITS = 15, 16
INERTIA = 24
EVERY, REBUILD = 8, 32
FULL, LOW = 1 << 48, 1 << 32
MOST = 57344
_U = np.uint64
_I = np.int64


@cache
def curves() -> tuple[np.ndarray, np.ndarray]:
    """stretch by probability (12 bits) and squash by stretched value + 2047, as integers from a rule that rounds alike everywhere."""
    squash = np.array([int(4096 / (1 + 2.718281828459045 ** (-x / 256)) + 0.5) for x in range(-2047, 2048)], _I).clip(1, 4095)
    stretch = np.searchsorted(squash, np.arange(4096)).clip(0, 4094) - 2047
    return stretch.astype(_I), squash


class Chances:
    """Mixed probabilities of one decision for each context; near is the order's own count in that context, usable where it has a prediction."""

    def __init__(self, near: np.ndarray, usable: np.ndarray):
        self.near, self.usable = near, usable
        self.rates = [np.full(len(near), 1 << 15, _I), np.full(16, 1 << 15, _I), np.full(1, 1 << 15, _I)]
        self.weights = [1 << 15, 1 << 14, 1 << 13]
        self.mix()

    def mix(self) -> None:
        stretch, squash = curves()
        self.inputs = [stretch[r >> 4] for r in (self.rates[0], self.rates[1][self.near], self.rates[2])]
        dot = (self.weights[0] * self.inputs[0] + self.weights[1] * self.inputs[1] + self.weights[2] * self.inputs[2]) >> 16
        self.chance = np.where(self.usable, squash[np.minimum(np.maximum(dot, -2047), 2047) + 2047], 0)

    def learn(self, hits: np.ndarray, n: np.ndarray) -> None:
        total = int(n.sum())
        if not total:
            return
        error = hits * 4096 - n * self.chance
        for k in range(3):
            change = int((error * self.inputs[k]).sum()) // total >> 7
            self.weights[k] = min(max(self.weights[k] + change, -(1 << 17)), 1 << 17)
        by_near = [np.bincount(self.near, x, 16).astype(_I) for x in (hits, n)]
        for k, (h, m) in enumerate(((hits, n), by_near, (hits.sum(keepdims=True), n.sum(keepdims=True)))):
            self.rates[k] = np.minimum((self.rates[k] * INERTIA + (h << 16)) // (INERTIA + m), 65535)
        self.mix()


class Block:
    """Coder and models of a block."""

    def __init__(self, lanes: int, words: np.ndarray | None = None):
        self.reading = words is not None
        self.range, self.at = np.full(lanes, FULL, _U), np.zeros(lanes, _I)
        if self.reading:
            self.words, self.at[:] = words, 3
            self.low = words[0].astype(_U) << _U(32) | words[1].astype(_U) << _U(16) | words[2]
        else:
            self.words, self.low = np.zeros((STEPS, lanes), np.uint32), np.zeros(lanes, _U)
        self.seen = [np.zeros(1 << FREQ_BITS, np.uint32), np.zeros(1 << PAIR_BITS, np.uint32)]
        context = np.arange(512)
        two, one, same = context >> 4 & 15, context & 15, context >= 256
        self.first, self.second = Chances(two, two > 0), Chances(one, (one > 0) & ~same)
        self.contexts: list[np.ndarray] = []
        self.count = np.zeros(1 << FREQ_BITS, _I)
        self.bounds()
        self.rebuild()

    def bounds(self) -> None:
        """Cumulated bounds of the three symbols by context, in units of 2**-CHANCE_BITS."""
        a, b = np.minimum(self.first.chance, 4094), self.second.chance
        self.cut = [(a << 3).astype(_U), (a + np.where(b > 0, np.maximum((4096 - a) * b >> 12, 1), 0) << 3).astype(_U)]

    def learn(self) -> None:
        seen = np.bincount(np.concatenate(self.contexts), minlength=2048).reshape(512, 4)
        self.contexts = []
        right, other, none = seen[:, 0], seen[:, 1], seen[:, 2]
        use = self.first.usable
        self.first.learn(right * use, (right + other + none) * use)
        use = self.second.usable
        self.second.learn(other * use, (other + none) * use)
        self.bounds()

    def rebuild(self) -> None:
        """Order 0's frequencies, from the ids that it has coded."""
        least = 1
        while np.count_nonzero(self.count >= least) > MOST:
            least += 1
        known = np.flatnonzero(self.count >= least)
        n = self.count[known]
        room = (1 << FREQ_BITS) - 512 - len(known)
        freq = 1 + n * room // max(1, int(n.sum()))
        self.freq, self.start = np.zeros(1 << FREQ_BITS, _U), np.zeros(1 << FREQ_BITS, _U)
        stop = np.cumsum(freq)
        self.freq[known], self.start[known] = freq, stop - freq
        self.escape = int(stop[-1]) if len(stop) else 0
        self.slot = np.zeros(1 << FREQ_BITS, np.uint16)
        self.slot[: self.escape] = np.repeat(known, freq)

    def shift(self, lane: np.ndarray) -> None:
        """Moves sixteen bits in or out in each of these lanes."""
        at = self.at[lane]
        self.at[lane] = at + 1
        low = self.low[lane]
        if self.reading:
            self.low[lane] = low << _U(16) | self.words[at, lane]
        else:
            if int(at.max()) >= len(self.words):
                self.words = np.concatenate([self.words, np.zeros_like(self.words)])
            self.words[at, lane] = low >> _U(32)
            self.low[lane] = (low & _U(LOW - 1)) << _U(16)
        self.range[lane] <<= _U(16)

    def move(self, lane: np.ndarray, start: np.ndarray, width: np.ndarray) -> None:
        """Narrows the range of some lanes."""
        if self.reading:
            self.low[lane] -= start
        else:
            self.low[lane] += start
        self.range[lane] = width
        if len(narrow := lane[width < _U(LOW)]):
            self.shift(narrow)

    def whole(self, lane: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
        """Ids by order 0."""
        unit = self.range[lane] >> _U(FREQ_BITS)
        if self.reading:
            place = np.minimum(self.low[lane] // unit, _U((1 << FREQ_BITS) - 1)).astype(_I)
            ids = self.slot[place].astype(_I)
            out = place >= self.escape
        else:
            out = self.freq[ids] == 0
        start, freq = self.start[ids], self.freq[ids]
        if out.any():
            start[out], freq[out] = self.escape, (1 << FREQ_BITS) - self.escape
            self.move(lane, unit * start, unit * freq)
            some = lane[out]
            unit = self.range[some] >> _U(16)
            if self.reading:
                ids[out] = np.minimum(self.low[some] // unit, _U(65535)).astype(_I)
            self.move(some, unit * ids[out].astype(_U), unit)
        else:
            self.move(lane, unit * start, unit * freq)
        np.add.at(self.count, ids, 1)
        return ids

    def step(self, lanes: int, one: np.ndarray, two: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
        """Codes one id in each of the first lanes, after ids one and two before it."""
        pair = (one * 40503 + two * 30011 * 65537 >> 5) & ((1 << PAIR_BITS) - 1)
        near, far = self.seen[0][one].astype(_I), self.seen[1][pair].astype(_I)
        guess_one, guess_two = near >> 4, far >> 4
        context = (far & 15) << 4 | near & 15 | (guess_one == guess_two).astype(_I) << 8
        whole = lanes == len(self.range)
        width, low = (self.range, self.low) if whole else (self.range[:lanes], self.low[:lanes])
        unit = width >> _U(CHANCE_BITS)
        a, b = unit * self.cut[0][context], unit * self.cut[1][context]
        if ids is None:
            past_a, past_b = low >= a, low >= b
        else:
            past_a = ids + 1 != guess_two
            past_b = past_a & (ids + 1 != guess_one)
        start = np.where(past_b, b, np.where(past_a, a, _U(0)))
        width[:] = np.where(past_b, width, np.where(past_a, b, a)) - start
        if self.reading:
            low -= start
        else:
            low += start
        if len(narrow := np.flatnonzero(width < _U(LOW))):
            self.shift(narrow)
        lane = np.flatnonzero(past_b)
        if ids is None:
            out = np.where(past_a, guess_one, guess_two) - 1
            if len(lane):
                out[lane] = self.whole(lane, None)
        else:
            out = ids
            if len(lane):
                self.whole(lane, ids[lane])
        self.contexts.append(context << 2 | past_a.astype(_I) + past_b)
        for table, place, held, guess in ((self.seen[0], one, near, guess_one), (self.seen[1], pair, far, guess_two)):
            hits = held & 15
            same = guess == out + 1
            table[place] = np.where(same, held + (hits < 15), np.where(hits > 3, held - (hits + 1 >> 1), out + 1 << 4 | 1))
        return out

    def run(self, n: int, lanes: int, steps: int, ids: np.ndarray | None) -> np.ndarray:
        grid = np.zeros((steps + 2, lanes), _I)
        if ids is not None:
            body = np.zeros(lanes * steps, _I)
            body[:n] = ids
            grid[2:] = body.reshape(lanes, steps).T
        last = n - (lanes - 1) * steps
        for k in range(steps):
            m = lanes if k < last else lanes - 1
            if not m:
                break
            out = self.step(m, grid[k + 1, :m], grid[k, :m], None if ids is None else grid[k + 2, :m])
            if ids is None:
                grid[k + 2, :m] = out
            if k < EVERY or k % EVERY == 0:
                self.learn()
            if k in (0, 1, 3, 7, 15) or k % REBUILD == REBUILD - 1:
                self.rebuild()
        return grid[2:].T.reshape(-1)[:n]

    def finished(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of each lane (a column each), with carries settled, and their numbers."""
        top = int(self.at.max()) + 3
        words = np.zeros((top, len(self.at)), np.uint32)
        words[: min(top, len(self.words))] = self.words[:top]
        lanes = np.arange(len(self.at))
        for k in range(3):
            words[self.at + k, lanes] = self.low >> _U(32) if k == 0 else (self.low >> _U(32 - 16 * k)) & _U(0xFFFF)
        for k in range(top - 1, 0, -1):
            words[k - 1] += words[k] >> 16
            words[k] &= 0xFFFF
        return words, self.at + 3


def shape(n: int) -> tuple[int, int]:
    """Lanes and steps of a block of n ids."""
    steps = max(1, -(-n // LANES), min(n, STEPS))
    return max(1, -(-n // steps)), steps


def encode(ids: np.ndarray) -> bytes:
    """A block: crc32 of its ids as little-endian unsigned 32-bit, then words of each lane (32 bits each), then the lanes' words of 16 bits."""
    if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < 1 << 16:
        raise ValueError("ids must be below 65,536")
    lanes, steps = shape(len(ids))
    block = Block(lanes)
    block.run(len(ids), lanes, steps, ids)
    words, sizes = block.finished()
    flat = words.T.astype("<u2")[np.arange(len(words)) < sizes[:, None]]
    return zlib.crc32(ids.astype("<u4").tobytes()).to_bytes(4, "little") + sizes.astype("<u4").tobytes() + flat.tobytes()


def decode(data: bytes, n: int) -> np.ndarray:
    """The ids of a block; a ValueError where they don't have its checksum."""
    lanes, steps = shape(n)
    sizes = np.frombuffer(data, "<u4", lanes, 4).astype(_I)
    flat = np.frombuffer(data, "<u2", -1, 4 + 4 * lanes)
    if len(flat) != sizes.sum() or sizes.min() < 3:
        raise ValueError("a block is damaged")
    words = np.zeros((lanes, int(sizes.max()) + steps + 4), np.uint16)
    words[np.arange(words.shape[1]) < sizes[:, None]] = flat
    found = Block(lanes, np.ascontiguousarray(words.T)).run(n, lanes, steps, None).astype("<u4")
    if zlib.crc32(found.tobytes()) != int.from_bytes(data[:4], "little"):
        raise ValueError("a block is damaged")
    return found
