"""Arithmetic coding of token ids under an adaptive mix of order-0, order-1 and order-2 predictions.

A block is coded on its own from an empty model. It is cut into lanes, stretches coded in step:
at every step each lane codes one id, and then the model, shared by all lanes, learns all of
them. A lane has its own range coder, so a step is a handful of array operations.

The model of one id: the order-2 context (a hash of the two ids before) and the order-1 context
(the id before) each predict one id, with a confidence that grows when they were right. How far
each is trusted is learned per pair of confidences, as counts of "order 2 right", "order 1 right",
"neither"; these weights mix the two with the order-0 frequencies of all ids, which code the rest.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 1 << 20
LANES = 8192
SLOTS = 1 << 18  # the order-2 hash keeps the top 18 bits
STEP = np.uint64(16)
TRUST_BITS = 15
LEARN_EVERY = 4

_TOP, _LOW = np.uint64(1 << 48), np.uint64(1 << 32)
_MASK = np.uint64((1 << 48) - 1)
_WORD = np.uint64(16)
_HEAD = struct.Struct("<IIII")


class CorruptBlock(ValueError):
    """A block whose checksum or size does not agree."""


class _Model:
    def __init__(self, vocabulary: int):
        self.v = vocabulary
        self.count = np.ones(vocabulary, np.uint64)
        self.guess1, self.sure1 = np.full(vocabulary, -1, np.int64), np.zeros(vocabulary, np.int8)
        self.guess2, self.sure2 = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, np.int8)
        self.trust = np.tile(np.array([1, 1, 2], np.int64), (32, 1))
        self.steps = 0

    def begin(self) -> None:
        """Tables that hold for a step."""
        if self.steps % LEARN_EVERY == 0:
            self.sums = np.zeros(self.v + 1, np.uint64)
            np.cumsum(self.count, out=self.sums[1:])
            self.frozen, self.total = self.count.copy(), self.sums[-1]
        self.steps += 1
        share = self.trust[:, :2] * ((1 << TRUST_BITS) - 3) // self.trust.sum(axis=1, keepdims=True) + 1
        self.edges = np.zeros((32, 4), np.uint64)
        self.edges[:, 1:3] = np.cumsum(share, axis=1)
        self.edges[:, 3] = 1 << TRUST_BITS

    def predict(self, one: np.ndarray, two: np.ndarray) -> None:
        self.one = one
        mixed = two.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + one.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        self.slot = (mixed >> np.uint64(46)).astype(np.int64)
        self.p1, self.p2 = self.guess1.take(one), self.guess2.take(self.slot)
        self.c1, self.c2 = self.sure1.take(one), self.sure2.take(self.slot)
        self.row = (self.c2.astype(np.int64) << 3) + (self.c1 << 1) + (self.p1 == self.p2)

    def kinds(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids == self.p2, 0, np.where(ids == self.p1, 1, 2))

    def learn(self, ids: np.ndarray, kinds: np.ndarray) -> None:
        np.add.at(self.count, ids, STEP)
        self.trust += np.bincount(self.row * 3 + kinds, minlength=96).reshape(32, 3)
        for at, guess, sure, p, c in (
            (self.one, self.guess1, self.sure1, self.p1, self.c1),
            (self.slot, self.guess2, self.sure2, self.p2, self.c2),
        ):
            right = ids == p
            guess[at] = np.where(right | (c > 0), p, ids)
            sure[at] = np.where(right, np.minimum(c + 1, 3), np.maximum(c - 1, 0))


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // 128))
    steps = -(-n // lanes)
    return -(-n // steps), steps


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    """One block: header (ids, payload bytes, checksums of both), lane sizes, coded words."""
    n = len(ids)
    if not n:
        return _HEAD.pack(0, 0, 0, 0)
    lanes, steps = _shape(n)
    padded = np.zeros(lanes * steps, np.int64)
    padded[:n] = ids
    grid = padded.reshape(lanes, steps)
    model = _Model(vocabulary)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, _TOP)
    digits = np.zeros((lanes, steps * 3 + 2), np.uint32)
    at = np.ones(lanes, np.int64)  # digit 0 stays free for a carry

    def put(who, start, size, total=None):
        lo, r = low[who], span[who]
        r = r >> np.uint64(TRUST_BITS) if total is None else r // total
        lo, r = lo + start * r, size * r
        over = np.flatnonzero(lo >= _TOP)
        if len(over):
            digits[who[over], at[who[over]] - 1] += 1
            lo[over] &= _MASK
        small = np.flatnonzero(r < _LOW)
        while len(small):
            rows = who[small]
            digits[rows, at[rows]] = lo[small] >> np.uint64(32)
            at[rows] += 1
            lo[small] = lo[small] << _WORD & _MASK
            r[small] <<= _WORD
            small = small[r[small] < _LOW]
        low[who], span[who] = lo, r

    everyone = np.arange(lanes)
    one, two = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    for s in range(steps):
        active = everyone[: -(-(n - s) // steps)]
        x, m = grid[active, s], len(active)
        model.begin()
        model.predict(one[:m], two[:m])
        kinds = model.kinds(x)
        start = model.edges[model.row, kinds]
        put(active, start, model.edges[model.row, kinds + 1] - start)
        rest = np.flatnonzero(kinds == 2)
        if len(rest):
            y = x[rest]
            put(active[rest], model.sums[y], model.frozen[y], model.total)
        model.learn(x, kinds)
        two[:m], one[:m] = one[:m].copy(), x
    low += np.uint64((1 << 32) - 1)  # any value of the last range will do: the one with fewest words
    over = low >= _TOP
    digits[everyone[over], at[over] - 1] += 1
    digits[everyone, at] = (low & _MASK) >> np.uint64(32)
    at += 1
    for column in range(int(at.max()) - 1, 0, -1):
        digits[:, column - 1] += digits[:, column] >> 16
    sizes = (at - 1).astype("<u4")
    body = digits[:, 1:][np.arange(digits.shape[1] - 1) < sizes[:, None]].astype("<u2")
    payload = sizes.tobytes() + body.tobytes()
    return _HEAD.pack(n, len(payload), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(payload)) + payload


def decode_block(data: memoryview, offset: int, vocabulary: int) -> tuple[np.ndarray, int]:
    """The ids of the block at ``offset`` and the offset behind it; raises ``CorruptBlock``."""
    n, size, ids_crc, payload_crc = _HEAD.unpack_from(data, offset)
    offset += _HEAD.size
    payload = data[offset:offset + size]
    if len(payload) != size or zlib.crc32(payload) != payload_crc:
        raise CorruptBlock("payload does not agree with its checksum")
    if not n:
        return np.zeros(0, np.uint32), offset
    lanes, steps = _shape(n)
    sizes = np.frombuffer(payload, "<u4", lanes).astype(np.int64)
    words = np.append(np.frombuffer(payload, "<u2", offset=4 * lanes).astype(np.uint64), np.uint64(0))
    ends = np.cumsum(sizes)
    at = ends - sizes

    def take(rows):
        here = at[rows]
        at[rows] = here + 1
        return words[np.where(here < ends[rows], here, len(words) - 1)]

    everyone = np.arange(lanes)
    code, span = np.zeros(lanes, np.uint64), np.full(lanes, _TOP)
    for _ in range(3):
        code = code << _WORD | take(everyone)
    model = _Model(vocabulary)
    grid = np.zeros((lanes, steps), np.int64)

    def settle(who, c, r):
        small = np.flatnonzero(r < _LOW)
        while len(small):
            c[small] = c[small] << _WORD | take(who[small])
            r[small] <<= _WORD
            small = small[r[small] < _LOW]
        code[who], span[who] = c, r

    one, two = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    for s in range(steps):
        active = everyone[: -(-(n - s) // steps)]
        m = len(active)
        model.begin()
        model.predict(one[:m], two[:m])
        edges = model.edges[model.row]
        c, r = code[:m].copy(), span[:m] >> np.uint64(TRUST_BITS)
        slot = c // r
        kinds = (slot >= edges[:, 1]).astype(np.int64) + (slot >= edges[:, 2])
        start = edges[active, kinds]
        settle(active, c - start * r, (edges[active, kinds + 1] - start) * r)
        x = np.where(kinds == 0, model.p2, model.p1)
        rest = np.flatnonzero(kinds == 2)
        if len(rest):
            who = active[rest]
            c, r = code[who], span[who] // model.total
            slot = np.minimum(c // r, model.total - np.uint64(1))
            y = np.searchsorted(model.sums, slot, side="right") - 1
            settle(who, c - model.sums[y] * r, model.frozen[y] * r)
            x[rest] = y
        model.learn(x, kinds)
        grid[active, s] = x
        two[:m], one[:m] = one[:m].copy(), x
    ids = grid.ravel()[:n].astype(np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise CorruptBlock("ids do not agree with their checksum")
    return ids, offset + size
