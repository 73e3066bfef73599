"""Adaptive context-mixing range coder for token ids, in independently reset, checksummed blocks.

A block's ids are cut into lanes of equal length that are coded side by side, one id of every lane a step, with one
model that all lanes share and that learns after each step. Three predictions are mixed for every id: order 2 and order 1
each put their mass on the id that last followed their context, order 0 is a frequency for every id. How far each context
has been right lately, and whether both agree, selects a cell; what the cell's predictions have earned so far are the
weights of the mixture. One arithmetic coding step writes the id by the mixture's cumulative frequencies. Encoder and
decoder do the same integer arithmetic, so what one writes the other reads.

Layout of a block (little-endian): magic, lanes, ids, alphabet, CRC-32 of the payload, CRC-32 of the ids as unsigned
32-bit integers; then the payload: one 32-bit length per lane and the lanes' 16-bit words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CMR2"
HEADER = struct.Struct("<4sIQIII")
MAX_LANES, LANE_IDS = 8192, 128
#: Order-2 contexts are hashed to this many slots.
SLOT_BITS = 19
LEVEL_BITS = 3
LEVELS = 1 << LEVEL_BITS
#: Weights of a cell add up to 2^WEIGHT_BITS, order-0 frequencies to 2^SUM_BITS; an id's coding interval has their product.
WEIGHT_BITS, SUM_BITS = 12, 18
STEP, EVERY = 32, 4
MASS, SCALE = np.int64(1 << SUM_BITS), np.uint64(WEIGHT_BITS + SUM_BITS)
FLOOR = np.uint64(1 << 32)
LOW32 = np.uint64((1 << 32) - 1)
ONE, U16, U48 = np.uint64(1), np.uint64(16), np.uint64(48)


class Model:
    """The mixture for one step of all lanes, and what it learns from the ids."""

    def __init__(self, alphabet: int):
        if not 0 < alphabet <= 1 << (SUM_BITS - 1):
            raise ValueError(f"alphabets have 1 to {1 << (SUM_BITS - 1)} ids")
        # an id and its level in one number, so that a context is one place in memory
        self.two, self.one = np.zeros(1 << SLOT_BITS, np.int32), np.zeros(alphabet, np.int32)
        self.counts = np.ones(alphabet, np.int64)
        self.cells = np.ones((LEVELS * LEVELS * 2, 3), np.int64)
        self.steps = 0
        self._refresh()

    def _refresh(self) -> None:
        """Integer weights and order-0 sums from the counts; done every EVERY steps, on both sides."""
        sums = np.concatenate([[0], np.cumsum(self.counts)])
        alphabet = len(self.counts)
        self.sums = sums * ((1 << SUM_BITS) - alphabet) // sums[-1] + np.arange(alphabet + 1)
        self.size = np.diff(self.sums)
        self.at_sum = None  # the id at every sum, made when a decoder asks
        share = self.cells * ((1 << WEIGHT_BITS) - 3) // self.cells.sum(1, keepdims=True) + 1
        self.of_two, self.of_one = share[:, 0] << SUM_BITS, share[:, 1] << SUM_BITS
        self.of_all = (1 << WEIGHT_BITS) - share[:, 0] - share[:, 1]

    def predict(self, before: np.ndarray, last: np.ndarray) -> None:
        self.slot = ((last * 0x9E3779B1 + before * 0x85EBCA77) & 0xFFFFFFFF) >> (32 - SLOT_BITS)
        self.last = last
        two, one = (table.take(at).astype(np.int64) for table, at in ((self.two, self.slot), (self.one, last)))
        self.guess2, self.guess1 = two >> LEVEL_BITS, one >> LEVEL_BITS
        self.level2, self.level1 = two & (LEVELS - 1), one & (LEVELS - 1)
        self.same = self.guess2 == self.guess1
        self.cell = ((self.level2 << LEVEL_BITS) + self.level1) * 2 + self.same
        self.w2, self.w1, self.w0 = self.of_two.take(self.cell), self.of_one.take(self.cell), self.of_all.take(self.cell)

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cumulative frequency below, frequency) of each lane's id in its mixture."""
        below = self.w0 * self.sums.take(ids) + self.w2 * (self.guess2 < ids) + self.w1 * (self.guess1 < ids)
        return below, self.w0 * self.size.take(ids) + self.w2 * (self.guess2 == ids) + self.w1 * (self.guess1 == ids)

    def find(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, cumulative frequencies below, frequencies) of the intervals that hold each lane's place."""
        if self.at_sum is None:
            self.at_sum = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        two, one, w0, w1, w2 = self.guess2, self.guess1, self.w0, self.w1, self.w2
        low2, low1 = w0 * self.sums.take(two) + w1 * (one < two), w0 * self.sums.take(one) + w2 * (two < one)
        share2, share1 = w0 * self.size.take(two) + w2 + w1 * self.same, w0 * self.size.take(one) + w1 + w2 * self.same
        from2, from1 = place - low2, place - low1
        in_two = (from2 >= 0) & (from2 < share2)
        out, below, share = np.where(in_two, two, one), np.where(in_two, low2, low1), np.where(in_two, share2, share1)
        rest = np.nonzero(~(in_two | ((from1 >= 0) & (from1 < share1))))[0]
        if len(rest):
            past = (from2.take(rest) > 0) * w2.take(rest) + (from1.take(rest) > 0) * w1.take(rest)
            w0 = w0.take(rest)
            found = self.at_sum.take((place.take(rest) - past) // w0)
            out[rest] = found
            below[rest], share[rest] = w0 * self.sums.take(found) + past, w0 * self.size.take(found)
        return out, below, share

    def learn(self, ids: np.ndarray) -> None:
        hit2, hit1 = self.guess2 == ids, self.guess1 == ids
        missed = ~(hit2 | hit1)
        earner = np.where(hit2, 0, 1 + missed)
        self.cells += np.bincount(self.cell * 3 + earner, minlength=self.cells.size).reshape(self.cells.shape)
        np.add.at(self.counts, ids[missed], STEP)
        for table, at, guess, level, hit in ((self.two, self.slot, self.guess2, self.level2, hit2), (self.one, self.last, self.guess1, self.level1, hit1)):
            kept = np.where(hit | (level > 1), guess, ids) << LEVEL_BITS
            table[at] = kept + np.where(hit, np.minimum(level + 1, LEVELS - 1), level >> 1)
        self.steps += 1
        if self.steps % EVERY == 0:
            self._refresh()


def _settled(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Lanes whose next word is decided, or whose interval has become too small."""
    return (((low ^ (low + size)) >> U48) == 0) | (size < FLOOR)


def _shifted(lo: np.ndarray, sz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low ends and sizes one word further on; an interval across a border is cut at it."""
    across = ((lo ^ (lo + sz)) >> U48) != 0
    return lo << U16, np.where(across, (~lo + ONE) & LOW32, sz) << U16


def encode_block(ids: np.ndarray, alphabet: int) -> bytes:
    """One block. ``ids``: integers in [0, alphabet)."""
    n = len(ids)
    lanes = int(min(MAX_LANES, max(1, n // LANE_IDS)))
    steps = -(-n // lanes)
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = Model(alphabet)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    words, used = np.zeros((steps * 2 + 8, lanes), np.uint16), np.zeros(lanes, np.int64)
    before = last = np.zeros(lanes, np.int64)
    for t in range(steps):
        now = grid[t]
        model.predict(before, last)
        below, share = model.interval(now)
        unit = size >> SCALE
        low += unit * below.view(np.uint64)
        size = unit * share.view(np.uint64)
        todo = np.nonzero(_settled(low, size))[0]
        while len(todo):
            lo, sz = low[todo], size[todo]
            if used[todo].max() >= len(words):
                words = np.concatenate([words, np.zeros_like(words)])
            words[used[todo], todo] = lo >> U48
            used[todo] += 1
            lo, sz = _shifted(lo, sz)
            low[todo], size[todo] = lo, sz
            todo = todo[_settled(lo, sz)]
        model.learn(now)
        before, last = last, now
    end = low + LOW32
    for shift in (48, 32):
        if used.max(initial=0) >= len(words):
            words = np.concatenate([words, np.zeros_like(words)])
        words[used, np.arange(lanes)] = (end >> np.uint64(shift)).astype(np.uint16)
        used += 1
    words = words[: used.max()]
    filled = np.arange(len(words))[None, :] < used[:, None]
    payload = used.astype("<u4").tobytes() + np.ascontiguousarray(words.T)[filled].astype("<u2").tobytes()
    plain = np.asarray(ids).astype("<u4").tobytes()
    return HEADER.pack(MAGIC, lanes, n, alphabet, zlib.crc32(payload), zlib.crc32(plain)) + payload


def decode_block(data: bytes) -> np.ndarray:
    """The ids of one block (uint32). Raises ValueError where a checksum doesn't hold."""
    magic, lanes, n, alphabet, payload_crc, ids_crc = HEADER.unpack_from(data)
    payload = memoryview(data)[HEADER.size :]
    if magic != MAGIC or zlib.crc32(payload) != payload_crc:
        raise ValueError("damaged block")
    used = np.frombuffer(payload, "<u4", lanes).astype(np.int64)
    flat = np.concatenate([np.frombuffer(payload, "<u2", offset=4 * lanes), np.zeros(4, "<u2")])
    ends = np.cumsum(used)
    at = ends - used
    steps = -(-n // lanes)
    grid = np.zeros((steps, lanes), np.int64)
    model = Model(alphabet)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    code = np.zeros(lanes, np.uint64)
    before = last = np.zeros(lanes, np.int64)

    def take(which) -> np.ndarray:
        k = at[which]
        at[which] = k + 1
        return np.where(k < ends[which], flat[np.minimum(k, len(flat) - 1)], np.uint16(0)).astype(np.uint64)

    everyone = np.arange(lanes)
    for _ in range(4):
        code = (code << U16) | take(everyone)
    for t in range(steps):
        model.predict(before, last)
        unit = size >> SCALE
        now, below, share = model.find(((code - low) // unit).astype(np.int64))
        low += unit * below.view(np.uint64)
        size = unit * share.view(np.uint64)
        todo = np.nonzero(_settled(low, size))[0]
        while len(todo):
            code[todo] = (code[todo] << U16) | take(todo)
            lo, sz = _shifted(low[todo], size[todo])
            low[todo], size[todo] = lo, sz
            todo = todo[_settled(lo, sz)]
        model.learn(now)
        grid[t] = now
        before, last = last, now
    ids = np.ascontiguousarray(grid.T).reshape(-1)[:n].astype("<u4")
    if zlib.crc32(ids.tobytes()) != ids_crc:
        raise ValueError("damaged block")
    return ids
