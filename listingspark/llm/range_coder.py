"""Adaptive context-mixing range coder for blocks of token ids.

A block is coded by many lanes in step: each lane takes a contiguous run of the block, and all lanes
share one model, so every step codes one id per lane with whole-array arithmetic.  The model mixes
three predictions of the next id: the follower last seen after the two ids before it (order 2), after
the one id before it (order 1), and the counts of all ids so far (order 0).  How much each prediction
is trusted is learnt per pair of their confidences.  The model starts anew in each block, so a block
can be read without any other; the arithmetic is integer only, so every machine reads the same ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES = 16384
LANE_IDS = 64
_TOP, _BOT = np.uint64(1 << 48), np.uint64(1 << 32)
_SIXTEEN, _FORTY_EIGHT, _SLOT_BITS = np.uint64(16), np.uint64(48), np.uint64(10)
_SLOTS = 1 << 10
_CONTEXTS = 1 << 17
_HEAD = struct.Struct("<IIIII")  # ids, lanes, bytes of body, crc32 of ids, crc32 of body


class Model:
    """Shared state of one block."""

    def __init__(self, n_ids: int, lanes: int):
        self.n_ids = n_ids
        self.counts, self.below = np.ones(n_ids, np.int64), np.zeros(n_ids + 1, np.int64)
        self.every = np.arange(n_ids, dtype=np.uint16 if n_ids <= 1 << 16 else np.int32)
        self.add = max(16, min(4096, n_ids // 64) // max(1, lanes // 64))
        self.one, self.one_sure = np.zeros(n_ids, np.int32), np.zeros(n_ids, np.int16)
        self.two, self.two_sure = np.zeros(_CONTEXTS, np.int32), np.zeros(_CONTEXTS, np.int16)
        self.trust = np.tile(np.array([8, 1, 1], np.int64), (64, 1))
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self._sum()

    def _sum(self) -> None:
        if self.counts.sum() > 1 << 20:
            self.counts = (self.counts + 1) >> 1
        np.cumsum(self.counts, out=self.below[1:])
        self.total = np.uint64(self.below[-1])
        total = self.trust.sum(1, keepdims=True)
        share = 1 + self.trust * (_SLOTS - 3) // total
        share[:, 0] += _SLOTS - share.sum(1)
        self.share = share.astype(np.uint64).ravel()
        self.start = (np.cumsum(share, axis=1) - share).astype(np.uint64).ravel()

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids predicted by order 2 and order 1, and the row of the mixing table, per lane."""
        self.at = (self.before * 40503 ^ self.last * 8191) & (_CONTEXTS - 1)
        self.p2, self.p1 = self.two.take(self.at), self.one.take(self.last)
        self.s2, self.s1 = self.two_sure.take(self.at), self.one_sure.take(self.last)
        self.row = (self.s2 * 24 + self.s1 * 3).astype(np.int64)
        return self.p2, self.p1, self.row

    def learn(self, ids: np.ndarray, slots: np.ndarray) -> None:
        self._follow(self.two, self.two_sure, self.at, self.p2, self.s2, ids)
        self._follow(self.one, self.one_sure, self.last, self.p1, self.s1, ids)
        self.trust += np.bincount(slots, minlength=192).reshape(64, 3) * 4
        if self.trust.max() > 1 << 16:
            self.trust = (self.trust + 1) >> 1
        self.counts += np.bincount(ids, minlength=self.n_ids) * self.add
        self.before, self.last = self.last, ids
        self._sum()

    def id_at(self, value: np.ndarray) -> np.ndarray:
        """The id whose share of the order-0 counts holds ``value``."""
        return np.repeat(self.every, self.counts).take(value).astype(np.int64)

    @staticmethod
    def _follow(ids_of: np.ndarray, sure_of: np.ndarray, at: np.ndarray, said: np.ndarray, sure: np.ndarray, ids: np.ndarray) -> None:
        hit = said == ids
        ids_of[at] = np.where(hit | (sure > 0), said, ids)
        sure_of[at] = np.where(hit, np.minimum(sure + 1, 7), sure >> 1)


def lanes_of(n: int) -> int:
    return min(LANES, max(1, n // LANE_IDS))


def encode_block(ids: np.ndarray, n_ids: int) -> bytes:
    """One block: its head, with checksums of the ids and of the coded bytes, and its body."""
    n = len(ids)
    lanes = lanes_of(n)
    steps = -(-n // lanes)
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = Model(n_ids, lanes)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, np.uint64(0xFFFFFFFFFFFFFFFF))
    lane_out, word_out = [], []
    for s in grid:
        p2, p1, row = model.predict()
        slots = np.where(s == p2, 2, s == p1)
        rest = np.flatnonzero(slots == 0)
        slots += row
        width >>= _SLOT_BITS
        low += model.start.take(slots) * width
        width *= model.share.take(slots)
        part, ids_rest = width.take(rest) // model.total, s.take(rest)
        low[rest] += model.below.take(ids_rest).view(np.uint64) * part
        width[rest] = part * model.counts.take(ids_rest).view(np.uint64)
        model.learn(s, slots)
        act = np.arange(lanes, dtype=np.uint16)
        lo, wd = low, width
        while True:
            settled = (lo ^ (lo + wd)) < _TOP
            need = settled | (wd < _BOT)
            act = act[need]
            if not len(act):
                break
            lo = lo[need]
            wd = np.where(settled[need], wd[need], (-lo) & (_BOT - np.uint64(1))) << _SIXTEEN
            lane_out.append(act)
            word_out.append((lo >> _FORTY_EIGHT).astype("<u2"))
            lo = lo << _SIXTEEN
            low[act], width[act] = lo, wd
    for _ in range(4):
        lane_out.append(np.arange(lanes, dtype=np.uint16))
        word_out.append((low >> _FORTY_EIGHT).astype("<u2"))
        low = low << _SIXTEEN
    lane, word = np.concatenate(lane_out), np.concatenate(word_out)
    body = np.bincount(lane, minlength=lanes).astype("<u4").tobytes() + word[np.argsort(lane, kind="stable")].tobytes()
    return _HEAD.pack(n, lanes, len(body), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


def decode_block(head: bytes, body: bytes, n_ids: int) -> np.ndarray:
    """The ids of a block; a damaged block raises ``ValueError``."""
    n, lanes, _, ids_crc, body_crc = _HEAD.unpack(head)
    if zlib.crc32(body) != body_crc:
        raise ValueError("token block is damaged: checksum of its bytes")
    steps = -(-n // lanes)
    sizes = np.frombuffer(body, "<u4", lanes).astype(np.int64)
    words = np.concatenate((np.frombuffer(body, "<u2", offset=4 * lanes).astype(np.uint64), np.zeros(1, np.uint64)))
    at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    code = np.zeros(lanes, np.uint64)
    for _ in range(4):
        code = code << _SIXTEEN | words[at]
        at += 1
    model = Model(n_ids, lanes)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, np.uint64(0xFFFFFFFFFFFFFFFF))
    grid = np.empty((steps, lanes), np.int64)
    last_slot = np.uint64(_SLOTS - 1)
    for t in range(steps):
        p2, p1, row = model.predict()
        width >>= _SLOT_BITS
        value = np.minimum((code - low) // width, last_slot)
        slots = (value >= model.start.take(row + 1)).astype(np.int64) + (value >= model.start.take(row + 2))
        s = np.where(slots == 2, p2, p1).astype(np.int64)
        rest = np.flatnonzero(slots == 0)
        slots += row
        low += model.start.take(slots) * width
        width *= model.share.take(slots)
        part = width.take(rest) // model.total
        value = np.minimum((code.take(rest) - low.take(rest)) // part, model.total - np.uint64(1)).astype(np.int64)
        found = s[rest] = model.id_at(value)
        low[rest] += model.below.take(found).view(np.uint64) * part
        width[rest] = part * model.counts.take(found).view(np.uint64)
        model.learn(s, slots)
        grid[t] = s
        act = np.arange(lanes)
        lo, wd = low, width
        while True:
            settled = (lo ^ (lo + wd)) < _TOP
            need = settled | (wd < _BOT)
            act = act[need]
            if not len(act):
                break
            lo = lo[need]
            wd = np.where(settled[need], wd[need], (-lo) & (_BOT - np.uint64(1))) << _SIXTEEN
            code[act] = code[act] << _SIXTEEN | words[np.minimum(at[act], len(words) - 1)]
            at[act] += 1
            lo = lo << _SIXTEEN
            low[act], width[act] = lo, wd
    ids = grid.T.reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("token block is damaged: checksum of its ids")
    return ids


def head_size() -> int:
    return _HEAD.size


def body_size(head: bytes) -> int:
    return _HEAD.unpack(head)[2]
