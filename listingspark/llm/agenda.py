"""Merging of neighbouring symbols by rank, for many words at once.

A word is a row of symbols.  Its agenda holds the neighbours that may be merged; the one of least rank, and of these the
leftmost, leaves it first, and the new symbol may be merged with its own neighbours.  All words of one size take their
next step together: a step is a handful of array operations over the words that aren't done yet, so a word costs the same
whether it was seen before or not, and memory depends on the batch alone.

With ``gaps`` candidates are skipped: a word's number is how many candidates are merged before one is passed over, which
then stays unmerged until a neighbour changes; after each skip the word's key is hashed on to draw the next number.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

LONGEST = 256  # symbols of a word that is merged here
SIZES = (4, 6, 8, 10, 13, 16, 20, 28, 48, 96, LONGEST)
AT_ONCE = 1 << 18  # symbols
_NONE = np.int32(0x7FFFFFFF)
_MIX = np.uint64(0x9E3779B97F4A7C15)

Draw = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


class Pairs:
    """Which neighbours may be merged: a hash table over pairs of symbols with open places."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray, symbols: int):
        if len(rank) and int(rank.max()) >= 1 << 22:
            raise ValueError("at most 4,194,304 ranks")
        self.symbols = np.int64(symbols)
        self.rank = np.append(rank, 0).astype(np.int32)
        self.merged = np.append(merged, -1).astype(np.int32)
        bits = max(4, (4 * len(left)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, len(left), np.int32)
        key = left.astype(np.int64) * self.symbols + right
        waiting, at = np.arange(len(key)), self._slot(key)
        while len(waiting):
            free = waiting[self.keys[at[waiting]] < 0]
            place, first = np.unique(at[free], return_index=True)
            self.keys[place], self.values[place] = key[free[first]], free[first]
            waiting = waiting[self.keys[at[waiting]] != key[waiting]]
            at[waiting] = (at[waiting] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The number of each pair, or the last one for no pair; symbols below zero have none."""
        key = left.astype(np.int64) * self.symbols + right
        at = self._slot(key)
        there = self.keys[at]
        out = self.values[at]
        odd = np.flatnonzero((there != key) & (there >= 0))
        missing = there < 0
        while len(odd):
            at[odd] = (at[odd] + 1) & self.mask
            there = self.keys[at[odd]]
            out[odd] = self.values[at[odd]]
            missing[odd[there < 0]] = True
            odd = odd[(there != key[odd]) & (there >= 0)]
        none = np.int32(len(self.rank) - 1)
        out[missing | (left < 0) | (right < 0)] = none
        return out


def merge(pairs: Pairs, flat: np.ndarray, lens: np.ndarray, gaps: np.ndarray | None = None, keys: np.ndarray | None = None,
          draw: Draw | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Merge the words that lie in ``flat`` one behind the other, in place.

    Returns which places still hold a symbol, and the number of candidates of each word.  Words of over ``LONGEST``
    symbols are left alone.
    """
    starts = np.cumsum(lens) - lens
    alive = np.ones(len(flat), bool)
    candidates = np.zeros(len(lens), np.int64)
    low = 1
    for size in SIZES:
        words = np.flatnonzero((lens > low) & (lens <= size))
        low = size
        for a in range(0, len(words), max(1, AT_ONCE // size)):
            some = words[a:a + max(1, AT_ONCE // size)]
            _merge(pairs, flat, alive, candidates, some, starts[some], lens[some], size,
                   None if gaps is None else gaps[some].copy(), None if keys is None else keys[some].copy(), draw)
    return alive, candidates


def _merge(pairs: Pairs, flat, alive, candidates, words, starts, lens, size, gaps, keys, draw) -> None:
    rank, merged, none = pairs.rank, pairs.merged, len(pairs.rank) - 1
    column = np.arange(size)[:, None]  # below, all tables are in C order, a row for each place in the word
    inside = column < lens
    place = np.where(inside, starts + column, 0)
    symbols = np.where(inside, flat[place], -1)
    entry = pairs.find(symbols[:-1].ravel(), symbols[1:].ravel()).reshape(size - 1, -1)
    order = np.where(entry == none, _NONE, rank[entry] << 8 | column[:-1].astype(np.int32))
    after = np.repeat(np.arange(1, size + 1, dtype=np.int16)[:, None], len(words), axis=1)
    before = after - np.int16(2)

    def leave(which: np.ndarray) -> None:
        cells = inside[:, which]
        flat[place[:, which][cells]] = symbols[:, which][cells]
        alive[place[:, which][cells]] = symbols[:, which][cells] != -2

    while True:
        n = symbols.shape[1]
        best = np.minimum.reduce(order, axis=0)
        going = best != _NONE
        act = np.flatnonzero(going)
        if 4 * len(act) < 3 * n:  # words that are done make room
            leave(np.flatnonzero(~going))
            if not len(act):
                return
            words, lens, inside, place, symbols, entry, order, after, before = (
                words[act], lens[act], *(np.take(x, act, axis=1) for x in (inside, place, symbols, entry, order, after, before)))
            if gaps is not None:
                gaps, keys = gaps[act], keys[act]
            best, n = best[act], len(act)
            act = np.arange(n)
        candidates[words[act]] += 1
        c = (best[act] & 255).astype(np.int64)
        if gaps is not None:
            skip = gaps[act] == 0
            gaps[act] -= 1
            passed = act[skip]
            if len(passed):
                order.ravel()[c[skip] * n + passed] = _NONE
                keys[passed], gaps[passed] = draw(keys[passed])
                act, c = act[~skip], c[~skip]
        at = c * n + act
        s, o, e, f, b = symbols.ravel(), order.ravel(), entry.ravel(), after.ravel(), before.ravel()
        j = f[at].astype(np.int64)
        new = merged[e[at]]
        right = f[j * n + act].astype(np.int64)
        s[at] = new
        s[j * n + act] = -2
        inner = j < size - 1
        o[j[inner] * n + act[inner]] = _NONE
        f[at] = right
        left = b[at].astype(np.int64)
        r = right < lens[act]
        b[right[r] * n + act[r]] = c[r]
        h = left >= 0
        found = pairs.find(np.concatenate((new[r], s[left[h] * n + act[h]])), np.concatenate((s[right[r] * n + act[r]], new[h])))
        spot = np.concatenate((c[r] * n + act[r], left[h] * n + act[h]))
        where = np.concatenate((c[r], left[h])).astype(np.int32)
        last = at[~r]
        o[last[last < len(o)]] = _NONE
        e[spot] = found
        o[spot] = np.where(found == none, _NONE, rank[found] << 8 | where)
