"""Periodic runs of words: stretches that repeat themselves with some period, and texts without the repeats.

A run is a maximal stretch of consecutive words with smallest period ``q`` and a length of at least
``max(shortest, 3 * q)``.

*Internal pattern matching.*  The words of a text are sorted into a suffix order by prefix doubling; suffixes that
share their first ``2**k`` words are one range of it at every ``k``.  A wavelet matrix over that order answers which
positions of a range lie in a window of the text, in as many steps as a position has bits, for all questions at once.
A run of period ``q`` holds an aligned block of ``B`` words, ``B <= q < 2 * B`` (``B = 8`` for all shorter periods),
that occurs again ``q`` words on.  So every aligned block asks for its occurrences in ``[i + B, i + 2 * B)``
(``[i + 1, i + 16)`` for blocks of 8).  The answers are terms of arithmetic progressions; each is a candidate period,
kept where two overlapping blocks show a square, and extended word by word both ways.  A block inside a run found
already asks only for what lies behind that run, since nearer terms are multiples of its period.

Work stays inside the row: no shuffle, and a text holds a task only for ``n log n`` steps.  Memory for a text of ``n``
words is some ``20 * n`` bytes and ``4 * n`` for each doubling after the eighth word at which blocks still repeat.

Null text has no words.  Empty, blank and short texts have no run.  Repeated rows and rows with equal or null ids are
judged one by one, each by its own text.  Extra columns may have any names; those in ``carry`` come along and give way
to the four own columns.  Ties for the best run: smallest start, then period.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import documents, ship, texts

SHORTEST = 24
BLOCK = 8  # a third of SHORTEST: what a run of any shorter period holds twice
AT_ONCE = 1 << 20

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def suffix_order(ids: np.ndarray, least: int = BLOCK) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """A suffix order of ``ids`` and, per block length from ``least`` on, the place where each suffix's range begins
    and all such places; lengths at which nothing repeats are left out."""
    n = len(ids)
    rank, span, levels = np.asarray(ids, np.int64), 0, {}
    while True:
        if span:
            key = rank * (n + 1)
            key[:n - span] += rank[span:] + 1
        else:
            key = rank
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        begins = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(begins, np.diff(np.append(begins, n)))
        span = 2 * span or 1
        if len(begins) == n:
            return order, levels
        if span >= least:
            levels[span] = rank.astype(np.int32 if n < 1 << 31 else np.int64), begins
        if 2 * span > n:
            return order, levels


class Wavelet:
    """A wavelet matrix over numbers below ``size``; answers come for arrays of ranges."""

    def __init__(self, values: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        self.rows = []
        for b in reversed(range(self.bits)):
            bit = ((values >> b) & 1).astype(np.uint8)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(bit) // 64 + 1, "<u8")
            words.view(np.uint8)[:len(packed)] = packed
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
            self.rows.append((b, words, before, len(bit) - int(before[-1])))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[at >> 6] + np.bitwise_count(words[at >> 6] & mask)

    def below(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many numbers of each range are less than its limit."""
        found = np.where(limit >> self.bits > 0, right - left, 0)
        for b, words, before, zeros in self.rows:
            l1, r1 = self._ones(words, before, left), self._ones(words, before, right)
            up = (limit >> b) & 1 == 1
            found = np.where(up & (limit >> self.bits == 0), found + (right - r1) - (left - l1), found)
            left, right = np.where(up, zeros + l1, left - l1), np.where(up, zeros + r1, right - r1)
        return found

    def nth(self, left: np.ndarray, right: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The ``n``-th least number of each range, from 0."""
        value = np.zeros(len(left), np.int64)
        for b, words, before, zeros in self.rows:
            l1, r1 = self._ones(words, before, left), self._ones(words, before, right)
            low = (right - r1) - (left - l1)
            up = n >= low
            n = np.where(up, n - low, n)
            left, right = np.where(up, zeros + l1, left - l1), np.where(up, zeros + r1, right - r1)
            value |= up.astype(np.int64) << b
        return value


def _reach(ids: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from ``a`` and ``b`` (later) agree, forwards, or backwards before them."""
    room, done, size = (len(ids) - b if step > 0 else a), 0, 64
    while done < room:
        size = min(size, room - done)
        x, y = (ids[a + done:a + done + size], ids[b + done:b + done + size]) if step > 0 else (
            ids[a - done - size:a - done][::-1], ids[b - done - size:b - done][::-1])
        differ = x != y
        if differ.any():
            return done + int(differ.argmax())
        done += size
        size *= 4
    return done


def _primitive(ids: np.ndarray, start: int, period: int) -> bool:
    """Whether no part of ``period`` is a period of the stretch."""
    root, left, f = ids[start:start + period], period, 2
    while left > 1:
        if left % f:
            f = f + 1 if f * f <= left else left
            continue
        while left % f == 0:
            left //= f
        p = period // f
        if (root[p:] == root[:-p]).all():
            return False
    return True


def _repeats(ids: np.ndarray, size: int) -> bool:
    """Whether some ``size`` (a power of two) words may occur twice; never False when they do."""
    h, span = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019), 1
    while span < size:
        h = (h[:-span] ^ (h[:-span] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[span:]
        span *= 2
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def find_runs(ids: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """All runs of a sequence of word numbers as (start, length, period), by start, then period."""
    if shortest < 3 * BLOCK:
        raise ValueError(f"shortest must be {3 * BLOCK} or more")
    n = len(ids)
    if n < shortest or not _repeats(ids, BLOCK):
        return []
    order, levels = suffix_order(ids)
    tree = Wavelet(order, n)
    runs: list[tuple[int, int, int]] = []
    for block, (rank, begins) in levels.items():
        if 3 * block > n and block > BLOCK:
            break
        at = np.arange(0, n - block + 1, block)
        left = rank[at].astype(np.int64)
        right = np.append(begins, n)[np.searchsorted(begins, left, "right")]
        first = at + (block if block > BLOCK else 1)
        for s, size, q in runs:
            if q <= block:
                inside = slice(-(-s // block), (s + size - block) // block + 1)
                first[inside] = np.maximum(first[inside], s + size - block + 1)
        some = np.flatnonzero((right - left > 1) & (first < at + 2 * block))
        at, left, right, first = at[some], left[some], right[some], first[some]
        low = tree.below(left, right, first)
        many = tree.below(left, right, at + 2 * block) - low
        found = []
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(many) // AT_ONCE)) + 1).tolist(), len(many)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            times = many[a:b]
            terms = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            i = np.repeat(at[a:b], times)
            d = tree.nth(np.repeat(left[a:b], times), np.repeat(right[a:b], times), np.repeat(low[a:b], times) + terms) - i
            square = (i + 2 * d <= n)
            i, d = i[square], d[square]
            tail = np.maximum(i + d - block, i)
            square = (d <= block) | (rank[tail] == rank[np.minimum(tail + d, n - 1)])
            found.append(np.stack((d[square], i[square])))
        candidates = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        candidates = candidates[:, np.lexsort(candidates[::-1])]
        last = (0, 0, 0)  # period, start and end of the stretch seen last
        for d, i in zip(*candidates.tolist(), strict=True):
            if last[0] == d and i + d <= last[2]:
                continue
            start = i - _reach(ids, i, i + d, -1)
            stop = i + d + _reach(ids, i, i + d, 1)
            last = (d, start, stop)
            if stop - start >= max(shortest, 3 * d) and _primitive(ids, start, d):
                runs.append((start, stop - start, d))
    return sorted(set(runs), key=lambda r: (r[0], r[2]))


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run that repeats itself most often, exactly; ties: smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST,
                  carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, runs`` (all runs, by start, then period)``, best`` (the run of the greatest length by period)``,
    collapsed`` (the words that stay), and the columns of ``carry``."""
    ship(docs.sparkSession)
    own = ("doc_id", "runs", "best", "collapsed")
    carry = tuple(c for c in carry if c not in own)
    rows = documents(docs, id_col, text_col, carry)
    others = rows.schema.fields[2:]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("best", RUN),
                           T.StructField("collapsed", T.StringType()), *others])
    run_type = pa.struct([(n, pa.int64()) for n in RUN.names])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, best, kept = [], [], []
            for text in texts(batch.column(1)):
                words = text.split()
                number = {w: i for i, w in enumerate(dict.fromkeys(words))}
                runs = find_runs(np.fromiter(map(number.__getitem__, words), np.int64, len(words)), shortest) if len(words) >= shortest else []
                found.append([dict(zip(RUN.names, r, strict=True)) for r in runs])
                top = best_run(runs)
                best.append(top and dict(zip(RUN.names, top, strict=True)))
                kept.append(collapse(words, runs))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(run_type)), pa.array(best, run_type), pa.array(kept, pa.binary()).cast(pa.string()),
                 *batch.columns[2:]], names=schema.names)

    return rows.mapInArrow(judge, schema).select(*own, *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)])
