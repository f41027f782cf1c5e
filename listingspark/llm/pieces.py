"""SentencePiece (merge type) encoding with seeded merge-dropout, and decoding.

Pieces never hold a space after anything else, so a text splits into words with the spaces before them, and
each is segmented by an agenda: candidate merges of neighbours leave it by score, then from the left.  Each
candidate is skipped with the probability of the dropout, as if it were not there; later merges may propose
it anew with other neighbours.  Without dropout the ids are those of the library.

Skips are drawn for every word of every document on its own: a keyed hash of seed, document and place gives the
number of candidates before the next skip (a geometric draw, which is the same as one draw per candidate).  All words of a
batch take their steps together.  The path without skips is kept for words met lately, with its number of candidates, and
holds when the first skip lies beyond them; every other word runs its own agenda.  What is kept never changes a result.  The same
seed gives the same ids again on any cluster.

Characters without a piece become byte pieces, and so does the mark that pieces write for a space, so every
text decodes to itself.  Null text is the empty text, which has no ids; an empty table gives no rows;
repeated rows are encoded alike; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .agenda import LONGEST, Pairs, merge
from .common import documents, ship, slices, texts
from .tokens import Kept

_WORD = re.compile(r" +[^ ]*")
_MARK = "▁"
_ALL = (1 << 64) - 1
_NONE = float("inf")
_SHORT = 48  # characters of a word whose agenda is a list
_STEP = 0x9E3779B97F4A7C15
_MOST_GAP = 4096  # candidates that one draw covers
_LOADED: dict[tuple, Pieces] = {}


def _mixed(x: int) -> int:
    """The finalizer of SplitMix64."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _ALL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _ALL
    return x ^ x >> 31


def _mixed_all(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """A model file with one dropout and seed."""

    def __init__(self, path: str, dropout: float = 0.0, seed: int = 0, most_words: int = 200_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        self.byte = {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the model has no byte pieces, so it can't encode every text")
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {names[i].replace(_MARK, " "): i for i in plain}
        if any(re.search(f"[^{_MARK}]{_MARK}", names[i]) for i in plain):
            raise ValueError("the model has pieces across words")
        self.rank = {k: -model.get_score(i) for k, i in self.ids.items()}
        self.bytes_of = [b""] * n
        for k, i in self.ids.items():
            self.bytes_of[i] = k.encode()
        for b, i in self.byte.items():
            self.bytes_of[i] = bytes([b])
        self.limit = round(dropout * (1 << 16))
        self.seed = seed & _ALL
        # A hash below the k-th bound means a skip within the first k candidates; as integers, alike on any machine.
        self.bounds, kept = [], 1 << 1024
        while self.limit and len(self.bounds) < _MOST_GAP and kept >> 960:
            kept = kept * ((1 << 16) - self.limit) >> 16
            self.bounds.append(min(_ALL, (1 << 64) - (kept >> 960)))
        self.bound_array = np.array(self.bounds, np.uint64)
        self.kept = Kept(300 * most_words)
        self._symbols()

    def _symbols(self) -> None:
        """Numbers for pieces and characters, the pairs that make a piece, and the ids that a symbol stands for at the end."""
        number = {s: i for i, s in enumerate(dict.fromkeys([*self.ids, *(c for s in self.ids for c in s)]))}
        ranks = {r: i for i, r in enumerate(sorted(set(self.rank.values())))}
        parts = [(number[s[:i]], number[s[i:]], ranks[self.rank[s]], number[s])
                 for s in self.ids for i in range(1, len(s)) if s[:i] in number and s[i:] in number]
        self.pairs = Pairs(*np.array(parts, np.int64).reshape(-1, 4).T, symbols=len(number))
        self.of_char = np.full(0x110000, -1, np.int32)  # -1: a character of no piece
        for s, i in number.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        self.of_symbol = np.array([self.ids.get(s, -1) for s in number] + [-1], np.int32)  # -1: to be written in bytes

    def _draw(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = _mixed_all(keys + np.uint64(_STEP))
        return keys, self._next(keys)

    def _next(self, keys: np.ndarray) -> np.ndarray:
        """Candidates before the next skip; a word merged at once has fewer than the bounds reach."""
        gaps = np.searchsorted(self.bound_array, keys, side="right")
        return np.where(gaps == len(self.bounds), 1 << 40, gaps)

    def packed_all(self, words: list[str], gaps: np.ndarray | None = None, keys: np.ndarray | None = None) -> list[tuple[bytes, int]]:
        """Packed ids of each word and its number of candidates.  A word after one space comes without it."""
        spelled = [w if w[:1] == " " else " " + w for w in words]
        lens = np.fromiter(map(len, spelled), np.int64, len(spelled))
        chars = np.frombuffer("".join(spelled).encode("utf-32-le"), np.uint32)
        flat = self.of_char[chars]
        alive, n = merge(self.pairs, flat, lens, gaps, keys, self._draw)
        there = np.flatnonzero(alive)
        ids = self.of_symbol[flat[there]]
        ends = np.cumsum(alive)[np.cumsum(lens) - 1]
        odd = np.flatnonzero(ids < 0)
        if len(odd):  # characters written in bytes
            coded = [np.array([self.byte[b] for b in chr(c).encode()], np.int32) for c in chars[there[odd]].tolist()]
            sizes = np.ones(len(ids), np.int64)
            sizes[odd] = list(map(len, coded))
            first = np.cumsum(sizes) - sizes
            wide = np.empty(int(sizes.sum()), np.int32)
            wide[first] = ids
            wide[np.repeat(first[odd], sizes[odd]) + np.concatenate([np.arange(len(c)) for c in coded])] = np.concatenate(coded)
            ids, ends = wide, np.cumsum(sizes)[ends - 1]
        packed, at = ids.astype("<i4").tobytes(), 0
        out = []
        for end, k in zip((4 * ends).tolist(), n.tolist(), strict=True):
            out.append((packed[at:end], k))
            at = end
        for i in np.flatnonzero(lens > LONGEST).tolist():
            draw = None
            if keys is not None:
                draw = self.skips(chain((int(np.searchsorted(self.bound_array, keys[i], side="right")),), self._gaps(int(keys[i])))).__next__
            found, k = self.segment(spelled[i], draw)
            out[i] = np.array(found, "<i4").tobytes(), k
        return out

    def segment(self, word: str, draw=None) -> tuple[list[int], int]:
        """Ids of one word with the spaces before it, and the number of candidates; ``draw`` tells for each if it is skipped."""
        ids, out = self.ids, []
        symbols, n = self._agenda(word, draw) if len(word) > _SHORT else self._scan(word, draw)
        for s in symbols:
            i = ids.get(s)
            if i is None or s == _MARK:
                out.extend(self.byte[b] for b in s.encode())
            else:
                out.append(i)
        return out, n

    def skips(self, gaps: Iterator[int]) -> Iterator[bool]:
        """Gaps as one answer per candidate; a gap as long as the bounds is not ended by a skip."""
        for gap in gaps:
            yield from repeat(False, gap)
            if gap < len(self.bounds):
                yield True

    def _gaps(self, key: int) -> Iterator[int]:
        while True:
            key = _mixed(key + _STEP & _ALL)
            yield bisect_right(self.bounds, key)

    def _scan(self, word: str, draw) -> tuple[list[str], int]:
        """A short agenda kept as a list of ranks, the least of which is looked up."""
        get, n = self.rank.get, 0
        symbols = list(word)
        ranks = [get(a + b, _NONE) for a, b in zip(symbols, symbols[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            n += 1
            if draw and draw():
                ranks[i] = _NONE
                continue
            pair = symbols[i] = symbols[i] + symbols[i + 1]
            del symbols[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(symbols[i - 1] + pair, _NONE)
            if i < len(ranks):
                ranks[i] = get(pair + symbols[i + 1], _NONE)
        return symbols, n

    def _agenda(self, word: str, draw) -> tuple[list[str], int]:
        """A long agenda kept as a heap; entries of which a side was merged meanwhile are passed over."""
        rank, candidates = self.rank, 0
        symbols: list[str | None] = list(word)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(rank[p], i, p) for i, p in enumerate(map(str.__add__, word, word[1:])) if p in rank]
        heapify(agenda)
        while agenda:
            _, i, pair = heappop(agenda)
            left, j = symbols[i], after[i]
            if left is None or j >= n or left + symbols[j] != pair:
                continue
            candidates += 1
            if draw and draw():
                continue
            symbols[i], symbols[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                new = pair + symbols[k]
                if new in rank:
                    heappush(agenda, (rank[new], i, new))
            h = before[i]
            if h >= 0:
                new = symbols[h] + pair
                if new in rank:
                    heappush(agenda, (rank[new], h, new))
        return [s for s in symbols if s is not None], candidates

    def encode(self, text: bytes, doc: bytes) -> bytes:
        """Packed 32-bit ids of a whole text; ``doc`` tells documents apart."""
        return self.encode_all([text], [doc])[0]

    def encode_all(self, rows: list[bytes], docs: list[bytes]) -> list[bytes]:
        """:meth:`encode` for texts and their documents."""
        words, sizes = [], []
        for text in rows:
            plain = text.decode("utf-8", "replace")
            if not plain:
                own = []
            elif "  " in plain or plain[0] == " ":
                own = [w if w[1:2] == " " else w[1:] for w in _WORD.findall(" " + plain)]
            else:
                own = plain.split(" ")
            words += own
            sizes.append(len(own))
        found = self.kept.all(words, self.packed_all)
        out = [f[0] for f in found]
        if self.limit and words:
            from xxhash import xxh64_intdigest

            seeds = np.array([xxh64_intdigest(d, self.seed) for d in docs], np.uint64)
            places = np.arange(1, len(words) + 1, dtype=np.uint64) - np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.uint64)
            keys = _mixed_all(places * np.uint64(_STEP) + np.repeat(seeds, sizes))
            gaps = self._next(keys)
            hit = np.flatnonzero(gaps < np.fromiter((f[1] for f in found), np.int64, len(found)))
            for i, (ids, _) in zip(hit.tolist(), self.packed_all([words[i] for i in hit.tolist()], gaps[hit], keys[hit]), strict=True):
                out[i] = ids
        ends = np.cumsum(sizes).tolist()
        return [b"".join(out[b - n:b]) for b, n in zip(ends, sizes, strict=True)]

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids that :meth:`encode` gave."""
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:]


def pieces(path: str, dropout: float = 0.0, seed: int = 0) -> Pieces:
    """A model loaded once per process."""
    key = (path, dropout, seed)
    if key not in _LOADED:
        _LOADED[key] = Pieces(*key)
    return _LOADED[key]


def encode(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: whole texts as arrays of piece ids."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces(model, dropout, seed)
        for batch in batches:
            coded = []
            for part in slices(batch, 2 << 20):
                coded += coder.encode_all(texts(part.column(1)), [str(d).encode() for d in part.column(0).to_pylist()])
            ends = np.cumsum([0, *[len(c) // 4 for c in coded]]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id", "ids"), ids_col: str = "ids") -> DataFrame:
    """``keep`` and ``decoded``: the texts of piece ids; a kept column of that name gives way to it."""
    keep = tuple(c for c in keep if c != "decoded")
    ship(encoded.sparkSession)
    rows = encoded.select(encoded[ids_col].cast("array<int>").alias("_ids"), *[encoded[c] for c in keep])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]) + ", decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces(model)
        for batch in batches:
            column = batch.column(0)
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(np.diff(column.offsets.to_numpy()))))
            table = coder.bytes_of
            out = [b"".join(map(table.__getitem__, flat[a:b].tolist()))[1:] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.binary()).cast(pa.string())], names=[*keep, "decoded"])

    return rows.mapInArrow(run, schema)
