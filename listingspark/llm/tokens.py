"""Token ids of whole texts by a tokenizer file, with whole words kept in a bounded cache.

When white space can't be part of a token, the words between white space are independent.  Words met lately are
kept in tables of a fixed size, in two generations; the others of a batch are merged all together.  A tokenizer file for
which that is not known is applied to whole texts.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import numpy as np

from .agenda import LONGEST, Pairs, merge

_OTHER, _LETTER, _MARK = range(3)
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[list(b"abcdefghijklmnopqrstuvwxyz")] = _LETTER
_KINDS[list(b"!\"#$%&'()*+,-./:;=?@[\\]^_`{|}~")] = _MARK
_SPACES = np.zeros(256, bool)
_SPACES[list(b" \t\n\x0b\f\r")] = True
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n of eight bytes
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOADED: dict[str, Encoder] = {}


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Kept:
    """What was found for words lately, up to about ``most`` bytes: a full generation becomes the old one, the old one
    goes, and what is met again moves on to the new one."""

    def __init__(self, most: int, own: int = 250):
        self.most, self.own = most // 2, own
        self.new: dict = {}
        self.old: dict = {}
        self.size = 0

    def all(self, words: list, find: Callable[[list], Iterable]) -> list:
        """What belongs to each word; ``find`` gives it for a list of words not kept."""
        found = list(map(self.new.get, words))
        missing = {w: None for w, f in zip(words, found) if f is None}
        if missing:
            again = [w for w in missing if w in self.old] if self.old else []
            for w in again:
                self.new[w] = self.old[w]
                del missing[w]
            new = list(missing)
            self.new.update(zip(new, find(new), strict=True))
            self.size += sum(map(len, new)) + sum(map(len, again)) + self.own * (len(new) + len(again))
            found = [self.new[w] if f is None else f for w, f in zip(words, found)]
        if self.size > self.most:
            self.old, self.new, self.size = self.new, {}, 0
        return found


def _within(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each size, one behind the other."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class WordTable:
    """Ids of words of up to 16 bytes, none of them zero: the bytes themselves are the key, so no two words share one."""

    TRIES = 4

    def __init__(self, bits: int, dtype: np.dtype):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.low, self.high = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.at, self.count = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int32)
        self.pool, self.used, self.words = np.zeros(1 << bits, dtype), 0, 0

    def full(self) -> bool:
        return 2 * self.words > self.mask

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = (low ^ (high * _MIX)) * np.uint64(0xBF58476D1CE4E5B9)
        return (((h ^ (h >> np.uint64(29))) * _MIX) >> self.shift).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word begin in the pool, -1 for words that aren't here, and how many there are."""
        slot = self._slots(low, high)
        there = self.low.take(slot)
        same = (there == low) & (self.high.take(slot) == high)
        at, count = np.where(same, self.at.take(slot), -1), np.where(same, self.count.take(slot), 0)
        left = np.flatnonzero(~same & (there != 0))
        for step in range(1, self.TRIES):
            if not len(left):
                break
            slot_left = (slot[left] + step) & self.mask
            there = self.low[slot_left]
            same = (there == low[left]) & (self.high[slot_left] == high[left])
            at[left[same]], count[left[same]] = self.at[slot_left[same]], self.count[slot_left[same]]
            left = left[~same & (there != 0)]
        return at, count

    def add(self, low: np.ndarray, high: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Words that find no place in a few tries are not kept."""
        begin = self.used + np.cumsum(counts) - counts
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        slot, left = self._slots(low, high), np.arange(len(low))
        for step in range(self.TRIES):
            s = (slot[left] + step) & self.mask
            free = np.flatnonzero(self.low[s] == 0)
            place, first = np.unique(s[free], return_index=True)
            who = left[free[first]]
            self.low[place], self.high[place], self.at[place], self.count[place] = low[who], high[who], begin[who], counts[who]
            self.words += len(who)
            left = left[(self.low[s] != low[left]) | (self.high[s] != high[left])]


class Encoder:
    """Ids of one tokenizer file as packed little-endian integers of ``dtype``."""

    def __init__(self, path: str, table_bits: int = 19):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.n_ids = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.n_ids <= 1 << 16 else np.dtype("<u4")
        self.by_word = _by_word(spec)
        if self.by_word:
            self.bits = table_bits
            self.new = self.old = WordTable(table_bits, self.dtype)
            self._pairs(spec["model"])

    def _pairs(self, model: dict) -> None:
        vocab, ends = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, merged = (np.array([vocab[x] for x in xs], np.int64) for xs in zip(*((a, b, a + b) for a, b in merges), strict=True))
        self.pairs = Pairs(left, right, np.arange(len(merges)), merged, len(vocab))
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.outer = np.array([vocab[c + ends] for c in letters], np.int32)

    def encode(self, text: bytes) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, rows: list[bytes]) -> list[bytes]:
        """Packed ids of whole texts, without special tokens."""
        if not self.by_word:
            coded = self.tokenizer.encode_batch_fast([r.decode("utf-8", "replace") for r in rows], add_special_tokens=False)
            return [np.array(e.ids, self.dtype).tobytes() for e in coded]
        # Lower case is the same before and after NFC unless a mark of U+0300 to U+036F may join an ASCII letter.
        blob = b" ".join([b"", *(r if b"\xcc" in r or b"\xcd" in r else r.lower() for r in rows), b"\0" * 17])
        raw = np.frombuffer(blob, np.uint8)[:-17]
        space = _SPACES[raw]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1  # the first byte and the last are spaces
        starts, lens = edges[::2], edges[1::2] - edges[::2]
        ids, counts = self._ids(blob, raw, starts, lens)
        ends = np.cumsum([len(r) + 1 for r in rows])  # the space behind each row
        upto = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(starts, ends)] * self.dtype.itemsize
        packed = ids.tobytes()
        return [packed[a:b] for a, b in zip([0, *upto[:-1].tolist()], upto.tolist(), strict=True)]

    def _ids(self, blob: bytes, raw: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one behind the other, and how many each has."""
        eight = np.ndarray((len(blob) - 7,), "<u8", blob, strides=(1,))  # the eight bytes from every place on
        low, high = eight[starts] & _BYTES[np.minimum(lens, 8)], eight[starts + 8] & _BYTES[np.clip(lens - 8, 0, 8)]
        short = lens <= 16
        zero = np.flatnonzero(raw == 0)
        if len(zero):
            short[np.searchsorted(starts, zero, "right") - 1] = False
        at, counts = self.new.find(low, high)
        at[~short] = -1
        lost = np.flatnonzero(at < 0)
        if len(lost):
            again, size = self.old.find(low[lost], high[lost])
            back = np.flatnonzero((again >= 0) & short[lost])
            # Equal words are neighbours in the order of a hash; one of them stands for all.
            order = lost[np.argsort(low[lost] * _MIX ^ high[lost], kind="stable")]
            new = np.ones(len(order), bool)
            new[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]]) | ~short[order[1:]] | ~short[order[:-1]]
            known = np.zeros(len(raw) + 1, bool)
            known[starts[lost[back]]] = True
            where, many = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
            where[lost[back]], many[lost[back]] = again[back], size[back]
            heads = order[new]
            old, fresh = heads[known[starts[heads]]], heads[~known[starts[heads]]]
            fresh_ids, fresh_counts = self._encoded(raw, starts[fresh], lens[fresh])
            old_counts = many[old]
            old_ids = self.old.pool[np.repeat(where[old], old_counts) + _within(old_counts)]
            found, sizes = np.concatenate((old, fresh)), np.concatenate((old_counts, fresh_counts))
            own = np.concatenate((old_ids, fresh_ids))
            begin = np.cumsum(sizes) - sizes
            head_at, head_count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
            head_at[found], head_count[found] = begin, sizes
            head_of = heads[np.cumsum(new) - 1]
            pool = np.concatenate((self.new.pool[:self.new.used], own))
            at[order], counts[order] = self.new.used + head_at[head_of], head_count[head_of]
            keep = short[found]
            kept_ids = own if keep.all() else own[np.repeat(keep, sizes)]
            if self.new.full():
                self.old, self.new = self.new, WordTable(self.bits, self.dtype)
            self.new.add(low[found[keep]], high[found[keep]], kept_ids, sizes[keep])
        else:
            pool = self.new.pool
        counts = counts.astype(np.int64)
        return pool[np.repeat(at, counts) + _within(counts)], counts

    def _encoded(self, raw: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some words one behind the other, and how many each has.

        Words of letters of ASCII and Latin-1 and marks behind them are lower-cased and merged all together, as one token
        of letters and one of marks before merging: such letters are stable under NFC.  Others go through the tokenizer.
        """
        given = raw[np.repeat(starts, lens) + _within(lens)]
        raw = np.where((given >= 65) & (given <= 90), given + 32, given).astype(np.uint8)
        owner = np.repeat(np.arange(len(lens)), lens)
        kind = _KINDS[raw]
        two = np.flatnonzero(raw[:-1] == 0xC3)
        after = raw[two + 1]
        two = two[(after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)]
        kind[two] = kind[two + 1] = _LETTER
        odd = lens > LONGEST
        odd[owner[kind == _OTHER]] = True
        odd[owner[np.flatnonzero((kind[1:] == _LETTER) & (kind[:-1] == _MARK) & (owner[1:] == owner[:-1])) + 1]] = True
        ends = np.cumsum(lens)
        texts = {i: given[ends[i] - lens[i]:ends[i]].tobytes() for i in np.flatnonzero(odd).tolist()}
        raw[two[raw[two + 1] <= 0x9E] + 1] += 0x20
        counts, pool = np.zeros(len(lens), np.int64), np.zeros(0, self.dtype)
        used = np.flatnonzero(~odd[owner])
        raw, owner, kind = raw[used], owner[used], kind[used]
        if len(used):
            ends = np.append(np.flatnonzero((owner[1:] != owner[:-1]) | (kind[1:] != kind[:-1])) + 1, len(raw))
            flat = self.inner[raw]
            flat[ends - 1] = self.outer[raw[ends - 1]]
            alive, _ = merge(self.pairs, flat, np.diff(ends, prepend=0))
            pool = flat[alive].astype(self.dtype)
            counts += np.bincount(owner[alive], minlength=len(lens))
        if texts:
            coded = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts.values()], add_special_tokens=False)
            by_word = {i: np.array(c.ids, self.dtype) for i, c in zip(texts, coded, strict=True)}
            counts[list(by_word)] = [len(c) for c in by_word.values()]
            begin, whole = np.cumsum(counts) - counts, np.empty(int(counts.sum()), self.dtype)
            plain = np.flatnonzero(~odd)
            whole[np.repeat(begin[plain], counts[plain]) + _within(counts[plain])] = pool
            for i, c in by_word.items():
                whole[begin[i]:begin[i] + len(c)] = c
            pool = whole
        return pool, counts


def _by_word(spec: dict) -> bool:
    """Whether white space ends every token of this file, and the word rule of :meth:`Encoder._word` holds."""
    normal = [(n["type"], (n.get("pattern") or {}).get("Regex"), n.get("content")) for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (normal == [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)] and len(steps) == 2
            and steps[0]["type"] == "Split" and steps[0]["invert"] and steps[0]["behavior"] == "Removed"
            and steps[0]["pattern"].get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
            and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"])


def encoder(path: str) -> Encoder:
    """The encoder of a file, loaded once per process."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
