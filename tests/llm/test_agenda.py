"""Merging many words at once against one word after the other, and the words that are kept."""

import random

import numpy as np
import pytest

import public_tokenizers
from listingspark.llm import agenda, pieces, tokens

PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("seed", range(3))
def test_merges_like_a_single_agenda(seed):
    r = random.Random(seed)
    symbols = 40
    pairs = {}
    for _ in range(150):
        pairs[r.randrange(symbols), r.randrange(symbols)] = (r.randrange(60), r.randrange(symbols))
    table = agenda.Pairs(*np.array([(a, b, *v) for (a, b), v in pairs.items()]).T, symbols=symbols)
    words = [[r.choice([-1, *range(symbols)]) if r.random() < 0.1 else r.randrange(12) for _ in range(r.choice([0, 1, 2, 3, 7, 12, 50, 256]))] for _ in range(300)]
    want = []
    for w in words:
        w, n = list(w), 0
        while True:
            best = min(((pairs[w[i], w[i + 1]][0], i) for i in range(len(w) - 1) if (w[i], w[i + 1]) in pairs), default=None)
            if best is None:
                break
            i = best[1]
            w[i:i + 2] = [pairs[w[i], w[i + 1]][1]]
            n += 1
        want.append((w, n))
    lens = np.array([len(w) for w in words])
    flat = np.array([s for w in words for s in w], np.int32)
    alive, n = agenda.merge(table, flat, lens)
    ends = np.cumsum(lens)
    got = [(flat[b - k:b][alive[b - k:b]].tolist(), int(c)) for b, k, c in zip(ends, lens, n)]
    assert got == want


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.6])
def test_pieces_of_many_words_are_those_of_each(dropout):
    coder, r = pieces.Pieces(PIECES, dropout, 3), random.Random(4)
    words = ["".join(r.choice(["a", "th", "ing", "é", "😀", "x" * r.randrange(30), "der", "▁"]) for _ in range(r.randrange(9))) for _ in range(400)]
    words += ["ab" * 300, "", "  ", "   two", "q" * 256, "q" * 255]
    keys = np.random.default_rng(1).integers(0, 1 << 63, len(words), np.uint64) if dropout else None
    got = coder.packed_all(words, None if keys is None else coder._next(keys), keys)
    for i, w in enumerate(words):
        draw = None
        if dropout:
            gaps = (int(np.searchsorted(coder.bound_array, keys[i], side="right")), *[])
            draw = coder.skips(g for part in (gaps, coder._gaps(int(keys[i]))) for g in part).__next__
        ids, n = coder.segment(w if w[:1] == " " else " " + w, draw)
        assert (np.frombuffer(got[i][0], "<i4").tolist(), got[i][1]) == (ids, n), w


def test_texts_together_or_alone():
    coder = pieces.Pieces(PIECES, 0.3, 8)
    rows, docs = [b"one two  three", b"", b" ", "▁ é 😀 one two".encode(), b"one two  three"], [b"1", b"2", b"3", b"4", b"5"]
    together = coder.encode_all(rows, docs)
    assert together == [pieces.Pieces(PIECES, 0.3, 8, most_words=0).encode(t, d) for t, d in zip(rows, docs)]
    assert together[0] != together[4]  # another document, other skips


def test_kept_is_bounded_and_right():
    kept, asked = tokens.Kept(4000, own=100), []

    def find(words):
        asked.extend(words)
        return [w[::-1] for w in words]

    r = random.Random(2)
    for _ in range(200):
        words = [f"w{min(r.randrange(300), r.randrange(300))}" for _ in range(5)]
        assert kept.all(words, find) == [w[::-1] for w in words]
        assert len(kept.new) + len(kept.old) < 2 * 26
    assert 100 < len(asked) < 900


def test_words_of_every_kind_match_the_tokenizer():
    enc, r = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json")), random.Random(1)
    parts = ["A", "ǰ", "J\u030c", "é", "E\u0301", "\u00c5", "A\u030a", "ß", "×", "÷", "'s", "'S", "don't", "(the", "1", "23", "Œ", "ı", "İ", "\u212a", "ﬁ", "—", "“",
             "x" * 90, "y" * 300, "日", "😀", " ", "\n", "\xa0", ".", ",", "...", "!?", "ÀÖØÞ", "þÿ", "_", "{", "\x00", "\x7f", "Ⅷ", "²"]
    for _ in range(1500):
        t = "".join(r.choice(parts) for _ in range(r.randrange(25)))
        assert np.frombuffer(enc.encode(t.encode()), enc.dtype).tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_words_move_between_the_tables():
    """Small tables are filled and changed often; ids stay those of the tokenizer."""
    enc, r = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"), table_bits=6), random.Random(2)
    words = ["w" + "".join(r.choice("abcdeéß") for _ in range(r.randrange(1, 22))) for _ in range(200)] + ["a\x00b", "a", "a\x00", "ab"]
    changes = set()
    for _ in range(60):
        rows = [" ".join(r.choice(words[:r.choice([5, 204])]) for _ in range(r.randrange(40))) for _ in range(3)]
        assert [np.frombuffer(c, enc.dtype).tolist() for c in enc.encode_all([t.encode() for t in rows])] == [
            e.ids for e in enc.tokenizer.encode_batch_fast(rows, add_special_tokens=False)]
        changes.add(id(enc.new))
    assert len(changes) > 3
