"""Cases of the second review of the training-data operators."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from listingspark.llm import language, pieces, simhash
from tests.llm.test_llm import PIECES

STAGE = dict(corpus_pipeline.STAGES)


def words(n, rng):
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(n)]


def shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))}


# --- near duplicates

def test_near_copies_with_a_repeated_passage_are_found(spark):
    rng = random.Random(7)
    rows = []
    for i in range(40):
        text, passage = words(260, rng), words(20, rng)
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(text + passage * 10))]
        assert len(shingles(rows[-2][1]) & shingles(rows[-1][1])) >= 0.8 * len(shingles(rows[-2][1]) | shingles(rows[-1][1]))
    got = STAGE["near_dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r.doc_id for r in got.collect()} == {2 * i for i in range(40)}


def test_pairs_at_the_similarity_meet_in_a_band_and_radius():
    rng = np.random.default_rng(3)
    apart = far = 0
    for _ in range(3000):
        u = np.frombuffer(rng.bytes(321 * 8), np.uint64)
        a, b = u[:289], np.concatenate((u[:257], u[289:]))  # 257 of 321
        apart += not (simhash.band_keys(a, *corpus_pipeline.NEAR_BANDS) == simhash.band_keys(b, *corpus_pipeline.NEAR_BANDS)).any()
        far += (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > corpus_pipeline.NEAR_RADIUS
    assert apart <= 3 and far == 0


def least_of_class(rows, similarity):
    """Id to the least id reachable over pairs of that Jaccard similarity, by all pairs."""
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in sets}


def edited(text, n, changed, rng):
    for _ in range(n):
        copy = list(text)
        for i in rng.sample(range(0, len(text), 10), changed):
            copy[i + rng.randint(3, 6)] = words(1, rng)[0] + "q"
        yield " ".join(copy)


@pytest.mark.parametrize("tile_shingles", [1 << 20, 20_000])
def test_edited_copies_meet_their_original_in_large_groups(spark, monkeypatch, tile_shingles):
    monkeypatch.setattr(simhash.missed_links, "__defaults__", (*simhash.missed_links.__defaults__[:-1], tile_shingles))
    rng = random.Random(4)
    text = words(300, rng)
    rows = list(enumerate([" ".join(text), *edited(text, 300, 5, rng)], 1))
    rng.shuffle(rows)
    want = least_of_class(rows, 0.8)
    assert len(set(want.values())) == 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(docs, words=5, radius=24, bands=(16, 4), similarity=0.8)
    assert {r.doc_id: r.component_id for r in got.collect()} == want


# --- pieces

def word_ids(coder, word, n):
    """Ids of n occurrences of a word in one document, each word told apart by the end mark after it."""
    ids = np.frombuffer(coder.encode(" ".join([word, "|"] * n).encode(), b"7"), "<i4").tolist()
    out, one = [], []
    for i in ids:
        if coder.bytes_of[i].endswith(b"|"):
            out.append(tuple(one[:-1] if coder.bytes_of[one[-1]] == b" " else one))
            one = []
        else:
            one.append(i)
    return out


@pytest.mark.parametrize("word", ["understanding", "table", "x" * 60])
def test_every_occurrence_of_a_word_draws_its_own_skips(word):
    coder, n, rng = pieces.Pieces(PIECES, 0.1, 3), 20_000, random.Random(5)
    got, want = Counter(word_ids(coder, word, n)), Counter(tuple(coder.segment(" " + word, lambda: rng.random() < 0.1)[0]) for _ in range(n))
    assert len(want) > 4 and set(k for k, c in want.items() if c > 40) <= set(got)
    assert all(abs(got[k] - want[k]) < 6 * (got[k] + want[k]) ** 0.5 for k in got | want)
    small = pieces.Pieces(PIECES, 0.1, 3, most_words=2)  # what is kept changes nothing
    assert word_ids(small, word, 500) == word_ids(coder, word, 500)


# --- language

def test_language_with_long_texts_alone_is_learnt(spark):
    rng = random.Random(8)
    own = {k: words(300, rng) for k in ("aa", "bb", "cc")}
    text = lambda k, n: " ".join(rng.choices(own[k], k=n))
    rows = [(i, text("aa", 100), "aa") for i in range(6)] + [(i, text("bb", 2000), "bb") for i in range(6, 12)]
    rows += [(i, "1 " * 3000 + text("cc", 2000), "cc") for i in range(12, 18)] + [(18, "12 " * 100, "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learnt = language.fit(docs)
    assert sorted(learnt) == ["aa", "bb", "cc"] and all(len(d) <= 6 * 4001 for d in learnt.values())
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in language.classify(docs, learnt).collect()}
    assert all(got[d] == (lang, False) for d, _, lang in rows[:-1])
