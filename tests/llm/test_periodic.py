"""Periodic runs against a brute-force search, on drawn word sequences, odd rows and the given documents."""

import hashlib
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from listingspark.llm import periodic, queries
from tests.llm.test_llm import empty, odd  # noqa: F401

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, shortest=24):
    n, out = len(w), set()
    for p in range(1, n // 3 + 1):
        j = 0
        while j + p < n:
            if w[j] != w[j + p]:
                j += 1
                continue
            s = j
            while j + p < n and w[j] == w[j + p]:
                j += 1
            e = j + p
            if e - s >= max(shortest, 3 * p) and not any(w[s:e - q] == w[s + q:e] for q in range(1, p)):
                out.add((s, e - s, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def drawn(r):
    kind, n = r.randrange(7), r.randrange(0, 260)
    if kind == 0:
        return [r.randrange(2) for _ in range(n)]
    if kind == 1:
        return [0] * n
    if kind == 2:  # one period with faults
        base = [r.randrange(r.choice([2, 3, 50])) for _ in range(r.randrange(1, 60))]
        w = [base[i % len(base)] for i in range(n)]
        for _ in range(r.randrange(3) if n else 0):
            w[r.randrange(n)] = r.randrange(50)
        return w
    if kind == 3:  # neighbouring runs
        w = []
        while len(w) < n:
            w += [r.randrange(3) for _ in range(r.randrange(1, 12))] * r.randrange(1, 9)
        return w
    if kind == 4:  # runs inside periods of a longer run
        return (([0] * r.randrange(5, 40) + [1]) * r.randrange(1, 6)) * r.randrange(1, 4)
    if kind == 5:
        a, b = [0], [0, 1]
        while len(b) <= n:
            a, b = b, b + a
        return b[:n] * r.choice([1, 3])
    base = [r.randrange(5) for _ in range(r.randrange(1, 9))]
    return [9] * r.randrange(30) + (base * 8)[:r.randrange(20, 30)] + [7] * r.randrange(30)


@pytest.mark.parametrize("seed", range(4))
def test_all_runs_are_found(seed):
    r = random.Random(seed)
    for _ in range(250):
        w = drawn(r)
        assert periodic.find_runs(np.array(w, np.int64)) == brute_runs(w), w


@pytest.mark.parametrize("shortest", [24, 30, 61])
def test_shortest(shortest):
    r = random.Random(9)
    for _ in range(60):
        w = drawn(r)
        assert periodic.find_runs(np.array(w, np.int64), shortest) == brute_runs(w, shortest), w


def test_shortest_has_a_floor():
    with pytest.raises(ValueError):
        periodic.find_runs(np.zeros(9, np.int64), 10)


def test_very_long_text():
    w = np.random.default_rng(1).integers(0, 3000, 300_000)
    w[50_000:53_000] = np.tile(np.arange(100), 30)
    w[100_000:190_000] = np.tile(np.arange(5000, 35_000), 3)
    w[200_000:200_100] = 7
    w[[49_999, 53_000, 99_999, 190_000, 199_999, 200_100]] = 99_999
    assert periodic.find_runs(w) == [(50_000, 3000, 100), (100_000, 90_000, 30_000), (200_000, 100, 1)]


def test_few_chunks_of_candidates(monkeypatch):
    monkeypatch.setattr(periodic, "AT_ONCE", 7)
    r = random.Random(3)
    for _ in range(60):
        w = drawn(r)
        assert periodic.find_runs(np.array(w, np.int64)) == brute_runs(w), w


def test_wavelet():
    r = np.random.default_rng(2)
    for size in (1, 2, 63, 64, 65, 300):
        values = r.permutation(size)
        tree = periodic.Wavelet(values, size)
        a, b = r.integers(0, size + 1, 200), r.integers(0, size + 1, 200)
        left, right = np.minimum(a, b), np.maximum(a, b)
        limit = r.integers(0, 3 * size, 200)
        want = [int((values[i:j] < x).sum()) for i, j, x in zip(left, right, limit)]
        assert tree.below(left, right, limit).tolist() == want
        some = right > left
        k = r.integers(0, 1 << 30, 200) % np.maximum(right - left, 1)
        assert tree.nth(left[some], right[some], k[some]).tolist() == [sorted(values[i:j])[x] for i, j, x in zip(left[some], right[some], k[some])]


def expected(words):
    runs, drop = brute_runs(words), set()
    for s, length, p in runs:
        drop |= set(range(s + p, s + length))
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    return runs, best, " ".join(w for i, w in enumerate(words) if i not in drop)


def test_odd_rows(spark, odd, empty):
    found = periodic.periodic_runs(odd, carry=("part", "batch", "doc_id", "n_words"))
    assert found.columns == ["doc_id", "runs", "best", "collapsed", "part", "batch", "n_words"]
    got = sorted((r.doc_id or -1, [tuple(x) for x in r.runs], r.best and tuple(r.best), r.collapsed, r.part, r.batch, r.n_words) for r in found.collect())
    want = sorted((r.doc_id or -1, *expected(WORD.findall(r.text or "")), r.part, r.batch, r.n_words)
                  for r in odd.collect() if len(r.text or "") < 5000)
    assert [g for g in got if g[0] not in (5, 6)] == want
    assert (10, [(0, 500, 1)], (0, 500, 1), "x", "p", 2, 1) in got
    assert periodic.periodic_runs(empty).collect() == []


def test_query(spark):
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op11_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        w = WORD.findall(d.text or "")
        h, n = zlib.crc32(str(d.doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 1500:
            continue
        runs, best, kept = expected(w)
        some += len(runs)
        digest = hashlib.sha256("".join(f"{s},{size},{p}\n" for s, size, p in runs).encode()).hexdigest()
        assert got[d.doc_id] == (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest, hashlib.sha256(kept.encode()).hexdigest())
    assert some > 10


def test_query_on_odd_rows(spark, odd, tmp_path):
    odd.unionByName(spark.createDataFrame([(None, "y " * 30)], "doc_id long, text string"), allowMissingColumns=True).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()
    assert len(rows) == odd.count() + 1
    assert [tuple(r)[1:5] for r in rows if r.doc_id is None and r.n_runs] == [(1, 0, 30, 1)]
    assert all(None not in (r.runs_sha256, r.collapsed_sha256) for r in rows)
