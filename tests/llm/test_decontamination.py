"""Benchmark passages in documents against a search of every window, and against SQL."""

import os
import random
import re

import duckdb
import numpy as np
import pytest

from listingspark.llm import decontamination as dec, queries
from tests.llm.test_llm import empty, odd  # noqa: F401

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    patterns = {}
    for item, text in items:
        w = words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            patterns.setdefault(tuple(w[i:i + k]), set()).add(None if item is None else str(item))
    sizes = {len(p) for p in patterns}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                own = patterns.get(tuple(w[i:i + k]))
                if own:
                    hit |= set(range(i, i + k))
                    found |= own
        spans = []
        for i in sorted(hit):
            if spans and spans[-1][0] + spans[-1][1] == i:
                spans[-1][1] += 1
            else:
                spans.append([i, 1])
        out.append((doc, len(w), len(hit), tuple(map(tuple, spans)), len(found - {None}), tuple(sorted(found - {None}))))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(map(tuple, r.spans)), r.n_items, tuple(r.items)) for r in df.collect()), key=str)


def frames(spark, docs, items):
    return (spark.createDataFrame([(*d, 1, "p") for d in docs], "doc_id long, text string, n_words int, pattern string"),
            spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, row_id int"))


def drawn(seed, vocabulary, n_docs=150, n_items=60):
    r = random.Random(seed)
    def text(n):
        return " ".join(r.choice(vocabulary) for _ in range(n))

    items = [(i if i % 9 else i // 9, text(r.choice([0, 1, 2, 3, 5, 9, 10, 11, 25, 40]))) for i in range(n_items)]
    items += [(items[3][0], text(12)), (None, text(15)), (None, None), (900, None), (901, " ,;"), (902, items[-5][1])]
    docs = []
    for i in range(n_docs):
        parts = [text(r.randrange(0, 60))]
        for _ in range(r.randrange(3)):
            w = r.choice(items)[1] or ""
            parts += [w.upper() if r.random() < 0.3 else w.replace(" ", r.choice([" ", ", ", "\n"])), text(r.randrange(0, 30))]
        docs.append((i % 140, "; ".join(parts)))
    return docs + [(None, items[5][1]), (5000, None), (5001, ""), (5002, " .\x00- "), (None, None)], items


@pytest.mark.parametrize("vocabulary", [["a", "b"], ["x", "y", "é", "7", "😀", "and", "the"], [f"w{i}" for i in range(400)]])
def test_drawn_texts(spark, vocabulary):
    docs, items = drawn(len(vocabulary), vocabulary)
    assert found(dec.decontaminate(*frames(spark, docs, items))) == brute(docs, items)


def test_window_size(spark):
    docs, items = drawn(5, ["u", "v", "w"], 60, 20)
    assert found(dec.decontaminate(*frames(spark, docs, items), window=4)) == brute(docs, items, 4)


def test_hot_passage_and_hot_item_sets(spark):
    """One passage is in most items and most documents."""
    hot = " ".join(f"hot{i}" for i in range(14))
    items = [(i, f"own{i} {hot} end{i}") for i in range(300)] + [(1000 + i, "the") for i in range(30)]
    docs = [(i, f"before {hot} after {i}" if i % 3 else f"clean {i} the the") for i in range(600)]
    assert found(dec.decontaminate(*frames(spark, docs, items))) == brute(docs, items)


def test_odd_rows(spark, odd, empty):
    items = [(1, None), (2, ""), (3, "Code ok"), (3, "Code ok"), (4, " ".join(w for w in odd.filter("doc_id = 5").first().text.split()[100:140]))]
    _, bench = frames(spark, [], items)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = found(dec.decontaminate(odd, bench))
    assert got == brute(rows, items) and any(g[2] for g in got)
    none = spark.createDataFrame([], "item_id long, text string")
    assert found(dec.decontaminate(odd, none)) == brute(rows, [])
    assert dec.decontaminate(empty, bench).collect() == [] and dec.decontaminate(empty, none).collect() == []


def test_very_long_text(spark):
    r = random.Random(4)
    w = [f"v{r.randrange(5000)}" for _ in range(400_000)]
    items = [(1, " ".join(w[123_456:123_480])), (2, " ".join(w[399_985:])), (3, " ".join(w[:10]))]
    docs, bench = frames(spark, [(1, " ".join(w)), (2, " ".join(w[:9]))], items)
    assert found(dec.decontaminate(docs, bench)) == brute([(1, " ".join(w)), (2, " ".join(w[:9]))], items)


@pytest.mark.parametrize("bits", [(20, 22, 24), (3, 3, 3), (5, 8, 3)])
@pytest.mark.parametrize("size", [1, 2, 3, 7, 10])
def test_no_place_is_skipped(monkeypatch, bits, size):
    """Whatever the tables' sizes: every occurrence is among the places; with large ones little else is, and most words are skipped."""
    for name, b in zip(("SHIFT_BITS", "BUCKET_BITS", "WHOLE_BITS"), bits):
        monkeypatch.setattr(dec, name, b)
    monkeypatch.setattr(dec, "LANE", 16)
    r = random.Random(size)
    vocabulary = [b"w%d" % i for i in range(30)]
    patterns = [[r.choice(vocabulary) for _ in range(size)] for _ in range(20)]
    a, b = dec.Tables(size), dec.Tables(size)
    a.add(patterns[:12])
    b.add(patterns[12:])
    a.join(b.parts())
    texts = [[r.choice(vocabulary) for _ in range(r.randrange(0, 70))] + r.choice(patterns) + [r.choice(vocabulary) for _ in range(r.randrange(5))] for _ in range(60)]
    sizes = np.array([len(t) for t in texts])
    first = np.cumsum(sizes) - sizes
    every = [w for t in texts for w in t]
    got = a.search(dec.hashes(every), first, sizes - size + 1).tolist()
    want = [f + i for t, f in zip(texts, first.tolist()) for i in range(len(t) - size + 1) if t[i:i + size] in patterns]
    assert set(want) <= set(got) and len(got) == len(set(got))
    if bits[0] == 20:
        assert got == want


def test_tables_are_bounded(spark):
    """What reaches the driver has one size for any number of items."""
    assert sum(len(p) for p in dec.Tables(10).parts()) < 2000
    t = dec.Tables(10)
    assert t.shift.nbytes + t.bucket.nbytes + t.whole.nbytes < 4 << 20


def test_query_and_sql(spark, tmp_path):
    docs, items = drawn(8, ["n", "m", "o", "p", "q"], 60, 30)
    d, i = frames(spark, docs, items)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    i.write.parquet(str(tmp_path / "benchmark.parquet"))
    for folder in (SF, str(tmp_path)):
        got = queries.QUERIES["op13_decontamination"](spark, folder)
        con = duckdb.connect()
        for name in ("documents", "benchmark"):
            path = f"{folder}/{name}.parquet"
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
        want = con.sql(queries.ORACLES["op13_decontamination"])
        assert got.columns == want.columns
        rows = sorted(map(tuple, got.collect()), key=str)
        assert rows == sorted(want.fetchall(), key=str) and any(r[2] for r in rows)
