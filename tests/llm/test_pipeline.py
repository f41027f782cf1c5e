"""The corpus pipeline: each stage on its own input against a brute-force version, and the whole run."""

import os
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from listingspark.llm import rules
from listingspark.llm.common import stored
from tests.llm.test_llm import SCHEMA, brute_repeats, brute_rules, passage  # noqa: F401

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def shingles(text, words=5):
    w = (text or "").lower().split()
    return {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))}


def test_stages_are_the_five():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_dedup", "substring_dedup", "packing"]


def test_language_stage(spark, documents):
    got = STAGE["language"](spark, documents, SF)
    assert got.columns == documents.columns
    rows = {r.doc_id: r for r in documents.collect()}
    kept = {r.doc_id: r for r in got.collect()}
    assert all(kept[d].text == rows[d].text and kept[d].lang in ("en", "de", "fr", "es") for d in kept)
    long = [d for d, r in rows.items() if len(re.findall(r"[^\W\d_]", r.text or "")) > 100]
    assert sum(d in kept for d in long) >= 0.97 * len(long)


def test_quality_stage(spark, documents):
    got = {r.doc_id for r in STAGE["quality"](spark, documents, SF).collect()}
    judged = {r.doc_id: r for r in rules.judge(documents, keep=("doc_id", "text")).collect()}
    assert got == {d for d, r in judged.items() if r.kept}
    assert all(brute_rules(r.text)[0] == r.n_words for r in judged.values())


def test_near_duplicates_stage(spark, documents):
    near = passage(200, 11).split()
    other = list(near)
    other[50] = "changed"
    extra = spark.createDataFrame([(100_000, " ".join(near)), (100_001, " ".join(near)), (100_002, " ".join(other)), (100_003, passage(200, 12)), (None, "no id")], "doc_id long, text string")
    docs = documents.unionByName(extra, allowMissingColumns=True)
    got = STAGE["near_dedup"](spark, docs, SF)
    assert got.columns == docs.columns
    kept = {r.doc_id: r.text for r in got.collect()}
    assert 100_000 in kept and 100_003 in kept and not {100_001, 100_002} & set(kept) and None in kept
    sets = {d: shingles(t) for d, t in kept.items() if d is not None}
    holders = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            holders[x].add(d)
    pairs = {(a, b) for ds in holders.values() for a in ds for b in ds if a < b}
    assert not [p for p in pairs if len(sets[p[0]] & sets[p[1]]) >= 0.85 * len(sets[p[0]] | sets[p[1]])]
    whole = {r.doc_id: shingles(r.text) for r in docs.collect() if r.doc_id is not None}
    assert all(any(whole[d] & s for k, s in sets.items() if k < d) for d in whole if d not in kept)


def test_substring_stage(spark, documents):
    got = STAGE["substring_dedup"](spark, documents, SF)
    assert got.columns == documents.columns
    want = {d: (kept, n, gone) for d, kept, n, gone in brute_repeats([(r.doc_id, r.text) for r in documents.collect()], 13)}
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in got.collect():
        kept, _, gone = want[r.doc_id]
        assert r.text == (kept if gone else texts[r.doc_id]) and r.n_chars == len(r.text)


def test_whole_run(spark, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stored(stage(spark, docs, SF), "test")
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= before
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0


@pytest.mark.parametrize("empty", [True, False])
def test_stages_on_odd_rows(spark, empty):
    rows = [] if empty else [(1, None, None, 1, "p", "n", 2, 3), (1, None, None, 1, "p", "n", 2, 3), (2, "", "en", 1, "p", "n", 2, 3), (None, passage(80, 1), "en", 1, "p", "n", 2, 3),
                             (3, passage(3000, 2), "en", 1, "p", "n", 2, 3), (4, passage(80, 4), None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        found = got.collect()
        if name != "packing":
            assert got.columns == docs.columns
        assert not empty or found == []
