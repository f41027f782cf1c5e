"""The stored index against the full scan: words, phrases, accents, filters, pages, and how little it reads."""

import glob
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from listingspark.operators import search as S, text_index as I
from listingspark.operators.postings import FIELD, block_postings

SCHEMA = "id long, title string, company string, tags array<string>, category string, type string, source_platform string, is_active boolean"
WORDS = ["content", "seo", "writer", "Café", "remote", "C3", "naïve", "Ǎbc", "Łódź", "e", "commerce", "data", "ops"]


def drawn(spark, n, seed=1, words=WORDS):
    r = random.Random(seed)
    def text(most):
        return r.choice([" ", "-", ", "]).join(r.choice(words) for _ in range(r.randrange(most)))

    rows = [(i, text(9) or None, text(3), [text(2) for _ in range(r.randrange(3))] if r.random() < 0.8 else None, r.choice(["admin", "tech"]),
             r.choice(["VA", "project"]), r.choice(["p1", "p2"]), r.random() < 0.8) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def listings(spark):
    return drawn(spark, 700)


@pytest.fixture(scope="module")
def index(spark, listings, tmp_path_factory):
    return I.write_index(listings, str(tmp_path_factory.mktemp("index") / "i"), block=16)


def same(index, listings, query, size=30, page=1, **filters):
    got = I.search_index(index, listings, query, size, page, **filters).select("id", "score").collect()
    want = S.search(listings, query, size, page, **filters).select("id", "score").collect()
    assert [(r.id, round(r.score, 9)) for r in got] == [(r.id, round(r.score, 9)) for r in want]
    assert I.search_index_total(index, listings, query, **filters).first().total == S.search_total(listings, query, **filters).first()[0]
    return got


@pytest.mark.parametrize("query", ["remote", "content-seo", "e-commerce data", "ÃBC lodz", "cafe-REMOTE-c3", "data data", "ops-ops naïve"])
def test_same_pages_and_totals(index, listings, query):
    assert same(index, listings, query, 7) or "-" in query


def test_second_page(index, listings):
    assert len(same(index, listings, "remote", 7, 3)) == 7


@pytest.mark.parametrize("query", ["unknown", "remote unknown", "", " - "])
def test_no_hits(index, listings, query):
    assert I.search_index(index, listings, query).collect() == [] and I.search_index_total(index, listings, query).first().total == 0


@pytest.mark.parametrize("query, filters", [("remote", {"category": "admin"}), ("seo content", {"type": "VA", "platform": "p1"}), ("e-commerce", {"category": "none"})])
def test_filters(index, listings, query, filters):
    same(index, listings, query, 5, **filters)


def test_filters_read_the_live_listings(spark, index, listings):
    """An index is of a day; what is visible is decided now."""
    gone = listings.withColumn("is_active", listings["id"] % 2 == 0)
    got = I.search_index(index, gone, "remote", 1000)
    assert got.count() == gone.where("is_active").join(S.matches(gone, "remote").select("id"), "id").count()
    assert all(r.id % 2 == 0 for r in got.collect())


def test_accents_fold_alike_on_both_sides(spark, tmp_path):
    titles = ["Ǎbc role", "abc rôle", "Ḅad", "étude", "SMØRGÅS", "Łódź", "ŐŰ"]
    t = spark.createDataFrame([(i, x, "c", None, "a", "b", "p", True) for i, x in enumerate(titles)], SCHEMA)
    index = I.write_index(t, str(tmp_path / "i"))
    for query, want in [("Ǎbc", [0, 1]), ("abc", [0, 1]), ("ROLE", [0, 1]), ("bad", [2]), ("étude", [3]), ("smorgas", [4]), ("łodz", [5]), ("ou", [6])]:
        assert sorted(r.id for r in S.search(t, query).collect()) == want, query
        assert sorted(r.id for r in I.search_index(index, t, query).collect()) == want, query
    for title in titles:
        assert S.query_tokens(title)[0] == t.where(t["title"] == title).select(S.tokens(t["title"])[0]).first()[0]


def test_phrases_stay_inside_a_field(spark, tmp_path):
    t = spark.createDataFrame([(1, "seo content", "x", None, "a", "b", "p", True), (2, "content", "seo", ["a", "b"], "a", "b", "p", True),
                               (3, "content seo content seo", "x", ["content seo"], "a", "b", "p", True)], SCHEMA)
    index = I.write_index(t, str(tmp_path / "i"))
    assert [r.id for r in I.search_index(index, t, "content-seo").collect()] == [3]
    assert [r.id for r in I.search_index(index, t, "a-b").collect()] == [2]  # tags are one field


def test_few_blocks_are_read(spark, tmp_path):
    """Listings of one length share blocks, so a page of short ones leaves the blocks of long ones unread."""
    rows = [(i, "remote " + " ".join(f"w{i % 97}x{j}" for j in range(i % 40)), "c", None, "a", "b", "p", True) for i in range(8000)]
    t = spark.createDataFrame(rows, SCHEMA).repartition(4).cache()
    folder = str(tmp_path / "i")
    index = I.write_index(t, folder, block=8, row_group_bytes=4096)
    read, of = I.blocks_read(index, t, "remote", 20)
    assert of >= 1000 and read <= of // 10
    same(index, t, "remote", 20)
    q = I._ask(index, "remote")
    least = q.least_tops(I.reach(index, q, t, 20, {}))["remote"]
    groups = skipped = 0
    for name in glob.glob(f"{folder}/postings/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        for g in range(meta.num_row_groups):
            term, top = (next(c for c in map(meta.row_group(g).column, range(meta.row_group(g).num_columns)) if c.path_in_schema == n).statistics for n in ("term", "top"))
            if term.min <= "remote" <= term.max:
                groups += 1
                skipped += top.max < least
    assert groups > 4 and skipped > groups // 2
    plan = index.postings.where(f"term = 'remote' AND top >= {least}")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(top" in plan and "EqualTo(term,remote)" in plan


def test_bounds_read_no_positions(index):
    plan = I._blocks(index, I._ask(index, "remote seo"))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<term:string,block:bigint,top:double>" in plan


def test_every_block_is_in_one_partition(index):
    docs = index.postings.selectExpr("term", "block", "inline(entries)")
    assert docs.groupBy("term", "block").count().agg({"count": "max"}).first()[0] <= 16
    assert docs.groupBy("id").agg({"block": "min"}).count() == docs.select("id", "block").distinct().count()


def test_empty_index(spark, tmp_path):
    t = spark.createDataFrame([], SCHEMA)
    index = I.write_index(t, str(tmp_path / "i"))
    assert I.search_index(index, t, "a").collect() == [] and I.search_index_total(index, t, "a").first().total == 0


def test_block_size_is_checked(spark, listings, tmp_path):
    with pytest.raises(ValueError):
        I.write_index(listings, str(tmp_path / "i"), block=100)


def test_listings_are_read_once(spark, tmp_path):
    """Tokens are cut before the range exchange, which reads its input twice."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    t = drawn(spark, 300, seed=4)
    index = I.write_index(t.mapInArrow(counted, t.schema), str(tmp_path / "i"), block=16)
    assert seen.value == 300
    same(index, t, "content-seo", 7)


def test_blocks_are_whole_in_any_batches():
    """Batches that cut blocks make the same postings; repeated rows of one id and length share an entry."""
    rows = [{"block": i // 4, "id": i // 2 % 5, "length": 3, "title": "a b a" if i % 2 else "b c b", "company": "", "tags": "a"} for i in range(40)]
    made = []
    for size in (1, 3, 40):
        batches = [pa.RecordBatch.from_pylist(rows[i:i + size]) for i in range(0, 40, size)]
        for tokens in (1, 1 << 20):
            out = [r for b in block_postings(iter(batches), S.FIELDS, 3.0, tokens) for r in b.to_pylist()]
            assert len(out) == len({(r["term"], r["block"]) for r in out})
            made.append(sorted(out, key=lambda r: (r["term"], r["block"])))
    assert all(m == made[0] for m in made) and len(made[0]) == 30
    one = made[0][0]
    assert (one["term"], one["block"], one["docs"]) == ("a", 0, 2)
    assert one["entries"][0] == {"id": 0, "length": 3, "places": [0, 2, 2 * FIELD, 2 * FIELD]}
