"""Whole texts by default, HTML feeds, date forms, one vote per key."""

import pytest
from pyspark.sql import functions as F

from listingspark.functions.times import parse_time, unread_dates
from listingspark.operators import cleaning, geo, links, verdicts, views
from listingspark.plans.ingest_batch import extract_all
from listingspark.sources import extract

DATES = {
    "Tue, 02 Jan 2024 10:00:00 EST": "2024-01-02 15:00:00", "02 Jan 2024": "2024-01-02 00:00:00", "Jan 2, 2024": "2024-01-02 00:00:00",
    "2024/01/02": "2024-01-02 00:00:00", "Tuesday, 02 Jan 2024 10:00:00 GMT": "2024-01-02 10:00:00", "Tue, 2 Jan 2024 10:00:00": "2024-01-02 10:00:00",
    "2024-01-02T10:00:00Z": "2024-01-02 10:00:00", "Tue, 02 Jan 2024 10:00 +0530": "2024-01-02 04:30:00", "January 2, 2024 3:04:05 PST": "2024-01-02 11:04:05",
    "1/2/2024 10:00": "2024-01-02 10:00:00", "2 January 2024 10:00:00+01:00": "2024-01-02 09:00:00", "Sept 5, 2024": "2024-09-05 00:00:00", "someday": None, "": None,
}


def test_date_forms(spark):
    df = spark.createDataFrame([(d,) for d in DATES], "d string")
    assert {r.d: r.t for r in df.select("d", parse_time(F.col("d")).cast("string").alias("t")).collect()} == DATES
    assert unread_dates(df, ["d"]).first().d == 1


def test_long_texts_are_judged_whole(spark):
    late = "filler " * 1500 + "Applicants must be based in the UK."
    df = spark.createDataFrame([(1, "Analyst", late)], "id int, title string, description string")
    assert geo.geo_gate(df).first().gate_eligibility == "ineligible"
    assert geo.geo_gate(df, chars=1500).first().gate_eligibility == "unclear"
    pages = spark.createDataFrame([(1, f"<p>{late}</p>")], "page_id int, html string")
    assert geo.scan_landing_pages(pages).first().geo_lock and not geo.scan_landing_pages(pages, chars=4000).first().geo_lock
    checks = spark.createDataFrame([(1, 200, "x" * 7000 + " this domain is for sale")], "id int, status int, body string")
    assert links.classify_links(checks).first().link_status == "parked" and links.classify_links(checks, body_chars=6000).first().link_status == "ok"
    two = spark.createDataFrame([("t", "u", "c", "a" * 1500 + "b"), ("t", "u", "c", "a" * 1500 + "c")], "title string, source_url string, company string, description string")
    assert cleaning.add_keys(two).select("description_hash").distinct().count() == 2
    assert cleaning.add_keys(two, 1500).select("description_hash").distinct().count() == 1


def test_take_new_takes_what_is_asked(spark):
    assert views.take_new(spark.range(300), 250, "id").count() == 250
    with pytest.raises(ValueError, match="one row"):
        views.take_new(spark.range(3), 0, "id")


def _payload(spark, rows):
    return spark.createDataFrame([(*r, "Co", "tok", 200) for r in rows], "source_id string, kind string, body string, company string, token string, status int").withColumn(
        "fetched_at", F.lit("2024-01-31 00:00:00").cast("timestamp"))


def _sources(spark, *names):
    return spark.createDataFrame([(n, n, "full-time", ["remote"], None) for n in names], "source_id string, platform string, default_type string, tags array<string>, max_items int")


def test_cdata_may_hold_item_tags(spark):
    body = ("<rss><channel><item><title>One</title><link>https://a.example.com/1</link><description><![CDATA[<b>x</b> </item> y]]></description></item>"
            "<item><title>Two</title><link>https://a.example.com/2</link></item></channel></rss>")
    got = extract.extract_rss(_payload(spark, [("s", "rss", body)]), _sources(spark, "s")).orderBy("ordinal").collect()
    assert [(r.title, r.source_url) for r in got] == [("One", "https://a.example.com/1"), ("Two", "https://a.example.com/2")]
    assert "y" in got[0].description


def test_html_feed_is_part_of_the_run(spark):
    strict = "<a href='/jobseekers/job/1'><h4>Data  <b>Analyst</b></h4></a><a href='/jobseekers/job/2'>See More</a>"
    loose = "<a class=x href='https://o.example.com/jobseekers/job/3'><h2> </h2>Loose title</a>"
    payloads = _payload(spark, [("s", "html", strict), ("t", "html", loose), ("ghost", "html", strict), ("t", "html", None)])
    state = spark.createDataFrame([], "source_id string, body_hash string, last_count int")
    got = {r.source_id: r for r in extract_all(payloads, state, _sources(spark, "s", "t"), "board.example.com").collect()}
    assert got["s"].source_url == "https://www.board.example.com/jobseekers/job/1" and got["s"].title == "Data Analyst" and got["s"].batch_order.feed == 1
    assert got["t"].title == "Loose title" and got["t"].company != got["s"].company and set(got) == {"s", "t"}
    assert [r.source_id for r in extract.unknown_payloads(payloads, _sources(spark, "s", "t")).collect()] == ["ghost"]


def test_one_vote_per_key(spark):
    votes = spark.createDataFrame([("a", True, True, "old", 1), ("a", True, False, "new", 2), ("b", True, True, "x", 1)],
                                  "listing_key string, available boolean, eligible boolean, reason string, voted_at int")
    got = {r.listing_key: r.reason for r in verdicts.newest(votes, "listing_key").collect()}
    assert got == {"a": "new", "b": "x"}
    listings = spark.createDataFrame([("a", "unknown", "unclear", "e")], "source_url string, gate_scope string, gate_eligibility string, gate_evidence string")
    out = verdicts.merge_verdicts(listings, votes, votes).collect()
    assert len(out) == 1 and out[0].decision == "ineligible"
