"""Hand-counted tables: quality cohorts, duplicates, discovery, search, cadence, lifecycle."""

from pyspark.sql import functions as F

from listingspark.operators import discovery as D, lifecycle as J, links, quality as Q, search as S, verdicts, views as W
from listingspark.plans.ingest_batch import ingest_items
from listingspark.schemas import SCHEMAS, conform
from listingspark.sources import ingest, registry as G, state as P

NOW = "2026-08-22 00:00:00"
COHORT = """title string, company string, source_platform string, category string, posted string, scraped string, is_active boolean,
 inactive_reason string, seen string, verified string, ph_eligibility string"""
ROWS = [
    ("VA Assistant", "Acme", "RemoteOK", "admin", "2026-06-01", "2026-06-01", True, None, "2026-07-01", "2026-08-01", "eligible_verified"),
    ("VA Assistant", "Acme", "RemoteOK", "admin", "2026-08-20", "2026-08-20", True, None, "2026-08-21", None, "eligible_verified"),
    ("va assistant", "acme", "WeWorkRemotely", "admin", "2026-08-19", "2026-08-19", True, None, None, "2026-08-10", "unclear"),
    ("Bookkeeper", None, "Remotive", "finance", "2026-05-15", "2026-05-15", True, None, "2026-08-21", None, "ineligible"),
    ("Bookkeeper", "", "Remotive", "finance", "2026-08-01", "2026-08-01", True, None, "2026-07-05", None, None),
    ("Designer", "Globex", "WeWorkRemotely", "design", "garbage-date", "garbage-date", True, None, "2026-08-21", "2026-08-20", "eligible_likely"),
    ("Developer", "Initech", "RemoteOK", "engineering", "2026-07-10", "2026-07-10", True, None, None, None, "unclear"),
    ("Old Role A", "Acme", "RemoteOK", "admin", "2026-04-01", "2026-04-01", False, "stale-feed", "2026-05-01", "2026-05-01", "eligible_verified"),
    ("Old Role B", "Globex", "Remotive", "finance", "2026-04-02", "2026-04-02", False, "link-unavailable", "2026-05-02", None, "unclear"),
    ("Old Role C", "Initech", "RemoteOK", "engineering", "2026-04-03", "2026-04-03", False, "stale-feed", "2026-05-03", "2026-05-03", "ineligible"),
    ("Old Role D", "Umbrella", "WeWorkRemotely", "other", "2026-04-04", "2026-04-04", False, None, "2026-05-04", "2026-05-04", None),
]


def cohort(spark):
    from listingspark.operators.cleaning import normalize_times
    df = spark.createDataFrame(ROWS, COHORT).withColumnsRenamed({"posted": "posted_at", "scraped": "scraped_at", "seen": "last_seen_at", "verified": "last_verified_at"})
    return normalize_times(df, ["posted_at", "scraped_at", "last_seen_at", "last_verified_at"])


def test_quality_cohorts(spark, rows):
    t = cohort(spark)
    assert rows(Q.core_totals(t)) == [(11, 7, 4)]
    a = Q.active_cohorts(t, NOW).first().asDict()
    assert a == {"active": 7, "stale_30d": 3, "unseen_14d": 2, "never_seen": 2, "never_verified": 4, "missing_company": 2, "undated": 1}
    assert rows(Q.dup_summary(t)) == [(2, 5, 3)]
    assert [tuple(r) for r in Q.dup_top(t).collect()] == [("VA Assistant", "Acme", 3), ("Bookkeeper", "", 2)]
    assert rows(Q.distribution(t, "inactive_reason", active=False)) == [("(null)", 1), ("link-unavailable", 1), ("stale-feed", 2)]
    r = Q.reconcile(t, NOW).first().asDict()
    assert r.pop("undated") == 1 and set(r.values()) == {0} and len(r) == 10


def times(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp") for c in cols})


def test_duplicate_survivors(spark, rows):
    t = times(spark.createDataFrame([
        (1, "Acme", "h", True, "2026-08-01", None, "2026-08-01", "old"), (2, "ACME", "h", True, "2026-08-02", None, "2026-08-01", "new"),
        (3, "Other", "h", True, None, None, "2026-07-01", "x"), (4, "Acme", None, True, None, None, "2026-07-01", "x"),
        (5, "Acme", "h", False, "2026-08-09", None, "2026-07-01", "x")],
        "id long, company string, description_hash string, is_active boolean, last_seen_at string, posted_at string, scraped_at string, inactive_reason string"),
        "last_seen_at", "posted_at", "scraped_at")
    assert rows(J.duplicate_survivors(t)) == [(2,), (3,)]
    out = J.archive_duplicates(t, NOW)
    assert rows(out, "id", "is_active", "inactive_reason")[0] == (1, False, "duplicate-superseded")
    assert [r[1] for r in rows(out, "id", "is_active")] == [False, True, True, True, False]
    assert rows(J.duplicate_survivors(out)) == [(2,), (3,)]


def test_discovery(spark, rows):
    data = [("Positive Co", "verified", "eligible_verified", 12), ("Positive Co", "likely", "eligible_likely", 11), ("Positive Co", "newer-unclear", "unclear", 13),
            ("Mixed Co", "mixed-positive", "eligible_verified", 12), ("Mixed Co", "mixed-unclear", "unclear", 13), ("Unclear Co", "u1", "unclear", 12), ("Unclear Co", "u2", "unclear", 11),
            ("Known Co", "k1", "eligible_verified", 12), ("KNOWN co", "k2", "eligible_verified", 12)]
    t = times(spark.createDataFrame([(c, f"https://example.com/{u}", "admin", True, e, f"2026-08-{d}", None) for c, u, e, d in data],
                                    "company string, source_url string, category string, is_active boolean, ph_eligibility string, scraped_at string, posted_at string"), "scraped_at", "posted_at")
    known = spark.createDataFrame([("known CO",)], "company_name string")
    c = D.prospect_candidates(t, known, 2, "2026-01-01", 200)
    assert rows(c) == [("Positive Co", 2, "https://example.com/verified", "admin")]
    many = spark.range(130).select(F.concat(F.lit("Red Owl "), "id").alias("company"), F.col("id").alias("jobs"), F.lit("https://jobs.lever.co/x/1").alias("sample_url"), F.lit("tech").alias("category"))
    lanes = D.classify_candidates(many, known)
    assert all(r.over_ceiling for r in D.drain(lanes, 15, 120).collect()) and D.drain(lanes, 15).count() == 15
    assert [r.jobs for r in D.drain(lanes, 3, 200).collect()] == [129, 128, 127]


def test_ranked_search(spark):
    t = spark.createDataFrame([
        (1, "Assistant", "Alpha", ["remote"], "admin", "VA", "Remotive", True), (2, "Executive Assistant", "Beta", ["assistant", "assistant", "assistant"], "admin", "VA", "Remotive", True),
        (3, "Assistant", "Filtered Category", ["x"], "engineering", "VA", "Remotive", True), (4, "Assistant", "Inactive", ["x"], "admin", "VA", "Remotive", False),
        (5, "Assistant", "Filtered Platform", ["x"], "admin", "VA", "RemoteOK", True), (6, "E-commerce Manager", "Café", None, "admin", "VA", "Remotive", True)],
        "id long, title string, company string, tags array<string>, category string, type string, source_platform string, is_active boolean")
    hits = {"category": "admin", "type": "VA", "platform": "Remotive"}
    assert S.search_total(t, "assistant", **hits).first()[0] == 2
    assert [r.id for r in S.search(t, "assistant", **hits).collect()] == [2, 1]
    assert [r.id for r in S.search(t, "E-Commerce").collect()] == [6]
    assert [r.id for r in S.search(t, "cafe manager").collect()] == [6]
    assert S.search(t, "commerce-e").count() == 0 and S.search(t, "  ").count() == 0


def test_verification_rotates(spark):
    t = spark.range(40).select("id", F.lit(True).alias("is_active"), F.lit(None).cast("timestamp").alias("last_verified_at"))
    first = {r.id for r in W.verify_batch(t, 20).collect()}
    later = t.withColumn("last_verified_at", F.when(F.col("id").isin(list(first)), F.lit(NOW).cast("timestamp")))
    assert first.isdisjoint({r.id for r in W.verify_batch(later, 20).collect()})


def test_link_check_transitions(spark, rows):
    t = times(spark.createDataFrame([(i, u, True, n) for i, u, n in [(1, "https://a.com/1", 2), (2, "https://a.com/2", 1), (3, "https://a.com/3", 2), (4, "https://a.com/4", 2), (5, "ftp://x", 0), (6, "https://a.com/6", 0)]],
                                    "id long, source_url string, is_active boolean, failed_count int").withColumns({
        "inactive_reason": F.lit(None).cast("string"), "ph_eligibility": F.lit("unclear"), "last_verified_at": F.lit(None).cast("string")}), "last_verified_at")
    checks = times(spark.createDataFrame([(1, 1, NOW, 404, None), (2, 2, NOW, 404, None), (3, 3, NOW, 503, None), (4, 4, NOW, None, None), (5, 5, NOW, 200, None), (6, 6, NOW, 200, "locked")],
                                         "check_id long, id long, ts string, status int, geo_lock string").withColumn("body", F.lit("parked free")), "ts")
    out = links.apply_link_checks(t, checks)
    assert rows(out, "id", "is_active", "inactive_reason", "failed_count") == [
        (1, False, "link-unavailable", 2), (2, True, None, 2), (3, True, None, 0), (4, True, None, 2), (5, False, "invalid-source-url", 0), (6, False, "policy-rejected", 0)]
    assert out.where("last_verified_at is null").count() == 0


def test_company_strikes(spark, rows):
    seq = ["dead", "dead", "lost", "dead", "ok", "dead"]
    c = times(spark.createDataFrame([(i, 1, f"2026-08-0{i + 1}", s == "dead", {"dead": "dead_http", "lost": "unreachable", "ok": "ok"}[s]) for i, s in enumerate(seq)],
                                    "id long, company_id long, ts string, hard_dead boolean, link_status string"), "ts")
    assert [r.strikes for r in links.running_strikes(c).orderBy("id").collect()] == [1, 2, 2, 3, 0, 1]
    assert rows(links.link_strikes(c)) == [(1, 6, 1, 3, True)]


def test_cadence_group(spark, rows):
    feeds = spark.createDataFrame([("a", 60, "g", 0), ("b", 60, "g", 1), ("c", 60, None, 2), ("d", None, None, 3)], "source_id string, min_interval_minutes int, cadence_group string, position int")
    events = times(spark.createDataFrame([(1, "a", "2026-08-21 21:30:00", "HTTP 429"), (2, "a", "2026-08-21 22:00:00", "x HTTP 429"), (3, "b", "2026-08-21 22:10:00", None), (4, "c", "2026-08-21 23:30:00", None)],
                                         "id long, source_id string, ts string, error string").withColumns({"skipped": F.lit(False), "ok": F.col("error").isNull(), "cnt": F.lit(1)}), "ts")
    plan = lambda at: dict(rows(P.plan_cadence(feeds, P.latest_state(events), events, at), "source_id", "decision"))
    assert plan("2026-08-22 00:00:00") == {"a": "due", "b": "group", "c": "interval", "d": "due"}  # 60 + 60 minutes have passed
    assert plan("2026-08-21 23:59:00") == {"a": "interval", "b": "due", "c": "interval", "d": "due"}
    assert rows(P.rate_limit_streak(events)) == [("a", 2, 60), ("b", 0, 0), ("c", 0, 0)]


def test_failing_sources_and_outage(spark, rows):
    def events(n):
        return times(spark.createDataFrame([(k * 10 + i, f"s{k}", f"2026-08-{i + 1:02d}", False, "boom") for k in range(n) for i in range(5)] + [(999, "few", "2026-08-01", False, "boom")],
                                           "id long, source_id string, ts string, ok boolean, error string").withColumns({"skipped": F.lit(False), "cnt": F.lit(0)}), "ts")
    pauses = spark.createDataFrame([("s0",)], "source_id string")
    assert rows(P.failing_sources(events(3), pauses), "source_id", "outage") == [("s1", False), ("s2", False)]
    assert {r.outage for r in P.failing_sources(events(6), pauses).collect()} == {True}


def test_policy_fails_closed(spark, rows):
    c = spark.createDataFrame([(1, "A", "ashby", "x"), (2, "B", "nope", "y"), (3, "C", None, None)], "id long, company_name string, ats_platform string, ats_token string")
    none = spark.createDataFrame([], "source_key string, enabled boolean, status string, notes string")
    pauses = conform(spark.range(0).select(F.lit(None).alias("x")), "pauses")
    out = G.resolve_ats_policy(c, none, none.withColumnRenamed("source_key", "ats_platform"), pauses)
    assert rows(out, "id", "enabled") == [(1, False), (2, False), (3, False)]


def votes(spark, table, data):
    names = [f.name for f in SCHEMAS[table]]
    return conform(spark.createDataFrame(data, ", ".join(f"{n} {SCHEMAS[table][n].dataType.simpleString()}" for n in names[:len(data[0])])), table)


def test_ingest_counts_close_and_replay_is_a_no_op(spark, rows):
    items = spark.createDataFrame([
        (1, "Virtual Assistant", "https://a.com/1", None, "worldwide role"), (2, "Virtual Assistant", "https://a.com/1", None, "again"), (3, "Driver", "nope", None, "x"),
        (4, "Analyst", "https://a.com/4", "https://evil.com/x", "Nice work."), (5, "Agent", "https://a.com/5", None, "US only."), (6, "Known", "https://a.com/6", None, "x"), (7, "Editor", "https://a.com/7", None, "Nice work.")],
        "ordinal long, title string, source_url string, application_url string, description string").withColumns({
        "company": F.lit("Acme"), "source_platform": F.lit("p"), "location_raw": F.lit(None).cast("string"), "tags": F.array(F.lit("x")), "type": F.lit("VA"), "category": F.lit("other")})
    stored = conform(spark.createDataFrame([(6, "https://a.com/6", False, "stale-feed", "h")], "id long, source_url string, is_active boolean, inactive_reason string, content_hash string"), "listings")
    first = votes(spark, "votes", [("https://a.com/1", True, True, "fine", "creative", ["Skill "], "USD 5"), ("https://a.com/4", True, True, "fine", "tech", [], None)])
    second = votes(spark, "skeptics", [("https://a.com/4", True, False, "hidden lock")])
    out = ingest_items(items, stored, first, second, NOW, "ordinal")
    c = out.counts.first().asDict()
    assert (c["raw"], c["dropped"], c["known"], c["new"], c["repeated"]) == (7, 1, 1, 4, 1)
    assert c["raw"] == c["dropped"] + c["known"] + c["new"] + c["repeated"]
    assert (c["inserted"], c["published"], c["rejected"], c["parked"]) == (4, 1, 2, 1)
    got = {r.source_url[-1]: (r.is_active, r.inactive_reason, r.ph_eligibility, r.category) for r in out.listings.collect()}
    assert got == {"1": (True, None, "eligible_likely", "design"), "4": (False, "policy-rejected", "unclear", "other"), "5": (False, "policy-rejected", "ineligible", "other"),
                   "6": (True, None, None, None), "7": (False, "pending-triage", "unclear", "other")}
    assert out.listings.where("source_url like '%/4'").first().application_url == "https://a.com/4"
    again = ingest_items(items, out.listings, first, second, NOW, "ordinal")
    assert again.counts.first().inserted == 0 and again.listings.count() == 5


def test_sweep_rotates_unavailable(spark, rows):
    t = spark.createDataFrame([(i, True, None, "unclear") for i in range(1, 5)], "id long, is_active boolean, inactive_reason string, ph_eligibility string")
    v = spark.createDataFrame([(1, False, None, None), (2, True, False, "US"), (3, True, True, "ok")], "listing_key long, available boolean, eligible boolean, reason string")
    s = spark.createDataFrame([(3, False, None, None)], "listing_key long, available boolean, eligible boolean, reason string")
    out = verdicts.apply_sweep(t, v, s, NOW)
    assert rows(out, "id", "is_active", "ph_eligibility", "geo_evidence") == [
        (1, True, "unclear", None), (2, False, "ineligible", "AI re-triage: US"), (3, True, "eligible_likely", "AI re-triage passed (single vote): ok"), (4, True, "unclear", None)]
    assert rows(out.where("geo_checked_at is not null"), "id") == [(1,), (2,), (3,)]


def test_digest_payload_is_all_or_nothing(spark, rows):
    d = spark.createDataFrame([(p, i, c, v, "t", u, None, None, None, None) for p, i, c, v, u in [
        (1, 0, "a", "v1", "https://v.com/1"), (1, 1, "b", "v1", "https://v.com/2"), (2, 0, "a", "v2", "https://v.com/3"), (2, 1, " ", "v3", "https://v.com/4"), (2, 2, "a", "v4", "nope")]],
        "payload_id long, index long, creator_name string, video_id string, video_title string, video_url string, transcript_raw string, action_plan array<string>, tags array<string>, published_at string")
    v = ingest.validate_digests(d)
    assert rows(v.select("payload_id", "payload_ok", "first_error").distinct()) == [(1, True, None), (2, False, "item 1: creator_name")]
    good = ingest.accepted_digests(v, NOW)
    target = conform(spark.range(0).select(F.lit(None).alias("x")), "digests")
    assert rows(ingest.upsert_digests(target, good), "video_id", "video_url") == [("v1", "https://v.com/1")]


def test_watchdog(spark):
    runs = lambda *r: times(spark.createDataFrame(list(r), "ts string, degraded boolean, summary string"), "ts")
    board = lambda at: times(spark.createDataFrame([(True, at)], "is_active boolean, scraped_at string"), "scraped_at")
    ok = J.ingest_health(runs(("2026-08-21 20:00:00", True, "x=1"), ("2026-08-21 23:00:00", False, None)), board("2026-08-21 10:00:00"), NOW).first()
    assert (ok.status, ok.reason) == ("healthy", "last run clean")
    bad = J.ingest_health(runs(("2026-08-21 20:00:00", False, None), ("2026-08-21 21:00:00", True, "x=1")), board("2026-08-20 10:00:00"), NOW).first()
    assert bad.status == "alert" and bad.reason == "degraded run: x=1; no scrape run in 3.0h; board frozen: no new visible job in 38.0h"
    assert str(bad.last_clean_at) == "2026-08-21 20:00:00"
    empty = runs(("2026-08-21 20:00:00", False, None)).where("false")
    assert J.ingest_health(empty, board(NOW), NOW, deployed_at="2026-08-21 23:00:00").first().status == "grace"
    assert J.ingest_health(empty, board(NOW), NOW).first().status == "alert"


def test_run_summary_cut(spark):
    c = spark.createDataFrame([(1, 2, ["a  b", "a  b", ""], True), (0, 0, None, True), (0, 0, None, False)],
                              "insert_failed_batches int, failed_sources int, provider_failures array<string>, cadence_available boolean")
    assert [r.summary for r in Q.run_summary(c).collect()] == ["insertFailedBatches=1, aiProviders=a b, failedSources=2", None, "cadenceStateUnavailable"]
    assert [r.summary for r in Q.run_summary(c, 40).collect()][0] == "insertFailedBatches=1, aiProviders=a b"
    assert [r.summary for r in Q.run_summary(c, 10).collect()][0] == "insertFai…"
