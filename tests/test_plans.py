"""Plan shape and skew: what the optimizer makes of the queries."""

import pytest
from pyspark.sql import functions as F

from checks.all import ORACLES, QUERIES
from checks.compare import canonical, connect
from checks.views import view
from listingspark.functions.regex import SPACE
from listingspark.operators import lifecycle as J
from listingspark.operators.cleaning import sanitize_urls
from listingspark.sources import state
from listingspark.skew import count_since

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rank_limit_acts_before_the_shuffle(spark):
    events = view(spark, SF, "fetch_events")
    plans = {name: QUERIES[name](spark, SF) for name in ("top_per_category", "insert_new")}
    plans["streak"], plans["failing"] = state.rate_limit_streak(events, 20), state.failing_sources(events, events.select("source_id").where("id < 0"))
    for name, df in plans.items():
        assert "WindowGroupLimit" in plan(df) and "Partial" in plan(df), name


def test_top_k_needs_no_global_sort(spark):
    for name in ("board_page", "verify_batch", "sweep_batch", "search"):
        assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, SF)), name


def test_scan_reads_only_what_is_needed(spark):
    text = plan(QUERIES["classify_fetch"](spark, SF))
    assert "props" not in text and "value#" not in text
    assert "PushedFilters: [IsNotNull(event_id)" in plan(QUERIES["core_totals"](spark, SF)) or "IsNotNull(doc_id)" in plan(QUERIES["core_totals"](spark, SF))


@pytest.mark.parametrize("name", ["geo_gate", "sanitize_urls", "clean_votes", "link_strikes", "incident_actions", "robots_gate", "extract_rss", "search", "apply_verdicts"])
def test_no_python_and_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for word in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text


def hot(spark, n=3000):
    """A third of all rows share one key."""
    return spark.range(n).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("key"),
                                 (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=(F.col("id") % 1000).cast("int"))).alias("ts"), (F.col("id") % 7).alias("v"))


@pytest.mark.parametrize("before", [False, True])
def test_count_since_matches_a_window(spark, rows, before):
    df = hot(spark).withColumns({"hit": F.col("v") < 3, "stop": F.col("id") % 11 == 4})
    w = "over (partition by key order by ts, id rows between unbounded preceding and {})"
    df2 = df.selectExpr("*", f"sum(int(hit)) {w.format('current row')} c")
    frame = w.format("1 preceding" if before else "current row")
    want = df2.selectExpr("id", "c", f"max(case when stop then c end) {frame} m").selectExpr("id", "c - coalesce(m, 0)", "m is not null")
    got = count_since(df, ["key"], "ts", "id", F.col("hit"), F.col("stop"), "n", before).select("id", "n", "n_any")
    assert rows(got) == rows(want)


def test_hot_duplicate_group(spark, rows):
    t = hot(spark).select("id", F.lit("h").alias("description_hash"), F.col("key").alias("company"), F.lit(True).alias("is_active"), F.col("ts").alias("last_seen_at"),
                          F.lit(None).cast("timestamp").alias("posted_at"), F.col("ts").alias("scraped_at"))
    want = t.selectExpr("id", "row_number() over (partition by company order by last_seen_at desc, id desc) r").where("r = 1").select("id")
    assert rows(J.duplicate_survivors(t)) == rows(want)


def test_every_query_is_reachable():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 130


FAST = ["core_totals", "reconcile", "facets", "dup_keys", "top_per_category", "posting_documents", "sanitize_urls", "geo_gate", "detect_language", "link_strikes", "insert_new",
        "apply_link_checks", "plan_ats_fetch", "plan_cadence", "robots_gate", "candidate_lanes", "search", "extract_rss", "extract_breezy", "incident_actions", "validate_digests"]


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    got, want = QUERIES[name](spark, SF).toPandas(), connect(SF).execute(ORACLES[name]).df()
    assert canonical(got) == canonical(want)


def test_bodies_of_one_partition_are_dealt_over_tasks(spark):
    """Few files of many bodies must not make few tasks."""
    from listingspark.plans.ingest_batch import extract_all

    payloads = spark.createDataFrame(
        [(f"s{i}", "lever", "Acme", "t", 200, None, f'[{{"text":"Role {i}","hostedUrl":"https://a.example.com/{i}"}}]') for i in range(40)],
        "source_id string, kind string, company string, token string, status int, fetched_at timestamp, body string").coalesce(1)
    state = spark.createDataFrame([], "source_id string, body_hash string, last_count int")
    sources = spark.createDataFrame([], "source_id string, platform string, default_type string, tags array<string>, max_items int")
    rows = extract_all(payloads, state, sources, "board.example.com").selectExpr("title", "spark_partition_id() AS p").collect()
    assert sorted(r.title for r in rows) == sorted(f"Role {i}" for i in range(40))
    assert len({r.p for r in rows}) >= 4


def test_generated_code_of_addresses_is_compiled(spark):
    """The JVM never compiles a method of over 8,000 bytes; every row would run through its interpreter."""
    rows = spark.range(9).selectExpr("concat('https://jobs.lever.co/acme/', id) AS source_url", "concat('https://jobs.lever.co/acme/apply', id) AS application_url",
                                     *[f"concat('c', id) AS c{i}" for i in range(12)])
    out = sanitize_urls(rows)
    codes = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(out._jdf.queryExecution().executedPlan())
    sizes = [codes.apply(i)._3().maxMethodCodeSize() for i in range(codes.size())]
    assert sizes and max(sizes) < 8000
    assert {(r.ats_platform, r.ats_token, r.trusted_source) for r in out.collect()} == {("lever", "acme", True)}


def test_white_space_class_is_the_plain_one(spark):
    """The ranges that rule out most characters early must not rule out any white space."""
    chars = spark.range(0x10000).where("id NOT BETWEEN 55296 AND 57343").selectExpr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE') AS c", "id")
    plain = "[\\s\\x0B\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
    assert chars.where(F.col("c").rlike(SPACE) != F.col("c").rlike(plain)).count() == 0
    assert chars.where(F.col("c").rlike(SPACE)).count() == 25
