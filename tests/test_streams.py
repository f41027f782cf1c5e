"""Streaming queries against their batch forms on the same events."""

from datetime import datetime

from pyspark.sql import functions as F

from checks.rule_queries import checked
from checks.source_queries import clicks, limited
from checks.views import view
from listingspark.operators import links
from listingspark.schemas import conform
from listingspark.skew import in_pieces
from listingspark.sources import state as P
from listingspark.streaming import ingest, states, windows

SF = "/root/testdata/sf0.001"


def split_files(df, path, order):
    """Write in order as several files, so that a stream sees several micro-batches."""
    ranked = df.withColumn("_part", F.ntile(3).over(__import__("pyspark").sql.Window.orderBy(*order)))
    for n in (1, 2, 3):
        ranked.where(F.col("_part") == n).drop("_part").coalesce(1).write.parquet(f"{path}/b{n}")
    return path


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{path}/*")


def run(df, mode, tmp_path, spark, name):
    query = (df.writeStream.outputMode(mode).format("memory").queryName(name)
             .option("checkpointLocation", str(tmp_path / f"cp_{name}")).start())
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


def folded(spark, df, fold, tmp_path):
    """Three micro-batches; returns all output, the last state and all late events."""
    path = split_files(df, str(tmp_path / "in"), ["ts", "id"])
    live = stream(spark, path, spark.read.parquet(f"{path}/*").schema)
    states.run_fold(live, fold, str(tmp_path / "fold"), str(tmp_path / "cp")).awaitTermination()
    read = lambda name: spark.read.parquet(str(tmp_path / "fold" / name))
    return read("out"), read("state/version=3"), read("late")


def test_streak_stream_matches_batch(spark, tmp_path, rows):
    events = limited(view(spark, SF, "fetch_events"))
    _, state, late = folded(spark, events, states.streak_fold(), tmp_path)
    want = P.rate_limit_streak(events, 10_000)
    assert rows(state, "key", "streak") == rows(want, "source_id", "streak") and late.count() == 0


def test_strikes_stream_matches_batch(spark, tmp_path, rows):
    checks = checked(view(spark, SF, "checks")).select("id", "company_id", "ts", "hard_dead", "link_status")
    _, state, _ = folded(spark, checks, states.strikes_fold(), tmp_path)
    want = links.link_strikes(checks).select(F.col("company_id").cast("string"), "strikes", "reached_threshold")
    assert rows(state, "key", "strikes", "reached_threshold") == rows(want)


def test_late_events_are_set_aside(spark, rows):
    fold = states.streak_fold()
    event = lambda *e: spark.createDataFrame(list(e), "source_id string, id int, t string, error string").select(
        "source_id", "id", F.col("t").cast("timestamp").alias("ts"), F.lit(False).alias("skipped"), "error")
    out, state, late = states.fold_batch(fold, event(("a", 1, "2024-01-01", "HTTP 429"), ("a", 2, "2024-01-02", "HTTP 429"), ("b", 3, "2024-01-05", None)), spark.createDataFrame([], fold.schema))
    assert rows(out, "key", "streak", "backoff_minutes") == [("a", 2, 60), ("b", 0, 0)] and late.count() == 0
    out, state, late = states.fold_batch(fold, event(("a", 2, "2024-01-02", "HTTP 429"), ("a", 4, "2024-01-01", None), ("a", 5, "2024-01-02", "HTTP 429"), ("c", 1, "2024-01-01", "HTTP 429")), state)
    assert rows(out, "key", "streak") == [("a", 3), ("c", 1)] and rows(late, "key", "id") == [("a", 2), ("a", 4)]
    assert rows(state, "key", "id", "streak") == [("a", 5, 3), ("b", 3, 0), ("c", 1, 1)]


def test_a_hot_key_is_cut_into_pieces(spark, rows):
    """One key owns nearly all events, many at one time; no window holds more than a partition of them."""
    events = spark.range(4000).select(F.when(F.col("id") % 50 == 0, "cold").otherwise("hot").alias("source_id"), "id", F.expr("timestamp_seconds(1704067200 + id div 400 * 7200 + id % 3)").alias("ts"),
                                      F.lit(False).alias("skipped"), F.expr("CASE WHEN id % 97 <> 5 THEN 'HTTP 429' END").alias("error"), F.lit(1).alias("cnt"), F.lit(True).alias("ok"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or so few rows make one partition
    try:
        pieces = in_pieces(events, ["source_id"], "ts", "id")
        assert pieces.groupBy("source_id", "_piece").count().where("source_id = 'hot'").count() >= 3
        fold = states.streak_fold()
        _, state, _ = states.fold_batch(fold, events, spark.createDataFrame([], fold.schema))
        assert rows(state, "key", "streak") == rows(P.rate_limit_streak(events, 10_000), "source_id", "streak")
        cut = {gap: windows.activity_sessions(events, gap) for gap in ("1 hour", "2 hours", "3 hours")}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for gap, found in cut.items():
        whole = events.groupBy("source_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("attempts"), F.sum("cnt").alias("items"))
        assert rows(found) == rows(whole.select("source_id", "w.start", "w.end", "attempts", "items"))


def test_late_and_undated_rows_have_a_table(spark, rows):
    events = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 09:30:00"), ("a", None), (None, "2024-01-01 10:00:00")], "source_id string, t string").select("source_id", F.col("t").cast("timestamp").alias("ts"))
    assert rows(windows.late_events(events, "2024-01-01 10:00:00"), "source_id", "reason") == [("a", "late"), ("a", "undated"), (None, "without source")]


def test_incident_stream_matches_batch(spark, tmp_path, rows):
    i = F.col("id")
    signal = F.when(i % 5 == 0, "failing").when(i % 7 == 3, "unknown").otherwise("healthy")
    signals = view(spark, SF, "fetch_events").select("id", F.concat(F.lit("k"), (i % 4).cast("string")).alias("incident_key"), "ts", signal.alias("signal"))
    out, _, _ = folded(spark, signals, states.incident_fold(3), tmp_path)
    want = states.incident_actions(signals, threshold=3)
    assert rows(out, "key", "id", "action", "healthy_streak") == rows(want, "incident_key", "id", "action", "healthy_streak")


def test_incident_with_open_incident(spark, rows):
    signals = spark.createDataFrame([("A", 1, "2024-01-01", "healthy"), ("a", 2, "2024-01-02", "unknown"), ("a", 3, "2024-01-03", "healthy"),
                                     ("a", 4, "2024-01-04", "failing"), ("b", 5, "2024-01-01", "healthy")], "incident_key string, id int, t string, signal string")
    signals = signals.withColumn("ts", F.col("t").cast("timestamp"))
    open_ = spark.createDataFrame([("a", 7, 0), ("a", 9, 5)], "incident_key string, number int, healthy_streak int")
    got = rows(states.incident_actions(signals, open_, 2), "id", "action", "healthy_streak")
    assert got == [(1, "UPDATE", 1), (2, "HOLD", 1), (3, "CLOSE", 0), (4, "CREATE", 0), (5, "HOLD", 0)]


def test_closed_health_windows_match_batch(spark, tmp_path, rows):
    events = view(spark, SF, "fetch_events")
    path = split_files(events, str(tmp_path / "h"), ["ts", "id"])
    live = stream(spark, path, spark.read.parquet(f"{path}/*").schema)
    out = run(windows.health_windows(live), "append", tmp_path, spark, "health")
    batch = windows.health_windows(events)
    closed = batch.join(out.agg(F.max("window_end").alias("m")).select("m"), F.col("window_end") <= F.col("m"), "inner").drop("m")
    assert out.count() > 100
    assert rows(out, *batch.columns) == rows(closed, *batch.columns)


def test_sessions_close_in_append_mode(spark, tmp_path, rows):
    events = view(spark, SF, "fetch_events")
    path = split_files(events, str(tmp_path / "w"), ["ts", "id"])
    live = stream(spark, path, spark.read.parquet(f"{path}/*").schema)
    out = run(windows.activity_sessions(live), "append", tmp_path, spark, "sessions")
    batch = set(rows(windows.activity_sessions(events)))
    got = set(rows(out, "source_id", "session_start", "session_end", "attempts", "items"))
    assert got and got <= batch


def test_click_stream_counts(spark, tmp_path, rows):
    made, listings = clicks(spark, SF)
    made.coalesce(1).write.parquet(str(tmp_path / "k"))
    live = spark.readStream.schema(made.schema).parquet(str(tmp_path / "k"))
    out = run(windows.click_counts(live, listings), "complete", tmp_path, spark, "clicked")
    assert rows(out, "id", "clicks") == rows(windows.click_counts(made, listings), "id", "clicks")


def lever(spark, rows):
    """Payloads of one posting each: (company, posting, hour of fetch or None, extra white space)."""
    body = '[{"text": "Data Analyst", "hostedUrl": "https://jobs.lever.co/%s/%d", "categories": {"location": "Manila"}}]%s'
    made = [(f"lever:{c}", "lever", c.title(), c, 200, body % (c, n, " " * extra), None if hour is None else datetime(2024, 1, 30, hour)) for c, n, hour, extra in rows]
    return conform(spark.createDataFrame(made, "source_id string, kind string, company string, token string, status int, body string, fetched_at timestamp"), "payloads")


def empty_table(spark, name):
    return conform(spark.range(0).select(F.lit(None).alias("x")), name)


def run_ingest(spark, folder, slices, sources=None, again=False, buckets=16):
    """Micro-batches of one slice each; returns the folder of the table."""
    if not again:
        ingest.start_table(empty_table(spark, "listings"), f"{folder}/t", buckets)
    for i, part in enumerate(slices):
        part.coalesce(1).write.mode("overwrite").parquet(f"{folder}/p/{i}")
    live = spark.readStream.schema(slices[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/p/*")
    ingest.run_ingest(live, f"{folder}/t", sources if sources is not None else empty_table(spark, "sources"), lambda: empty_table(spark, "votes"), lambda: empty_table(spark, "skeptics"),
                      lambda: empty_table(spark, "source_state"), "board.example.com", lambda: "2024-01-31 00:00:00", f"{folder}/cp").awaitTermination()
    return f"{folder}/t"


def test_every_payload_is_accounted_for(spark, tmp_path, rows):
    feed = lever(spark, [("ghost", 1, 0, 0)]).withColumns({"kind": F.lit("rss"), "source_id": F.lit("ghost")})
    first = lever(spark, [("a", 1, 5, 0), ("a", 1, 6, 0), ("b", 1, 9, 0), ("c", 1, None, 0)]).unionByName(feed)
    second = lever(spark, [("a", 1, 10, 0), ("d", 1, 7, 0), ("e", 1, 8, 0), ("f", 1, 20, 0)])  # 8:00 is an hour before the newest: not late
    third = lever(spark, [("b", 1, 20, 0), ("f", 1, 21, 0), ("g", 1, 18, 0)]).unionByName(feed)
    table = run_ingest(spark, str(tmp_path), [first, second, third])
    assert rows(ingest.account(spark, table), "version", "payloads", *ingest.REASONS, "unaccounted") == [
        (1, 5, 1, 1, 0, 1, 2, 0), (2, 4, 0, 0, 1, 1, 2, 0), (3, 4, 0, 1, 1, 1, 1, 0)]
    # b came so long ago that its repeat is taken again; the address is known, so nothing is added.
    aside = ingest.set_aside(spark, table)
    assert rows(aside, "version", "source_id", "reason") == [(1, "ghost", "unregistered"), (1, "lever:c", "undated"), (2, "lever:d", "late"), (3, "ghost", "unregistered"), (3, "lever:g", "late")]
    assert aside.where("body is null").count() == 0
    assert [r[0] for r in rows(ingest.read_version(spark, table, 3), "source_url")] == [f"https://jobs.lever.co/{c}/1" for c in "abef"]


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    """Buckets without a changed row are referred to, and go when no kept version refers to them."""
    first = lever(spark, [(f"c{i}", i, 1, 0) for i in range(60)])
    second, third = lever(spark, [("z", 1, 2, 0)]), lever(spark, [(f"c{i}", i, 3, 1) for i in range(5)])  # known, stamped already
    table = run_ingest(spark, str(tmp_path), [first, second, third])
    held = [ingest.read_manifest(spark, table, n)["buckets"] for n in range(4)]
    assert len(held[1]) > 10 and set(held[1].values()) == {1}
    assert sorted(held[2].values()).count(2) == 1 and held[3] == held[2]
    written = [sum(f.stat().st_size for f in (tmp_path / "t" / "data" / f"version={v}").rglob("*.parquet")) for v in (1, 2)]
    assert written[1] < written[0] / 4 and not (tmp_path / "t" / "data" / "version=3").exists()
    assert ingest.read_version(spark, table, 3).count() == 61
    before = ingest.read_version(spark, table, 2).orderBy("source_url").collect()
    gone = ingest.drop_unreferenced(spark, table, latest=3, keep=2)
    changed = [b for b, v in held[2].items() if v == 2 and b in held[1]]
    assert gone == [f"{table}/data/version=1/bucket={b}" for b in changed]
    assert ingest.read_version(spark, table, 3).orderBy("source_url").collect() == before


def test_a_replayed_batch_adds_nothing(spark, tmp_path, rows):
    """The checkpoint of the stream is lost; all batches come again."""
    slices = [lever(spark, [("a", 1, 1, 0), ("b", 1, 1, 0)]), lever(spark, [("a", 2, 2, 0), ("a", 1, 2, 0)])]
    table = run_ingest(spark, str(tmp_path / "x"), slices)
    want = rows(ingest.read_version(spark, table, 2), "source_url", "is_active", "inactive_reason"), rows(ingest.account(spark, table))
    assert ("https://jobs.lever.co/a/1", False, "pending-triage") in want[0] and len(want[0]) == 3
    (tmp_path / "x" / "cp").rename(tmp_path / "x" / "lost")
    run_ingest(spark, str(tmp_path / "x"), slices, again=True)
    assert (rows(ingest.read_version(spark, table, 2), "source_url", "is_active", "inactive_reason"), rows(ingest.account(spark, table))) == want


def test_a_payload_that_fills_a_batch_stays_spread(spark):
    landed = lever(spark, [("a", 1, h, 0) for h in (3, 1, 2)] * 40).repartition(4).withColumn("number", F.monotonically_increasing_id())
    verdicts = ingest.payload_verdicts(landed, empty_table(spark, "sources"), landed.selectExpr("source_id", "'' AS body_hash").where("false"), None)
    assert verdicts.groupBy("reason").count().orderBy("reason").collect() == [("repeated", 119), ("taken", 1)]
    assert verdicts.where("reason = 'taken'").first().fetched_at == datetime(2024, 1, 30, 1)
    assert "Window" not in verdicts._jdf.queryExecution().optimizedPlan().toString()
