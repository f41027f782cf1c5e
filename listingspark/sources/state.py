"""Fetch state derived from events: latest state, cadence, failures, retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import urls as U
from ..functions.times import before, moment
from ..schemas import fill

BACKOFF_BASE, BACKOFF_CAP = 30, 240


def latest_state(events: DataFrame) -> DataFrame:
    """Last attempt, success, count and error per source; maxima combine before the shuffle."""
    return events.where("source_id is not null").groupBy("source_id").agg(
        F.max("ts").alias("last_attempt_at"), F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_success_at"),
        F.max(F.struct("ts", "id", "cnt"))["cnt"].alias("last_count"),
        F.max(F.struct("ts", "id", F.when(~F.col("ok"), F.coalesce(
            "error", F.lit("Unknown source fetch error"))).alias("e")))["e"].alias("last_error"))


def with_state(sources: DataFrame, state: DataFrame) -> DataFrame:
    """Sources with their last known state, NULL when never fetched."""
    return sources.join(state, "source_id", "left")


def _recent(events: DataFrame, n: int) -> DataFrame:
    """The last ``n`` attempts per source that were not skipped; the limit acts before the shuffle."""
    order = Window.partitionBy("source_id").orderBy(F.desc("ts"), F.desc("id"))
    return events.where(~F.col("skipped") & F.col("source_id").isNotNull()).withColumn(
        "_rank", F.row_number().over(order)).where(F.col("_rank") <= n)


def rate_limit_streak(events: DataFrame, n: int | None = None) -> DataFrame:
    """Per source the unbroken run of ``HTTP 429`` at the newest end, and the cooldown it earns.

    The run counts attempts after the newest one that was not refused: two sums per source, combined before
    the shuffle.  With ``n`` only the last ``n`` attempts are looked at.
    """
    limited = F.coalesce(F.contains(F.col("error"), F.lit("HTTP 429")), F.lit(False))
    tried = _recent(events, n) if n is not None else events.where(~F.col("skipped") & F.col("source_id").isNotNull())
    place = F.struct("ts", "id")
    last = tried.groupBy("source_id").agg(F.max(F.when(~limited, place)).alias("_last"))
    since = F.col("_last").isNull() | (place > F.col("_last"))
    return tried.select("source_id", "ts", "id").join(last, "source_id").groupBy("source_id").agg(
        F.count_if(since).cast("int").alias("streak")).withColumn("backoff_minutes", backoff_minutes(F.col("streak")))


def backoff_minutes(streak):
    """30 minutes, doubled per further refusal, at most four hours."""
    doublings = F.least(streak, F.lit(4)) - 1
    return F.when(streak > 0, F.least(F.lit(BACKOFF_CAP), (F.lit(BACKOFF_BASE) * F.pow(F.lit(2), doublings)).cast("int"))
                  ).otherwise(0)


def plan_cadence(sources: DataFrame, state: DataFrame, events: DataFrame, as_of, window: int | None = None) -> DataFrame:
    """Which sources may be fetched now: ``due``, ``interval``, ``group`` or ``off``.

    Wait for the own interval plus, inside a shared-origin group, the cooldown.  Of the members that
    passed, the one attempted longest ago goes, unknown attempts first, registry order on ties.
    """
    streaks = rate_limit_streak(events, window)
    df = fill(sources, "sources", "min_interval_minutes", "cadence_group", "position", "status")
    df = df.join(state.select("source_id", "last_attempt_at"), "source_id", "left").join(streaks, "source_id", "left")
    grouped = F.col("cadence_group").isNotNull() & F.col("min_interval_minutes").isNotNull()
    df = df.withColumn("backoff_minutes", F.when(grouped, F.coalesce("backoff_minutes", F.lit(0))).otherwise(0))
    next_at = F.col("last_attempt_at") + F.make_dt_interval(
        mins=(F.col("min_interval_minutes") + F.col("backoff_minutes")).cast("int"))
    df = df.withColumn("_state", F.when(F.coalesce(F.col("status").isin("paused", "deprecated"), F.lit(False)), "off").when(
        F.coalesce(moment(as_of) < next_at, F.lit(False)), "interval"))
    never = F.lit("0001-01-01").cast("timestamp")
    winner = df.where(F.col("_state").isNull() & grouped).groupBy("cadence_group").agg(F.min(F.struct(
        F.coalesce("last_attempt_at", never).alias("a"), "position", "source_id"))["source_id"].alias("turn_of"))
    df = df.join(winner, ["cadence_group"], "left")
    waits = grouped & (F.col("source_id") != F.col("turn_of"))
    return df.withColumn("decision", F.coalesce("_state", F.when(waits, "group").otherwise("due"))).drop("_state", "streak")


def failing_sources(events: DataFrame, pauses: DataFrame, n: int = 4, ceiling: int = 3) -> DataFrame:
    """Sources whose last ``n`` attempts all failed, without those already paused.

    More than ``ceiling`` at once looks like an outage: they are all returned with ``outage`` set and
    nothing should be paused.
    """
    bad = _recent(events, n).groupBy("source_id").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if("ok").alias("_ok"),
        F.min(F.struct("_rank", "error"))["error"].alias("latest_error")).where(
        (F.col("attempts") == n) & (F.col("_ok") == 0)).drop("_ok")
    open_ = bad.join(pauses.select("source_id"), "source_id", "left_anti")
    return open_.withColumn("outage", open_.agg(F.count(F.lit(1))).scalar() > ceiling)


def source_health(events: DataFrame, hours: int, as_of) -> DataFrame:
    """per source over the trailing window: attempts, successes, skips, items, failures, last error."""
    rows = events.where((F.col("ts") > before(as_of, hours=hours)) & (F.col("ts") <= moment(as_of)))
    failed = F.count_if(~F.col("ok"))
    return rows.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if("ok").alias("ok"), F.count_if("skipped").alias("skipped"),
        F.sum("cnt").alias("items"), failed.alias("failed"), F.max("ts").alias("last_attempt_at"),
        F.round(failed / F.count(F.lit(1)), 4).alias("failure_ratio"),
        F.max(F.when(~F.col("ok"), F.struct("ts", "id", "error")))["error"].alias("latest_error"))


def sources_to_retry(items: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Sources that delivered an address which is still unresolved."""
    owned = U.with_url(items, "source_url", "_u").select(
        "source_id", U.safe_source(U.Url("_u"), F.col("source_url")).alias("source_url")).where(
        "source_id is not null and source_url is not null").distinct()
    open_ = U.with_url(unresolved, "source_url", "_u").select(
        U.safe_source(U.Url("_u"), F.col("source_url")).alias("source_url")).distinct()
    return owned.join(open_, "source_url", "left_semi").select("source_id").distinct()


def persist_validators(state: DataFrame, retry: DataFrame) -> DataFrame:
    """A source with unresolved items loses its validators, so its next fetch is a full one."""
    df = state.join(retry.select("source_id", F.lit(True).alias("_retry")).distinct(), "source_id", "left")
    return df.withColumns({c: F.when(F.col("_retry").isNull(), F.col(c))
                           for c in ("etag", "last_modified", "body_hash")}).select(*state.columns)


def changed_payloads(payloads: DataFrame, state: DataFrame) -> DataFrame:
    """Add ``body_hash``, ``unchanged`` and ``prior_count``; only changed bodies are worth parsing."""
    prior = state.select("source_id", F.col("body_hash").alias("_prior"), F.col("last_count").alias("prior_count"))
    df = payloads.withColumn("body_hash", F.sha2("body", 256)).join(prior, "source_id", "left")
    same = (F.col("status") == 304) | F.coalesce(F.col("_prior") == F.col("body_hash"), F.lit(False))
    return df.withColumn("unchanged", F.coalesce(same, F.lit(False))).withColumn(
        "prior_count", F.when(F.col("unchanged"), F.coalesce("prior_count", F.lit(0)))).drop("_prior")
