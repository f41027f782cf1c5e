"""Link health: response classes (C4, C5), strikes (G6) and their application."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import values as V
from ..functions import urls as U
from ..functions.text import head
from ..schemas import fill
from ..skew import count_since

STRIKES = 3


def classify_links(checks: DataFrame, use_body: bool = True, body_chars: int | None = None) -> DataFrame:
    """C4: add ``link_status``, ``link_evidence`` and ``hard_dead`` from an HTTP status and body.

    Rows without a status are network failures and go through :func:`classify_unreachable`.
    Parked pages are told by their whole body, or by its first ``body_chars``.
    """
    status = F.col("status")
    body = F.lower(head(F.coalesce(F.col("body"), F.lit("")), body_chars)) if use_body else F.lit("")
    marker = F.coalesce(*[F.when(F.contains(body, F.lit(m)), F.lit(m)) for m in V.PARKED_MARKERS])
    df = checks.withColumn("_marker", F.when(status.between(200, 299), marker))
    http = F.concat(F.lit("HTTP "), status.cast("string"))
    kind = (
        F.when(F.col("_marker").isNotNull(), "parked")
        .when(status.between(200, 399), "ok")
        .when(status.isin(V.GONE_STATUSES), "dead_http")
        .when(status.isNotNull(), "bot_wall")
    )
    evidence = (
        F.when(F.col("_marker").isNotNull(), F.concat(
            F.lit('Body contains "'), F.col("_marker"), F.lit('" ('), http, F.lit(")")))
        .when(status.between(200, 399) | status.isin(V.GONE_STATUSES), http)
        .when(status.isin(V.BOT_WALL_STATUSES), F.concat(http, F.lit(" (bot wall — site alive)")))
        .when(status >= 500, F.concat(http, F.lit(" (edge/origin transient — not counted dead)")))
        .when(status.isNotNull(), F.concat(http, F.lit(" (ambiguous — not counted dead)")))
    )
    return df.withColumns({
        "link_status": kind, "link_evidence": evidence,
        "hard_dead": F.coalesce(kind.isin("parked", "dead_http"), F.lit(False)),
    }).drop("_marker")


def classify_unreachable(checks: DataFrame, code_chars: int | None = None) -> DataFrame:
    """Add ``reason_code`` and ``reason`` for network errors described by
    ``cause_code``, ``error_code``, ``error_name`` and ``error_message``."""
    cause, code, name, message = [
        F.coalesce(F.col(c), F.lit("")) for c in ("cause_code", "error_code", "error_name", "error_message")]
    short = F.coalesce(*[F.nullif(x, F.lit("")) for x in (cause, code, name)], F.lit("network failure"))
    df = checks.withColumns({
        "reason_code": head(short, code_chars),
        "_code": F.upper(F.concat_ws(" ", cause, code, name)), "_msg": F.lower(message),
    })
    reason = None
    for label, (codes, texts) in V.UNREACHABLE_RULES.items():
        test = F.col("_msg").rlike(texts)
        if codes:
            test = F.col("_code").rlike(codes) | test
        reason = (F if reason is None else reason).when(test, label)
    fetch_layer = (name == "TypeError") | F.col("_msg").rlike("fetch failed|failed to fetch")
    return df.withColumn("reason", reason.when(fetch_layer, "REQUEST_ERROR").otherwise("UNKNOWN_NETWORK")).drop(
        "_code", "_msg")


def running_strikes(checks: DataFrame, key: str = "company_id", at: str = "ts", tie: str = "id") -> DataFrame:
    """Strikes after every check, in event order.

    A hard-dead check adds one, an answer resets, an unreachable host changes nothing.
    """
    df = checks.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    answered = ~F.col("hard_dead") & (F.col("link_status") != "unreachable")
    return count_since(df, [key], at, tie, F.col("hard_dead"), answered, "strikes").drop("strikes_any")


def link_strikes(checks: DataFrame, key: str = "company_id", at: str = "ts", tie: str = "id") -> DataFrame:
    """Per key the strikes now, the most ever and whether the third was reached."""
    return running_strikes(checks, key, at, tie).groupBy(key).agg(
        F.count(F.lit(1)).alias("checks"),
        F.max(F.struct(at, tie, "strikes"))["strikes"].alias("strikes"),
        F.max("strikes").alias("max_strikes"),
        (F.max("strikes") >= STRIKES).alias("reached_threshold"))


def _latest(checks: DataFrame, key: str) -> DataFrame:
    """Last check per key; a maximum over structs combines before the shuffle."""
    rest = [c for c in checks.columns if c != key]
    return checks.groupBy(key).agg(F.max(F.struct("ts", "check_id", *[
        c for c in rest if c not in ("ts", "check_id")])).alias("_c")).select(key, "_c")


def apply_link_checks(listings: DataFrame, checks: DataFrame, use_body: bool = False, evidence_chars: int | None = None) -> DataFrame:
    """Listing table after its latest link check.

    ``checks(check_id, id, ts, status, body, geo_lock)``; a NULL status is a network failure and only
    rotates the row.  The third hard-dead check deactivates without raising the counter.
    """
    t = fill(listings, "listings", "geo_evidence", "geo_checked_at", "updated_at")
    cols = t.columns
    last = _latest(classify_links(checks, use_body).select(
        "check_id", "id", "ts", "status", "geo_lock", "hard_dead"), "id")
    t = U.with_url(t, "source_url", "_u").join(last, "id", "left")
    c, seen = F.col("_c"), F.col("_c").isNotNull() & F.col("is_active")
    bad = seen & U.safe_source(U.Url("_u"), F.col("source_url")).isNull()
    live = seen & ~bad & c["status"].isNotNull()
    lock = live & c["geo_lock"].isNotNull() & c["status"].between(200, 299)
    dead = live & ~lock & c["hard_dead"]
    third = dead & (F.coalesce("failed_count", F.lit(0)) + 1 >= STRIKES)
    return t.withColumns({
        "is_active": F.when(bad | lock | third, False).otherwise(F.col("is_active")),
        "inactive_reason": F.when(bad, "invalid-source-url").when(lock, "policy-rejected")
            .when(third, "link-unavailable").otherwise(F.col("inactive_reason")),
        "ph_eligibility": F.when(lock, "ineligible").otherwise(F.col("ph_eligibility")),
        "geo_evidence": F.when(lock, F.concat(F.lit("Verifier page scan: "), head(c["geo_lock"], evidence_chars)))
            .otherwise(F.col("geo_evidence")),
        "geo_checked_at": F.when(lock, c["ts"]).otherwise(F.col("geo_checked_at")),
        "failed_count": F.when(third | lock, F.col("failed_count")).when(dead, F.coalesce("failed_count", F.lit(0)) + 1)
            .when(live, F.lit(0)).otherwise(F.col("failed_count")),
        "last_verified_at": F.when(seen, c["ts"]).otherwise(F.col("last_verified_at")),
        "updated_at": F.when(seen, c["ts"]).otherwise(F.col("updated_at")),
    }).select(*cols)


def apply_company_checks(companies: DataFrame, checks: DataFrame) -> DataFrame:
    """Company table after its latest check ``(check_id, id, ts, link_status, link_evidence, hard_dead)``."""
    t = fill(companies, "companies", "notes", "link_status", "link_evidence", "link_checked_at")
    cols = t.columns
    t = t.join(_latest(checks, "id"), "id", "left")
    c, seen = F.col("_c"), F.col("_c").isNotNull()
    prior = F.coalesce("link_fail_count", F.lit(0))
    strikes = F.when(c["link_status"] == "unreachable", prior).when(c["hard_dead"], prior + 1).otherwise(0)
    flagged = seen & c["hard_dead"] & (prior + 1 >= STRIKES) & F.col("is_verified")
    note = F.concat(F.lit("[auto "), F.date_format(c["ts"], "yyyy-MM-dd"), F.lit("] link "), c["link_status"],
                    F.lit(" x"), (prior + 1).cast("string"), F.lit(": "), c["link_evidence"])
    return t.withColumns({
        "link_status": F.when(seen, c["link_status"]).otherwise(F.col("link_status")),
        "link_evidence": F.when(seen, c["link_evidence"]).otherwise(F.col("link_evidence")),
        "link_checked_at": F.when(seen, c["ts"]).otherwise(F.col("link_checked_at")),
        "link_fail_count": F.when(seen, strikes).otherwise(F.col("link_fail_count")),
        "is_verified": F.when(flagged, False).otherwise(F.col("is_verified")),
        "notes": F.when(flagged, F.concat_ws(" | ", "notes", note)).otherwise(F.col("notes")),
    }).select(*cols)


def attempt_rollup(checks: DataFrame) -> DataFrame:
    """attempted, succeeded, failed and deactivated over ``(succeeded, deactivated)`` rows."""
    ok = F.coalesce(F.col("succeeded"), F.lit(False))
    return checks.agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(ok).alias("succeeded"),
        F.count_if(~ok).alias("failed"), F.coalesce(F.sum("deactivated"), F.lit(0)).cast("bigint").alias("deactivated"))


def link_tally(checks: DataFrame) -> DataFrame:
    """F16: checks by status and by unreachable reason, zeros included, with the outage flag.

    One aggregate row is turned into the fixed list of keys, so nothing is joined.
    """
    statuses = [F.count_if(F.col("link_status") == s).alias(f"s_{s}") for s in V.LINK_STATUSES]
    lost = F.col("link_status") == "unreachable"
    reasons = [F.count_if(lost & (F.coalesce("reason", F.lit("UNKNOWN_NETWORK")) == r)).alias(f"r_{r}")
               for r in V.UNREACHABLE_REASONS]
    one = checks.agg(F.count(F.lit(1)).alias("checked"), *statuses, *reasons)
    entries = [F.struct(F.lit("status").alias("kind"), F.lit(s).alias("key"), F.col(f"s_{s}").alias("n"))
               for s in V.LINK_STATUSES]
    entries += [F.struct(F.lit("reason").alias("kind"), F.lit(r).alias("key"), F.col(f"r_{r}").alias("n"))
                for r in V.UNREACHABLE_REASONS]
    degraded = (F.col("checked") >= 10) & (F.col("s_unreachable") >= 0.8 * F.col("checked"))
    return one.select("checked", degraded.alias("degraded"), F.explode(F.array(*entries)).alias("e")).select(
        "e.kind", "e.key", "e.n", "checked", "degraded")

