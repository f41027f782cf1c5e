"""Listing lifecycle: batch transitions ``f(table, changes, as_of) -> new table``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import values as V
from ..functions import urls as U
from ..functions.regex import has_text, trim
from ..functions.text import head
from ..functions.times import before, effective_at, iso, moment, parse_time
from ..schemas import fill
from .cleaning import description_key
from .geo import geo_gate


def new_items(batch: DataFrame, listings: DataFrame) -> DataFrame:
    """Batch rows whose address is unknown, active or not."""
    return batch.join(listings.select("source_url"), "source_url", "left_anti")


def seen_rows(listings: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored rows whose address is in the batch."""
    return listings.join(batch.select("source_url"), "source_url", "left_semi")


def first_per_key(batch: DataFrame, key: str, order: str) -> DataFrame:
    """First row per key in batch order; rows without the key are kept.

    A row without the key is a group of its own, so the batch is read once.  A rank of one is pushed below the
    shuffle, so at most one row per key and task travels.
    """
    numbered = batch.withColumn("_alone", F.when(F.col(key).isNull(), F.monotonically_increasing_id()))
    place = Window.partitionBy(key, "_alone").orderBy(order)
    return numbered.withColumn("_rank", F.row_number().over(place)).where("_rank = 1").drop("_rank", "_alone")


def fresh_rows(target: DataFrame, batch: DataFrame, order: str = "ordinal") -> DataFrame:
    """Batch rows that an insert would accept: first per address, then per content, none stored yet."""
    unique = first_per_key(first_per_key(batch, "source_url", order), "content_hash", order)
    return unique.join(target.select("source_url"), "source_url", "left_anti").join(
        target.select("content_hash").where("content_hash is not null"), "content_hash", "left_anti")


def insert_new(target: DataFrame, batch: DataFrame, order: str = "ordinal") -> DataFrame:
    """Target plus the batch rows that conflict on neither key; replaying a batch adds nothing."""
    fresh = fresh_rows(target, batch, order)
    return target.unionByName(fresh.drop(order), allowMissingColumns=True)


def _with_seen(t: DataFrame, seen: DataFrame) -> DataFrame:
    """Flag stored rows that the batch confirms; both sides are unique per address."""
    urls = seen.select("source_url").distinct().withColumn("_seen", F.lit(True))
    return t.join(urls, "source_url", "left").withColumn("_seen", F.coalesce("_seen", F.lit(False)))


def _due(as_of, hours: int):
    return F.col("_seen") & (F.col("last_seen_at").isNull() | (F.col("last_seen_at") < before(as_of, hours=hours)))


def _back():
    return F.coalesce(F.col("_seen") & ~F.col("is_active") & F.col("inactive_reason").isin(V.RECOVERABLE_REASONS), F.lit(False))


def _stamped(flag: str, as_of) -> dict:
    return {c: F.when(F.col(flag), moment(as_of)).otherwise(F.col(c)) for c in ("last_seen_at", "updated_at")}


def _revived(flag: str, as_of) -> dict:
    b = F.col(flag)
    return {"is_active": F.col("is_active") | b, "inactive_reason": F.when(~b, F.col("inactive_reason")),
            "failed_count": F.when(b, 0).otherwise(F.col("failed_count"))}


def touch_seen(t: DataFrame, seen: DataFrame, as_of, hours: int = 12) -> DataFrame:
    """Stamp rows seen again, only when the stamp is missing or older than ``hours``."""
    t = fill(t, "listings", "updated_at")
    return _with_seen(t, seen).withColumn("_due", _due(as_of, hours)).withColumns(_stamped("_due", as_of)).select(*t.columns)


def revive(t: DataFrame, seen: DataFrame, as_of) -> DataFrame:
    """Reactivate rows seen again that were archived for staleness or a dead link only."""
    t = fill(t, "listings", "updated_at", "failed_count")
    return _with_seen(t, seen).withColumn("_back", _back()).withColumns({**_revived("_back", as_of), **_stamped("_back", as_of)}).select(*t.columns)


def seen_again(t: DataFrame, seen: DataFrame, as_of, hours: int = 12, flag: str | None = None) -> DataFrame:
    """J2 and J3 in one join of the table; ``flag`` names a column that tells which rows change."""
    t = fill(t, "listings", "updated_at", "failed_count")
    df = _with_seen(t, seen).withColumns({"_due": _due(as_of, hours), "_back": _back()}).withColumn("_any", F.col("_due") | F.col("_back"))
    df = df.withColumns({**_revived("_back", as_of), **_stamped("_any", as_of)})
    return df.select(*t.columns, *([F.col("_any").alias(flag)] if flag else []))


def _archive(t: DataFrame, test, reason: str | None, as_of) -> DataFrame:
    t = fill(t, "listings", "updated_at")
    df = t.withColumn("_out", F.coalesce(test, F.lit(False)))
    out = F.col("_out")
    return df.withColumns({
        "is_active": F.col("is_active") & ~out,
        "inactive_reason": F.when(out, F.lit(reason)).otherwise(F.col("inactive_reason")) if reason
            else F.col("inactive_reason"),
        "updated_at": F.when(out, moment(as_of)).otherwise(F.col("updated_at")),
    }).select(*t.columns)


def archive_stale(t: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Archive active rows not seen for ``days``."""
    return _archive(t, F.col("is_active") & (effective_at("stale") < before(as_of, days)), "stale-feed", as_of)


def duplicate_survivors(listings: DataFrame) -> DataFrame:
    """G1: one id per active (description, company) group: the freshest, then the highest id.

    Written as a maximum, which combines before the shuffle: a group with a third of all rows sends
    one row per task.
    """
    return _duplicates(listings).groupBy("description_hash", "_company").agg(
        F.max(F.struct("_fresh", "id"))["id"].alias("id")).select("id")


def _duplicates(listings: DataFrame) -> DataFrame:
    fresh = F.coalesce(effective_at("dedup"), F.lit("0001-01-01").cast("timestamp"))
    return listings.where("is_active and description_hash is not null").select(
        "id", "description_hash", F.lower(F.coalesce("company", F.lit(""))).alias("_company"), fresh.alias("_fresh"))


def archive_duplicates(t: DataFrame, as_of) -> DataFrame:
    """Archive the losers of every duplicate group; nothing is deleted.

    Survivors come back by ``id``, which is unique, so a large group does not gather in one task.
    """
    stay = duplicate_survivors(t).withColumn("_stays", F.lit(True))
    df = t.join(stay, "id", "left")
    losing = F.col("is_active") & F.col("description_hash").isNotNull() & F.col("_stays").isNull()
    return _archive(df.withColumn("_losing", losing), F.col("_losing"), "duplicate-superseded", as_of).drop(
        "_stays", "_losing")


def recover_pending(t: DataFrame, as_of) -> DataFrame:
    """Publish parked rows that the gate alone found open; their eligibility stays unclear."""
    t = fill(t, "listings", "geo_scope", "geo_evidence", "updated_at")
    hit = ~F.col("is_active") & (F.col("inactive_reason") == "pending-triage") & F.col("geo_scope").isin(
        V.GATE_ELIGIBLE_SCOPES)
    df = t.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    h = F.col("_hit")
    return df.withColumns({
        "is_active": F.col("is_active") | h,
        "inactive_reason": F.when(~h, F.col("inactive_reason")),
        "geo_evidence": F.when(h, "Geo-gate eligible; auto-published pending AI re-vet").otherwise(F.col("geo_evidence")),
        "last_seen_at": F.when(h, moment(as_of)).otherwise(F.col("last_seen_at")),
        "updated_at": F.when(h, moment(as_of)).otherwise(F.col("updated_at")),
    }).select(*t.columns)


def park_pending(gated: DataFrame, as_of, reason: str, key_chars: int | None = None, reason_chars: int | None = None) -> DataFrame:
    """Gated batch rows without a verdict become hidden ``pending-triage`` rows.

    The duplicate key takes the whole description and the reason is kept whole, unless limited.
    """
    now = moment(as_of)
    df = U.with_url(U.with_url(gated, "source_url", "_src"), "application_url", "_app")
    link = U.trusted_apply(U.Url("_app"), F.col("application_url"), U.Url("_src"), F.col("source_url"))
    return U.drop_url(df.withColumns({
        "application_url": F.coalesce(link, F.col("source_url")),
        "is_active": F.lit(False), "inactive_reason": F.lit("pending-triage"),
        "geo_scope": F.col("gate_scope"), "ph_eligibility": F.lit("unclear"),
        "geo_evidence": F.lit("Pending durable triage: " + reason[:reason_chars]), "geo_checked_at": now,
        "description_hash": description_key(key_chars), "scraped_at": now, "last_seen_at": now, "updated_at": now,
    }).drop("gate_scope", "gate_eligibility", "gate_evidence"), "_src", "_app")


def fill_apply_url(t: DataFrame) -> DataFrame:
    """A blank apply address becomes the source address."""
    due = ~has_text(F.col("application_url")) & has_text(F.col("source_url"))
    return t.withColumn("application_url", F.when(due, F.col("source_url")).otherwise(F.col("application_url")))


def repair_timestamps(t: DataFrame, cols: list[str]) -> DataFrame:
    """Date text of mixed formats to UTC ISO text; text that already has a ``T`` is left alone."""
    return t.withColumns({c: F.when(F.contains(c, F.lit("T")), F.col(c)).otherwise(iso(parse_time(F.col(c))))
                          for c in cols})


def archive_keywords(t: DataFrame, platform: str, as_of, keywords: list[str] = V.PHYSICAL_TITLE_WORDS) -> DataFrame:
    """Archive active rows of one platform whose title names a physical role."""
    title = F.lower("title")
    named = F.lit(False)
    for word in keywords:
        named = named | F.contains(title, F.lit(word))
    return _archive(t, F.col("is_active") & (F.col("source_platform") == platform) & named, None, as_of)


def infer_reason(t: DataFrame) -> DataFrame:
    """Label inactive, unlabelled, positively eligible rows with the reason their counters imply."""
    due = ~F.col("is_active") & F.col("inactive_reason").isNull() & F.col("ph_eligibility").isin(V.POSITIVE_ELIGIBILITY)
    guess = F.when(F.coalesce("failed_count", F.lit(0)) >= 3, "link-unavailable").otherwise("stale-feed")
    return t.withColumn("inactive_reason", F.when(due, guess).otherwise(F.col("inactive_reason")))


def _on_host(c, host: str):
    pattern = "^https?://(www\\.)?" + host.replace(".", "\\.") + "/"
    return F.coalesce(F.lower(trim(c)).rlike(pattern), F.lit(False))


def repair_contaminated(t: DataFrame, host: str, as_of) -> DataFrame:
    """Apply links copied from ``host`` into rows of other sources fall back to the source."""
    t = fill(t, "listings", "updated_at")
    df = t.withColumn("_bad", _on_host(F.col("application_url"), host) & ~_on_host(F.col("source_url"), host))
    return df.withColumns({
        "application_url": F.when(F.col("_bad"), F.col("source_url")).otherwise(F.col("application_url")),
        "updated_at": F.when(F.col("_bad"), moment(as_of)).otherwise(F.col("updated_at")),
    }).select(*t.columns)


def clear_contaminated_websites(companies: DataFrame, host: str, names: list[str], note: str) -> DataFrame:
    """Named companies whose website is only that host lose it and their link history."""
    t = fill(companies, "companies", "notes", "link_status", "link_checked_at", "link_evidence")
    bare = "^https?://(www\\.)?" + host.replace(".", "\\.") + "/?$"
    bad = F.col("company_name").isin(names) & F.coalesce(F.lower(trim(F.col("website"))).rlike(bare), F.lit(False))
    df = t.withColumn("_bad", bad)
    keep = ~F.col("_bad")
    return df.withColumns({
        **{c: F.when(keep, F.col(c)) for c in ("website", "link_status", "link_checked_at", "link_evidence")},
        "link_fail_count": F.when(keep, F.col("link_fail_count")).otherwise(0),
        "notes": F.when(keep, F.col("notes")).otherwise(F.concat_ws(" | ", "notes", F.lit(note))),
    }).select(*t.columns)


def geo_backfill(t: DataFrame, as_of, evidence_chars: int | None = None) -> DataFrame:
    """Gate every active row on its text alone; closed rows leave the board, the others are annotated."""
    cols = fill(t, "listings", "geo_scope", "geo_evidence", "geo_checked_at", "updated_at").columns
    active = t.where("is_active")
    blind = active.withColumns({"_kept_location": F.col("location_raw"), "location_raw": F.lit(None).cast("string")})
    gated = fill(geo_gate(blind), "listings", "geo_scope", "geo_evidence", "geo_checked_at", "updated_at")
    closed = F.col("gate_eligibility") == "ineligible"
    done = gated.withColumns({
        "location_raw": F.col("_kept_location"),
        "geo_scope": F.col("gate_scope"), "ph_eligibility": F.col("gate_eligibility"),
        "geo_evidence": head(F.col("gate_evidence"), evidence_chars), "geo_checked_at": moment(as_of),
        "is_active": ~closed,
        "updated_at": F.when(closed, moment(as_of)).otherwise(F.col("updated_at")),
    }).select(*cols)
    return done.unionByName(t.where("not is_active"), allowMissingColumns=True)


def retain_events(events: DataFrame, as_of, days: int = 90) -> DataFrame:
    """Events inside the retention period."""
    return events.where(F.col("ts") >= before(as_of, days))


def ingest_health(runs: DataFrame, listings: DataFrame, as_of, stale_hours: float = 3, board_hours: float = 36,
                  deployed_at=None, grace_hours: float = 2) -> DataFrame:
    """One row: last attempt, last clean run and the watchdog verdict on both clocks.

    ``runs(ts, degraded, summary)``.  A degraded run keeps the last clean time.  The board clock reads
    the newest scrape of any visible listing.
    """
    now = moment(as_of)
    hours = lambda c: F.round((F.unix_millis(now) - F.unix_millis(c)) / 3_600_000, 2)
    board = listings.where("is_active").agg(F.max("scraped_at")).scalar()
    one = runs.agg(
        F.count(F.lit(1)).alias("runs"), F.max("ts").alias("last_attempt_at"),
        F.max(F.when(~F.col("degraded"), F.col("ts"))).alias("last_clean_at"),
        F.max(F.struct("ts", F.when(F.col("degraded"), F.col("summary")).alias("s")))["s"].alias("last_error"),
    ).withColumns({"hours_since_attempt": hours(F.col("last_attempt_at")), "board_hours": hours(board)})
    age, idle = F.col("hours_since_attempt"), F.col("board_hours")
    reasons = F.filter(F.array(
        F.when(F.col("last_error").isNotNull(), F.concat(F.lit("degraded run: "), F.col("last_error"))),
        F.when(age.isNull() | (age < 0), "heartbeat row has no valid last-attempt age").when(
            age >= stale_hours, F.concat(F.lit("no scrape run in "), age.cast("string"), F.lit("h"))),
        F.when((idle >= 0) & (idle >= board_hours), F.concat(
            F.lit("board frozen: no new visible job in "), idle.cast("string"), F.lit("h"))),
    ), lambda r: r.isNotNull())
    grace = F.lit(False) if deployed_at is None else hours(moment(deployed_at)).between(0, grace_hours - 1e-9)
    none = F.col("runs") == 0
    return one.withColumn("_reasons", reasons).withColumns({
        "status": F.when(none & grace, "grace").when(none | (F.size("_reasons") > 0), "alert").otherwise("healthy"),
        "reason": F.when(none & grace, "awaiting first heartbeat").when(none, "diagnostic heartbeat row missing")
            .when(F.size("_reasons") > 0, F.array_join("_reasons", "; ")).otherwise("last run clean"),
    }).drop("_reasons")


