"""Direct ingest of listings and digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .. import values as V
from ..functions import text as T, urls as U
from ..functions.regex import text_or_null, trim
from ..functions.times import moment, parse_time
from ..operators.cleaning import add_keys, sanitize_urls
from ..operators.geo import geo_gate
from ..operators.lifecycle import first_per_key

_ITEM = {
    "title": "string", "company": "string", "type": "string", "source_url": "string", "source_platform": "string",
    "tags": "array<string>", "category": "string", "location_type": "string", "client_timezone": "string",
    "pay_range": "string", "description": "string", "application_url": "string", "posted_at": "string",
    "scraped_at": "string", "experience_level": "string", "last_seen_at": "string", "last_verified_at": "string",
    "location_raw": "string",
}


def conform_ingest(items: DataFrame, as_of, max_tags: int | None = None) -> DataFrame:
    """Caller-supplied listings to table rows.

    Only known descriptive fields pass; the server owns state, keys and counters.  Rows without a safe
    web address are dropped.  Dates come as text.
    """
    have = set(items.columns)
    df = items.select(*[c for c in ("payload_id", "ordinal") if c in have], *[
        (F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in _ITEM.items()])
    clean = [c for c, t in _ITEM.items() if t == "string" and c not in ("source_url", "application_url")]
    df = df.withColumns({c: text_or_null(F.col(c)) for c in clean})
    df = sanitize_urls(df).where("source_url is not null").drop("quarantined", "host", "trusted_source", "ats_platform", "ats_token")
    now = moment(as_of)
    tags = F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.isNotNull())
    df = df.withColumns({
        "title": F.coalesce("title", F.lit("Untitled")),
        "type": T.one_of(F.col("type"), V.JOB_TYPES, "freelance"),
        "location_type": T.one_of(F.col("location_type"), V.LOCATION_TYPES, "remote"),
        "experience_level": T.one_of(F.col("experience_level"), V.EXPERIENCE_LEVELS),
        "source_platform": F.coalesce("source_platform", F.lit("ingest")),
        "category": F.coalesce("category", F.lit("other")),
        "tags": tags if max_tags is None else F.slice(tags, 1, max_tags),
        "posted_at": parse_time(F.col("posted_at")),
        "scraped_at": F.coalesce(parse_time(F.col("scraped_at")), now),
        "last_seen_at": F.coalesce(parse_time(F.col("last_seen_at")), now),
        "last_verified_at": parse_time(F.col("last_verified_at")),
    })
    gated = geo_gate(add_keys(df).drop("company_key"))
    shut = F.col("gate_eligibility") == "ineligible"
    return gated.withColumns({
        "is_active": ~shut, "inactive_reason": F.when(shut, "policy-rejected"),
        "click_count": F.lit(0).cast("bigint"), "failed_count": F.lit(0),
        "geo_scope": F.col("gate_scope"), "ph_eligibility": F.col("gate_eligibility"),
        "geo_evidence": F.col("gate_evidence"), "geo_checked_at": now, "updated_at": now,
    }).drop("gate_scope", "gate_eligibility", "gate_evidence")


def normalize_items(items: DataFrame) -> DataFrame:
    """Last boundary before the table: unsafe rows go, untrusted apply links are replaced, keys are recomputed.

    ``quarantined`` stays on the rows for :func:`boundary_counts`.
    """
    df = sanitize_urls(items).where("source_url is not null")
    return df.withColumn("content_hash", F.sha2(F.concat_ws("::", "title", "source_url"), 256)).select(
        *items.columns, *(["content_hash"] if "content_hash" not in items.columns else []), "quarantined")


def boundary_counts(items: DataFrame) -> DataFrame:
    """Rows received, kept, dropped for their address and with a quarantined apply link; one scan."""
    df = sanitize_urls(items)
    return df.agg(F.count(F.lit(1)).alias("received"), F.count("source_url").alias("kept"),
                  F.count_if(F.col("source_url").isNull()).alias("dropped_no_url"),
                  F.count_if("quarantined").alias("quarantined"))


# Digest field limits.
DIGEST_LIMITS = {"creator_name": 200, "video_id": 128, "video_title": 500, "transcript_raw": 80_000}
DIGEST_LISTS = {"action_plan": (30, 1000), "tags": (30, 100)}


def _needs(c: Column, limit: int) -> Column:
    size = F.length(trim(c))
    return F.coalesce((size > 0) & (size <= limit), F.lit(False))


def _fits(limit: int) -> Callable[[Column], Column]:
    return lambda text: _needs(text, limit)


def validate_digests(items: DataFrame, max_items: int | None = None) -> DataFrame:
    """Add ``item_error``, ``payload_ok`` and ``first_error`` to digest items.

    ``items(payload_id, index, creator_name, video_id, video_title, video_url, transcript_raw,
    action_plan, tags, published_at)`` with dates as text.  One bad item rejects its whole payload; the
    verdict of a payload is an aggregate that is joined back salted, so a huge payload stays spread.
    With ``max_items`` a payload of more items is rejected too.
    """
    df = U.with_url(items, "video_url", "_u")
    error = F.when(~_needs(F.col("creator_name"), DIGEST_LIMITS["creator_name"]), "creator_name")
    for name in ("video_id", "video_title"):
        error = error.when(~_needs(F.col(name), DIGEST_LIMITS[name]), name)
    error = error.when(U.safe_source(U.Url("_u"), F.col("video_url")).isNull(), "video_url")
    error = error.when(F.col("transcript_raw").isNotNull() & ~_needs(
        F.col("transcript_raw"), DIGEST_LIMITS["transcript_raw"]), "transcript_raw")
    for name, (count, size) in DIGEST_LISTS.items():
        fine = (F.size(name) <= count) & F.forall(name, _fits(size))
        error = error.when(F.col(name).isNotNull() & ~fine, name)
    error = error.when(F.col("published_at").isNotNull() & parse_time(F.col("published_at")).isNull(), "published_at")
    df = U.drop_url(df.withColumn("item_error", error), "_u")
    verdict = df.groupBy("payload_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(F.when(F.col("item_error").isNotNull(), F.struct("index", F.col("item_error").alias("field")))).alias("_bad"))
    message = F.when(F.col("_bad").isNotNull(), F.concat(F.lit("item "), F.col("_bad.index").cast("string"), F.lit(": "), F.col("_bad.field")))
    if max_items is not None:
        message = F.when(F.col("_n") > max_items, f"more than {max_items} items").otherwise(message)
    verdict = verdict.select("payload_id", message.alias("first_error"))
    return df.join(verdict, ["payload_id"], "inner").withColumn(
        "payload_ok", F.col("first_error").isNull())


def accepted_digests(validated: DataFrame, as_of) -> DataFrame:
    """Normalised rows of accepted payloads."""
    df = U.with_url(validated.where("payload_ok"), "video_url", "_u")
    texts = {c: text_or_null(F.col(c)) for c in ("creator_name", "video_id", "video_title", "transcript_raw")}
    lists = {c: F.transform(F.coalesce(c, F.array().cast("array<string>")), trim) for c in DIGEST_LISTS}
    return U.drop_url(df.withColumns({**texts, **lists, "video_url": U.safe_source(U.Url("_u"), F.col("video_url")),
                           "published_at": parse_time(F.col("published_at")), "processed_at": moment(as_of)}).drop(
        "item_error", "payload_ok", "first_error"), "_u")


def upsert_digests(target: DataFrame, batch: DataFrame, order: str = "index") -> DataFrame:
    """Target plus digests of unknown videos; the first of a video wins."""
    new = first_per_key(batch, "video_id", order).join(target.select("video_id"), "video_id", "left_anti")
    return target.unionByName(new.select(*[c for c in target.columns if c in new.columns]), allowMissingColumns=True)


