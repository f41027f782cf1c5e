"""Fetch outcome classes (C11), vote merging (C12, C13) and the transitions built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T, urls as U
from ..functions.times import moment
from ..schemas import fill


def classify_fetch(events: DataFrame, sources: DataFrame) -> DataFrame:
    """C11: add ``outcome`` to fetch events: policy first, then transport, payload shape and count."""
    known = sources.select("source_id", F.col("status").alias("_status"))
    df = events.join(known, ["source_id"], "left")
    message = F.lower(F.coalesce("error", F.lit("")))
    return df.withColumn("outcome", (
        F.when(F.coalesce(F.col("_status"), F.lit("allowed")) != "allowed", "POLICY_BLOCKED")
        .when(F.col("skipped"), "UNKNOWN")
        .when(~F.col("ok") & message.rlike("429|rate limit"), "RATE_LIMITED")
        .when(~F.col("ok") & message.rlike("parse|schema"), "SCHEMA_BROKEN")
        .when(~F.col("ok"), "UNREACHABLE")
        .when(F.col("cnt") > 0, "HEALTHY_WITH_RESULTS")
        .when(F.col("cnt") == 0, "HEALTHY_EMPTY")
        .otherwise("UNKNOWN"))).drop("_status")


class _Fields:
    """Columns that share a prefix, read by their own name."""

    def __init__(self, prefix: str) -> None:
        self.prefix = prefix

    def __getitem__(self, name: str) -> Column:
        return F.col(self.prefix + name)


def newest(votes: DataFrame, key: str, at: str = "voted_at") -> DataFrame:
    """One row per key: the greatest by ``at``, where there is such a column, and then by the other columns."""
    rest = sorted((c for c in votes.columns if c != key), key=lambda c: c != at)
    return votes.groupBy(key).agg(F.max(F.struct(*rest)).alias("_newest")).select(key, *[F.col(f"_newest.{c}").alias(c) for c in rest])


def merge_verdicts(listings: DataFrame, votes: DataFrame, skeptics: DataFrame, key: str = "source_url") -> DataFrame:
    """Add ``decision`` and ``decision_reason`` plus the vote as ``_vote_`` columns.

    Needs ``gate_scope``.  No usable vote means ``unavailable`` (nothing is published on it); the
    skeptic only counts where the gate found nothing, and an unavailable skeptic does not block.
    Of several votes for one listing the newest counts, so no listing is doubled.
    """
    votes, skeptics = newest(votes, "listing_key"), newest(skeptics, "listing_key")
    first = votes.select(F.col("listing_key").alias(key), *[
        F.col(c).alias(f"_vote_{c}") for c in votes.columns if c != "listing_key"])
    second = skeptics.select(F.col("listing_key").alias(key), *[
        F.col(c).alias(f"_skeptic_{c}") for c in ("available", "eligible", "reason")])
    df = listings.join(first, key, "left").join(second, key, "left")
    v, s = _Fields("_vote_"), _Fields("_skeptic_")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    refuted = (F.col("gate_scope") == "unknown") & F.coalesce(s["available"], F.lit(False)) & no(s["eligible"])
    decision = (
        F.when(F.col("gate_eligibility") == "ineligible", "gate-rejected")
        .when(no(v["available"]), "unavailable")
        .when(no(v["eligible"]), "ineligible")
        .when(refuted, "consensus-split")
        .otherwise("eligible"))
    return df.withColumn("decision", decision).withColumn("decision_reason", (
        F.when(F.col("decision") == "gate-rejected", F.col("gate_evidence"))
        .when(F.col("decision") == "unavailable", F.coalesce(v["reason"], F.lit("no verdict on record")))
        .when(F.col("decision") == "ineligible", F.coalesce(v["reason"], F.lit("ineligible")))
        .when(F.col("decision") == "consensus-split", F.coalesce(s["reason"], F.lit("refuted")))
        .otherwise(F.coalesce(v["reason"], F.lit("eligible"))))).drop(*[
            c for c in second.columns if c != key])


def _after(label: str, text: Column, chars: int | None) -> Column:
    return F.concat(F.lit(label), T.head(text, chars))


def apply_verdicts(merged: DataFrame, as_of, evidence_chars: int | None = None, parked_chars: int | None = None) -> DataFrame:
    """Listing columns after the merged decision.

    Undecided rows are parked as ``pending-triage``.  A trusted apply link of the vote wins over the
    one in the feed, and the source address is the last resort.  Reasons are kept whole unless
    ``evidence_chars``, or ``parked_chars`` for parked rows, limits them.
    """
    now = moment(as_of)
    t = fill(merged, "listings", "tags", "pay_range", "experience_level", "application_url", "type", "category")
    d, v, why = F.col("decision"), _Fields("_vote_"), F.col("decision_reason")
    t = U.with_url(t, "source_url", "_src")
    t = U.with_url(t, "application_url", "_app")
    t = U.with_url(t, v["application_url"], "_voted")
    src, raw = U.Url("_src"), F.col("source_url")
    good = d == "eligible"
    link = F.coalesce(
        F.when(good, U.trusted_apply(U.Url("_voted"), v["application_url"], src, raw)),
        U.trusted_apply(U.Url("_app"), F.col("application_url"), src, raw), raw)
    own = F.coalesce("tags", F.array().cast("array<string>"))
    rejected = F.when(d == "gate-rejected", "geo-gate-rejected").when(d == "ineligible", "triage-rejected").when(
        d == "consensus-split", "consensus-quarantined")
    votes = [c for c in t.columns if c.startswith("_vote_")]
    return U.drop_url(t.withColumns({
        "is_active": good,
        "inactive_reason": F.when(good, F.lit(None).cast("string")).when(d == "unavailable", "pending-triage")
            .otherwise("policy-rejected"),
        "geo_scope": F.col("gate_scope"),
        "ph_eligibility": F.when(good, F.when(F.col("gate_eligibility") == "unclear", "eligible_likely").otherwise(
            F.col("gate_eligibility"))).when(d.isin("gate-rejected", "ineligible"), "ineligible").otherwise("unclear"),
        "geo_evidence": F.when(good & (F.col("gate_scope") == "unknown"), _after("AI triage passed: ", why, evidence_chars))
            .when(good, F.col("gate_evidence")).when(d == "gate-rejected", F.col("gate_evidence"))
            .when(d == "ineligible", _after("AI triage: ", why, evidence_chars))
            .when(d == "consensus-split", _after("Consensus split — skeptic: ", why, evidence_chars))
            .otherwise(_after("Pending durable triage: ", why, parked_chars)),
        "geo_checked_at": now,
        "application_url": link,
        "tags": F.when(good, T.merge_tags(own, F.array(v["category"]), v["tags"], normalise=True))
            .when(rejected.isNotNull(), F.array_distinct(F.concat(own, F.array(rejected)))).otherwise(own),
        "pay_range": F.when(good, v["pay_range"]).otherwise(F.col("pay_range")),
        "category": F.when(good, T.fold_category(v["category"])).when(rejected.isNotNull(), "other")
            .otherwise(F.col("category")),
        "experience_level": F.when(good, v["experience_level"]).otherwise(F.col("experience_level")),
        "type": F.when(good, F.when(v["employment_type"] == "contract", "freelance").otherwise(
            F.coalesce(v["employment_type"], F.lit("freelance")))).otherwise(F.col("type")),
        "updated_at": now,
    }).drop(*votes, "decision_reason", "gate_scope", "gate_eligibility", "gate_evidence"), "_src", "_app", "_voted")


def rejections_by_source(merged: DataFrame) -> DataFrame:
    """gate rejections per source of a batch."""
    return merged.where(F.col("gate_eligibility") == "ineligible").groupBy("source_platform").agg(
        F.count(F.lit(1)).alias("rejected"))


def verdict_counts(gated: DataFrame) -> DataFrame:
    """how often the gate gave each eligibility."""
    return gated.groupBy("gate_eligibility").agg(F.count(F.lit(1)).alias("n"))


def apply_sweep(listings: DataFrame, votes: DataFrame, skeptics: DataFrame, as_of) -> DataFrame:
    """Re-decide rows of the unclear backlog that have a new vote.

    Votes are keyed by listing id.  An unavailable vote only rotates ``geo_checked_at``.
    """
    now = moment(as_of)
    t = fill(listings, "listings", "geo_evidence", "geo_checked_at", "updated_at")
    cols = t.columns
    votes, skeptics = newest(votes, "listing_key"), newest(skeptics, "listing_key")
    v1 = votes.select(F.col("listing_key").alias("id"), F.struct("available", "eligible", "reason").alias("_v"))
    v2 = skeptics.select(F.col("listing_key").alias("id"), F.struct("available", "eligible", "reason").alias("_s"))
    t = t.join(v1, "id", "left").join(v2, "id", "left")
    v, s = F.col("_v"), F.col("_s")
    due = v.isNotNull() & F.col("is_active") & (F.col("ph_eligibility") == "unclear")
    judged = due & F.coalesce(v["available"], F.lit(False))
    against = judged & ~F.coalesce(v["eligible"], F.lit(False))
    seen = F.coalesce(s["available"], F.lit(False))
    split = judged & ~against & seen & ~F.coalesce(s["eligible"], F.lit(False))
    passed = judged & ~against & ~split
    reason = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), F.lit(default))
    return t.withColumns({
        "is_active": F.when(against | split, False).otherwise(F.col("is_active")),
        "inactive_reason": F.when(against | split, "policy-rejected").otherwise(F.col("inactive_reason")),
        "ph_eligibility": F.when(against, "ineligible").when(passed, "eligible_likely").otherwise(
            F.col("ph_eligibility")),
        "geo_evidence": F.when(against, _after("AI re-triage: ", reason(v["reason"], "ineligible"), None))
            .when(split, _after("Re-triage consensus split — skeptic: ", reason(s["reason"], "refuted"), None))
            .when(passed & s.isNotNull() & ~seen, _after(
                "AI re-triage passed (single vote): ", reason(v["reason"], "eligible"), None))
            .when(passed, _after("AI re-triage + skeptic agreed: ", reason(v["reason"], "eligible"), None))
            .otherwise(F.col("geo_evidence")),
        "geo_checked_at": F.when(due, now).otherwise(F.col("geo_checked_at")),
        "updated_at": F.when(due, now).otherwise(F.col("updated_at")),
    }).select(*cols)
