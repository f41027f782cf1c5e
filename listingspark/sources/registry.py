"""Source registry, pauses and tracking-system policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.regex import has_text, trim
from ..schemas import fill

OFF = ["paused", "deprecated"]


def enabled_sources(sources: DataFrame, type: str | None = None) -> DataFrame:
    """A2: sources that may be fetched, optionally of one feed type."""
    on = sources.where(~F.col("status").isin(OFF))
    return on.where(F.col("type") == type) if type else on


def disabled_sources(sources: DataFrame) -> DataFrame:
    return sources.where(F.col("status").isin(OFF))


def valid_pauses(pauses: DataFrame) -> DataFrame:
    """Complete pause rows, one per source (the last by pause time); others are dropped."""
    whole = pauses.where(has_text(F.col("source_id")) & F.col("reason").isNotNull() & F.col("paused_at").isNotNull()
                         & F.col("paused_by").isNotNull()).withColumn("source_id", trim(F.col("source_id")))
    return whole.groupBy("source_id").agg(F.max(F.struct("paused_at", "paused_by", "reason")).alias("p")).select(
        "source_id", F.concat(F.lit("Auto-paused "), F.col("p.paused_at"), F.lit(" by "), F.col("p.paused_by"),
                              F.lit(": "), F.col("p.reason")).alias("note"))


def apply_pauses(sources: DataFrame, pauses: DataFrame) -> DataFrame:
    """A3: paused sources get status ``paused`` and the reason in front of their notes."""
    df = sources.join(valid_pauses(pauses), "source_id", "left")
    hit = F.col("note").isNotNull()
    return df.withColumns({
        "status": F.when(hit, "paused").otherwise(F.col("status")),
        "notes": F.when(hit, F.concat(F.col("note"), F.lit(" (Prior notes: "), F.coalesce("notes", F.lit("")), F.lit(")")))
            .otherwise(F.col("notes")),
    }).select(*sources.columns)


def _tenant_key(companies: DataFrame) -> DataFrame:
    key = F.when(has_text(F.col("ats_platform")) & has_text(F.col("ats_token")), F.concat_ws(":", "ats_platform", "ats_token"))
    return companies.withColumn("source_key", key)


def unmatched_pauses(pauses: DataFrame, sources: DataFrame, companies: DataFrame) -> DataFrame:
    """A4: pauses that name neither a source nor a tracking tenant."""
    targets = sources.select("source_id").union(
        _tenant_key(companies).where("source_key is not null").select("source_key")).distinct()
    return valid_pauses(pauses).join(targets, "source_id", "left_anti").select("source_id")


def resolve_ats_policy(companies: DataFrame, token_policy: DataFrame, platform_policy: DataFrame,
                       pauses: DataFrame) -> DataFrame:
    """A5: add ``enabled``, ``policy_status`` and ``policy_notes`` to companies.

    Pause, then tenant policy, then platform policy; a platform nobody reviewed stays off.
    Policies are ``(source_key, enabled, status, notes)`` and ``(ats_platform, enabled, status, notes)``.
    """
    def packed(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.select(key, F.struct("enabled", "status", "notes").alias(name))

    df = _tenant_key(companies)
    df = df.join(valid_pauses(pauses).withColumnRenamed("source_id", "source_key"), ["source_key"], "left")
    df = df.join(packed(token_policy, "source_key", "_tp"), ["source_key"], "left")
    df = df.join(packed(platform_policy, "ats_platform", "_pp"), ["ats_platform"], "left")
    paused = F.when(F.col("note").isNotNull(), F.struct(
        F.lit(False).alias("enabled"), F.lit("paused").alias("status"), F.col("note").alias("notes")))
    unknown = F.struct(F.lit(False).alias("enabled"), F.lit("paused").alias("status"), F.concat(
        F.lit('Paused: platform "'), F.coalesce("ats_platform", F.lit("")), F.lit('" is not configured')).alias("notes"))
    df = df.withColumn("_p", F.coalesce(paused, F.col("_tp"), F.col("_pp"), unknown))
    return df.withColumns({"enabled": F.col("_p.enabled"), "policy_status": F.col("_p.status"),
                           "policy_notes": F.col("_p.notes")}).drop("note", "_tp", "_pp", "_p")


def plan_ats_fetch(resolved: DataFrame, rotated: str = "workable", n: int = 2) -> DataFrame:
    """Add ``plan`` (policy, rotation, duplicate, fetch) and ``primary_company``.

    One company per tenant fetches, first by name.  The rotated platform fetches only the tenants of
    its ``n`` companies verified longest ago.  Both choices reduce to one row per key before they are
    joined back.
    """
    df = fill(resolved, "companies", "verified_at").where("source_key is not null")
    oldest = Window.partitionBy("ats_platform").orderBy(
        F.col("verified_at").asc_nulls_first(), "source_key", "company_name", "id")
    turn = df.where(F.col("ats_platform") == rotated).withColumn("_r", F.row_number().over(oldest)).where(
        F.col("_r") <= n).select("source_key", F.lit(True).alias("_turn")).distinct()
    df = df.join(turn, ["source_key"], "left")
    waits = (F.col("ats_platform") == rotated) & F.col("_turn").isNull()
    df = df.withColumn("_state", F.when(~F.col("enabled"), "policy").when(waits, "rotation"))
    first = df.where("_state is null").groupBy("source_key").agg(F.min(F.struct("company_name", "id")).alias("_first"))
    df = df.join(first, ["source_key"], "left")
    plan = F.coalesce("_state", F.when(F.col("id") == F.col("_first.id"), "fetch").otherwise("duplicate"))
    return df.withColumns({
        "plan": plan,
        "primary_company": F.when(F.col("_state").isNull(), F.col("_first.company_name")),
    }).drop("_state", "_turn", "_first")


def fetch_results(cadence: DataFrame, ats: DataFrame) -> DataFrame:
    """One row per feed and tenant of a run with the decision taken, skipped ones included."""
    feeds = cadence.select("source_id", F.lit("feed").alias("kind"), "decision", (F.col("decision") != "due").alias("skipped"))
    tenants = ats.select(F.col("source_key").alias("source_id"), F.lit("ats").alias("kind"), F.col("plan").alias("decision"),
                         (F.col("plan") != "fetch").alias("skipped"))
    return feeds.unionByName(tenants)
