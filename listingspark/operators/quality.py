"""Quality reports over the listing table (F1-F9, F13, F15, F17-F21, F23, H-helpers)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import values as V
from ..functions.regex import SPACE, has_text, trim
from ..functions.text import head
from ..functions.times import before, effective_at

RECON_MEASURES = ["stale_30d", "unseen_14d", "never_verified", "missing_company"]


def _no_company() -> Column:
    return F.coalesce(F.trim("company"), F.lit("")) == ""


def _cohorts(as_of) -> dict[str, Column]:
    posted = effective_at("board")
    return {
        "stale_30d": posted < before(as_of, 30),
        "unseen_14d": F.col("last_seen_at") < before(as_of, 14),
        "never_seen": F.col("last_seen_at").isNull(),
        "never_verified": F.col("last_verified_at").isNull(),
        "missing_company": _no_company(),
        "undated": posted.isNull(),
        "ph_unclear": F.col("ph_eligibility") == "unclear",
        "ph_ineligible": F.col("ph_eligibility") == "ineligible",
    }


def _counts(tests: dict[str, Column], *names: str) -> list[Column]:
    return [F.count_if(tests[n]).alias(n) for n in names]


def core_totals(listings: DataFrame) -> DataFrame:
    """total, active and inactive rows."""
    return listings.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_active").alias("active"),
                        F.count_if(~F.col("is_active")).alias("inactive"))


def active_cohorts(listings: DataFrame, as_of) -> DataFrame:
    """sizes of the active cohorts."""
    t = _cohorts(as_of)
    return listings.where("is_active").agg(F.count(F.lit(1)).alias("active"), *_counts(
        t, "stale_30d", "unseen_14d", "never_seen", "never_verified", "missing_company", "undated"))


def distribution(listings: DataFrame, col: str, active: bool = True) -> DataFrame:
    """Rows per value of ``col``; NULL is shown as its own bucket."""
    rows = listings.where("is_active" if active else "not is_active")
    return rows.groupBy(F.coalesce(F.col(col), F.lit("(null)")).alias(col)).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), col)


def source_cohorts(listings: DataFrame, as_of) -> DataFrame:
    """seven measures per source."""
    t = _cohorts(as_of)
    return listings.where("is_active").groupBy("source_platform").agg(F.count(F.lit(1)).alias("active"), *_counts(
        t, "stale_30d", "unseen_14d", "never_verified", "missing_company", "ph_unclear", "ph_ineligible")).orderBy(
        F.desc("active"), "source_platform")


def _clusters(listings: DataFrame) -> DataFrame:
    company = F.coalesce("company", F.lit(""))
    return listings.where("is_active").groupBy(F.lower("title").alias("_t"), F.lower(company).alias("_c")).agg(
        F.min("title").alias("sample_title"), F.min(company).alias("sample_company"),
        F.count(F.lit(1)).alias("n")).where("n > 1")


def dup_summary(listings: DataFrame) -> DataFrame:
    """duplicate groups, rows in them and rows too many."""
    return _clusters(listings).agg(
        F.count(F.lit(1)).alias("dup_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in_dup_groups"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess_rows"))


def dup_top(listings: DataFrame, n: int = 20) -> DataFrame:
    """F8: the largest duplicate clusters with a deterministic sample."""
    return _clusters(listings).select("sample_title", "sample_company", "n").orderBy(
        F.desc("n"), "sample_title", "sample_company").limit(n)


def reconcile(listings: DataFrame, as_of) -> DataFrame:
    """deltas between independent partitions of the table; every one must be zero.

    One scan: the grand total and the strata come from grouping sets, then fold to a single row.
    """
    t = _cohorts(as_of)
    flagged = listings.select(
        "is_active", F.coalesce("source_platform", F.lit("")).alias("source"),
        F.coalesce("category", F.lit("")).alias("category"),
        F.coalesce("ph_eligibility", F.lit("(null)")).alias("eligibility"),
        F.coalesce("inactive_reason", F.lit("(null)")).alias("reason"),
        *[(F.col("is_active") & F.coalesce(t[m], F.lit(False))).alias(m) for m in [*RECON_MEASURES, "undated"]])
    sets = flagged.groupingSets(
        [[], ["source"], ["category"], ["eligibility"], ["reason"]], "source", "category", "eligibility", "reason"
    ).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("total"), F.count_if("is_active").alias("active"),
          F.count_if(~F.col("is_active")).alias("inactive"),
          *[F.count_if(m).alias(m) for m in [*RECON_MEASURES, "undated"]])
    grand, source, category, eligibility, reason = 15, 7, 11, 13, 14
    part = lambda g, c: F.coalesce(F.sum(F.when(F.col("g") == g, F.col(c))), F.lit(0))
    return sets.agg(
        (part(grand, "total") - part(grand, "active") - part(grand, "inactive")).alias("total_vs_parts"),
        (part(eligibility, "active") - part(grand, "active")).alias("eligibility_vs_active"),
        (part(category, "active") - part(grand, "active")).alias("category_vs_active"),
        (part(reason, "inactive") - part(grand, "inactive")).alias("reason_vs_inactive"),
        (part(source, "active") - part(grand, "active")).alias("source_vs_active"),
        (part(source, "total") - part(grand, "total")).alias("source_vs_total"),
        *[(part(source, m) - part(grand, m)).alias(f"{m}_vs_global") for m in RECON_MEASURES],
        part(grand, "undated").alias("undated"))


def facets(listings: DataFrame) -> DataFrame:
    """active rows per category and per platform as (facet, value, n); one scan, two groupings."""
    rows = listings.where("is_active").select("category", "source_platform")
    return rows.groupingSets([["category"], ["source_platform"]], "category", "source_platform").agg(
        F.grouping("category").alias("_g"), F.count(F.lit(1)).alias("n")).select(
        F.when(F.col("_g") == 0, "category").otherwise("platform").alias("facet"),
        F.when(F.col("_g") == 0, F.col("category")).otherwise(F.col("source_platform")).alias("value"), "n").where(
        "value is not null")


def board_stats(listings: DataFrame, companies: DataFrame) -> DataFrame:
    """visible listings and companies."""
    shown = companies.where("hires and coalesce(link_fail_count, 0) < 3").agg(F.count(F.lit(1))).scalar()
    return listings.where("is_active").agg(F.count(F.lit(1)).alias("listings")).withColumn("companies", shown)


def health_digest(listings: DataFrame, companies: DataFrame, as_of) -> DataFrame:
    """eight headline numbers as (metric, value)."""
    t, on = _cohorts(as_of), F.col("is_active")
    one = listings.agg(
        F.count_if(on).alias("active"), F.count(F.lit(1)).alias("total"),
        *[F.count_if(on & t[m]).alias(m) for m in ("stale_30d", "unseen_14d", "never_verified", "missing_company")])
    one = one.withColumns({"companies": companies.agg(F.count(F.lit(1))).scalar(),
                           "dup_groups": _clusters(listings).agg(F.count(F.lit(1))).scalar()})
    return _long(one, "metric", "value")


def _long(one: DataFrame, name: str, value: str) -> DataFrame:
    """One wide row as (name, value) rows."""
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias(name), F.col(c).cast("bigint").alias(value)) for c in one.columns])).alias("_e")
    ).select(f"_e.{name}", f"_e.{value}")


def missing_fields(listings: DataFrame, cols: list[str]) -> DataFrame:
    """active rows lacking each field, with their share in percent."""
    types = dict(listings.dtypes)
    empty = {c: ~has_text(F.col(c)) if types[c] == "string" else F.col(c).isNull() for c in cols}
    one = listings.where("is_active").agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(e).alias(c) for c, e in empty.items()])
    return one.select("_n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).alias("missing")) for c in cols])).alias("e")).select(
        "e.field", "e.missing", F.round(F.try_divide(100.0 * F.col("e.missing"), F.col("_n")), 2).alias("share"))


def freshness_buckets(listings: DataFrame, as_of) -> DataFrame:
    """active rows posted or seen longer ago than 30, 60 and 90 days, and undated ones."""
    posted, seen = F.col("posted_at"), F.col("last_seen_at")
    return _long(listings.where("is_active").agg(
        F.count_if(posted.isNull()).alias("posted_undated"),
        *[F.count_if(posted < before(as_of, d)).alias(f"posted_over_{d}d") for d in (30, 60, 90)],
        F.count_if(seen < before(as_of, 30)).alias("seen_over_30d")), "metric", "n")


def dup_keys(listings: DataFrame, keys: tuple[str, ...] = ("source_url", "content_hash", "description_hash")) -> DataFrame:
    """groups sharing a key and the rows in them, for each key column; the table is read once for all keys."""
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("k")
    groups = listings.where("is_active").select(named).select("k.*").where("value is not null and value <> ''").groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    shared = groups.where("n > 1")
    one = shared.agg(*[F.struct(F.count_if(F.col("key") == k).alias("dup_groups"), F.coalesce(F.sum(F.when(F.col("key") == k, F.col("n"))), F.lit(0)).alias("dup_rows")).alias(k) for k in keys])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"{k}.dup_groups").alias("dup_groups"), F.col(f"{k}.dup_rows").alias("dup_rows")) for k in keys])).alias("e")).select("e.*")


def stale_policy(listings: DataFrame, sources: DataFrame, as_of, grace_days: int = 14) -> DataFrame:
    """dry run of the stale policy: action per source state, platform and last sighting.

    Listings shrink to one row per platform and sighting class before they meet the registry, so a
    platform with a third of all rows costs nothing extra.
    """
    seen = F.when(F.col("last_seen_at").isNull(), "missing").when(
        F.col("last_seen_at") >= before(as_of, grace_days), "recent").otherwise("old")
    small = listings.where("is_active").groupBy("source_platform", seen.alias("seen")).agg(F.count(F.lit(1)).alias("n"))
    paused = F.col("status").isin("paused", "deprecated")
    states = sources.groupBy(F.col("platform").alias("source_platform")).agg(
        F.when(F.bool_or(~paused), "enabled").otherwise("paused").alias("state"))
    state = F.coalesce("state", F.lit("unclassified"))
    action = (
        F.when(state == "enabled", "keep_enabled_source").when(state == "unclassified", "classify_source_before_action")
        .when(F.col("seen") == "missing", "review_paused_missing_last_seen")
        .when(F.col("seen") == "recent", "hold_paused_recently_seen").otherwise("review_paused_not_seen"))
    return small.join(states, "source_platform", "left").groupBy(
        state.alias("source_state"), "source_platform", action.alias("action")).agg(F.sum("n").alias("rows"))


def verify_backlog(listings: DataFrame, checked: int, deactivated: int, per_run: int, runs_per_day: int = 2) -> DataFrame:
    """size of the verification queue after a run and the days to drain it."""
    return listings.where("is_active").agg(
        F.count(F.lit(1)).alias("backlog"), F.count_if(F.col("last_verified_at").isNull()).alias("never_verified")
    ).withColumns({
        "deferred": F.greatest(F.lit(0), F.col("backlog") + deactivated - checked),
        "sweep_days": F.ceil(F.col("backlog") / per_run / runs_per_day)})


def run_summary(counters: DataFrame, max_length: int | None = None, max_failures: int | None = None,
                failure_chars: int | None = None) -> DataFrame:
    """per run ``summary``, ``signal_count`` and ``degraded`` from its counters.

    Everything is kept by default; with ``max_length`` a longer summary is cut after the last complete signal
    that fits, and provider failures may be limited in number and length.
    """
    have = set(counters.columns)
    signals = []
    for column, label in V.COUNTERS:
        if column not in have:
            continue
        if column == "provider_failures":
            clean = F.transform(F.array_distinct(F.coalesce(column, F.array().cast("array<string>"))), lambda s: head(
                trim(F.regexp_replace(s, f"{SPACE}+", " ")), failure_chars))
            kept = F.filter(clean, lambda s: s != "")
            kept = kept if max_failures is None else F.slice(kept, 1, max_failures)
            signals.append(F.when(F.size(kept) > 0, F.concat(F.lit(f"{label}="), F.array_join(kept, "|"))))
        else:
            n = F.floor(F.col(column))
            signals.append(F.when(F.col(column) > 0, F.concat(F.lit(f"{label}="), n.cast("string"))))
    if "cadence_available" in have:
        signals.append(F.when(~F.col("cadence_available"), F.lit("cadenceStateUnavailable")))
    df = counters.withColumn("_s", F.filter(F.array(*signals), lambda s: s.isNotNull()))
    joined = F.array_join("_s", ", ")
    summary = joined
    if max_length is not None:
        start = F.substring(joined, 1, max_length)
        boundary = F.length(start) - F.locate(" ,", F.reverse(start)) - 1
        cut = F.when(F.locate(", ", start) > 1, F.substring(start, F.lit(1), boundary)).otherwise(
            F.concat(F.substring(start, 1, max_length - 1), F.lit("…")))
        summary = F.when(F.length(joined) <= max_length, joined).otherwise(cut)
    return df.withColumns({
        "signal_count": F.size("_s"), "degraded": F.size("_s") > 0, "summary": F.when(F.size("_s") > 0, summary),
    }).drop("_s")


