"""Company discovery and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import values as V
from ..functions import text as T, urls as U
from ..functions.regex import has_text, trim
from ..functions.times import effective_at, moment
from ..schemas import fill


def prospect_candidates(listings: DataFrame, companies: DataFrame, min_jobs: int, cutoff, limit: int) -> DataFrame:
    """companies with open listings that the directory lacks.

    One grouping gives counts, the freshest sample address and the category; the anti join runs on the
    grouped rows, so no company with many listings is shuffled as rows.
    """
    fresh = effective_at("prospect")
    rows = listings.where(F.col("is_active") & F.col("ph_eligibility").isin(V.POSITIVE_ELIGIBILITY)
                          & has_text(F.col("company")))
    grouped = rows.groupBy(F.lower("company").alias("_key")).agg(
        F.min("company").alias("company"), F.count(F.lit(1)).alias("jobs"),
        F.max(F.struct(fresh.alias("at"), F.col("source_url").alias("url")))["url"].alias("sample_url"),
        F.max("category").alias("category"), F.max(fresh).alias("_fresh"))
    known = companies.select(F.lower("company_name").alias("_key"))
    return grouped.where((F.col("jobs") >= min_jobs) & (F.col("_fresh") >= moment(cutoff))).join(
        known, "_key", "left_anti").select("company", "jobs", "sample_url", "category").orderBy(
        F.desc("jobs"), "company").limit(limit)


def classify_candidates(candidates: DataFrame, companies: DataFrame) -> DataFrame:
    """C14: add ``lane`` (auto_add, review, rejected) with tracking tenant and niche.

    Rows already in the directory or repeated under the same canonical name are dropped; the one with
    most jobs stays.
    """
    df = U.with_url(candidates, "sample_url", "_u").withColumn("company_key", T.company_key(F.col("company")))
    good = T.is_quality_company(F.col("company"))
    rejected = df.where(~good).withColumn("lane", F.lit("rejected"))
    known = companies.select(T.company_key(F.col("company_name")).alias("company_key"))
    order = Window.partitionBy("company_key").orderBy(F.desc("jobs"), "company")
    kept = df.where(good).join(known, "company_key", "left_anti").withColumn(
        "_r", F.row_number().over(order)).where("_r = 1").drop("_r").withColumn(
        "lane", F.when(U.is_trusted_source(U.Url("_u")), "auto_add").otherwise("review"))
    ats = U.ats_of(U.Url("_u"))
    return U.drop_url(kept.unionByName(rejected).withColumns({
        "company": trim(F.col("company")), "ats_platform": ats["platform"], "ats_token": ats["token"],
        "niche": T.niche_of(F.col("category"))}), "_u")


def drain(classified: DataFrame, n: int = 15, ceiling: int | None = None) -> DataFrame:
    """H9: the ``n`` strongest auto-add rows; with a ``ceiling``, ``over_ceiling`` flags a run of more rows than that."""
    ready = classified.where("lane = 'auto_add'")
    if ceiling is not None:
        ready = ready.withColumn("over_ceiling", ready.agg(F.count(F.lit(1))).scalar() > ceiling)
    return ready.orderBy(F.desc("jobs"), "company").limit(n)


def add_prospects(companies: DataFrame, drained: DataFrame, as_of) -> DataFrame:
    """Directory plus drained companies; a discovered tenant is stored but stays disabled by policy.

    Rows flagged as over the ceiling of a run wait for a person.
    """
    have = fill(companies, "companies", "notes", "is_remote")
    if "over_ceiling" in drained.columns:
        drained = drained.where("not over_ceiling")
    day = F.date_format(moment(as_of), "yyyy-MM-dd")
    note = F.concat(F.lit("Prospector auto-add "), day, F.lit(": discovered from "), F.col("jobs").cast("string"),
                    F.lit(" active job(s); sample "), F.coalesce("sample_url", F.lit("n/a")), F.lit("."))
    new = drained.select(
        F.col("company").alias("company_name"), F.lit(True).alias("hires"), "niche", F.lit(False).alias("is_verified"),
        F.lit(True).alias("is_remote"), note.alias("notes"), "ats_platform", "ats_token")
    return have.unionByName(new, allowMissingColumns=True)


def ats_proposals(drained: DataFrame, classified: DataFrame) -> DataFrame:
    """Discovered tenants that a person may enable."""
    cols = ["company", "ats_platform", "ats_token", "jobs", "sample_url"]
    both = drained.select(cols).unionByName(classified.where("lane = 'review'").select(cols))
    return both.where("ats_platform is not null")


def seed_companies(companies: DataFrame, seed: DataFrame) -> DataFrame:
    """Directory plus curated rows whose canonical name is not there yet."""
    known = companies.select(T.company_key(F.col("company_name")).alias("_key"))
    new = seed.withColumn("_key", T.company_key(F.col("company_name"))).join(known, "_key", "left_anti").drop("_key")
    return companies.unionByName(new, allowMissingColumns=True)


def company_job_signal(companies: DataFrame, listings: DataFrame) -> DataFrame:
    """Per company the verified and the positively eligible open listings."""
    rows = listings.where(F.col("is_active") & F.col("ph_eligibility").isin(V.POSITIVE_ELIGIBILITY))
    signal = rows.groupBy(F.lower("company").alias("_key")).agg(
        F.count_if(F.col("ph_eligibility") == "eligible_verified").alias("verified_jobs"),
        F.count(F.lit(1)).alias("eligible_jobs"))
    return companies.withColumn("_key", F.lower("company_name")).join(signal, "_key", "left").drop("_key").fillna(
        0, ["verified_jobs", "eligible_jobs"])


def enrich_companies(companies: DataFrame, listings: DataFrame, as_of) -> DataFrame:
    """Fill hiring pages from the tracking tenant and verify companies their own listings vouch for."""
    t = fill(companies, "companies", "hiring_page_url", "notes", "verified_at")
    cols = t.columns
    t = company_job_signal(t, listings)
    page = F.when(~has_text(F.col("hiring_page_url")), U.ats_url(
        F.col("ats_platform"), F.col("ats_token"), V.ATS_CAREER_PAGES))
    selected = (~F.col("is_verified") & F.col("hires")) | (
        F.col("ats_platform").isNotNull() & F.col("ats_token").isNotNull() & F.col("hiring_page_url").isNull())
    t = t.withColumn("_page", F.when(selected, page)).withColumn(
        "_verify", selected & ~F.col("is_verified") & (F.col("verified_jobs") >= 1) & (F.col("eligible_jobs") >= 2))
    acts = F.array_join(F.filter(F.array(
        F.concat(F.lit("hiring_page="), F.col("_page")),
        F.when(F.col("_verify"), F.concat(
            F.lit("auto-verified ("), F.col("verified_jobs").cast("string"), F.lit(" verified, "),
            F.col("eligible_jobs").cast("string"), F.lit(" PH-eligible jobs)")))), lambda a: a.isNotNull()), "; ")
    note = F.concat(F.lit("[enrich "), F.date_format(moment(as_of), "yyyy-MM-dd"), F.lit("] "), acts)
    return t.withColumns({
        "hiring_page_url": F.coalesce("_page", "hiring_page_url"),
        "is_verified": F.col("is_verified") | F.col("_verify"),
        "verified_at": F.when(F.col("_verify"), moment(as_of)).otherwise(F.col("verified_at")),
        "notes": F.when(acts != "", F.concat_ws(" | ", "notes", note)).otherwise(F.col("notes")),
    }).select(*cols)


def enrich_batch(companies: DataFrame, n: int, seed: int) -> DataFrame:
    """H8: companies with a gap that can be filled, in an order shuffled by ``seed`` and repeatable."""
    t = fill(companies, "companies", "hiring_page_url")
    gap = (~F.col("is_verified") & F.col("hires")) | (
        F.col("ats_platform").isNotNull() & F.col("ats_token").isNotNull() & F.col("hiring_page_url").isNull())
    return t.where(gap).orderBy(F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))), 256), "id").limit(n)


def cross_company_hosts(df: DataFrame, threshold: float = 3) -> DataFrame:
    """untrusted apply hosts that appear for at least ``threshold`` different companies."""
    t = U.with_url(U.with_url(df, "source_url", "_src"), "application_url", "_app")
    ok = (U.safe_source(U.Url("_src"), F.col("source_url")).isNotNull()
          & U.safe_apply(U.Url("_app"), F.col("application_url")).isNotNull() & U.Url("_app").known
          & has_text(F.col("company")) & ~U.attributable(U.Url("_app"), U.Url("_src")))
    pairs = t.where(ok).select(U.host_of(U.Url("_app")).alias("host"), trim(F.lower("company")).alias("company"))
    return pairs.groupBy("host").agg(F.count_distinct("company").alias("companies")).where(
        F.col("companies") >= max(2, int(threshold)))
