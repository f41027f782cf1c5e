"""Board, directory and export views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import values as V
from ..functions import text as T, urls as U
from ..functions.regex import has_text
from ..functions.times import before, effective_at, iso
from ..schemas import fill

CARD = ["id", "title", "company", "type", "source_url", "source_platform", "posted_at", "experience_level",
        "geo_scope", "ph_eligibility", "geo_evidence"]


def board(listings: DataFrame, category: str | None = None, type: str | None = None,
          platform: str | None = None) -> DataFrame:
    """Visible listings; an unknown category or type is ignored, a platform is taken as given."""
    df = listings.where("is_active")
    if category in V.BOARD_CATEGORIES:
        df = df.where(F.col("category") == category)
    if type in V.JOB_TYPES:
        df = df.where(F.col("type") == type)
    if platform:
        df = df.where(F.col("source_platform") == platform)
    return df


def cards(df: DataFrame) -> DataFrame:
    """The eleven card columns."""
    return fill(df, "listings", *CARD).select(*CARD)


def visible_companies(companies: DataFrame) -> DataFrame:
    """D3: companies that hire and have fewer than three link strikes."""
    return companies.where("hires and coalesce(link_fail_count, 0) < 3")


def directory(companies: DataFrame, category: str | None = None, q: str = "") -> DataFrame:
    """Visible companies of a niche or special filter whose name contains ``q``."""
    df = visible_companies(companies)
    if category == "dayshift":
        df = df.where("is_dayshift")
    elif category == "marketplaces":
        df = df.where("is_marketplace")
    elif category in V.DIRECTORY_NICHES:
        df = df.where(F.col("niche") == category)
    return contains_search(df, ["company_name"], q)


def public_details(listings: DataFrame) -> DataFrame:
    """Listings with a public detail page."""
    return listings.where(F.col("is_active") & F.col("ph_eligibility").isin(V.POSITIVE_ELIGIBILITY))


def category_page(listings: DataFrame, category: str) -> DataFrame:
    """Visible listings of one category."""
    return listings.where(F.col("is_active") & (F.col("category") == category))


def contains_search(df: DataFrame, cols: list[str], q: str) -> DataFrame:
    """Rows where any column contains the text, case-insensitively and literally."""
    if not q:
        return df
    test = F.lit(False)
    for c in cols:
        test = test | F.coalesce(F.contains(F.lower(c), F.lit(q.lower())), F.lit(False))
    return df.where(test)


def by_effective_date(df: DataFrame) -> DataFrame:
    """H1 order: newest effective date first, then highest id."""
    return df.orderBy(effective_at("board").desc_nulls_last(), F.desc("id"))


def page(df: DataFrame, order: str, n: int, size: int) -> DataFrame:
    """H1/H2: page ``n`` by ``board`` date or ``name``; a page past the end is empty."""
    ordered = by_effective_date(df) if order == "board" else df.orderBy("company_name", "id")
    return ordered.offset((n - 1) * size).limit(size)


def top_per_category(listings: DataFrame, n: int = 6) -> DataFrame:
    """Freshest ``n`` visible listings per category.

    The rank filter becomes a group limit below the shuffle: each task sends at most ``n`` rows per
    category, however many rows a category has.
    """
    order = Window.partitionBy("category").orderBy(effective_at("board").desc_nulls_last(), F.desc("id"))
    return listings.where("is_active").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def verify_batch(listings: DataFrame, n: int) -> DataFrame:
    """H4: visible listings verified longest ago, never verified first."""
    return listings.where("is_active").orderBy(F.col("last_verified_at").asc_nulls_first(), "id").limit(n)


def company_check_batch(companies: DataFrame, n: int) -> DataFrame:
    """H5: companies with a website checked longest ago, never checked first."""
    df = fill(companies, "companies", "link_checked_at")
    return df.where(has_text(F.col("website"))).orderBy(F.col("link_checked_at").asc_nulls_first(), "id").limit(n)


def sweep_batch(listings: DataFrame, n: int, as_of, spent: int = 0, cap: int = 50, fresh_days: int = 10) -> DataFrame:
    """H6: unclear backlog, recent rows first, each part checked longest ago first, within the daily cap."""
    df = fill(listings, "listings", "geo_checked_at").where("is_active and ph_eligibility = 'unclear'")
    fresh = F.coalesce(F.col("scraped_at") >= before(as_of, fresh_days), F.lit(False))
    return df.withColumn("is_fresh", fresh).orderBy(
        F.desc("is_fresh"), F.col("geo_checked_at").asc_nulls_first(), "id").limit(max(0, min(n, cap - spent)))


def pending_batch(listings: DataFrame, n: int) -> DataFrame:
    """H7: parked rows scraped longest ago."""
    return listings.where("not is_active and inactive_reason = 'pending-triage'").orderBy(
        F.col("scraped_at").asc_nulls_first(), "id").limit(n)


def take_new(df: DataFrame, n: int = 50, order: str = "ordinal") -> DataFrame:
    """The first ``n`` new rows of a run."""
    if n < 1:
        raise ValueError("ask for one row at least")
    return df.orderBy(order).limit(n)


def left_over(df: DataFrame, taken: DataFrame, key: str = "source_url") -> DataFrame:
    """The backlog that a limited run leaves behind."""
    return df.join(taken.select(key), key, "left_anti")


def sitemap_rows(listings: DataFrame, base: str) -> DataFrame:
    """Public pages with the day they last changed."""
    df = fill(public_details(listings), "listings", "updated_at")
    return df.select(F.concat(F.lit(base + "/jobs/"), F.col("id").cast("string")).alias("loc"),
                     F.date_format(effective_at("sitemap"), "yyyy-MM-dd").alias("lastmod"),
                     F.lit("weekly").alias("changefreq"), F.lit("0.6").alias("priority"))


def _script_safe(json: Column) -> Column:
    for char in "<>&\u2028\u2029":
        json = F.replace(json, F.lit(char), F.lit(f"\\u{ord(char):04x}"))
    return json


def posting_documents(listings: DataFrame) -> DataFrame:
    """One schema.org posting per listing as JSON that is safe inside a script element."""
    kinds = F.create_map(*[F.lit(x) for pair in V.EMPLOYMENT_TYPES.items() for x in pair])
    shown = T.excerpt(F.col("description"), F.col("source_platform"))
    organisation = F.when(F.col("company") != "", F.struct(
        F.lit("Organization").alias("@type"), F.col("company").alias("name")))
    country = F.when(F.col("ph_eligibility") == "eligible_verified", F.struct(
        F.lit("Country").alias("@type"), F.lit("Philippines").alias("name")))
    document = F.to_json(F.struct(
        F.lit("https://schema.org/").alias("@context"), F.lit("JobPosting").alias("@type"), F.col("title"),
        F.coalesce(shown, F.col("title")).alias("description"), iso(effective_at("board")).alias("datePosted"),
        F.lit("TELECOMMUTE").alias("jobLocationType"), organisation.alias("hiringOrganization"),
        F.try_element_at(kinds, F.coalesce("type", F.lit(""))).alias("employmentType"),
        country.alias("applicantLocationRequirements"), F.lit(False).alias("directApply")))
    return public_details(listings).select("id", _script_safe(document).alias("document"))


def outbound_clicks(clicks: DataFrame, listings: DataFrame) -> DataFrame:
    """Add ``target``: where a click may lead, NULL when the address is not the listing's own.

    ``clicks(id, url)``.  An untrusted stored apply link leads to the source instead.
    """
    stored = listings.select("id", "source_url", "application_url")
    df = clicks.join(stored, ["id"], "left")
    df = U.with_url(U.with_url(df, "source_url", "_src"), "application_url", "_app")
    source = U.safe_source(U.Url("_src"), F.col("source_url"))
    apply = U.trusted_apply(U.Url("_app"), F.col("application_url"), U.Url("_src"), F.col("source_url"))
    return U.drop_url(df.withColumn("target", F.when(F.col("url") == F.col("source_url"), source).when(
        F.col("url") == F.col("application_url"), F.coalesce(apply, source))).drop(
        "source_url", "application_url"), "_src", "_app")
