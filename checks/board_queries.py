"""Board, directory, selection and export views."""

from pyspark.sql import functions as F

from listingspark.operators import views as W
from listingspark.operators.cleaning import with_effective_dates

from .registry import as_text, query, sec
from .views import AS_OF

NOW = f"TIMESTAMP '{AS_OF}'"
BOARD_ORDER = "coalesce(posted_at, scraped_at) DESC NULLS LAST, id DESC"
POSITIVE = "ph_eligibility IN ('eligible_verified', 'eligible_likely')"


@query(f"""SELECT category, rank, id, title, company, {sec('posted_at')} AS posted_at FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY {BOARD_ORDER}) AS INT) AS rank FROM listings WHERE is_active)
WHERE rank <= 6""", "listings")
def top_per_category(listings):
    top = W.top_per_category(listings, 6)
    return as_text(top.select("category", "rank", "id", "title", "company", "posted_at"), "posted_at")


@query("SELECT id, title, category, type FROM listings WHERE is_active AND category = 'tech' AND type = 'full-time'", "listings")
def board_filter(listings):
    return W.board(listings, "tech", "full-time").select("id", "title", "category", "type")


@query("SELECT id, source_platform FROM listings WHERE is_active AND source_platform = 'src3'", "listings")
def board_ignores_unknown_category(listings):
    return W.board(listings, "no-such", None, "src3").select("id", "source_platform")


@query(f"""SELECT id, title, company, type, source_url, source_platform, {sec('posted_at')} AS posted_at,
  CAST(NULL AS VARCHAR) AS experience_level, CAST(NULL AS VARCHAR) AS geo_scope, ph_eligibility,
  CAST(NULL AS VARCHAR) AS geo_evidence FROM listings WHERE is_active""", "listings")
def cards(listings):
    return as_text(W.cards(W.board(listings)), "posted_at")


@query("SELECT id, company_name, niche FROM companies WHERE hires AND link_fail_count < 3", "companies")
def visible_companies(companies):
    return W.visible_companies(companies).select("id", "company_name", "niche")


@query("""SELECT id, company_name, 'tech' AS filter FROM companies WHERE hires AND link_fail_count < 3 AND niche = 'tech'
UNION ALL SELECT id, company_name, 'dayshift' FROM companies WHERE hires AND link_fail_count < 3 AND is_dayshift
UNION ALL SELECT id, company_name, 'marketplaces' FROM companies WHERE hires AND link_fail_count < 3 AND is_marketplace
  AND contains(lower(company_name), 'acme 4')""", "companies")
def directory_filters(companies):
    parts = [W.directory(companies, "tech"), W.directory(companies, "dayshift"), W.directory(companies, "marketplaces", "ACME 4")]
    named = [p.select("id", "company_name", F.lit(n).alias("filter")) for p, n in zip(parts, ("tech", "dayshift", "marketplaces"))]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query(f"SELECT id, title, ph_eligibility FROM listings WHERE is_active AND {POSITIVE}", "listings")
def public_details(listings):
    return W.public_details(listings).select("id", "title", "ph_eligibility")


@query("SELECT id, title FROM listings WHERE is_active AND category = 'finance'", "listings")
def category_page(listings):
    return W.category_page(listings, "finance").select("id", "title")


@query("""SELECT id, title, company FROM listings WHERE is_active AND (contains(lower(title), 'support')
  OR contains(lower(company), 'support') OR contains(lower(source_platform), 'support'))""", "listings")
def contains_search(listings):
    return W.contains_search(W.board(listings), ["title", "company", "source_platform"], "Support").select("id", "title", "company")


@query(f"SELECT id, title FROM listings WHERE is_active ORDER BY {BOARD_ORDER} LIMIT 30 OFFSET 60", "listings")
def board_page(listings):
    return W.page(W.board(listings), "board", 3, 30).select("id", "title")


@query("SELECT id, company_name FROM companies WHERE hires AND link_fail_count < 3 ORDER BY company_name, id LIMIT 48", "companies")
def directory_page(companies):
    return W.page(W.visible_companies(companies), "name", 1, 48).select("id", "company_name")


@query(f"SELECT id, {sec('last_verified_at')} AS last_verified_at FROM listings WHERE is_active ORDER BY listings.last_verified_at NULLS FIRST, id LIMIT 20",
       "listings")
def verify_batch(listings):
    return as_text(W.verify_batch(listings, 20).select("id", "last_verified_at"), "last_verified_at")


@query("""SELECT id, website FROM (SELECT *, CASE WHEN id % 5 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01' + to_days(CAST(id % 9 AS INT)) END
  AS checked FROM companies) WHERE trim(coalesce(website, '')) <> '' ORDER BY checked NULLS FIRST, id LIMIT 25""", "companies")
def company_check_batch(companies):
    at = F.when(F.col("id") % 5 != 0, F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("id") % 9).cast("int")))
    return W.company_check_batch(companies.withColumn("link_checked_at", at), 25).select("id", "website")


@query(f"""SELECT id, scraped_at >= {NOW} - INTERVAL 10 DAY AS is_fresh FROM listings WHERE is_active AND ph_eligibility = 'unclear'
ORDER BY 2 DESC, last_verified_at NULLS FIRST, id LIMIT 38""", "listings")
def sweep_batch(listings):
    checked = listings.withColumn("geo_checked_at", F.col("last_verified_at"))
    return W.sweep_batch(checked, 40, AS_OF, spent=12, cap=50).select("id", "is_fresh")


@query("""SELECT id FROM listings WHERE NOT is_active AND inactive_reason IS NULL ORDER BY scraped_at NULLS FIRST, id LIMIT 10""", "listings")
def pending_batch(listings):
    parked = F.when(~F.col("is_active") & F.col("inactive_reason").isNull(), "pending-triage").otherwise(F.col("inactive_reason"))
    return W.pending_batch(listings.withColumn("inactive_reason", parked), 10).select("id")


@query("""WITH t AS (SELECT id, source_url FROM listings WHERE NOT is_active ORDER BY id LIMIT 50)
SELECT id, source_url, 'taken' AS part FROM t UNION ALL SELECT id, source_url, 'left' FROM listings
WHERE NOT is_active AND source_url NOT IN (SELECT source_url FROM t)""", "listings")
def take_new(listings):
    batch = listings.where("not is_active").select("id", "source_url")
    taken = W.take_new(batch, 50, "id")
    return taken.withColumn("part", F.lit("taken")).unionByName(W.left_over(batch, taken).withColumn("part", F.lit("left")))


@query(f"""SELECT 'https://board.example.com/jobs/' || id AS loc, strftime(coalesce(posted_at, scraped_at), '%Y-%m-%d') AS lastmod,
  'weekly' AS changefreq, '0.6' AS priority FROM listings WHERE is_active AND {POSITIVE}""", "listings")
def sitemap_rows(listings):
    return W.sitemap_rows(listings, "https://board.example.com")


@query(f"""WITH p AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'Remotive' ELSE source_platform END AS shown_on FROM listings
  WHERE is_active AND {POSITIVE}),
h AS (SELECT *, regexp_replace(substr(description, 1, 500), '[\\s\\x0B\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{FEFF}}]+$', '') AS head FROM p),
x AS (SELECT *, length(regexp_extract(head, '(?s)^(.*) ', 1)) AS last_blank FROM h),
d AS (SELECT *, CASE WHEN shown_on <> 'Remotive' OR description = '' THEN title WHEN length(description) < 300 THEN description
  WHEN last_blank > 400 THEN substr(head, 1, last_blank) ELSE head END AS body FROM x),
k AS (SELECT id, title, body, ph_eligibility = 'eligible_verified' AS verified, company,
  strftime(coalesce(posted_at, scraped_at), '%Y-%m-%dT%H:%M:%S') AS posted,
  CASE type WHEN 'full-time' THEN 'FULL_TIME' WHEN 'part-time' THEN 'PART_TIME' WHEN 'project' THEN 'TEMPORARY' ELSE 'CONTRACTOR' END AS kind FROM d)
SELECT id, title, replace(replace(replace(replace(replace(body, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026'), chr(8232), '\\u2028'), chr(8233), '\\u2029') AS description,
  posted, nullif(company, '') AS company, kind, verified FROM k""", "listings")
def posting_documents(listings):
    shown = F.when(F.col("id") % 2 == 0, "Remotive").otherwise(F.col("source_platform"))
    docs = W.posting_documents(listings.withColumn("source_platform", shown))
    safe = F.replace(F.replace(F.replace("document", F.lit("\\u003c"), F.lit("\\\\u003c")), F.lit("\\u003e"), F.lit("\\\\u003e")),
                     F.lit("\\u0026"), F.lit("\\\\u0026"))
    j = F.from_json(safe, "title string, description string, datePosted string, employmentType string, "
                          "hiringOrganization struct<name:string>, applicantLocationRequirements struct<name:string>")
    return docs.select("id", j.alias("j")).select(
        "id", "j.title", "j.description", F.substring("j.datePosted", 1, 19).alias("posted"),
        F.col("j.hiringOrganization.name").alias("company"), F.col("j.employmentType").alias("kind"),
        F.col("j.applicantLocationRequirements").isNotNull().alias("verified"))


@query(f"""SELECT id, {sec('coalesce(posted_at, scraped_at)')} AS effective_board, {sec('coalesce(last_seen_at, posted_at, scraped_at)')} AS effective_dedup,
  {sec('coalesce(scraped_at, posted_at)')} AS effective_prospect, {sec('coalesce(posted_at, scraped_at)')} AS effective_sitemap,
  {sec('coalesce(last_seen_at, scraped_at)')} AS effective_stale FROM listings""", "listings")
def effective_dates(listings):
    df = with_effective_dates(listings)
    names = [f"effective_{o}" for o in ("board", "dedup", "prospect", "sitemap", "stale")]
    return as_text(df.select("id", *names), *names)
