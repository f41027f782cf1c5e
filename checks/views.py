"""Tables of the listing domain derived from the given tables, as SQL that both engines run.

The given tables hold no listings, so every row here is derived from their ids and columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from listingspark.session import configure

AS_OF = "2024-01-31 00:00:00"

# Exact copies of a text have a company in common, up to case, so they are duplicates.
LISTINGS = """SELECT d.doc_id AS id,
  CASE d.doc_id % 11 WHEN 0 THEN 'Virtual Assistant' WHEN 1 THEN 'Senior React Developer' WHEN 2 THEN 'Bookkeeper'
    WHEN 3 THEN 'Customer Support Agent (Hybrid)' WHEN 4 THEN 'Graphic Designer' WHEN 5 THEN 'SEO Content Writer'
    WHEN 6 THEN 'Support Engineer - Texas' WHEN 7 THEN 'Warehouse Driver' WHEN 8 THEN 'Data Analyst, Philippines'
    WHEN 9 THEN 'test' ELSE 'Payroll Specialist' END AS title,
  CASE WHEN d.doc_id % 23 = 0 THEN NULL WHEN d.doc_id % 29 = 0 THEN '  '
    WHEN d.doc_id % 2 = 0 THEN concat('Acme ', CAST(length(d.text) % 14 AS STRING))
    ELSE concat('ACME ', CAST(length(d.text) % 14 AS STRING)) END AS company,
  CASE d.doc_id % 5 WHEN 0 THEN 'VA' WHEN 1 THEN 'freelance' WHEN 2 THEN 'project' WHEN 3 THEN 'full-time' ELSE 'part-time' END AS type,
  CASE WHEN p.url IS NOT NULL THEN p.url
    WHEN d.doc_id % 17 = 0 THEN concat('http://127.0.0.1/job/', CAST(d.doc_id AS STRING))
    WHEN d.doc_id % 7 = 0 THEN concat('https://jobs.ashbyhq.com/acme', CAST(d.doc_id % 14 AS STRING), '/', CAST(d.doc_id AS STRING))
    ELSE concat('https://www.', d.source, '.example.com/job/', CAST(d.doc_id AS STRING)) END AS source_url,
  CASE WHEN d.doc_id % 13 = 0 THEN concat('https://apply.shared.example.net/', CAST(d.doc_id AS STRING))
    WHEN d.doc_id % 19 = 0 THEN concat('hr', CAST(d.doc_id AS STRING), '@acme.example.com') ELSE NULL END AS application_url,
  d.source AS source_platform,
  CASE d.doc_id % 8 WHEN 0 THEN 'admin' WHEN 1 THEN 'tech' WHEN 2 THEN 'design' WHEN 3 THEN 'marketing'
    WHEN 4 THEN 'customer-service' WHEN 5 THEN 'finance' ELSE 'other' END AS category,
  CASE d.doc_id % 12 WHEN 0 THEN 'Anywhere in the World' WHEN 1 THEN 'Florida, United States' WHEN 2 THEN 'Manila, Philippines'
    WHEN 3 THEN 'EMEA' WHEN 4 THEN 'London' WHEN 5 THEN 'APAC' WHEN 6 THEN '' WHEN 7 THEN 'Singapore (on-site)' ELSE NULL END AS location_raw,
  d.text AS description, d.lang AS lang,
  CASE WHEN d.doc_id % 31 = 0 THEN NULL WHEN d.doc_id % 4 = 0 THEN e.ts WHEN d.doc_id % 4 = 1 THEN e.ts - INTERVAL 20 DAY
    WHEN d.doc_id % 4 = 2 THEN e.ts - INTERVAL 40 DAY ELSE e.ts - INTERVAL 75 DAY END AS posted_at,
  e.ts AS scraped_at,
  CASE WHEN d.doc_id % 6 = 0 THEN NULL WHEN d.doc_id % 6 = 1 THEN e.ts - INTERVAL 35 DAY ELSE e.ts END AS last_seen_at,
  CASE WHEN d.doc_id % 9 = 0 THEN NULL ELSE e.ts END AS last_verified_at,
  CAST(d.doc_id % 4 AS INT) AS failed_count,
  d.doc_id % 5 <> 4 AS is_active,
  CASE WHEN d.doc_id % 5 <> 4 THEN NULL WHEN d.doc_id % 3 = 0 THEN 'stale-feed' WHEN d.doc_id % 3 = 1 THEN 'policy-rejected' ELSE NULL END AS inactive_reason,
  CASE d.doc_id % 7 WHEN 0 THEN 'eligible_verified' WHEN 1 THEN 'eligible_likely' WHEN 2 THEN 'unclear' WHEN 3 THEN 'ineligible' WHEN 4 THEN NULL ELSE 'eligible_likely' END AS ph_eligibility
FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id"""

# Events of as many sources as the documents have.
N_SOURCES = "(SELECT count(DISTINCT source) FROM documents)"

FETCH_EVENTS = f"""SELECT event_id AS id, concat('src', CAST(user_id % {N_SOURCES} AS STRING)) AS source_id, ts,
  event_type <> 'error' AS ok, event_type = 'view' AS skipped,
  CASE WHEN event_type = 'error' OR event_type = 'view' THEN 0 ELSE CAST(event_id % 50 AS INT) END AS cnt,
  CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 3 = 0 THEN 'HTTP 500' WHEN event_id % 3 = 1 THEN 'HTTP 429' ELSE 'timeout' END AS error
FROM events"""

COMPANIES = """SELECT s_suppkey AS id, concat('Acme ', CAST(s_suppkey % 6 AS STRING)) AS company_name,
  CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE concat('acme', CAST(s_suppkey AS STRING), '.example.com') END AS website,
  s_suppkey % 10 <> 0 AS hires, s_suppkey % 3 = 0 AS is_verified, s_suppkey % 4 = 0 AS is_dayshift, s_suppkey % 8 = 0 AS is_marketplace,
  CASE s_suppkey % 4 WHEN 0 THEN 'tech' WHEN 1 THEN 'bpo' WHEN 2 THEN 'global-va' ELSE 'ecommerce' END AS niche,
  CASE s_suppkey % 6 WHEN 0 THEN 'ashby' WHEN 1 THEN 'greenhouse' ELSE NULL END AS ats_platform,
  CASE WHEN s_suppkey % 6 < 2 THEN concat('acme', CAST(s_suppkey % 5 AS STRING)) ELSE NULL END AS ats_token,
  CAST(s_suppkey % 5 AS INT) AS link_fail_count
FROM supplier"""

# Feed registry: one row per platform that occurs in documents; state and cadence follow its rank by name.
SOURCES = """SELECT concat('src', substr(source, 4)) AS source_id, concat('Feed ', source) AS name,
  concat('https://www.', source, '.example.com/feed') AS url,
  CASE WHEN n % 3 = 0 THEN 'json' WHEN n % 3 = 1 THEN 'rss' ELSE 'html' END AS type,
  CASE WHEN n % 5 = 4 THEN 'paused' WHEN n % 7 = 6 THEN 'deprecated' ELSE 'allowed' END AS status,
  concat('reviewed ', source) AS notes, source AS platform, 'full-time' AS default_type,
  CASE WHEN n % 2 = 0 THEN 60 ELSE NULL END AS min_interval_minutes,
  CASE WHEN n % 4 = 0 THEN 'origin-a' WHEN n % 4 = 2 THEN 'origin-b' ELSE NULL END AS cadence_group,
  CAST(n AS INT) AS position
FROM (SELECT source, CAST(substr(source, 4) AS INT) AS n FROM (SELECT DISTINCT source FROM documents) s0) s1"""

# Pauses of a sixth of the failing sources, one that names nothing, and one without a reason.
PAUSES = f"""SELECT concat('src', CAST(k AS STRING)) AS source_id, 'keeps failing' AS reason, '2024-01-30' AS paused_at, 'bot' AS paused_by
  FROM (SELECT user_id % {N_SOURCES} AS k FROM events WHERE event_type = 'error') f WHERE k % 6 = 3 GROUP BY k
UNION ALL SELECT concat('ghost', CAST(count(*) % 7 AS STRING)), 'gone', '2024-01-30', 'bot' FROM events
UNION ALL SELECT 'src5', NULL, max(substr(CAST(ts AS STRING), 1, 10)), 'bot' FROM events"""

# Link checks: one per event, spread over as many companies as there are suppliers.
CHECKS = """SELECT event_id AS id, user_id % (SELECT count(*) FROM supplier) AS company_id, ts,
  CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_type = 'error' THEN 404 WHEN event_type = 'view' THEN 503
    WHEN event_type = 'click' THEN CASE WHEN event_id % 4 = 0 THEN 404 ELSE 200 END
    WHEN event_type = 'signup' THEN 410 ELSE CAST(401 + event_id % 30 AS INT) END AS status,
  CASE WHEN event_id % 11 = 0 THEN 'Welcome. This Domain Is For Sale today' WHEN event_id % 17 = 0 THEN 'Account suspended'
    ELSE concat('<p>', props, '</p>') END AS body,
  CASE event_id % 7 WHEN 0 THEN 'ENOTFOUND' WHEN 1 THEN 'ECONNRESET' WHEN 2 THEN 'CERT_HAS_EXPIRED' ELSE NULL END AS cause_code,
  CASE WHEN event_id % 5 = 0 THEN 'UND_ERR_HEADERS_TIMEOUT' ELSE NULL END AS error_code,
  CASE WHEN event_id % 2 = 0 THEN 'TypeError' ELSE 'Error' END AS error_name,
  CASE event_id % 9 WHEN 0 THEN 'Network connection lost.' WHEN 1 THEN 'operation timed out' WHEN 2 THEN 'bad handshake'
    WHEN 3 THEN 'fetch failed' ELSE 'boom' END AS error_message
FROM events"""

# Listings whose texts carry the phrases the geographic and relevance rules look for, and source tags.
POSTINGS = """SELECT id, title, company, type, source_url, application_url, source_platform, category,
  location_raw, is_active, lang, CASE lang WHEN 'de' THEN array('remote', 'German') WHEN 'fr' THEN array('french ', 'English') WHEN 'es' THEN array('Spanish')
    ELSE array(source_platform, 'remote', source_platform) END AS tags,
  concat(CASE id % 16 WHEN 0 THEN 'You must be based in the Netherlands. ' WHEN 1 THEN 'Work from anywhere. ' WHEN 2 THEN 'US-only role. '
    WHEN 3 THEN 'Our Cebu office pays in USD. ' WHEN 4 THEN 'Citizens of the EU. Wir suchen für unser Unternehmen eine Person und die Arbeit mit Erfahrung. '
    WHEN 5 THEN 'Nous sommes une entreprise et nous cherchons avec vous pour notre mission dans les clients. ' WHEN 6 THEN 'Authorized to work in the US. '
    WHEN 7 THEN 'Delivery by courier. ' WHEN 8 THEN '&lt;b&gt;Fish &amp;amp; chips&#8217;s &#x41;&#128512;&#55296; &quot;ok&quot;&lt;/b&gt; ' WHEN 9 THEN 'CasinÃ² <br/>MÃ¼nchen   <i>x</i> '
    WHEN 10 THEN 'm/w/d Vollzeit ' ELSE '' END, description) AS description
FROM listings"""

VIEWS = {"listings": LISTINGS, "fetch_events": FETCH_EVENTS, "companies": COMPANIES, "sources": SOURCES,
         "pauses": PAUSES, "checks": CHECKS}
VIEWS["postings"] = POSTINGS.replace("FROM listings", f"FROM ({LISTINGS}) l0")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


_PLANS: dict[tuple, DataFrame] = {}


def _planned(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """Keep the unexecuted plan of a table per session, so that its schema is inferred once."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _PLANS:
        _PLANS[key] = build()
    return _PLANS[key]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return _planned(spark, sf, name, lambda: spark.read.parquet(f"{sf}/{name}.parquet"))


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table of long texts, dealt over all cores: the given files have one split each."""
    return table(configure(spark), sf, name).repartition(spark.sparkContext.defaultParallelism)


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Derived table as a Spark plan; times become zoned timestamps of the UTC session."""
    return _planned(spark, sf, f"view:{name}", lambda: _derive(spark, sf, name))


def _derive(spark: SparkSession, sf: str, name: str) -> DataFrame:
    configure(spark)
    for base in TABLES:
        if f" {base}" in VIEWS[name]:
            load = texts if name == "postings" and base == "documents" else table
            load(spark, sf, base).createOrReplaceTempView(base)
    df = spark.sql(VIEWS[name])
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def oracle(sql: str, *views: str) -> str:
    """Prefix a comparison query with the derived tables it reads."""
    # The list constructor is the one word the two dialects spell differently.
    heads = [f"{v} AS MATERIALIZED ({VIEWS[v].replace('array(', 'list_value(')})" for v in views]
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join([*heads, body[15:]])
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(heads) + (", " if heads else "") + body[5:]
    return ("WITH " + ", ".join(heads) + " " if heads else "") + body
