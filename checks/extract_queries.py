"""Extraction from landed payloads, direct ingest, digests and the whole ingest run.

Payload bodies are built from the listings by Spark, bounded in size, and extracted again; the
comparison SQL states the rows that must come back.
"""

from pyspark.sql import functions as F

from listingspark.plans.ingest_batch import extract_all, ingest_batch, ingest_items
from listingspark.session import configure
from listingspark.sources import extract as X, ingest as I

from . import rules_sql as R
from .lifecycle_queries import votes
from .registry import QUERIES, as_text, query, sec
from .views import AS_OF, table, view

HOST = "board.example.com"
STAMP = sec("posted_at")


def feed_sources(sources, capped=False):
    """Registry with tags and, if asked for, a cap on every fourth feed."""
    return sources.withColumns({"tags": F.array(F.lit("remote"), F.lit("feed")),
                                "max_items": F.when((F.col("position") % 4 == 0) & F.lit(capped), 20).cast("int")})


def _payloads(rows, kind, body, order="id"):
    """One body per platform and block of 1,000 ids, so that a body stays small: its items in id order, joined by ``body``."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(order, "item"))), lambda x: x["item"])
    return rows.groupBy("source_platform", F.expr("id div 1000").alias("block")).agg(items.alias("items")).select(
        F.col("source_platform").alias("source_id"), F.lit(kind).alias("kind"), F.concat(F.lit("Company "), "source_platform").alias("company"),
        F.concat(F.lit("tok-"), "source_platform").alias("token"), F.lit(200).alias("status"), (F.lit(AS_OF).cast("timestamp") + F.make_dt_interval(secs=F.col("block"))).alias("fetched_at"),
        body(F.col("items")).alias("body"))


def _rss_payloads(listings):
    esc = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    # Every eleventh item is broken XML and every thirteenth has no link.
    link = F.when(F.col("id") % 13 == 0, "").otherwise(F.concat(F.lit("<link>"), esc(F.col("source_url")), F.lit("</link>")))
    title = F.concat(F.lit("<title>"), F.when(F.col("company").isNull(), F.concat(F.lit("Blue Fox: "), "title")).otherwise(F.col("title")), F.lit("</title>"))
    item = F.concat(
        F.lit("<item>"), title, link, F.lit("<dc:creator><![CDATA["), F.coalesce("company", F.lit("")), F.lit("]]></dc:creator>"),
        F.lit("<category domain='x'>"), "category", F.lit("</category><category> "), "type", F.lit(" </category><region>"),
        esc(F.col("location_raw")), F.lit("</region><pubDate>"), F.date_format("scraped_at", "E, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate>"),
        F.when(F.col("id") % 11 == 3, "<oops>").otherwise(""), F.lit("</item>"))
    head, tail = "<?xml version='1.0'?><rss><channel><title>feed</title>", "</channel></rss>"
    return _payloads(listings.withColumn("item", item), "rss", lambda items: F.concat(F.lit(head), F.array_join(items, ""), F.lit(tail)))


# The feed of platform n is capped at 20 items when n % 4 = 0.
CAP = "(CAST(substr(source_platform, 4) AS INT) % 4 <> 0 OR ordinal < 20)"
NUMBERED = "nb AS (SELECT *, CAST(row_number() OVER (PARTITION BY source_platform, id // 1000 ORDER BY id) - 1 AS INT) AS ordinal FROM listings)"


RSS_SQL = f"""WITH {NUMBERED} SELECT source_platform AS source_id, ordinal, title, CASE WHEN company IS NULL OR trim(company) = '' THEN CASE WHEN company IS NULL THEN 'Blue Fox' END ELSE company END AS company,
  {R.trim('source_url')} AS source_url, 'remote,feed,' || category || ',' || type AS tags, nullif(location_raw, '') AS location_raw, {sec('scraped_at')} AS posted_at,
  sha256(title || '::' || {R.trim('source_url')}) AS content_hash FROM nb WHERE {{CAP}} AND id % 13 <> 0 AND id % 11 <> 3"""


def _rss(listings, sources, capped):
    out = X.extract_rss(_rss_payloads(listings), feed_sources(sources.withColumn("source_id", F.col("platform")), capped))
    return as_text(out.select("source_id", "ordinal", "title", "company", "source_url", F.array_join("tags", ",").alias("tags"),
                              "location_raw", "posted_at", "content_hash"), "posted_at")


@query(RSS_SQL.replace("{CAP}", "true"), "listings", "sources")
def extract_rss(listings, sources):
    return _rss(listings, sources, False)


@query(RSS_SQL.replace("{CAP}", CAP), "listings", "sources")
def extract_rss_capped(listings, sources):
    return _rss(listings, sources, True)


def _json_item(listings):
    url = F.when(F.col("id") % 4 == 0, F.concat(F.lit("http://board.example.com/job/"), F.col("id").cast("string"))).otherwise(
        F.when(F.col("id") % 9 == 0, "https://elsewhere.example.com/x"))
    apply = F.when(F.col("id") % 4 == 1, F.concat(F.lit("https://BOARD.example.com/apply/"), F.col("id").cast("string")))
    return F.to_json(F.struct(
        F.col("title").alias("position"), "company", F.array(F.upper("category"), F.lit(" Remote ")).alias("tags"),
        F.lit("<p>Short &amp; sweet</p>").alias("description"), url.alias("url"), apply.alias("apply_url"),
        F.when(F.col("id") % 3 == 0, F.col("id") * 10).alias("salary_min"), F.when(F.col("id") % 5 == 0, F.col("id") * 20).alias("salary_max"),
        F.col("location_raw").alias("location"), F.date_format("scraped_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date")))


def _array(items):
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


REL_T = "title || ' Short & sweet'"


def _json_payloads(listings):
    return _payloads(listings.withColumn("item", _json_item(listings)), "json", _array)


@query(f"""WITH {NUMBERED}, ok AS (SELECT *, CAST(row_number() OVER (PARTITION BY source_platform, id // 1000 ORDER BY id) - 1 AS INT) AS pos FROM listings WHERE id % 4 IN (0, 1) OR id % 9 = 0)
SELECT source_platform AS source_id, pos AS ordinal, title, nullif({R.trim('company')}, '') AS company, CASE WHEN id % 4 = 0 THEN 'https://board.example.com/job/' || id ELSE 'https://board.example.com/apply/' || id END AS source_url,
  CASE WHEN id % 4 = 1 THEN 'https://board.example.com/apply/' || id ELSE 'https://board.example.com/job/' || id END AS application_url, CASE WHEN category = 'feed' THEN 'remote,feed' ELSE 'remote,feed,' || category || ',remote' END AS tags,
  CASE WHEN id % 15 = 0 AND id > 0 THEN 'USD ' || id * 10 || '-' || id * 20 WHEN id % 3 = 0 AND id > 0 THEN 'USD ' || id * 10 WHEN id % 5 = 0 AND id > 0 THEN 'USD ' || id * 20 END AS pay_range,
  'Short & sweet' AS description, {sec('scraped_at')} AS posted_at FROM ok WHERE id % 4 IN (0, 1) AND title <> 'test'
  AND {R.hits(REL_T, R.V.RELEVANT_ROLES)} AND NOT {R.hits(REL_T, R.V.PHYSICAL_ROLES)}""", "listings", "sources")
def extract_json_board(listings, sources):
    out = X.extract_json_board(_json_payloads(listings), feed_sources(sources.withColumn("source_id", F.col("platform"))), HOST)
    return as_text(out.select("source_id", "ordinal", "title", "company", "source_url", "application_url", F.array_join("tags", ",").alias("tags"),
                              "pay_range", "description", "posted_at"), "posted_at")


def _millis(c):
    return (F.unix_timestamp(c) * 1000)


def ats_payloads(listings, vendor):
    i, when = F.col("id"), F.date_format("scraped_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    titled = F.concat(F.lit("<b>"), "title", F.lit("</b>"))
    url = F.col("source_url")
    if vendor == "lever":
        item = F.struct(titled.alias("text"), url.alias("hostedUrl"), F.struct(F.col("location_raw").alias("location")).alias("categories"),
                        F.when(i % 2 == 0, "on-site").otherwise("unspecified").alias("workplaceType"), F.lit("Plain <i>text</i>").alias("descriptionPlain"),
                        _millis("scraped_at").alias("createdAt"))
        wrap = _array
    elif vendor == "greenhouse":
        item = F.struct(titled.alias("title"), url.alias("absolute_url"), F.struct(F.col("location_raw").alias("name")).alias("location"), when.alias("updated_at"))
        wrap = lambda items: F.concat(F.lit('{"jobs":'), _array(items), F.lit("}"))
    elif vendor == "ashby":
        item = F.struct(titled.alias("title"), url.alias("jobUrl"), F.when(i % 7 == 0, False).alias("isListed"), F.when(i % 3 == 0, i % 2 == 0).alias("isRemote"),
                        F.col("location_raw").alias("location"), F.col("application_url").alias("applyUrl"), when.alias("publishedAt"))
        wrap = lambda items: F.concat(F.lit('{"jobs":'), _array(items), F.lit("}"))
    elif vendor == "workable":
        item = F.struct(titled.alias("title"), F.concat(F.lit("S"), i.cast("string")).alias("shortcode"), F.struct(
            F.col("location_raw").alias("city"), F.when(i % 2 == 0, "North").alias("region"), F.lit("PH").alias("country")).alias("location"), when.alias("published_on"))
        wrap = lambda items: F.concat(F.lit('{"results":'), _array(items), F.lit("}"))
    else:
        place = lambda n, r: F.struct(n.alias("name"), r.alias("is_remote"))
        item = F.struct(titled.alias("name"), url.alias("url"), F.when(i % 2 == 0, "$5/h").alias("salary"), F.array(
            place(F.col("location_raw"), F.when(i % 3 == 0, i % 2 == 0)), place(F.col("location_raw"), F.lit(None).cast("boolean")), place(F.lit("Cebu"), F.when(i % 3 == 1, False))).alias("locations"),
            when.alias("published_date"))
        wrap = _array
    return _payloads(listings.withColumn("item", F.to_json(item)), vendor, wrap)


LOC = "nullif(location_raw, '')"
ATS_SQL = {  # vendor -> (address, location, description, pay, apply, filter)
    "lever": ("source_url", f"nullif(concat_ws(' ', {LOC}, CASE WHEN id % 2 = 0 THEN '(on-site)' END), '')", "'Plain text'", "NULL", "NULL", "true"),
    "greenhouse": ("source_url", LOC, f"'Location: ' || {LOC}", "NULL", "NULL", "true"),
    "ashby": ("source_url", f"nullif(concat_ws(' ', {LOC}, CASE WHEN id % 3 = 0 AND id % 2 <> 0 THEN '(onsite)' END), '')",
              f"nullif(concat_ws(' ', 'Location: ' || {LOC} || '.', CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 'Remote: yes.' WHEN id % 3 = 0 THEN 'Remote: no.' END), '')", "NULL", "application_url", "id % 7 <> 0"),
    "workable": ("'https://apply.workable.com/tok-' || source_platform || '/j/S' || id || '/'", f"concat_ws(', ', {LOC}, CASE WHEN id % 2 = 0 THEN 'North' END, 'PH')", "NULL", "NULL", "NULL", "true"),
    "breezy": ("source_url", f"concat_ws('; ', {LOC}, 'Cebu')",
               f"'Location: ' || concat_ws('; ', {LOC}, 'Cebu') || '.' || CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN ' Remote: yes.' WHEN id % 3 <> 2 THEN ' Remote: no.' ELSE '' END",
               "CASE WHEN id % 2 = 0 THEN '$5/h' END", "NULL", "true"),
}


def _register_ats(vendor):
    url, loc, desc, pay, apply, keep = ATS_SQL[vendor]

    def run(listings):
        out = X.extract_ats(ats_payloads(listings, vendor), vendor)
        return as_text(out.select("source_id", "ordinal", "title", "company", "source_url", "application_url", "location_raw", "description", "pay_range",
                                  F.array_join("tags", ",").alias("tags"), "posted_at"), "posted_at")
    query(f"""WITH {NUMBERED} SELECT source_platform AS source_id, ordinal, title, 'Company ' || source_platform AS company, {url} AS source_url, CAST({apply} AS VARCHAR) AS application_url, {loc} AS location_raw,
  CAST({desc} AS VARCHAR) AS description, CAST({pay} AS VARCHAR) AS pay_range, 'company ' || source_platform AS tags, {sec('scraped_at')} AS posted_at FROM nb WHERE {keep}""", "listings", name=f"extract_{vendor}")(run)


for _vendor in ATS_SQL:
    _register_ats(_vendor)


def job_pages(spark, sf):
    """The given pages with job anchors added to two of three; some only suit the looser reading."""
    p, i = table(configure(spark), sf, "pages"), F.col("page_id")
    n = i.cast("string")
    strict = F.concat(F.lit("<a class='j' href='/jobseekers/job/"), n, F.lit("'><h4>Job  <b>"), n, F.lit("</b></h4> more</a><A HREF=\"https://o.example.com/jobseekers/job/x"), n,
                      F.lit("\">\n Plain "), n, F.lit("</A><a href='/jobseekers/job/9'>See More</a><a href='/jobseekers/job/e'> </a>"))
    loose = F.concat(F.lit("<a href='/jobseekers/job/"), n, F.lit("'><h2> </h2>Loose title "), n, F.lit("</a><a href='/jobseekers/job/2'><h2> </h2>abc</a><a href='/jobseekers/job/3'><h2> </h2><img src=x>Picture</a>"))
    return p.select("page_id", F.concat("html", F.lit("<a id='end'></a>"), F.when(i % 3 == 0, strict).when(i % 3 == 1, loose).otherwise("")).alias("html"))


@query("""SELECT page_id, 0 AS ordinal, 'Job ' || page_id AS title, 'https://www.board.example.com/jobseekers/job/' || page_id AS source_url FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT page_id, 1, 'Plain ' || page_id, 'https://o.example.com/jobseekers/job/x' || page_id FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT page_id, 0, 'Loose title ' || page_id, 'https://www.board.example.com/jobseekers/job/' || page_id FROM pages WHERE page_id % 3 = 1""")
def extract_html():
    raise NotImplementedError


QUERIES["extract_html"] = lambda spark, sf: X.extract_html(job_pages(spark, sf), "/jobseekers/job/", "https://www.board.example.com")


def _html_payloads(listings):
    """Board pages with a job anchor per listing, and one to skip."""
    n = F.col("id").cast("string")
    item = F.concat(F.lit("<a class='j' href='/jobseekers/job/"), n, F.lit("'><h4>"), "title", F.lit("</h4></a><a href='/jobseekers/job/0'>See More</a>"))
    return _payloads(listings.withColumn("item", item), "html", lambda items: F.concat(F.lit("<html><body>"), F.array_join(items, "\n"), F.lit("</body></html>")))


def all_payloads(listings):
    out = _rss_payloads(listings).unionByName(_html_payloads(listings)).unionByName(_json_payloads(listings))
    for vendor in ATS_SQL:
        out = out.unionByName(ats_payloads(listings, vendor).withColumn("source_id", F.concat(F.lit(f"{vendor}:"), "token")))
    return out


@query(f"""WITH f AS (SELECT CASE WHEN id % 13 <> 0 AND id % 11 <> 3 THEN 0 END AS feed FROM listings
UNION ALL SELECT 1 FROM listings
UNION ALL SELECT CASE WHEN id % 4 IN (0, 1) AND title <> 'test' AND {R.hits(REL_T, R.V.RELEVANT_ROLES)} AND NOT {R.hits(REL_T, R.V.PHYSICAL_ROLES)} THEN 2 END FROM listings
UNION ALL SELECT v FROM listings, (SELECT unnest([3, 4, 5, 6, 7]) AS v) WHERE v <> 5 OR id % 7 <> 0) SELECT feed, count(*) AS n FROM f WHERE feed IS NOT NULL GROUP BY 1""", "listings", "sources")
def union_feeds(listings, sources):
    registry = sources.withColumn("source_id", F.col("platform")).withColumns({"tags": F.array(F.lit("remote")), "max_items": F.lit(None).cast("int")})
    none = registry.select("source_id", F.lit(None).cast("string").alias("body_hash"), F.lit(0).alias("last_count")).where("false")
    rows = extract_all(all_payloads(listings), none, registry, HOST)
    return rows.groupBy(F.col("batch_order.feed").alias("feed")).agg(F.count(F.lit(1)).alias("n"))


# ---- direct ingest and digests -----------------------------------------------------------------
@query(f"""WITH x AS (SELECT id, {R.trim('title')} AS title, description, location_raw, tags FROM postings), {R.gate('x')}, u AS (SELECT *, {R.url_struct('source_url')} AS s, {R.url_struct('application_url')} AS a FROM postings)
SELECT id AS ordinal, title, nullif({R.trim('company')}, '') AS company, type, {R.safe_source('s', 'source_url')} AS source_url, coalesce({R.trusted_apply('a', 'application_url', 's', 'source_url')}, {R.safe_source('s', 'source_url')}) AS application_url,
  gate_eligibility <> 'ineligible' AS is_active, CASE WHEN gate_eligibility = 'ineligible' THEN 'policy-rejected' END AS inactive_reason, gate_scope AS geo_scope, gate_evidence AS geo_evidence,
  'remote' AS location_type, CASE WHEN id % 2 = 0 THEN 'mid' END AS experience_level FROM u JOIN gate USING (id) WHERE ({R.safe_source('s', 'source_url')}) IS NOT NULL""", "postings")
def conform_ingest(postings):
    items = postings.withColumns({"ordinal": F.col("id"), "is_active": F.lit(True), "click_count": F.lit(999), "location_type": F.lit("moon"),
                                  "experience_level": F.when(F.col("id") % 2 == 0, "mid").otherwise("guru")})
    return I.conform_ingest(items, AS_OF).select("ordinal", "title", "company", "type", "source_url", "application_url", "is_active", "inactive_reason",
                                                 "geo_scope", "geo_evidence", "location_type", "experience_level")


# Digest items from conversations: one payload per conversation, one item per turn.
DIGEST = """dg AS (SELECT conv_id AS payload_id, turn AS index, CASE WHEN conv_id % 7 = 3 AND turn = 1 THEN '  ' ELSE role END AS creator_name, 'v' || (conv_id % 50) || '-' || turn AS video_id,
  CASE WHEN conv_id % 11 = 5 AND turn = 0 THEN '' ELSE 'Talk ' || conv_id END AS video_title, CASE WHEN conv_id % 13 = 6 THEN 'ftp://v.example.com/' ELSE 'https://v.example.com/' || conv_id END AS video_url, conv_id % 17 = 8 AND turn = 1 AS bad_date FROM conversations),
de AS (SELECT *, CASE WHEN trim(creator_name) = '' THEN 'creator_name' WHEN video_title = '' THEN 'video_title' WHEN video_url LIKE 'ftp%' THEN 'video_url' WHEN bad_date THEN 'published_at' END AS item_error FROM dg),
dp AS (SELECT payload_id, 'item ' || min(index) FILTER (WHERE item_error IS NOT NULL) || ': ' || arg_min(item_error, index) FILTER (WHERE item_error IS NOT NULL) AS first_error FROM de GROUP BY 1)"""


def digests(spark, sf):
    c = table(configure(spark), sf, "conversations")
    k, t = F.col("conv_id"), F.col("turn")
    text = lambda h, v: F.concat(F.lit(h), v.cast("string"))
    return c.select(
        k.alias("payload_id"), t.alias("index"), F.when((k % 7 == 3) & (t == 1), "  ").otherwise(F.col("role")).alias("creator_name"),
        F.concat(text("v", k % 50), text("-", t)).alias("video_id"), F.when((k % 11 == 5) & (t == 0), "").otherwise(text("Talk ", k)).alias("video_title"),
        F.when(k % 13 == 6, "ftp://v.example.com/").otherwise(text("https://v.example.com/", k)).alias("video_url"), F.nullif("text", F.lit("")).alias("transcript_raw"),
        F.array(F.lit("step one")).alias("action_plan"), F.array(F.col("role")).alias("tags"),
        F.when((k % 17 == 8) & (t == 1), "someday").otherwise("2024-01-02").alias("published_at"))


@query(f"WITH {DIGEST} SELECT payload_id, index, item_error, first_error IS NULL AS payload_ok, first_error FROM de JOIN dp USING (payload_id)")
def validate_digests():
    raise NotImplementedError


QUERIES["validate_digests"] = lambda spark, sf: I.validate_digests(digests(spark, sf)).select("payload_id", "index", "item_error", "payload_ok", "first_error")


@query(f"""WITH {DIGEST}, g AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY payload_id) AS r FROM de JOIN dp USING (payload_id) WHERE first_error IS NULL)
SELECT video_id, video_title, video_url FROM g WHERE r = 1 AND payload_id >= 40 AND video_id NOT IN (SELECT video_id FROM g WHERE payload_id < 40) UNION ALL SELECT video_id, video_title, video_url FROM g WHERE r = 1 AND payload_id < 40""")
def upsert_digests():
    raise NotImplementedError


def _upsert(spark, sf):
    rows = I.accepted_digests(I.validate_digests(digests(spark, sf)), AS_OF)
    names = ["video_id", "video_title", "video_url"]
    empty = rows.where("false").select(names)
    stored = I.upsert_digests(empty, rows.where("payload_id < 40"), "payload_id")
    return I.upsert_digests(stored, rows.where("payload_id >= 40"), "payload_id").select(names)


QUERIES["upsert_digests"] = _upsert

# ---- whole run -----------------------------------------------------------------------------------
# Stored: even ids.  Batch: all postings, every tenth twice, a fifteenth with an unsafe address.
INGEST = f"""bt AS (SELECT id * 10 AS ordinal, id, title, CASE WHEN id % 15 = 7 THEN 'ftp://x' ELSE source_url END AS source_url FROM postings UNION ALL SELECT id * 10 + 1, id, title, source_url FROM postings WHERE id % 10 = 1),
bs AS (SELECT *, {R.url_struct('source_url')} AS s FROM bt), kp AS (SELECT *, {R.safe_source('s', 'source_url')} AS safe FROM bs), kk AS (SELECT * FROM kp WHERE safe IS NOT NULL),
tg AS (SELECT source_url FROM postings WHERE id % 2 = 0), kn AS (SELECT DISTINCT safe FROM kk WHERE safe IN (SELECT source_url FROM tg)), nw AS (SELECT DISTINCT safe FROM kk WHERE safe NOT IN (SELECT source_url FROM tg))"""


def run_ingest(postings):
    batch_rows = postings.withColumn("ordinal", F.col("id") * 10).withColumn(
        "source_url", F.when(F.col("id") % 15 == 7, "ftp://x").otherwise(F.col("source_url")))
    batch_rows = batch_rows.unionByName(postings.where("id % 10 = 1").withColumn("ordinal", F.col("id") * 10 + 1))
    cols = ["ordinal", "title", "company", "type", "source_url", "application_url", "source_platform", "category", "location_raw", "description", "tags"]
    target = postings.where("id % 2 = 0").withColumns({
        "content_hash": F.sha2(F.concat_ws("::", "title", "source_url"), 256), "inactive_reason": F.when(~F.col("is_active"), "stale-feed"),
        "failed_count": F.lit(0), "last_seen_at": F.lit(None).cast("timestamp"), "updated_at": F.lit(None).cast("timestamp")}).drop("lang")
    v, s = votes(postings, "source_url")
    return ingest_items(batch_rows.select(cols), target, v, s, AS_OF, "ordinal")


@query(f"""WITH {INGEST} SELECT (SELECT count(*) FROM bt) AS raw, (SELECT count(*) FROM kk) AS kept, (SELECT count(*) FROM bt) - (SELECT count(*) FROM kk) AS dropped,
  (SELECT count(*) FROM kn) AS known, (SELECT count(*) FROM nw) AS new, (SELECT count(*) FROM kk) - (SELECT count(*) FROM kn) - (SELECT count(*) FROM nw) AS repeated, (SELECT count(*) FROM nw) AS inserted, CAST(0 AS BIGINT) AS conflicting""", "postings")
def ingest_counts(postings):
    return run_ingest(postings).counts.select("raw", "kept", "dropped", "known", "new", "repeated", "inserted", "conflicting")


@query(f"""WITH {INGEST}, {R.gate('postings')}, vt AS (SELECT id, id % 5 NOT IN (0, 1) AS available, id % 5 NOT IN (0, 2) AS eligible FROM postings), sk AS (SELECT id, id % 7 NOT IN (0, 1) AS available, id % 7 NOT IN (0, 2) AS eligible FROM postings),
dc AS (SELECT p.id, safe AS source_url, CASE WHEN gate_eligibility = 'ineligible' THEN 'policy-rejected' WHEN NOT v.available THEN 'pending-triage' WHEN NOT v.eligible OR (gate_scope = 'unknown' AND s.available AND NOT s.eligible) THEN 'policy-rejected' END AS inactive_reason
  FROM (SELECT id, min(safe) AS safe FROM kk GROUP BY 1) p JOIN gate USING (id) JOIN vt v USING (id) JOIN sk s USING (id) WHERE safe IN (SELECT safe FROM nw))
SELECT source_url, inactive_reason, inactive_reason IS NULL AS is_active FROM dc UNION ALL
SELECT source_url, CASE WHEN NOT is_active AND source_url NOT IN (SELECT safe FROM kn) THEN 'stale-feed' END, is_active OR source_url IN (SELECT safe FROM kn) FROM postings WHERE id % 2 = 0""", "postings")
def ingest_run(postings):
    return run_ingest(postings).listings.select("source_url", "inactive_reason", "is_active")


# ---- a run from bodies -------------------------------------------------------------------------
# Stored: even ids.  Items of all eight kinds in the order of kinds; feeds only of registered platforms.
BODIES = f"""reg AS (SELECT platform FROM sources WHERE position % 5 <> 1), fd AS (
  SELECT 0 AS feed, id, title, {R.trim('source_url')} AS u FROM listings WHERE id % 13 <> 0 AND id % 11 <> 3 AND source_platform IN (SELECT platform FROM reg)
  UNION ALL SELECT 1, id, title, 'https://www.board.example.com/jobseekers/job/' || id FROM listings WHERE source_platform IN (SELECT platform FROM reg)
  UNION ALL SELECT 2, id, title, CASE WHEN id % 4 = 0 THEN 'https://board.example.com/job/' || id ELSE 'https://board.example.com/apply/' || id END FROM listings
    WHERE id % 4 IN (0, 1) AND title <> 'test' AND {R.hits(REL_T, R.V.RELEVANT_ROLES)} AND NOT {R.hits(REL_T, R.V.PHYSICAL_ROLES)} AND source_platform IN (SELECT platform FROM reg)
  UNION ALL SELECT v, id, title, CASE WHEN v = 6 THEN 'https://apply.workable.com/tok-' || source_platform || '/j/S' || id || '/' ELSE source_url END
    FROM listings, (SELECT unnest([3, 4, 5, 6, 7]) AS v) WHERE v <> 5 OR id % 7 <> 0),
fu AS (SELECT feed, id, title, u, {R.url_struct('u')} AS s FROM fd), fs AS (SELECT *, {R.safe_source('s', 'u')} AS safe FROM fu), fk AS (SELECT * FROM fs WHERE safe IS NOT NULL),
st AS (SELECT source_url, title FROM listings WHERE id % 2 = 0), ad AS (SELECT safe, arg_min(title, (feed, id)) AS title FROM fk GROUP BY 1)"""


def registered(sources):
    return feed_sources(sources.where("position % 5 <> 1").withColumn("source_id", F.col("platform")))


def no_state(sources):
    return sources.select(F.col("platform").alias("source_id"), F.lit(None).cast("string").alias("body_hash"), F.lit(0).alias("last_count")).where("false")


def stored_half(listings):
    return listings.where("id % 2 = 0").withColumns({
        "content_hash": F.sha2(F.concat_ws("::", "title", "source_url"), 256), "tags": F.lit(None).cast("array<string>"), "updated_at": F.lit(None).cast("timestamp")}).drop("lang")


def run_bodies(listings, sources):
    v, s = votes(listings, "source_url")
    return ingest_batch(all_payloads(listings), no_state(sources), registered(sources), stored_half(listings), v, s, AS_OF, HOST)


@query(f"""WITH {BODIES} SELECT (SELECT count(*) FROM fs) AS raw, (SELECT count(*) FROM fs) - (SELECT count(*) FROM fk) AS dropped, (SELECT count(*) FROM ad WHERE safe IN (SELECT source_url FROM st)) AS known,
  (SELECT count(*) FROM fk) - (SELECT count(*) FROM ad) AS repeated, (SELECT count(*) FROM ad WHERE safe NOT IN (SELECT source_url FROM st)) AS inserted, CAST(0 AS BIGINT) AS conflicting, CAST(0 AS BIGINT) AS unaccounted""", "listings", "sources")
def ingest_full_counts(listings, sources):
    """From bodies of all kinds to counts that close."""
    counts = run_bodies(listings, sources).counts
    return counts.select("raw", "dropped", "known", "repeated", "inserted", "conflicting", F.expr("raw - dropped - known - repeated - inserted - conflicting").alias("unaccounted"))


@query(f"WITH {BODIES} SELECT source_url, title FROM st UNION ALL SELECT safe, title FROM ad WHERE safe NOT IN (SELECT source_url FROM st)", "listings", "sources")
def ingest_full(listings, sources):
    """The table after a run from bodies; of equal addresses the first kind of feed wins."""
    return run_bodies(listings, sources).listings.select("source_url", "title")
