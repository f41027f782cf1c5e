"""Lifecycle transitions, duplicates and table repairs."""

from pyspark.sql import functions as F

from listingspark import values as V
from listingspark.operators import cleaning, geo, lifecycle as J, links, verdicts

from . import rules_sql as R
from .registry import as_text, in_list, query, sec
from .rule_queries import CLASS, checked
from .views import AS_OF

NOW = f"TIMESTAMP '{AS_OF}'"
STATE = ["id", "is_active", "inactive_reason"]
NOW_TEXT = f"'{AS_OF}'"
# A batch seen in the feeds: a third of the stored addresses plus addresses nobody knows.
BATCH = """b AS (SELECT source_url FROM listings WHERE id % 3 = 0 UNION ALL SELECT source_url || '/new' FROM listings WHERE id % 4 = 1)"""


def batch(listings):
    known = listings.where("id % 3 = 0").select("source_url")
    return known.union(listings.where("id % 4 = 1").select(F.concat("source_url", F.lit("/new"))))


@query(f"WITH {BATCH} SELECT source_url FROM b WHERE source_url NOT IN (SELECT source_url FROM listings)", "listings")
def new_items(listings):
    return J.new_items(batch(listings), listings)


@query(f"WITH {BATCH} SELECT id, source_url FROM listings WHERE source_url IN (SELECT source_url FROM b)", "listings")
def seen_rows(listings):
    return J.seen_rows(listings, batch(listings)).select("id", "source_url")


KEYED = """k AS (SELECT id, title, source_url, sha256(title || '::' || source_url) AS content_hash FROM listings)"""


@query(f"""WITH {KEYED}, incoming AS (SELECT id AS ordinal, CASE WHEN id % 3 = 1 THEN 'https://hot.example.com/one' WHEN id % 3 = 2 THEN source_url || '/v2' ELSE source_url END AS source_url,
  title, CASE WHEN id % 6 = 2 THEN 'same-content' ELSE sha256('n' || source_url) END AS content_hash FROM k),
u AS (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY ordinal) AS r FROM incoming),
c AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY ordinal) AS r2 FROM u WHERE r = 1)
SELECT source_url, title, content_hash FROM k UNION ALL SELECT source_url, title, content_hash FROM c WHERE r2 = 1 AND source_url NOT IN (SELECT source_url FROM k)
  AND content_hash NOT IN (SELECT content_hash FROM k)""", "listings")
def insert_new(listings):
    target = cleaning.add_keys(listings).select("source_url", "title", "content_hash")
    k = F.col("id") % 3
    incoming = listings.select(
        F.col("id").alias("ordinal"), "title",
        F.when(F.col("id") % 6 == 2, "same-content").otherwise(F.sha2(F.concat(F.lit("n"), "source_url"), 256)).alias("content_hash"),
        F.when(k == 1, "https://hot.example.com/one").when(k == 2, F.concat("source_url", F.lit("/v2"))).otherwise(F.col("source_url")).alias("source_url"))
    return J.insert_new(target, incoming)


@query(f"""WITH {BATCH}, t AS (SELECT *, source_url IN (SELECT source_url FROM b) AND (last_seen_at IS NULL OR last_seen_at < {NOW} - INTERVAL 12 HOUR) AS due FROM listings)
SELECT id, CASE WHEN due THEN {NOW_TEXT} ELSE {sec('last_seen_at')} END AS last_seen_at, CASE WHEN due THEN {NOW_TEXT} END AS updated_at FROM t""", "listings")
def touch_seen(listings):
    return as_text(J.touch_seen(listings, batch(listings), AS_OF).select("id", "last_seen_at", "updated_at"), "last_seen_at", "updated_at")


@query(f"""WITH {BATCH}, t AS (SELECT *, NOT is_active AND coalesce(inactive_reason IN ('stale-feed', 'link-unavailable'), false) AND source_url IN (SELECT source_url FROM b) AS back FROM listings)
SELECT id, is_active OR back AS is_active, CASE WHEN NOT back THEN inactive_reason END AS inactive_reason, CASE WHEN back THEN 0 ELSE failed_count END AS failed_count FROM t""", "listings")
def revive(listings):
    return J.revive(listings, batch(listings), AS_OF).select(*STATE, "failed_count")


@query(f"""WITH t AS (SELECT *, is_active AND coalesce(last_seen_at, scraped_at) < {NOW} - INTERVAL 30 DAY AS out_ FROM listings)
SELECT id, is_active AND NOT out_ AS is_active, CASE WHEN out_ THEN 'stale-feed' ELSE inactive_reason END AS inactive_reason FROM t""", "listings")
def archive_stale(listings):
    return J.archive_stale(listings, AS_OF).select(*STATE)


HASHED = "h AS (SELECT *, sha256(title || coalesce(description, '')) AS description_hash FROM listings)"
SURVIVORS = """s AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY description_hash, lower(coalesce(company, ''))
  ORDER BY coalesce(last_seen_at, posted_at, scraped_at) DESC, id DESC) AS r FROM h WHERE is_active AND description_hash IS NOT NULL) WHERE r = 1)"""


@query(f"WITH {HASHED}, {SURVIVORS} SELECT id FROM s", "listings")
def duplicate_survivors(listings):
    return J.duplicate_survivors(cleaning.add_keys(listings))


@query(f"""WITH {HASHED}, {SURVIVORS}, t AS (SELECT *, is_active AND description_hash IS NOT NULL AND id NOT IN (SELECT id FROM s) AS lost FROM h)
SELECT id, is_active AND NOT lost AS is_active, CASE WHEN lost THEN 'duplicate-superseded' ELSE inactive_reason END AS inactive_reason FROM t""", "listings")
def archive_duplicates(listings):
    return J.archive_duplicates(cleaning.add_keys(listings), AS_OF).select(*STATE)


LAST_CHECK = f"""c0 AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY ts DESC, id DESC) AS r FROM ({CLASS})), c AS (SELECT * FROM c0 WHERE r = 1)"""


# The checks spread over all listings.
LAST_LISTING_CHECK = f"""c0 AS (SELECT *, row_number() OVER (PARTITION BY listing ORDER BY ts DESC, id DESC) AS r
  FROM (SELECT *, id % (SELECT count(*) FROM listings) AS listing FROM ({CLASS}))), c AS (SELECT * FROM c0 WHERE r = 1)"""


@query(f"""WITH {LAST_LISTING_CHECK}, u AS (SELECT l.*, {R.url_struct('l.source_url')} AS s, c.listing IS NOT NULL AND l.is_active AS seen, c.status, c.id % 5 = 0 AS locked, c.ts
  FROM listings l LEFT JOIN (SELECT * FROM c) c ON c.listing = l.id),
v AS (SELECT *, seen AND ({R.safe_source('s', 'source_url')}) IS NULL AS bad FROM u),
w AS (SELECT *, seen AND NOT bad AND status IS NOT NULL AS live FROM v),
x AS (SELECT *, live AND locked AND status BETWEEN 200 AND 299 AS lock_, live AND NOT (locked AND status BETWEEN 200 AND 299) AND status IN (404, 410, 451) AS dead FROM w)
SELECT id, is_active AND NOT (bad OR lock_ OR (dead AND failed_count + 1 >= 3)) AS is_active,
  CASE WHEN bad THEN 'invalid-source-url' WHEN lock_ THEN 'policy-rejected' WHEN dead AND failed_count + 1 >= 3 THEN 'link-unavailable' ELSE inactive_reason END AS inactive_reason,
  CASE WHEN lock_ OR (dead AND failed_count + 1 >= 3) THEN failed_count WHEN dead THEN failed_count + 1 WHEN live THEN 0 ELSE failed_count END AS failed_count,
  CASE WHEN lock_ THEN 'ineligible' ELSE ph_eligibility END AS ph_eligibility, CASE WHEN lock_ THEN 'Verifier page scan: locked' END AS geo_evidence,
  CASE WHEN seen THEN {sec('ts')} ELSE {sec('last_verified_at')} END AS last_verified_at FROM x""", "listings", "checks")
def apply_link_checks(listings, checks):
    listing = F.col("id") % listings.agg(F.count(F.lit(1))).scalar()
    c = checks.select(F.col("id").alias("check_id"), listing.alias("id"), "ts", "status", "body",
                      F.when(F.col("id") % 5 == 0, "locked").alias("geo_lock"))
    out = links.apply_link_checks(listings, c)
    return as_text(out.select(*STATE, "failed_count", "ph_eligibility", "geo_evidence", "last_verified_at"), "last_verified_at")


EVIDENCE = """CASE WHEN mk IS NOT NULL THEN 'Body contains "' || mk || '" (HTTP ' || status || ')' WHEN link_status IN ('ok', 'dead_http') THEN 'HTTP ' || status END"""


@query(f"""WITH {LAST_CHECK}, j AS (SELECT s.*, c.company_id IS NOT NULL AS seen, coalesce(c.link_status, CASE WHEN c.company_id IS NOT NULL THEN 'unreachable' END) AS new_status,
  c.link_status IN ('parked', 'dead_http') AS dead, {EVIDENCE} AS ev, strftime(c.ts, '%Y-%m-%d') AS day FROM companies s LEFT JOIN c ON c.company_id = s.id),
f AS (SELECT *, coalesce(seen AND dead AND link_fail_count + 1 >= 3 AND is_verified, false) AS flagged FROM j)
SELECT id, new_status AS link_status, CASE WHEN NOT seen OR new_status = 'unreachable' THEN link_fail_count WHEN dead THEN link_fail_count + 1 ELSE 0 END AS link_fail_count,
  is_verified AND NOT flagged AS is_verified, CASE WHEN flagged THEN '[auto ' || day || '] link ' || new_status || ' x' || (link_fail_count + 1) || ': ' || ev END AS notes FROM f""", "companies", "checks")
def apply_company_checks(companies, checks):
    c = checked(checks).select(F.col("id").alias("check_id"), F.col("company_id").alias("id"), "ts", "link_status", "link_evidence", "hard_dead")
    return links.apply_company_checks(companies, c).select("id", "link_status", "link_fail_count", "is_verified", "notes")


PARKED = f"p AS (SELECT p0.*, gate_scope, gate_eligibility, gate_evidence FROM postings p0 JOIN gate USING (id))"


def parked(postings):
    gated = geo.geo_gate(postings)
    return J.park_pending(gated, AS_OF, "no verdict yet")


@query(f"""WITH {R.gate('postings')}, {PARKED}, u AS (SELECT *, {R.url_struct('source_url')} AS s, {R.url_struct('application_url')} AS a FROM p)
SELECT id, false AS is_active, 'pending-triage' AS inactive_reason, gate_scope AS geo_scope, 'unclear' AS ph_eligibility, 'Pending durable triage: no verdict yet' AS geo_evidence,
  coalesce({R.trusted_apply('a', 'application_url', 's', 'source_url')}, source_url) AS application_url, sha256(title || coalesce(description, '')) AS description_hash FROM u""", "postings")
def park_pending(postings):
    return parked(postings).select("id", "is_active", "inactive_reason", "geo_scope", "ph_eligibility", "geo_evidence",
                                   "application_url", "description_hash")


@query(f"""WITH {R.gate('postings')}, {PARKED}
SELECT id, gate_scope IN {in_list(V.GATE_ELIGIBLE_SCOPES)} AS is_active, CASE WHEN gate_scope NOT IN {in_list(V.GATE_ELIGIBLE_SCOPES)} THEN 'pending-triage' END AS inactive_reason,
  CASE WHEN gate_scope IN {in_list(V.GATE_ELIGIBLE_SCOPES)} THEN 'Geo-gate eligible; auto-published pending AI re-vet' ELSE 'Pending durable triage: no verdict yet' END AS geo_evidence,
  'unclear' AS ph_eligibility FROM p""", "postings")
def recover_pending(postings):
    return J.recover_pending(parked(postings), AS_OF).select(*STATE, "geo_evidence", "ph_eligibility")


@query("""SELECT id, CASE WHEN trim(coalesce(application_url, '')) = '' THEN source_url ELSE application_url END AS application_url FROM listings""", "listings")
def fill_apply_url(listings):
    return J.fill_apply_url(listings).select("id", "application_url")


@query("""SELECT id, CASE WHEN id % 4 = 3 THEN NULL WHEN id % 4 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || 'T' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000Z' END AS at FROM fetch_events""", "fetch_events")
def repair_timestamps(events):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    mixed = F.when(F.col("id") % 4 == 0, F.concat(text, F.lit("T"))).when(F.col("id") % 4 == 1, text).when(
        F.col("id") % 4 == 2, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000Z"))).otherwise("garbage")
    return J.repair_timestamps(events.select("id", mixed.alias("at")), ["at"])


@query(f"""SELECT id, is_active AND NOT (source_platform = 'src7' AND {R.any_substring('lower(title)', '|'.join(V.PHYSICAL_TITLE_WORDS))}) AS is_active, inactive_reason FROM listings""", "listings")
def archive_keywords(listings):
    return J.archive_keywords(listings, "src7", AS_OF).select(*STATE)


@query("""SELECT id, CASE WHEN NOT is_active AND inactive_reason IS NULL AND ph_eligibility IN ('eligible_verified', 'eligible_likely') THEN
  CASE WHEN failed_count >= 3 THEN 'link-unavailable' ELSE 'stale-feed' END ELSE inactive_reason END AS inactive_reason FROM listings""", "listings")
def infer_reason(listings):
    return J.infer_reason(listings).select("id", "inactive_reason")


@query("""SELECT id, CASE WHEN lower(trim(application_url)) LIKE 'https://apply.shared.example.net/%' AND NOT lower(trim(source_url)) LIKE 'https://apply.shared.example.net/%'
  THEN source_url ELSE application_url END AS application_url FROM listings""", "listings")
def repair_contaminated(listings):
    return J.repair_contaminated(listings, "apply.shared.example.net", AS_OF).select("id", "application_url")


@query("""WITH w AS (SELECT *, 'https://www.shared.example.net/' AS site FROM companies WHERE id % 2 = 0 UNION ALL SELECT *, website FROM companies WHERE id % 2 = 1),
b AS (SELECT *, company_name IN ('Acme 2', 'Acme 3') AND coalesce(site = 'https://www.shared.example.net/', false) AS bad FROM w)
SELECT id, CASE WHEN NOT bad THEN site END AS website, CASE WHEN bad THEN 0 ELSE link_fail_count END AS link_fail_count, CASE WHEN bad THEN 'cleared' END AS notes FROM b""", "companies")
def clear_contaminated_websites(companies):
    site = F.when(F.col("id") % 2 == 0, "https://www.shared.example.net/").otherwise(F.col("website"))
    out = J.clear_contaminated_websites(companies.withColumn("website", site), "shared.example.net", ["Acme 2", "Acme 3"], "cleared")
    return out.select("id", "website", "link_fail_count", "notes")


@query(f"""WITH blind AS (SELECT id, title, description, CAST(NULL AS VARCHAR) AS location_raw, tags FROM postings WHERE is_active), {R.gate('blind')}
SELECT p.id, CASE WHEN p.is_active THEN gate_eligibility <> 'ineligible' ELSE false END AS is_active, gate_scope AS geo_scope, gate_eligibility AS ph_eligibility,
  gate_evidence AS geo_evidence, p.location_raw FROM postings p LEFT JOIN gate USING (id)""", "postings")
def geo_backfill(postings):
    return J.geo_backfill(postings.withColumn("ph_eligibility", F.lit(None).cast("string")), AS_OF).select(
        "id", "is_active", "geo_scope", "ph_eligibility", "geo_evidence", "location_raw")


@query(f"SELECT id, source_id FROM fetch_events WHERE ts >= {NOW} - INTERVAL 10 DAY", "fetch_events")
def retain_events(events):
    return J.retain_events(events, AS_OF, 10).select("id", "source_id")


RUNS = """r AS (SELECT ts, event_type = 'error' AND event_id % 7 = 0 AS degraded, 'failedSources=' || (event_id % 9) AS summary FROM events)"""


@query(f"""WITH {RUNS}, o AS (SELECT count(*) AS runs, max(ts) AS la, max(ts) FILTER (WHERE NOT degraded) AS lc, arg_max(CASE WHEN degraded THEN summary ELSE '' END, ts) AS err FROM r),
h AS (SELECT *, round((epoch_ms({NOW}) - epoch_ms(la)) / 3600000.0, 2) AS age, round((epoch_ms({NOW}) - epoch_ms((SELECT max(scraped_at) FROM listings WHERE is_active))) / 3600000.0, 2) AS idle FROM o)
SELECT runs, {sec('la')} AS last_attempt_at, {sec('lc')} AS last_clean_at, nullif(err, '') AS last_error, age AS hours_since_attempt, idle AS board_hours,
  CASE WHEN err <> '' OR age >= 3 OR idle >= 36 THEN 'alert' ELSE 'healthy' END AS status FROM h""", "listings", "fetch_events!")
def ingest_health():
    raise NotImplementedError


from listingspark.session import configure  # noqa: E402

from .registry import QUERIES  # noqa: E402
from .views import table, view  # noqa: E402


def _health(spark, sf):
    e = table(configure(spark), sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    runs = e.select("ts", ((F.col("event_type") == "error") & (F.col("event_id") % 7 == 0)).alias("degraded"),
                    F.concat(F.lit("failedSources="), (F.col("event_id") % 9).cast("string")).alias("summary"))
    out = J.ingest_health(runs, view(spark, sf, "listings"), AS_OF).drop("reason")
    return as_text(out, "last_attempt_at", "last_clean_at")


QUERIES["ingest_health"] = _health

# Votes: one per fifth listing is missing, one in five unavailable, the rest split.
VOTES = """vt AS (SELECT id, id % 5 <> 1 AS available, id % 5 <> 2 AS eligible, 'vote ' || (id % 10) AS reason, CASE id % 3 WHEN 0 THEN 'creative' WHEN 1 THEN 'tech' ELSE 'zoo' END AS category,
  CASE id % 4 WHEN 0 THEN 'contract' WHEN 1 THEN 'part-time' END AS employment FROM postings WHERE id % 5 <> 0),
sk AS (SELECT id, id % 7 <> 1 AS available, id % 7 <> 2 AS eligible, 'skeptic ' || (id % 10) AS reason FROM postings WHERE id % 7 <> 0)"""


def votes(postings, key):
    i = F.col("id")
    v = postings.where("id % 5 <> 0").select(
        F.col(key).alias("listing_key"), (i % 5 != 1).alias("available"), (i % 5 != 2).alias("eligible"),
        F.concat(F.lit("vote "), (i % 10).cast("string")).alias("reason"),
        F.when(i % 3 == 0, "creative").when(i % 3 == 1, "tech").otherwise("zoo").alias("category"),
        F.array(F.lit("Alpha "), F.lit("beta")).alias("tags"), F.lit("USD 5").alias("pay_range"),
        F.concat("source_url", F.lit("?apply=1")).alias("application_url"),
        F.when(i % 4 == 0, "contract").when(i % 4 == 1, "part-time").alias("employment_type"), F.lit("mid").alias("experience_level"))
    s = postings.where("id % 7 <> 0").select(
        F.col(key).alias("listing_key"), (i % 7 != 1).alias("available"), (i % 7 != 2).alias("eligible"),
        F.concat(F.lit("skeptic "), (i % 10).cast("string")).alias("reason"))
    return v, s


MERGED = f"""m AS (SELECT p.id, gate_scope, gate_eligibility, gate_evidence, v.reason AS vr, v.category AS vc, v.employment, CASE WHEN gate_eligibility = 'ineligible' THEN 'gate-rejected' WHEN v.id IS NULL OR NOT v.available THEN 'unavailable' WHEN NOT v.eligible THEN 'ineligible'
  WHEN gate_scope = 'unknown' AND s.available AND NOT s.eligible THEN 'consensus-split' ELSE 'eligible' END AS decision, s.reason AS sr
  FROM p LEFT JOIN vt v ON v.id = p.id LEFT JOIN sk s ON s.id = p.id)"""
REASON = """CASE decision WHEN 'gate-rejected' THEN gate_evidence WHEN 'unavailable' THEN coalesce(vr, 'no verdict on record') WHEN 'consensus-split' THEN sr ELSE vr END"""


def merged(postings):
    v, s = votes(postings, "source_url")
    return verdicts.merge_verdicts(geo.geo_gate(postings), v, s)


@query(f"WITH {R.gate('postings')}, {PARKED}, {VOTES}, {MERGED} SELECT id, decision, {REASON} AS decision_reason FROM m", "postings")
def merge_verdicts(postings):
    return merged(postings).select("id", "decision", "decision_reason")


@query(f"""WITH {R.gate('postings')}, {PARKED}, {VOTES}, {MERGED}, w AS (SELECT m.*, {REASON} AS why, p.tags, p.category, p.type, p.source_url, p.source_url AS safe FROM m JOIN (SELECT id, tags, category, type, source_url FROM p) p USING (id)),
o AS (SELECT *, decision = 'eligible' AS good, list_transform(list_concat(list_concat(tags, [vc]), ['Alpha ', 'beta']), lambda x: x) AS all_tags FROM w)
SELECT id, decision, good AS is_active, CASE WHEN good THEN NULL WHEN decision = 'unavailable' THEN 'pending-triage' ELSE 'policy-rejected' END AS inactive_reason, gate_scope AS geo_scope,
  CASE WHEN good THEN CASE WHEN gate_eligibility = 'unclear' THEN 'eligible_likely' ELSE gate_eligibility END WHEN decision IN ('gate-rejected', 'ineligible') THEN 'ineligible' ELSE 'unclear' END AS ph_eligibility,
  CASE WHEN good AND gate_scope = 'unknown' THEN 'AI triage passed: ' || why WHEN good OR decision = 'gate-rejected' THEN gate_evidence WHEN decision = 'ineligible' THEN 'AI triage: ' || why
    WHEN decision = 'consensus-split' THEN 'Consensus split — skeptic: ' || why ELSE 'Pending durable triage: ' || why END AS geo_evidence,
  CASE WHEN good THEN CASE vc WHEN 'creative' THEN 'design' WHEN 'tech' THEN 'tech' ELSE 'other' END WHEN decision = 'unavailable' THEN category ELSE 'other' END AS category,
  CASE WHEN good THEN CASE WHEN employment = 'contract' THEN 'freelance' ELSE coalesce(employment, 'freelance') END ELSE type END AS type,
  CASE WHEN good THEN 'mid' END AS experience_level,
  array_to_string(CASE WHEN good THEN list_transform(list_filter(all_tags, lambda x, i: list_position(all_tags, x) = i), lambda x: lower(trim(x))) WHEN decision = 'unavailable' THEN tags
    ELSE list_append(list_filter(tags, lambda x, i: list_position(tags, x) = i), CASE decision WHEN 'gate-rejected' THEN 'geo-gate-rejected' WHEN 'ineligible' THEN 'triage-rejected' ELSE 'consensus-quarantined' END) END, ',') AS tags,
  CASE WHEN good AND NOT contains(source_url, '127.0.0.1') THEN safe || '?apply=1' ELSE source_url END AS application_url FROM o""", "postings")
def apply_verdicts(postings):
    return verdicts.apply_verdicts(merged(postings), AS_OF).select(
        "id", "decision", "is_active", "inactive_reason", "geo_scope", "ph_eligibility", "geo_evidence", "category", "type", "experience_level",
        F.array_join("tags", ",").alias("tags"), "application_url")


@query(f"WITH {R.gate('postings')}, {PARKED} SELECT source_platform, count(*) AS rejected FROM p WHERE gate_eligibility = 'ineligible' GROUP BY 1", "postings")
def rejections_by_source(postings):
    return verdicts.rejections_by_source(geo.geo_gate(postings))


@query(f"WITH {R.gate('postings')} SELECT gate_eligibility, count(*) AS n FROM gate GROUP BY 1", "postings")
def verdict_counts(postings):
    return verdicts.verdict_counts(geo.geo_gate(postings))


@query(f"""WITH {VOTES.replace('postings', 'listings')}, t AS (SELECT l.*, v.id IS NOT NULL AND is_active AND ph_eligibility = 'unclear' AS due, coalesce(v.available, false) AS va, coalesce(v.eligible, false) AS ve,
  coalesce(s.available, false) AS sa, coalesce(s.eligible, false) AS se, s.id IS NOT NULL AS has_s, v.reason AS vr, s.reason AS sr FROM listings l LEFT JOIN vt v ON v.id = l.id LEFT JOIN sk s ON s.id = l.id),
d AS (SELECT *, coalesce(due, false) AND va AND NOT ve AS against, coalesce(due, false) AND va AND ve AND sa AND NOT se AS split, coalesce(due, false) AND va AND ve AND NOT (sa AND NOT se) AS passed FROM t)
SELECT id, is_active AND NOT (against OR split) AS is_active, CASE WHEN against OR split THEN 'policy-rejected' ELSE inactive_reason END AS inactive_reason,
  CASE WHEN against THEN 'ineligible' WHEN passed THEN 'eligible_likely' ELSE ph_eligibility END AS ph_eligibility,
  CASE WHEN against THEN 'AI re-triage: ' || vr WHEN split THEN 'Re-triage consensus split — skeptic: ' || sr WHEN passed AND has_s AND NOT sa THEN 'AI re-triage passed (single vote): ' || vr
    WHEN passed THEN 'AI re-triage + skeptic agreed: ' || vr END AS geo_evidence, CASE WHEN due THEN {NOW_TEXT} END AS geo_checked_at FROM d""", "listings")
def apply_sweep(listings):
    v, s = votes(listings, "id")
    return as_text(verdicts.apply_sweep(listings, v, s, AS_OF).select(*STATE, "ph_eligibility", "geo_evidence", "geo_checked_at"), "geo_checked_at")


