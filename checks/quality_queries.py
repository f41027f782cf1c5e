"""Quality reports, distributions and reconciliation."""

from pyspark.sql import functions as F

from listingspark.operators import quality as Q
from listingspark.operators.cleaning import add_keys

from .registry import query
from .views import AS_OF

NOW = f"TIMESTAMP '{AS_OF}'"
POSTED = "coalesce(posted_at, scraped_at)"
STALE = f"{POSTED} < {NOW} - INTERVAL 30 DAY"
UNSEEN = f"last_seen_at < {NOW} - INTERVAL 14 DAY"
NO_COMPANY = "(company IS NULL OR trim(company) = '')"


def n_if(test: str, name: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {test}) AS BIGINT) AS {name}"


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE is_active) AS active,
  count(*) FILTER (WHERE NOT is_active) AS inactive FROM listings""", "listings")
def core_totals(listings):
    return Q.core_totals(listings)


@query(f"""SELECT count(*) AS active, {n_if(STALE, 'stale_30d')}, {n_if(UNSEEN, 'unseen_14d')},
  {n_if('last_seen_at IS NULL', 'never_seen')}, {n_if('last_verified_at IS NULL', 'never_verified')},
  {n_if(NO_COMPANY, 'missing_company')}, {n_if(POSTED + ' IS NULL', 'undated')}
FROM listings WHERE is_active""", "listings")
def active_cohorts(listings):
    return Q.active_cohorts(listings, AS_OF)


@query("""SELECT coalesce(ph_eligibility, '(null)') AS ph_eligibility, count(*) AS n FROM listings
WHERE is_active GROUP BY 1""", "listings")
def eligibility_distribution(listings):
    return Q.distribution(listings, "ph_eligibility")


@query("SELECT category, count(*) AS n FROM listings WHERE is_active GROUP BY 1", "listings")
def category_distribution(listings):
    return Q.distribution(listings, "category")


@query("""SELECT coalesce(inactive_reason, '(null)') AS inactive_reason, count(*) AS n FROM listings
WHERE NOT is_active GROUP BY 1""", "listings")
def inactive_reason_distribution(listings):
    return Q.distribution(listings, "inactive_reason", active=False)


@query(f"""SELECT source_platform, count(*) AS active, {n_if(STALE, 'stale_30d')}, {n_if(UNSEEN, 'unseen_14d')},
  {n_if('last_verified_at IS NULL', 'never_verified')}, {n_if(NO_COMPANY, 'missing_company')},
  {n_if("ph_eligibility = 'unclear'", 'ph_unclear')}, {n_if("ph_eligibility = 'ineligible'", 'ph_ineligible')}
FROM listings WHERE is_active GROUP BY 1""", "listings")
def source_cohorts(listings):
    return Q.source_cohorts(listings, AS_OF)


CLUSTERS = """SELECT min(title) AS sample_title, min(coalesce(company, '')) AS sample_company, count(*) AS n
  FROM listings WHERE is_active GROUP BY lower(title), lower(coalesce(company, '')) HAVING count(*) > 1"""


@query(f"""SELECT count(*) AS dup_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_in_dup_groups,
  CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS excess_rows FROM ({CLUSTERS})""", "listings")
def dup_summary(listings):
    return Q.dup_summary(listings)


@query(f"SELECT * FROM ({CLUSTERS}) ORDER BY n DESC, sample_title, sample_company LIMIT 20", "listings")
def dup_top(listings):
    return Q.dup_top(listings, 20)


def _delta(column: str, test: str, active: bool = True) -> str:
    where = "is_active" if active else "NOT is_active"
    return (f"CAST((SELECT sum(n) FROM (SELECT count(*) FILTER (WHERE {where} AND {test}) AS n FROM listings GROUP BY "
            f"{column})) - (SELECT count(*) FROM listings WHERE {where} AND {test}) AS BIGINT)")


@query(f"""SELECT CAST(count(*) - count(*) FILTER (WHERE is_active) - count(*) FILTER (WHERE NOT is_active) AS BIGINT) AS total_vs_parts,
  {_delta('ph_eligibility', 'true')} AS eligibility_vs_active, {_delta('category', 'true')} AS category_vs_active,
  {_delta('inactive_reason', 'true', False)} AS reason_vs_inactive, {_delta('source_platform', 'true')} AS source_vs_active,
  CAST((SELECT sum(n) FROM (SELECT count(*) AS n FROM listings GROUP BY source_platform)) - count(*) AS BIGINT) AS source_vs_total,
  {_delta('source_platform', STALE)} AS stale_30d_vs_global, {_delta('source_platform', UNSEEN)} AS unseen_14d_vs_global,
  {_delta('source_platform', 'last_verified_at IS NULL')} AS never_verified_vs_global,
  {_delta('source_platform', NO_COMPANY)} AS missing_company_vs_global,
  {n_if('is_active AND ' + POSTED + ' IS NULL', 'undated')} FROM listings""", "listings")
def reconcile(listings):
    return Q.reconcile(listings, AS_OF)


@query("""SELECT 'category' AS facet, category AS value, count(*) AS n FROM listings WHERE is_active GROUP BY 2
UNION ALL SELECT 'platform', source_platform, count(*) FROM listings WHERE is_active GROUP BY 2""", "listings")
def facets(listings):
    return Q.facets(listings)


@query("""SELECT (SELECT count(*) FROM listings WHERE is_active) AS listings,
  (SELECT count(*) FROM companies WHERE hires AND link_fail_count < 3) AS companies""", "listings", "companies")
def board_stats(listings, companies):
    return Q.board_stats(listings, companies)


@query(f"""WITH m AS (SELECT count(*) AS total, count(*) FILTER (WHERE is_active) AS active,
  {n_if('is_active AND ' + STALE, 'stale_30d')}, {n_if('is_active AND ' + UNSEEN, 'unseen_14d')},
  {n_if('is_active AND last_verified_at IS NULL', 'never_verified')}, {n_if('is_active AND ' + NO_COMPANY, 'missing_company')},
  (SELECT count(*) FROM companies) AS companies, (SELECT count(*) FROM ({CLUSTERS})) AS dup_groups FROM listings)
UNPIVOT m ON active, total, stale_30d, unseen_14d, never_verified, missing_company, companies, dup_groups
INTO NAME metric VALUE value""", "listings", "companies")
def health_digest(listings, companies):
    return Q.health_digest(listings, companies, AS_OF)


FIELDS = ["company", "application_url", "location_raw", "posted_at", "last_seen_at", "description"]


def _missing(f: str) -> str:
    empty = f"{f} IS NULL" if f.endswith("_at") else f"({f} IS NULL OR regexp_matches({f}, '^\\s*$'))"
    return (f"SELECT '{f}' AS field, count(*) FILTER (WHERE {empty}) AS missing, "
            f"round(100.0 * count(*) FILTER (WHERE {empty}) / count(*), 2) AS share FROM listings WHERE is_active")


@query(" UNION ALL ".join(_missing(f) for f in FIELDS), "listings")
def missing_fields(listings):
    return Q.missing_fields(listings, FIELDS)


@query(" UNION ALL ".join(
    [f"SELECT 'posted_undated' AS metric, count(*) FILTER (WHERE posted_at IS NULL) AS n FROM listings WHERE is_active"]
    + [f"SELECT 'posted_over_{d}d', count(*) FILTER (WHERE posted_at < {NOW} - INTERVAL {d} DAY) FROM listings WHERE is_active"
       for d in (30, 60, 90)]
    + [f"SELECT 'seen_over_30d', count(*) FILTER (WHERE last_seen_at < {NOW} - INTERVAL 30 DAY) FROM listings WHERE is_active"]),
    "listings")
def freshness_buckets(listings):
    return Q.freshness_buckets(listings, AS_OF)


KEYED = """SELECT *, sha256(title || '::' || source_url) AS content_hash,
  sha256(title || coalesce(description, '')) AS description_hash FROM listings"""


@query(f"WITH k AS ({KEYED}) " + " UNION ALL ".join(
    f"SELECT '{k}' AS key, count(*) AS dup_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS dup_rows FROM (SELECT count(*) AS n "
    f"FROM k WHERE is_active AND {k} <> '' GROUP BY {k} HAVING count(*) > 1)"
    for k in ("source_url", "content_hash", "description_hash")), "listings")
def dup_keys(listings):
    return Q.dup_keys(add_keys(listings))


@query(f"""WITH s AS (SELECT platform, bool_or(status NOT IN ('paused', 'deprecated')) AS on_ FROM sources GROUP BY 1),
j AS (SELECT l.source_platform, last_seen_at, CASE WHEN s.on_ IS NULL THEN 'unclassified' WHEN s.on_ THEN 'enabled'
  ELSE 'paused' END AS source_state FROM listings l LEFT JOIN s ON s.platform = l.source_platform WHERE is_active)
SELECT source_state, source_platform, CASE WHEN source_state = 'enabled' THEN 'keep_enabled_source'
  WHEN source_state = 'unclassified' THEN 'classify_source_before_action'
  WHEN last_seen_at IS NULL THEN 'review_paused_missing_last_seen'
  WHEN last_seen_at >= {NOW} - INTERVAL 14 DAY THEN 'hold_paused_recently_seen' ELSE 'review_paused_not_seen' END AS action,
  count(*) AS rows FROM j GROUP BY ALL""", "listings", "sources")
def stale_policy(listings, sources):
    return Q.stale_policy(listings, sources, AS_OF)


@query("""SELECT count(*) AS backlog, count(*) FILTER (WHERE last_verified_at IS NULL) AS never_verified,
  CAST(greatest(0, count(*) + 3 - 20) AS BIGINT) AS deferred, CAST(ceil(count(*) / 20.0 / 2) AS BIGINT) AS sweep_days
FROM listings WHERE is_active""", "listings")
def verify_backlog(listings):
    return Q.verify_backlog(listings, checked=20, deactivated=3, per_run=20)


RUN_SUMMARY = """WITH c AS (SELECT source_id, CAST(strftime(ts, '%Y-%m-%d') AS VARCHAR) AS day,
  count(*) FILTER (WHERE error = 'HTTP 500') AS insert_failed_batches, count(*) FILTER (WHERE error = 'HTTP 429') AS triage_failures,
  count(*) FILTER (WHERE error = 'timeout') AS failed_sources, count(*) FILTER (WHERE skipped) AS dropped_no_url,
  bool_and(ok) AS cadence_available FROM fetch_events GROUP BY 1, 2),
s AS (SELECT source_id, day, list_filter([
  CASE WHEN insert_failed_batches > 0 THEN 'insertFailedBatches=' || insert_failed_batches END,
  CASE WHEN triage_failures > 0 THEN 'triageFailures=' || triage_failures END,
  CASE WHEN failed_sources > 0 THEN 'failedSources=' || failed_sources END,
  CASE WHEN dropped_no_url > 0 THEN 'droppedNoUrl=' || dropped_no_url END,
  CASE WHEN NOT cadence_available THEN 'cadenceStateUnavailable' END], lambda x: x IS NOT NULL) AS t FROM c),
j AS (SELECT *, array_to_string(t, ', ') AS joined FROM s)
SELECT source_id, day, CAST(len(t) AS INT) AS signal_count, len(t) > 0 AS degraded,
  CASE WHEN len(t) = 0 THEN NULL ELSE {summary} END AS summary FROM j"""


def _run_counters(events):
    return events.groupBy("source_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count_if(F.col("error") == "HTTP 500").alias("insert_failed_batches"),
        F.count_if(F.col("error") == "HTTP 429").alias("triage_failures"),
        F.count_if(F.col("error") == "timeout").alias("failed_sources"),
        F.count_if("skipped").alias("dropped_no_url"), F.bool_and("ok").alias("cadence_available"))


@query(RUN_SUMMARY.format(summary="joined"), "fetch_events")
def run_summary(events):
    return Q.run_summary(_run_counters(events)).select("source_id", "day", "signal_count", "degraded", "summary")


@query(RUN_SUMMARY.format(summary="""CASE WHEN length(joined) <= 60 THEN joined
    WHEN strpos(substr(joined, 1, 60), ', ') > 1 THEN regexp_extract(substr(joined, 1, 60), '^(.*), ', 1)
    ELSE substr(joined, 1, 59) || '…' END"""), "fetch_events")
def run_summary_60(events):
    return Q.run_summary(_run_counters(events), 60).select("source_id", "day", "signal_count", "degraded", "summary")
