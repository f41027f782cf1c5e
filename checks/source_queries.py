"""Registry, fetch state, cadence, crawl policy, discovery and search."""

import uuid

from pyspark.sql import DataFrame, functions as F

from listingspark import values as V
from listingspark.functions import urls as U
from listingspark.operators import discovery as D, robots, search as S, text_index as I, verdicts, views as W
from listingspark.session import configure, shared_folder
from listingspark.sources import registry as G, state as P
from listingspark.streaming import states, windows

from . import rules_sql as R
from .registry import ORACLES, QUERIES, as_text, in_list, literal, query, sec
from .views import AS_OF, table, view

NOW = f"TIMESTAMP '{AS_OF}'"
OFF = "('paused', 'deprecated')"


@query(f"SELECT source_id, type, status, 'on' AS part FROM sources WHERE status NOT IN {OFF} UNION ALL SELECT source_id, type, status, 'off' FROM sources WHERE status IN {OFF} "
       f"UNION ALL SELECT source_id, type, status, 'rss' FROM sources WHERE status NOT IN {OFF} AND type = 'rss'", "sources")
def enabled_sources(sources):
    parts = {"on": G.enabled_sources(sources), "off": G.disabled_sources(sources), "rss": G.enabled_sources(sources, "rss")}
    named = [df.select("source_id", "type", "status", F.lit(n).alias("part")) for n, df in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


NOTE = "'Auto-paused ' || paused_at || ' by ' || paused_by || ': ' || reason"


@query(f"""SELECT s.source_id, CASE WHEN p.reason IS NOT NULL THEN 'paused' ELSE status END AS status,
  CASE WHEN p.reason IS NOT NULL THEN {NOTE} || ' (Prior notes: ' || notes || ')' ELSE notes END AS notes
FROM sources s LEFT JOIN (SELECT * FROM pauses WHERE reason IS NOT NULL) p ON p.source_id = s.source_id""", "sources", "pauses")
def apply_pauses(sources, pauses):
    return G.apply_pauses(sources, pauses).select("source_id", "status", "notes")


@query("""SELECT source_id FROM pauses WHERE reason IS NOT NULL AND source_id NOT IN (SELECT source_id FROM sources)
AND source_id NOT IN (SELECT ats_platform || ':' || ats_token FROM companies WHERE ats_token IS NOT NULL)""", "pauses", "sources", "companies")
def unmatched_pauses(pauses, sources, companies):
    return G.unmatched_pauses(pauses, sources, companies)


# Policies follow from the companies: some tenants reviewed, one platform on, one tenant paused.
POLICY = """c AS (SELECT *, ats_platform || ':' || ats_token AS source_key FROM companies),
tp AS (SELECT DISTINCT source_key, ats_token <> 'acme3' AS enabled, 'reviewed' AS status, 'tenant ' || source_key AS notes FROM c WHERE ats_platform = 'ashby' AND ats_token IN ('acme1', 'acme3')),
ps AS (SELECT DISTINCT source_key, 'Auto-paused 2024-01-30 by bot: ' || ats_token AS note FROM c WHERE ats_platform = 'greenhouse' AND ats_token = 'acme2'),
pol AS (SELECT c.*, CASE WHEN note IS NOT NULL THEN false WHEN tp.source_key IS NOT NULL THEN tp.enabled ELSE coalesce(ats_platform = 'greenhouse', false) END AS enabled,
  CASE WHEN note IS NOT NULL THEN note WHEN tp.source_key IS NOT NULL THEN tp.notes WHEN ats_platform IS NOT NULL AND ats_platform = 'greenhouse' THEN 'platform greenhouse'
    ELSE 'Paused: platform "' || coalesce(ats_platform, '') || '" is not configured' END AS policy_notes
  FROM c LEFT JOIN ps ON ps.source_key = c.source_key LEFT JOIN tp ON tp.source_key = c.source_key)"""


def resolved(companies):
    c = companies.withColumn("k", F.concat_ws(":", "ats_platform", "ats_token")).where("ats_token is not null")
    tp = c.where("ats_platform = 'ashby' and ats_token in ('acme1', 'acme3')").select(
        F.col("k").alias("source_key"), (F.col("ats_token") != "acme3").alias("enabled"), F.lit("reviewed").alias("status"),
        F.concat(F.lit("tenant "), "k").alias("notes")).distinct()
    pp = c.where("ats_platform = 'greenhouse'").select("ats_platform", F.lit(True).alias("enabled"), F.lit("reviewed").alias("status"),
                                                       F.concat(F.lit("platform "), "ats_platform").alias("notes")).distinct()
    ps = c.where("ats_platform = 'greenhouse' and ats_token = 'acme2'").select(
        F.col("k").alias("source_id"), F.col("ats_token").alias("reason"), F.lit("2024-01-30").alias("paused_at"), F.lit("bot").alias("paused_by")).distinct()
    return G.resolve_ats_policy(companies, tp, pp, ps)


@query(f"WITH {POLICY} SELECT id, source_key, enabled, policy_notes FROM pol", "companies")
def resolve_ats_policy(companies):
    return resolved(companies).select("id", "source_key", "enabled", "policy_notes")


@query(f"""WITH {POLICY}, v AS (SELECT *, CASE WHEN id % 7 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01' + to_days(CAST(id % 11 AS INT)) END AS verified_at FROM pol WHERE source_key IS NOT NULL),
turn AS (SELECT source_key FROM v WHERE ats_platform = 'greenhouse' ORDER BY verified_at NULLS FIRST, source_key, company_name, id LIMIT 3),
s AS (SELECT *, CASE WHEN NOT enabled THEN 'policy' WHEN ats_platform = 'greenhouse' AND source_key NOT IN (SELECT source_key FROM turn) THEN 'rotation' END AS st FROM v),
f AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY company_name, id) AS r, first_value(company_name) OVER (PARTITION BY source_key ORDER BY company_name, id) AS pc FROM s WHERE st IS NULL)
SELECT s.id, coalesce(s.st, CASE WHEN f.r = 1 THEN 'fetch' ELSE 'duplicate' END) AS plan, f.pc AS primary_company FROM s LEFT JOIN f ON f.id = s.id""", "companies")
def plan_ats_fetch(companies):
    at = F.when(F.col("id") % 7 != 0, F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("id") % 11).cast("int")))
    plan = G.plan_ats_fetch(resolved(companies).withColumn("verified_at", at), "greenhouse", 3)
    return plan.select("id", "plan", "primary_company")


LATEST = f"""ls AS (SELECT source_id, max(ts) AS last_attempt_at, max(ts) FILTER (WHERE ok) AS last_success_at, arg_max(cnt, (ts, id)) AS last_count,
  nullif(arg_max(coalesce(error, ''), (ts, id)), '') AS last_error FROM fetch_events GROUP BY 1)"""


@query(f"WITH {LATEST} SELECT source_id, {sec('last_attempt_at')} AS last_attempt_at, {sec('last_success_at')} AS last_success_at, last_count, last_error FROM ls", "fetch_events")
def latest_state(events):
    return as_text(P.latest_state(events), "last_attempt_at", "last_success_at")


@query(f"WITH {LATEST} SELECT s.source_id, status, last_count, last_error FROM sources s LEFT JOIN ls ON ls.source_id = s.source_id", "sources", "fetch_events")
def with_state(sources, events):
    return P.with_state(sources, P.latest_state(events)).select("source_id", "status", "last_count", "last_error")


# The newest events of every third source are turned into refusals so that streaks occur.
LIMITED = """SELECT id, source_id, ts, ok, skipped, cnt, CASE WHEN CAST(substr(source_id, 4) AS INT) % 3 = 0 AND rn <= CAST(substr(source_id, 4) AS INT) % 5 + 1 THEN 'fetch: HTTP 429' ELSE error END AS error
FROM (SELECT *, row_number() OVER (PARTITION BY source_id, skipped ORDER BY ts DESC, id DESC) AS rn FROM fetch_events)"""


def limited(events):
    n = F.substring("source_id", 4, 9).cast("int")
    rank = F.expr("row_number() over (partition by source_id, skipped order by ts desc, id desc)")
    return events.withColumn("rn", rank).withColumn("error", F.when(
        (n % 3 == 0) & (F.col("rn") <= n % 5 + 1), "fetch: HTTP 429").otherwise(F.col("error"))).drop("rn")


def _streak(recent: str) -> str:
    return f"""le AS ({LIMITED}), rk AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ts DESC, id DESC) AS r FROM le WHERE NOT skipped),
st AS (SELECT source_id, CAST(coalesce(min(r) FILTER (WHERE NOT coalesce(contains(error, 'HTTP 429'), false)), count(*) + 1) - 1 AS INT) AS streak FROM rk WHERE {recent} GROUP BY 1),
sb AS (SELECT *, CAST(CASE WHEN streak = 0 THEN 0 ELSE least(240, 30 * 2 ** (least(streak, 4) - 1)) END AS INT) AS backoff_minutes FROM st)"""


STREAK = _streak("true")


@query(f"WITH {STREAK} SELECT source_id, streak, backoff_minutes FROM sb", "fetch_events")
def rate_limit_streak(events):
    return P.rate_limit_streak(limited(events))


@query(f"WITH {_streak('r <= 3')} SELECT source_id, streak, backoff_minutes FROM sb", "fetch_events")
def rate_limit_streak_3(events):
    """Only the last three attempts are looked at."""
    return P.rate_limit_streak(limited(events), 3)


CADENCE_NOW = "2024-01-31 00:30:00"


@query(f"""WITH {STREAK}, {LATEST}, d AS (SELECT s.*, last_attempt_at, CASE WHEN cadence_group IS NOT NULL AND min_interval_minutes IS NOT NULL THEN coalesce(sb.backoff_minutes, 0) ELSE 0 END AS bo
  FROM sources s LEFT JOIN ls ON ls.source_id = s.source_id LEFT JOIN sb ON sb.source_id = s.source_id),
e AS (SELECT *, CASE WHEN status IN {OFF} THEN 'off' WHEN coalesce(TIMESTAMP '{CADENCE_NOW}' < last_attempt_at + to_minutes(min_interval_minutes + bo), false) THEN 'interval' END AS st FROM d),
w AS (SELECT *, row_number() OVER (PARTITION BY cadence_group ORDER BY last_attempt_at NULLS FIRST, position, source_id) AS r,
  first_value(source_id) OVER (PARTITION BY cadence_group ORDER BY last_attempt_at NULLS FIRST, position, source_id) AS turn_of FROM e WHERE st IS NULL AND cadence_group IS NOT NULL AND min_interval_minutes IS NOT NULL)
SELECT e.source_id, e.bo AS backoff_minutes, coalesce(e.st, CASE WHEN w.r > 1 THEN 'group' ELSE 'due' END) AS decision FROM e LEFT JOIN w ON w.source_id = e.source_id""", "sources", "fetch_events")
def plan_cadence(sources, events):
    return P.plan_cadence(sources, P.latest_state(events), limited(events), CADENCE_NOW).select("source_id", "backoff_minutes", "decision")


def _results(spark, sf):
    sources, events, companies = [view(spark, sf, v) for v in ("sources", "fetch_events", "companies")]
    at = F.when(F.col("id") % 7 != 0, F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("id") % 11).cast("int")))
    ats = G.plan_ats_fetch(resolved(companies).withColumn("verified_at", at), "greenhouse", 3)
    cadence = P.plan_cadence(sources, P.latest_state(events), limited(events), CADENCE_NOW)
    return G.fetch_results(cadence, ats).groupBy("kind", "decision", "skipped").agg(F.count(F.lit(1)).alias("n"))


QUERIES["fetch_results"] = _results
ORACLES["fetch_results"] = f"""SELECT 'feed' AS kind, decision, decision <> 'due' AS skipped, count(*) AS n FROM ({ORACLES['plan_cadence']}) GROUP BY 2, 3
UNION ALL SELECT 'ats', plan, plan <> 'fetch', count(*) FROM ({ORACLES['plan_ats_fetch']}) GROUP BY 2, 3"""


# Sources whose number is 1 mod 9 fail on their newest attempts.
FAILING = """SELECT * REPLACE (CASE WHEN CAST(substr(source_id, 4) AS INT) % 9 = 1 AND rn <= 5 THEN false ELSE ok END AS ok)
FROM (SELECT *, row_number() OVER (PARTITION BY source_id, skipped ORDER BY ts DESC, id DESC) AS rn FROM fetch_events)"""


@query(f"""WITH fe AS ({FAILING}), r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ts DESC, id DESC) AS k FROM fe WHERE NOT skipped),
b AS (SELECT source_id, count(*) AS attempts, max(CASE WHEN k = 1 THEN error END) AS latest_error FROM r WHERE k <= 4 GROUP BY 1 HAVING count(*) = 4 AND NOT bool_or(ok)),
o AS (SELECT * FROM b WHERE source_id NOT IN (SELECT source_id FROM pauses))
SELECT *, (SELECT count(*) FROM o) > 3 AS outage FROM o""", "fetch_events", "pauses")
def failing_sources(events, pauses):
    n = F.substring("source_id", 4, 9).cast("int")
    rank = F.expr("row_number() over (partition by source_id, skipped order by ts desc, id desc)")
    bad = events.withColumn("rn", rank).withColumn("ok", F.col("ok") & ~((n % 9 == 1) & (F.col("rn") <= 5))).drop("rn")
    return P.failing_sources(bad, pauses)


@query(f"""SELECT source_id, count(*) AS attempts, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE skipped) AS skipped, CAST(sum(cnt) AS BIGINT) AS items,
  count(*) FILTER (WHERE NOT ok) AS failed, {sec('max(ts)')} AS last_attempt_at, round(count(*) FILTER (WHERE NOT ok) / count(*), 4) AS failure_ratio,
  arg_max(error, (ts, id)) FILTER (WHERE NOT ok) AS latest_error FROM fetch_events WHERE ts > {NOW} - INTERVAL 168 HOUR AND ts <= {NOW} GROUP BY 1""", "fetch_events")
def source_health(events):
    return as_text(P.source_health(events, 168, AS_OF), "last_attempt_at")


ITEMS = """it AS (SELECT source_platform AS source_id, source_url FROM listings), un AS (SELECT source_url FROM listings WHERE id % 40 IN (3, 21)),
rt AS (SELECT DISTINCT source_id FROM it WHERE source_url IN (SELECT source_url FROM un) AND NOT contains(source_url, '127.0.0.1'))"""


def _retry(listings):
    return P.sources_to_retry(listings.select(F.col("source_platform").alias("source_id"), "source_url"), listings.where("id % 40 in (3, 21)").select("source_url"))


@query(f"WITH {ITEMS} SELECT source_id FROM rt", "listings")
def sources_to_retry(listings):
    return _retry(listings)


@query(f"""WITH {ITEMS} SELECT s.source_id, CASE WHEN r.source_id IS NULL THEN 'e-' || s.source_id END AS etag, CASE WHEN r.source_id IS NULL THEN sha256(s.source_id) END AS body_hash
FROM sources s LEFT JOIN rt r ON r.source_id = s.source_id""", "sources", "listings")
def persist_validators(sources, listings):
    state = sources.select("source_id", F.concat(F.lit("e-"), "source_id").alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.sha2("source_id", 256).alias("body_hash"))
    return P.persist_validators(state, _retry(listings)).drop("last_modified")


@query("""WITH p AS (SELECT 'p' || page_id AS source_id, CASE WHEN page_id % 9 = 0 THEN 304 ELSE 200 END AS status, html AS body, page_id FROM pages),
s AS (SELECT 'p' || page_id AS source_id, CASE WHEN page_id % 2 = 0 THEN sha256(html) ELSE sha256(url) END AS h, CAST(page_id % 50 AS INT) AS n FROM pages WHERE page_id % 3 <> 0)
SELECT p.source_id, status = 304 OR coalesce(h = sha256(body), false) AS unchanged, CASE WHEN status = 304 OR coalesce(h = sha256(body), false) THEN coalesce(n, 0) ELSE -1 END AS prior_count
FROM p LEFT JOIN s ON s.source_id = p.source_id""")
def changed_payloads():
    raise NotImplementedError


def _changed(spark, sf):
    pages = table(configure(spark), sf, "pages")
    key = F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("source_id")
    payloads = pages.select(key, F.when(F.col("page_id") % 9 == 0, 304).otherwise(200).alias("status"), F.col("html").alias("body"))
    state = pages.where("page_id % 3 <> 0").select(key, F.when(F.col("page_id") % 2 == 0, F.sha2("html", 256)).otherwise(F.sha2("url", 256)).alias("body_hash"),
                                                   (F.col("page_id") % 50).cast("int").alias("last_count"))
    return P.changed_payloads(payloads, state).select("source_id", "unchanged", F.coalesce("prior_count", F.lit(-1)).alias("prior_count"))


QUERIES["changed_payloads"] = _changed


@query(f"""SELECT e.id, CASE WHEN coalesce(s.status, 'allowed') <> 'allowed' THEN 'POLICY_BLOCKED' WHEN skipped THEN 'UNKNOWN' WHEN NOT ok AND contains(error, '429') THEN 'RATE_LIMITED'
  WHEN NOT ok THEN 'UNREACHABLE' WHEN cnt > 0 THEN 'HEALTHY_WITH_RESULTS' ELSE 'HEALTHY_EMPTY' END AS outcome FROM fetch_events e LEFT JOIN sources s ON s.source_id = e.source_id""", "fetch_events", "sources")
def classify_fetch(events, sources):
    return verdicts.classify_fetch(events, sources).select("id", "outcome")


# ---- crawl policy ----------------------------------------------------------------------------
# One robots document per origin of the pages; its text follows from the smallest page id.
ORIGIN = f"""og AS (SELECT page_id, url, s.scheme || '://' || s.host || s.port AS origin, s.path AS path FROM (SELECT *, {R.url_struct('url')} AS s FROM pages))"""


def _pages_with_origin(spark, sf):
    pages = table(configure(spark), sf, "pages")
    return U.with_url(pages.select("page_id", "url"), "url", "u").select("page_id", "url", U.origin_of(U.Url("u")).alias("origin"))


def robots_docs(spark, sf):
    low = _pages_with_origin(spark, sf).groupBy("origin").agg(F.min("page_id").alias("k"))
    k = F.col("k")
    signal = F.when(k % 3 == 0, "# Content-Signal: search=yes, ai-train=no\n").when(k % 3 == 1, "Content-Signal: search=yes,ai-input=no,use=reference\n").otherwise("")
    delay = F.concat(F.lit("Crawl-delay: "), (k % 10).cast("string"), F.lit("\n"))
    body = F.concat(
        F.lit("Disallow: /early\nUser-agent: *\nDisallow: /private\n"), delay,
        F.when(k % 2 == 0, "Disallow: /en/\nAllow: /en/7\n").otherwise("Disallow: /*page=\nDisallow:\nnonsense\n"), signal,
        F.when(k % 4 == 1, "User-agent: OtherBot\nUser-agent: ListingBot\nDisallow: /de/ # german\nAllow: /de/$\nUser-agent: listing\nDisallow: /\n").otherwise(""))
    status = F.when(k % 11 == 3, 503).when(k % 11 == 5, 404).when(k % 11 == 7, 403).otherwise(200)
    return low.select(
        "origin", "k", (F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(hours=F.when(k % 13 == 2, 30).otherwise(1))).alias("fetched_at"),
        status.alias("status"), F.when(status == 200, body).alias("body"), F.when(k % 17 == 4, "socket closed").alias("error"))


DOCS = f"""{ORIGIN}, dk AS (SELECT origin, min(page_id) AS k FROM og WHERE origin IS NOT NULL GROUP BY 1),
ds AS (SELECT *, CASE WHEN k % 11 = 3 THEN 503 WHEN k % 11 = 5 THEN 404 WHEN k % 11 = 7 THEN 403 ELSE 200 END AS status FROM dk)"""


@query(f"WITH {DOCS} SELECT origin, status, CASE WHEN status IN (200, 404) THEN 'allowed' ELSE 'unknown' END AS status_verdict FROM ds")
def robots_status():
    raise NotImplementedError


QUERIES["robots_status"] = lambda spark, sf: robots.robots_status(robots_docs(spark, sf)).select("origin", "status", "status_verdict")
RULES = [  # (when over k, group, agents, rule, kind, pattern); the crawl delay belongs to the first group
    ("true", 1, "*", 0, "disallow", "/private"), ("k % 2 = 0", 1, "*", 1, "disallow", "/en/"), ("k % 2 = 0", 1, "*", 2, "allow", "/en/7"),
    ("k % 2 = 1", 1, "*", 1, "disallow", "/*page="), ("k % 4 = 1", 2, "otherbot,listingbot", 0, "disallow", "/de/"),
    ("k % 4 = 1", 2, "otherbot,listingbot", 1, "allow", "/de/$"), ("k % 4 = 1", 3, "listing", 0, "disallow", "/")]


@query(f"WITH {DOCS} " + " UNION ALL ".join(
    f"SELECT origin, CAST({g} AS BIGINT) AS group_no, '{a}' AS agents, {'CAST(k % 10 AS DOUBLE)' if g == 1 else 'NULL'} AS crawl_delay, {r} AS rule_no, '{kind}' AS kind, '{p}' AS pattern, "
    f"{len(p)} AS length FROM ds WHERE status = 200 AND {when}" for when, g, a, r, kind, p in RULES))
def robots_rules():
    raise NotImplementedError


QUERIES["robots_rules"] = lambda spark, sf: robots.robots_rules(robots_docs(spark, sf)).withColumn("agents", F.array_join("agents", ","))


@query(f"""WITH {DOCS} SELECT origin, CASE WHEN status = 200 AND k % 3 < 2 THEN 'true' END AS search, CASE WHEN status = 200 AND k % 3 = 1 THEN 'false' END AS ai_input,
  CASE WHEN status = 200 AND k % 3 = 0 THEN 'false' END AS ai_train, CASE WHEN status = 200 AND k % 3 = 1 THEN 'reference' END AS use FROM ds""")
def robots_signals():
    raise NotImplementedError


QUERIES["robots_signals"] = lambda spark, sf: robots.robots_signals(robots_docs(spark, sf)).select(
    "origin", *[F.col(c).cast("string") for c in ("search", "ai_input", "ai_train")], "use")
# The applicable rules of each document written out by hand, as (pattern as regular expression, allow, length).
VERDICT = f"""{DOCS}, uu AS (SELECT page_id, og.url, og.origin, k, status, s.path || regexp_extract(s.tail, '^([^#]*)', 1) AS path FROM og JOIN (SELECT page_id, {R.url_struct('url')} AS s FROM pages) p USING (page_id) LEFT JOIN ds ON ds.origin = og.origin),
rl AS (SELECT page_id, unnest(CASE WHEN status IS DISTINCT FROM 200 THEN [] WHEN k % 4 = 1 THEN [{{'rx': '^/de/', 'allow': false, 'n': 4, 'p': '/de/'}}, {{'rx': '^/de/$', 'allow': true, 'n': 5, 'p': '/de/$'}}]
  WHEN k % 2 = 0 THEN [{{'rx': '^/private', 'allow': false, 'n': 8, 'p': '/private'}}, {{'rx': '^/en/', 'allow': false, 'n': 4, 'p': '/en/'}}, {{'rx': '^/en/7', 'allow': true, 'n': 5, 'p': '/en/7'}}]
  ELSE [{{'rx': '^/private', 'allow': false, 'n': 8, 'p': '/private'}}, {{'rx': '^/.*page=', 'allow': false, 'n': 7, 'p': '/*page='}}] END) AS r FROM uu),
bm AS (SELECT page_id, arg_max(r, r.n * 2 + CAST(r.allow AS INT)) AS b FROM rl JOIN uu USING (page_id) WHERE regexp_matches(path, r.rx) GROUP BY 1),
vd AS (SELECT uu.*, CASE WHEN b IS NOT NULL AND NOT b.allow THEN 'disallowed' ELSE 'allowed' END AS verdict, CASE WHEN status IS DISTINCT FROM 200 THEN 'No applicable robots group; default allow'
  WHEN b IS NOT NULL THEN CASE WHEN b.allow THEN 'Allow' ELSE 'Disallow' END || ': ' || b.p || ' matched ' || path ELSE 'No matching rule for ' || path || '; default allow' END AS evidence FROM uu LEFT JOIN bm USING (page_id))"""


@query(f"WITH {VERDICT} SELECT page_id, verdict, evidence, CASE WHEN status = 200 AND k % 4 <> 1 THEN CAST(k % 10 AS DOUBLE) END AS crawl_delay FROM vd")
def robots_verdicts():
    raise NotImplementedError


def _verdicts(spark, sf):
    urls = table(configure(spark), sf, "pages").select("page_id", "url")
    return robots.robots_verdicts(urls, robots_docs(spark, sf), "otherbot/1.0").select("page_id", "verdict", "evidence", "crawl_delay")


QUERIES["robots_verdicts"] = _verdicts


@query(f"""WITH {VERDICT}, g AS (SELECT *, CASE WHEN k % 13 = 2 THEN 'stale' WHEN k % 17 = 4 THEN 'error' WHEN status IN (503, 403) THEN 'unreachable' WHEN status = 404 THEN 'none' ELSE 'rules' END AS st FROM vd)
SELECT page_id, CASE st WHEN 'rules' THEN verdict WHEN 'none' THEN 'allowed' ELSE 'unknown' END AS verdict,
  CASE st WHEN 'rules' THEN evidence WHEN 'stale' THEN 'No fresh robots.txt on record' WHEN 'error' THEN 'robots.txt fetch failed: socket closed'
    WHEN 'unreachable' THEN 'robots.txt unreachable (HTTP ' || status || '); operator intent unknown' ELSE 'No robots.txt published (HTTP ' || status || '); no restrictions' END AS evidence,
  CASE WHEN st = 'rules' THEN k % 3 <> 1 ELSE true END AS ai_input_allowed, CASE st WHEN 'rules' THEN verdict <> 'allowed' WHEN 'none' THEN false ELSE true END AS would_block,
  CASE st WHEN 'rules' THEN verdict = 'allowed' WHEN 'none' THEN true ELSE false END AS allowed FROM g""")
def robots_gate():
    raise NotImplementedError


def _gate(spark, sf):
    urls = table(configure(spark), sf, "pages").select("page_id", "url")
    return robots.robots_gate(urls, robots_docs(spark, sf), "otherbot/1.0", AS_OF, "enforce").select(
        "page_id", "verdict", "evidence", "ai_input_allowed", "would_block", "allowed")


QUERIES["robots_gate"] = _gate
ROBOT_EVENTS = """SELECT id, 'https://' || source_id || '.example.com' AS robots_origin, id % 5 <> 0 AS robots_would_block, CASE id % 5 WHEN 0 THEN 'allowed' WHEN 1 THEN 'unknown' ELSE 'disallowed' END AS robots_verdict FROM fetch_events WHERE NOT skipped"""


@query(f"""SELECT robots_origin, count(*) AS checks, count(*) FILTER (WHERE robots_would_block) AS would_block, count(*) FILTER (WHERE robots_verdict = 'disallowed') AS disallowed,
  count(*) FILTER (WHERE robots_verdict = 'unknown') AS unknown FROM ({ROBOT_EVENTS}) GROUP BY 1""", "fetch_events")
def robots_rollup(events):
    k = F.col("id") % 5
    e = events.withColumns({"robots_origin": F.when(~F.col("skipped"), F.concat(F.lit("https://"), "source_id", F.lit(".example.com"))),
                            "robots_would_block": k != 0, "robots_verdict": F.when(k == 0, "allowed").when(k == 1, "unknown").otherwise("disallowed")})
    return robots.robots_rollup(e)


# ---- discovery -------------------------------------------------------------------------------
POSITIVE = "is_active AND ph_eligibility IN ('eligible_verified', 'eligible_likely')"
CANDIDATES = f"""cd AS (SELECT min(company) AS company, count(*) AS jobs, arg_max(source_url, (coalesce(scraped_at, posted_at), source_url)) AS sample_url, max(category) AS category
  FROM listings WHERE {POSITIVE} AND trim(coalesce(company, '')) <> '' AND lower(company) NOT IN (SELECT lower(company_name) FROM companies)
  GROUP BY lower(company) HAVING count(*) >= 2 AND max(coalesce(scraped_at, posted_at)) >= TIMESTAMP '2023-11-01')"""


@query(f"WITH {CANDIDATES} SELECT * FROM cd ORDER BY jobs DESC, company LIMIT 200", "listings", "companies")
def prospect_candidates(listings, companies):
    return D.prospect_candidates(listings, companies, 2, "2023-11-01", 200)


CLASSIFIED = f"""{CANDIDATES}, cu AS (SELECT *, {R.url_struct('sample_url')} AS s FROM cd),
cl AS (SELECT trim(company) AS company, jobs, sample_url, CASE WHEN {R.under(R.bare_host('s'), V.TRUSTED_HOSTS)} THEN 'auto_add' ELSE 'review' END AS lane, {R.ats('s')} AS ats,
  CASE WHEN category = 'tech' THEN 'tech' ELSE 'global-va' END AS niche FROM cu)"""


@query(f"WITH {CLASSIFIED} SELECT company, jobs, lane, split_part(ats, ':', 1) AS ats_platform, split_part(ats, ':', 2) AS ats_token, niche FROM cl", "listings", "companies")
def classify_candidates(listings, companies):
    c = D.prospect_candidates(listings, companies, 2, "2023-11-01", 200)
    return D.classify_candidates(c, companies).select("company", "jobs", "lane", "ats_platform", "ats_token", "niche")


# Names of every quality class, one row per document: placeholders, bare words, spacing and case variants.
NAMED = """nm AS (SELECT CASE doc_id % 7 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Solutions' WHEN 2 THEN 'Blue  Fox ' || (doc_id % 30) WHEN 3 THEN 'blue fox ' || (doc_id % 30) WHEN 4 THEN '12' || (doc_id % 3)
  WHEN 5 THEN 'Acme ' || (doc_id % 9) ELSE 'Red Owl ' || doc_id END AS company, doc_id AS jobs, CASE WHEN doc_id % 2 = 0 THEN 'https://jobs.lever.co/Owl' || doc_id || '/x' ELSE 'https://feed.example.com/' || doc_id END AS sample_url FROM documents)"""


@query(f"""WITH {NAMED}, k AS (SELECT *, trim(regexp_replace(lower(company), '\\s+', ' ', 'g')) AS key FROM nm),
q AS (SELECT *, length(key) >= 3 AND key NOT IN {in_list(V.NAME_BLOCKLIST + V.GENERIC_WORDS)} AND regexp_matches(key, '[a-z]') AS good FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY jobs DESC, company) AS n FROM q WHERE good AND key NOT IN (SELECT lower(company_name) FROM companies))
SELECT lane, count(*) AS n, CAST(sum(jobs) AS BIGINT) AS jobs, count(ats) AS tenants FROM (
  SELECT CASE WHEN contains(sample_url, 'lever') THEN 'auto_add' ELSE 'review' END AS lane, jobs, CASE WHEN contains(sample_url, 'lever') THEN 1 END AS ats FROM r WHERE n = 1
  UNION ALL SELECT 'rejected', jobs, CASE WHEN contains(sample_url, 'lever') THEN 1 END FROM q WHERE NOT good) GROUP BY 1""", "companies")
def candidate_lanes():
    raise NotImplementedError


def _lanes(spark, sf):
    d, i = table(configure(spark), sf, "documents"), F.col("doc_id")
    name = lambda head, v: F.concat(F.lit(head), v.cast("string"))
    k = i % 7
    company = (F.when(k == 0, "Unknown").when(k == 1, "Solutions").when(k == 2, name("Blue  Fox ", i % 30)).when(k == 3, name("blue fox ", i % 30))
               .when(k == 4, name("12", i % 3)).when(k == 5, name("Acme ", i % 9)).otherwise(name("Red Owl ", i)))
    url = F.when(i % 2 == 0, F.concat(F.lit("https://jobs.lever.co/Owl"), i.cast("string"), F.lit("/x"))).otherwise(name("https://feed.example.com/", i))
    c = d.select(company.alias("company"), i.alias("jobs"), url.alias("sample_url"), F.lit("tech").alias("category"))
    return D.classify_candidates(c, view(spark, sf, "companies")).groupBy("lane").agg(
        F.count(F.lit(1)).alias("n"), F.sum("jobs").alias("jobs"), F.count("ats_token").alias("tenants"))


QUERIES["candidate_lanes"] = _lanes


@query(f"""WITH {CLASSIFIED}, rd AS (SELECT company, jobs FROM cl) SELECT company, jobs, (SELECT count(*) FROM rd) > 3 AS over_ceiling FROM rd ORDER BY jobs DESC, company LIMIT 2""", "listings", "companies")
def drain(listings, companies):
    c = D.classify_candidates(D.prospect_candidates(listings, companies, 2, "2023-11-01", 200), companies)
    return D.drain(c.withColumn("lane", F.lit("auto_add")), 2, ceiling=3).select("company", "jobs", "over_ceiling")


@query(f"""WITH {CLASSIFIED} SELECT company_name, niche, ats_platform, ats_token, notes FROM (SELECT company_name, niche, ats_platform, ats_token, NULL AS notes FROM companies)
UNION ALL SELECT company, niche, nullif(split_part(ats, ':', 1), ''), nullif(split_part(ats, ':', 2), ''), 'Prospector auto-add 2024-01-31: discovered from ' || jobs || ' active job(s); sample ' || sample_url || '.' FROM cl WHERE lane = 'auto_add'""", "listings", "companies")
def add_prospects(listings, companies):
    c = D.classify_candidates(D.prospect_candidates(listings, companies, 2, "2023-11-01", 200), companies)
    return D.add_prospects(companies, D.drain(c), AS_OF).select("company_name", "niche", "ats_platform", "ats_token", "notes")


@query(f"WITH {CLASSIFIED} SELECT company, split_part(ats, ':', 1) AS ats_platform, split_part(ats, ':', 2) AS ats_token, jobs FROM cl WHERE ats IS NOT NULL", "listings", "companies")
def ats_proposals(listings, companies):
    c = D.classify_candidates(D.prospect_candidates(listings, companies, 2, "2023-11-01", 200), companies)
    return D.ats_proposals(D.drain(c), c).select("company", "ats_platform", "ats_token", "jobs")


@query("""SELECT company_name, website FROM companies UNION ALL SELECT 'ACME   ' || n_nationkey, 'https://' || lower(n_name) || '.example.com' FROM nation
WHERE 'acme ' || n_nationkey NOT IN (SELECT lower(company_name) FROM companies)""", "companies")
def seed_companies():
    raise NotImplementedError


def _seed(spark, sf):
    nation = table(configure(spark), sf, "nation")
    seed = nation.select(F.concat(F.lit("ACME   "), F.col("n_nationkey").cast("string")).alias("company_name"),
                         F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example.com")).alias("website"))
    return D.seed_companies(view(spark, sf, "companies"), seed).select("company_name", "website")


QUERIES["seed_companies"] = _seed
SIGNAL = f"""sg AS (SELECT lower(company) AS k, count(*) FILTER (WHERE ph_eligibility = 'eligible_verified') AS v, count(*) AS e FROM listings WHERE {POSITIVE} GROUP BY 1),
js AS (SELECT c.*, coalesce(v, 0) AS verified_jobs, coalesce(e, 0) AS eligible_jobs FROM companies c LEFT JOIN sg ON k = lower(company_name))"""


@query(f"WITH {SIGNAL} SELECT id, verified_jobs, eligible_jobs FROM js", "companies", "listings")
def company_job_signal(companies, listings):
    return D.company_job_signal(companies, listings).select("id", "verified_jobs", "eligible_jobs")


CAREER = "CASE ats_platform WHEN 'greenhouse' THEN 'https://boards.greenhouse.io/' || ats_token WHEN 'ashby' THEN 'https://jobs.ashbyhq.com/' || ats_token END"


@query(f"""WITH {SIGNAL}, g AS (SELECT *, {CAREER} AS page, (NOT is_verified AND hires) OR ats_token IS NOT NULL AS sel FROM js),
v AS (SELECT *, sel AND NOT is_verified AND verified_jobs >= 1 AND eligible_jobs >= 2 AS ver, CASE WHEN sel THEN page END AS hp FROM g),
n AS (SELECT *, array_to_string(list_filter(['hiring_page=' || hp, CASE WHEN ver THEN 'auto-verified (' || verified_jobs || ' verified, ' || eligible_jobs || ' PH-eligible jobs)' END], lambda x: x IS NOT NULL), '; ') AS acts FROM v)
SELECT id, hp AS hiring_page_url, is_verified OR ver AS is_verified, CASE WHEN acts <> '' THEN '[enrich 2024-01-31] ' || acts END AS notes FROM n""", "companies", "listings")
def enrich_companies(companies, listings):
    return D.enrich_companies(companies, listings, AS_OF).select("id", "hiring_page_url", "is_verified", "notes")


@query("SELECT id FROM companies WHERE (NOT is_verified AND hires) OR ats_token IS NOT NULL ORDER BY sha256(id || ':7'), id LIMIT 25", "companies")
def enrich_batch(companies):
    return D.enrich_batch(companies, 25, 7).select("id")


@query("""SELECT id, CASE WHEN trim(coalesce(website, '')) <> '' THEN 'https://' || website END AS check_url, coalesce(website, 'unknown') AS host,
  CASE ats_platform WHEN 'ashby' THEN 'https://api.ashbyhq.com/posting-api/job-board/' || ats_token WHEN 'greenhouse' THEN 'https://boards-api.greenhouse.io/v1/boards/' || ats_token || '/jobs' END AS endpoint FROM companies""", "companies")
def company_urls(companies):
    df = U.with_url(companies, U.check_url(F.col("website")), "u")
    return df.select("id", U.check_url(F.col("website")).alias("check_url"), F.coalesce(U.Url("u")["host"], F.lit("unknown")).alias("host"),
                     U.ats_url(F.col("ats_platform"), F.col("ats_token"), V.ATS_ENDPOINTS).alias("endpoint"))


# ---- search ----------------------------------------------------------------------------------
_TOKENS = r"list_filter(regexp_split_to_array(strip_accents(lower(coalesce({}, ''))), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _bm25(phrases: list[str], extra: str = "", title: str = "title") -> str:
    """Ranked hits ``sc`` of phrases, a phrase being words joined by one space; every start of a phrase in a field counts."""
    def tf(phrase: str) -> str:
        words = phrase.split()
        return " + ".join("len(list_filter(range(1, len({0}) + 1), lambda i: {1}))".format(
            f, " AND ".join(f"{f}[i + {j}] = {literal(w)}" if j else f"{f}[i] = {literal(w)}" for j, w in enumerate(words))) for f in ("f1", "f2", "f3"))

    tfs = ", ".join(f"{tf(p)} AS tf{i}" for i, p in enumerate(phrases))
    dfs = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(phrases)))
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / av))" for i in range(len(phrases)))
    hit = " AND ".join(f"tf{i} > 0" for i in range(len(phrases)))
    return f"""tk AS (SELECT id, title, category, type, source_platform, is_active, {_TOKENS.format(title)} AS f1, {_TOKENS.format("company")} AS f2,
  {_TOKENS.format("array_to_string(tags, ' ')")} AS f3 FROM postings),
tq AS (SELECT *, len(f1) + len(f2) + len(f3) AS dl, {tfs} FROM tk), sx AS (SELECT count(*) AS n, avg(dl) AS av, {dfs} FROM tq),
sc AS (SELECT tq.*, {score} AS score FROM tq, sx WHERE is_active AND {hit} {extra})"""


def _page(limit: int = 30, offset: int = 0) -> str:
    return f"SELECT id, round(score, 6) AS score FROM sc ORDER BY round(score, 9) DESC, id LIMIT {limit} OFFSET {offset}"


def _scored(hits: DataFrame) -> DataFrame:
    return hits.select("id", F.round("score", 6).alias("score"))


_INDEXES: dict[tuple, I.TextIndex] = {}


def indexed(listings: DataFrame, name: str) -> I.TextIndex:
    """The index of a table, written once per session and table to the shared folder, as it is once per day in use."""
    key = (listings.sparkSession.sparkContext.applicationId, name, listings.semanticHash())
    if key not in _INDEXES:
        _INDEXES[key] = I.write_index(listings, f"{shared_folder(listings.sparkSession)}/text-index-{uuid.uuid4().hex}", row_group_bytes=1 << 18)
    return _INDEXES[key]


def of_texts(postings: DataFrame) -> DataFrame:
    """Listings whose titles are whole texts."""
    return postings.withColumn("title", F.col("description"))


@query(f"WITH {_bm25(['virtual', 'acme'])} SELECT id, title, round(score, 6) AS score FROM sc ORDER BY round(score, 9) DESC, id LIMIT 30", "postings")
def search(postings):
    return S.search(postings, "Virtual ÁCME").select("id", "title", F.round("score", 6).alias("score"))


@query(f"""WITH {_bm25(['analyst', 'remote'], "AND category = 'admin'")} {_page()}""", "postings")
def search_filtered(postings):
    """The second word occurs in tags alone."""
    return _scored(S.search(postings, "analyst REMOTE", category="admin"))


@query(f"WITH {_bm25(['react developer'])} SELECT count(*) AS total FROM sc", "postings")
def search_phrase_total(postings):
    return S.search_total(postings, "react-developer")


@query(f"WITH {_bm25(['support', 'agent'])} {_page()}", "postings")
def search_index(postings):
    return _scored(I.search_index(indexed(postings, "postings"), postings, "support agent"))


@query(f"WITH {_bm25(['senior react', 'acme'])} {_page(10, 10)}", "postings")
def search_index_phrase(postings):
    """A phrase and a word, the second page."""
    return _scored(I.search_index(indexed(postings, "postings"), postings, "Senior-React âcmë", size=10, page=2))


@query(f"""WITH {_bm25(['remote'], "AND category = 'admin' AND type = 'VA'")} {_page(5)}""", "postings")
def search_index_filtered(postings):
    return _scored(I.search_index(indexed(postings, "postings"), postings, "remote", size=5, category="admin", type="VA"))


@query(f"WITH {_bm25(['the'], title='description')} {_page(20)}", "postings")
def search_index_texts(postings):
    """A common word in whole texts: blocks under the twentieth score are not read."""
    texts = of_texts(postings)
    return _scored(I.search_index(indexed(texts, "texts"), texts, "thé", size=20))


@query(f"WITH {_bm25(['que la', 'de'], title='description')} {_page(20)}", "postings")
def search_index_texts_phrase(postings):
    texts = of_texts(postings)
    return _scored(I.search_index(indexed(texts, "texts"), texts, "que-la dé", size=20))


@query(f"""WITH {_bm25(['und die'], "AND category = 'other'", title='description')} SELECT count(*) AS total FROM sc""", "postings")
def search_index_total(postings):
    texts = of_texts(postings)
    return I.search_index_total(indexed(texts, "texts"), texts, "und-die", category="other")


@query(f"""WITH f AS (SELECT id, 'title' AS field, title AS x FROM postings UNION ALL SELECT id, 'company', company FROM postings
  UNION ALL SELECT id, 'tags', array_to_string(tags, ' ') FROM postings), t AS (SELECT id, field, unnest({_TOKENS.format("x")}) AS term FROM f)
SELECT field, term, count(*) AS tf, count(DISTINCT id) AS docs FROM t GROUP BY 1, 2""", "postings")
def term_index(postings):
    """The position lists of the index, counted per field and term."""
    found = indexed(postings, "postings").postings.select("term", F.inline("entries")).select("term", "id", F.explode("places").alias("place"))
    field = F.element_at(F.array(*[F.lit(f) for f in S.FIELDS]), F.shiftright("place", 40).cast("int") + 1)
    return found.groupBy(field.alias("field"), "term").agg(F.count(F.lit(1)).alias("tf"), F.count_distinct("id").alias("docs"))


# ---- windows and clicks ------------------------------------------------------------------------
@query(f"""SELECT source_id, {sec("date_trunc('day', ts)")} AS window_start, count(*) AS attempts, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE skipped) AS skipped,
  CAST(sum(cnt) AS BIGINT) AS items, count(*) FILTER (WHERE NOT ok) AS failed FROM fetch_events GROUP BY 1, 2""", "fetch_events")
def health_daily(events):
    return as_text(windows.health_windows(events, "1 day", None), "window_start").drop("window_end")


@query(f"""WITH w AS (SELECT *, unnest(generate_series(date_trunc('hour', ts) - INTERVAL 23 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS s FROM fetch_events)
SELECT source_id, {sec('s')} AS window_start, {sec('s + INTERVAL 24 HOUR')} AS window_end, count(*) AS attempts, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE skipped) AS skipped,
  CAST(sum(cnt) AS BIGINT) AS items, count(*) FILTER (WHERE NOT ok) AS failed FROM w GROUP BY 1, s""", "fetch_events")
def health_sliding(events):
    return as_text(windows.health_windows(events), "window_start", "window_end")


@query(f"""WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY source_id ORDER BY ts, id) + INTERVAL 3 HOUR THEN 1 ELSE 0 END AS brk FROM fetch_events),
s AS (SELECT *, sum(brk) OVER (PARTITION BY source_id ORDER BY ts, id) AS k FROM g)
SELECT source_id, {sec('min(ts)')} AS session_start, {sec('max(ts) + INTERVAL 3 HOUR')} AS session_end, count(*) AS attempts, CAST(sum(cnt) AS BIGINT) AS items FROM s GROUP BY source_id, k""", "fetch_events")
def activity_sessions(events):
    return as_text(windows.activity_sessions(events), "session_start", "session_end")


CLICKS = f"""cu AS (SELECT *, {R.url_struct('source_url')} AS s, {R.url_struct('application_url')} AS a FROM listings),
ck AS (SELECT e.event_id AS click_id, l.id, CASE e.event_id % 3 WHEN 0 THEN l.source_url WHEN 1 THEN l.application_url ELSE 'https://evil.example.com/' END AS url, l.source_url, l.application_url, s, a
  FROM events e JOIN cu l ON l.id = e.event_id % (SELECT count(*) FROM documents)),
tg AS (SELECT click_id, id, CASE WHEN url = source_url THEN {R.safe_source('s', 'source_url')} WHEN url = application_url THEN coalesce({R.trusted_apply('a', 'application_url', 's', 'source_url')}, {R.safe_source('s', 'source_url')}) END AS target FROM ck)"""


def clicks(spark, sf):
    listings = view(spark, sf, "listings")
    e = table(spark, sf, "events").select(F.col("event_id").alias("click_id"), (F.col("event_id") % table(spark, sf, "documents").agg(F.count(F.lit(1))).scalar()).alias("id"))
    k = F.col("click_id") % 3
    made = e.join(listings.select("id", "source_url", "application_url"), "id").select("click_id", "id", F.when(
        k == 0, F.col("source_url")).when(k == 1, F.col("application_url")).otherwise("https://evil.example.com/").alias("url"))
    return made, listings


@query(f"WITH {CLICKS} SELECT click_id, target FROM tg", "listings")
def outbound_clicks():
    raise NotImplementedError


@query(f"WITH {CLICKS} SELECT id, count(*) AS clicks FROM tg WHERE target IS NOT NULL GROUP BY 1", "listings")
def click_counts():
    raise NotImplementedError


QUERIES["outbound_clicks"] = lambda spark, sf: W.outbound_clicks(*clicks(spark, sf)).select("click_id", "target")
QUERIES["click_counts"] = lambda spark, sf: windows.click_counts(*clicks(spark, sf))

SIGNALS = "sn AS (SELECT id, 'k' || (id % 6) AS incident_key, ts, CASE id % 5 WHEN 0 THEN 'failing' WHEN 4 THEN CASE WHEN id % 3 = 0 THEN 'failing' ELSE 'unknown' END ELSE 'healthy' END AS signal FROM fetch_events)"


@query(f"""WITH RECURSIVE {SIGNALS.replace('sn AS (SELECT id,', 'sn AS (SELECT row_number() OVER (PARTITION BY id % 6 ORDER BY ts, id) AS n, id,')},
st AS (SELECT incident_key, n, id, signal = 'failing' AS o, 0 AS h, CASE WHEN signal = 'failing' THEN 'CREATE' ELSE 'HOLD' END AS action FROM sn WHERE n = 1
  UNION ALL SELECT sn.incident_key, sn.n, sn.id, CASE sn.signal WHEN 'failing' THEN true WHEN 'healthy' THEN o AND h + 1 < 2 ELSE o END,
    CASE WHEN sn.signal = 'failing' THEN 0 WHEN sn.signal = 'healthy' AND o AND h + 1 < 2 THEN h + 1 WHEN sn.signal = 'healthy' THEN 0 ELSE h END,
    CASE WHEN sn.signal = 'failing' THEN CASE WHEN NOT o THEN 'CREATE' WHEN h > 0 THEN 'UPDATE' ELSE 'HOLD' END WHEN sn.signal = 'healthy' AND o THEN CASE WHEN h + 1 >= 2 THEN 'CLOSE' ELSE 'UPDATE' END ELSE 'HOLD' END
  FROM st JOIN sn ON sn.incident_key = st.incident_key AND sn.n = st.n + 1)
SELECT incident_key, id, action, CAST(h AS INT) AS healthy_streak FROM st""", "fetch_events", name="incident_actions")
def incident_actions(events):
    i = F.col("id")
    signal = F.when(i % 5 == 0, "failing").when((i % 5 == 4) & (i % 3 == 0), "failing").when(i % 5 == 4, "unknown").otherwise("healthy")
    signals = events.select("id", F.concat(F.lit("K"), (i % 6).cast("string")).alias("incident_key"), "ts", signal.alias("signal"))
    return states.incident_actions(signals).select("incident_key", "id", "action", "healthy_streak")


