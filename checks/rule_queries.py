"""Cleaning jobs, rule classifiers and geographic eligibility."""

from pyspark.sql import functions as F

from listingspark import values as V
from listingspark.functions import urls as U
from listingspark.operators import cleaning as N, discovery, geo, links
from listingspark.sources import ingest

from . import rules_sql as R
from .registry import in_list, literal, pattern, query, sec, seconds
from .views import table, texts

ENTITIES = """replace(replace(replace(replace(replace({}, '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' ')"""


def _decoded(e: str) -> str:
    """Numeric references by splitting at their opener, then the names."""
    def step(text: str, opener: str, digits: str, number: str) -> str:
        char = (f"CASE WHEN length(regexp_extract(x, '^({digits}+);', 1)) > 12 THEN '' ELSE "
                f"CASE WHEN {number} > 1114111 OR {number} BETWEEN 55296 AND 57343 THEN '' ELSE chr(CAST({number} AS INT)) END END")
        piece = f"CASE WHEN regexp_matches(x, '^{digits}+;') THEN {char} || regexp_replace(x, '^{digits}+;', '') ELSE '{opener}' || x END"
        return f"(string_split({text}, '{opener}')[1] || array_to_string(list_transform(string_split({text}, '{opener}')[2:], lambda x: {piece}), ''))"
    out = step(e, "&#", "[0-9]", "CAST(regexp_extract(x, '^([0-9]+);', 1) AS BIGINT)")
    for opener in ("&#x", "&#X"):
        out = step(out, opener, "[0-9A-Fa-f]", "CAST(concat('0x', regexp_extract(x, '^([0-9A-Fa-f]+);', 1)) AS BIGINT)")
    return ENTITIES.format(out)


DECODED = f"d AS (SELECT id, description, {_decoded('description')} AS dec FROM postings)"


@query(f"""WITH {DECODED} SELECT id, nullif({R.squeeze(R.no_tags("regexp_replace(dec, '&lt;[^&]*&gt;', ' ', 'gi')"))}, '') AS description FROM d""", "postings")
def clean_text_rss(postings):
    return N.clean_text(postings.select("id", "description"), ["description"], "rss")


@query(f"SELECT id, nullif({R.trim(R.no_tags('description', ''))}, '') AS description FROM postings", "postings")
def clean_text_ats(postings):
    return N.clean_text(postings.select("id", "description"), ["description"], "ats")


@query(f"""SELECT page_id, {R.squeeze("regexp_replace(" + R.no_tags("regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g')") + ", '&[a-z#0-9]+;', ' ', 'gi')")} AS html FROM pages""")
def clean_text_page():
    raise NotImplementedError


LATIN = "upper(array_to_string(list_transform(string_split(description, ''), lambda c: printf('%02x', ord(c))), ''))"


@query(f"""WITH m AS (SELECT id, description, CASE WHEN regexp_matches(description, '[ÂÃ][\\x{{80}}-\\x{{FF}}]') AND NOT regexp_matches(description, '[^\\x{{00}}-\\x{{FF}}]')
  THEN TRY(decode(from_hex({LATIN}))) END AS fixed FROM postings),
postings2 AS (SELECT id, CASE WHEN length(fixed) < length(description) THEN fixed ELSE description END AS description FROM m),
{DECODED.replace('FROM postings', 'FROM postings2')} SELECT id, nullif({R.squeeze(R.no_tags('dec'))}, '') AS description FROM d""", "postings")
def clean_text_json(postings):
    return N.clean_text(postings.select("id", "description"), ["description"], "json")


@query(f"""WITH raw AS (SELECT id, CASE id % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
  WHEN 2 THEN strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' GMT' WHEN 3 THEN strftime(ts, '%Y-%m-%d') WHEN 4 THEN 'soon' ELSE NULL END AS t, ts FROM fetch_events)
SELECT id, CASE WHEN id % 6 < 3 THEN {sec('ts')} WHEN id % 6 = 3 THEN strftime(ts, '%Y-%m-%d') || ' 00:00:00' END AS at FROM raw""", "fetch_events")
def normalize_times(events):
    day = F.date_format("ts", "yyyy-MM-dd")
    clock = F.date_format("ts", "HH:mm:ss")
    text = (F.when(F.col("id") % 6 == 0, F.concat_ws(" ", day, clock)).when(F.col("id") % 6 == 1, F.concat(day, F.lit("T"), clock, F.lit("Z")))
            .when(F.col("id") % 6 == 2, F.concat(F.date_format("ts", "E, dd MMM yyyy"), F.lit(" "), clock, F.lit(" GMT")))
            .when(F.col("id") % 6 == 3, day).when(F.col("id") % 6 == 4, "soon"))
    return N.normalize_times(events.select("id", text.alias("at")), ["at"]).withColumn("at", seconds("at"))


URLS = f"""u0 AS (SELECT *, {R.url_struct('source_url')} AS s, {R.url_struct('application_url')} AS a FROM listings),
u1 AS (SELECT *, {R.safe_source('s', 'source_url')} AS safe, {R.trusted_apply('a', 'application_url', 's', 'source_url')} AS trusted, {R.ats('s')} AS ats FROM u0)"""


@query(f"""WITH {URLS} SELECT id, safe AS source_url, CASE WHEN safe IS NOT NULL THEN coalesce(trusted, safe) END AS application_url,
  safe IS NOT NULL AND coalesce(application_url <> '', false) AND trusted IS NULL AS quarantined, {R.bare_host('s')} AS host,
  {R.under(R.bare_host('s'), V.TRUSTED_HOSTS)} AS trusted_source, split_part(ats, ':', 1) AS ats_platform, split_part(ats, ':', 2) AS ats_token FROM u1""", "listings")
def sanitize_urls(listings):
    return N.sanitize_urls(listings).select("id", "source_url", "application_url", "quarantined", "host", "trusted_source",
                                            "ats_platform", "ats_token")


@query(f"""SELECT page_id, url, {R.render('s')} AS normal, {R.bare_host('s')} AS host FROM (SELECT *, {R.url_struct('url')} AS s FROM pages)""")
def page_hosts():
    raise NotImplementedError


@query(f"""WITH {URLS} SELECT count(*) AS received, count(safe) AS kept, count(*) FILTER (WHERE safe IS NULL) AS dropped_no_url,
  count(*) FILTER (WHERE safe IS NOT NULL AND coalesce(application_url <> '', false) AND trusted IS NULL) AS quarantined FROM u1""", "listings")
def boundary_counts(listings):
    return ingest.boundary_counts(listings)


@query(f"""WITH {URLS} SELECT id, safe AS source_url, coalesce(trusted, safe) AS application_url, sha256(title || '::' || safe) AS content_hash FROM u1
WHERE safe IS NOT NULL""", "listings")
def normalize_items(listings):
    return ingest.normalize_items(listings).select("id", "source_url", "application_url", "content_hash")


@query(f"""WITH {URLS}, p AS (SELECT {R.bare_host('a')} AS host, lower(trim(company)) AS c FROM u1 WHERE a IS NOT NULL AND safe IS NOT NULL
  AND contains(a.host, '.') AND trim(coalesce(company, '')) <> '' AND NOT {R.attributable('a', 's')})
SELECT host, count(DISTINCT c) AS companies FROM p GROUP BY 1 HAVING count(DISTINCT c) >= 3""", "listings")
def cross_company_hosts(listings):
    return discovery.cross_company_hosts(listings, 3)


@query("""SELECT id, sha256(title || '::' || source_url) AS content_hash, sha256(title || coalesce(description, '')) AS description_hash,
  trim(regexp_replace(lower(company), '\\s+', ' ', 'g')) AS company_key FROM listings""", "listings")
def add_keys(listings):
    return N.add_keys(listings).select("id", "content_hash", "description_hash", "company_key")


def _case(expr: str, rules: dict[str, str], test) -> str:
    return "CASE " + " ".join(f"WHEN {test(expr, words)} THEN '{name}'" for name, words in rules.items()) + " ELSE 'other' END"


BODY = "lower(title || ' ' || coalesce(description, ''))"
HEUR = {k: v[0] for k, v in V.HEURISTIC_CATEGORY_WORDS.items()}
HEUR_TAGS = "CASE " + " ".join(f"WHEN {R.any_substring(BODY, w)} THEN '{','.join(tags)}'" for w, tags in V.HEURISTIC_CATEGORY_WORDS.values()) + " ELSE 'remote' END"


@query(f"""WITH c0 AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'Acme Labs: ' || title ELSE title END AS raw_title, CASE WHEN id % 3 = 0 THEN NULL ELSE company END AS raw_company FROM postings),
c AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'Acme Labs' ELSE nullif({R.trim('raw_company')}, '') END AS company, title, description, tags, category, type,
  lower(title || ' ' || array_to_string(tags, ' ')) AS tt FROM c0)
SELECT id, title, company, lower(trim(title)) IN {in_list(V.PLACEHOLDER_TITLES)} AS is_placeholder,
  {R.hits("title || ' ' || coalesce(description, '')", V.RELEVANT_ROLES)} AND NOT
    {R.hits("title || ' ' || coalesce(description, '')", V.PHYSICAL_ROLES)} AS is_relevant,
  {R.hits("title || ' ' || coalesce(description, '')", V.GEO_RESTRICTIONS)} AS geo_restricted,
  {R.hits("title || ' ' || coalesce(description, '')", V.LOCAL_ONLY)} AS local_only,
  CASE WHEN category <> 'other' THEN category ELSE {_case('tt', V.BOARD_CATEGORY_WORDS, R.any_substring)} END AS board_category,
  {_case(BODY, HEUR, R.any_substring)} AS guessed_category, {HEUR_TAGS} AS guessed_tags,
  CASE WHEN category = 'tech' THEN 'tech' ELSE 'global-va' END AS niche, type,
  coalesce(length(company) >= 3 AND lower(company) NOT IN {in_list(V.NAME_BLOCKLIST + V.GENERIC_WORDS)} AND regexp_matches(lower(company), '[a-z]'), false) AS quality_company
FROM c""", "postings")
def enrich_columns(postings):
    third = F.col("id") % 3 == 0
    raw = postings.withColumns({"title": F.when(third, F.concat(F.lit("Acme Labs: "), "title")).otherwise(F.col("title")),
                                "company": F.when(~third, F.col("company"))})
    return N.enrich_columns(raw).select(
        "id", "title", "company", "is_placeholder", "is_relevant", "geo_restricted", "local_only", "board_category",
        "guessed_category", F.array_join("guessed_tags", ",").alias("guessed_tags"), "niche", "type", "quality_company")


@query(f"""WITH v AS (SELECT event_id AS id, user_id, event_type, value, event_id % 6 AS k FROM events)
SELECT id, k <> 4 AND k <> 5 AS available, CASE WHEN k NOT IN (4, 5) THEN CAST(user_id % 2 = 0 AS VARCHAR) END AS eligible,
  CASE WHEN k = 4 THEN 'AI classified' WHEN k = 5 THEN 'text only' ELSE event_type END AS reason,
  CASE WHEN k = 4 THEN 'other' WHEN k = 5 THEN 'other' WHEN user_id % 3 = 0 THEN 'tech' ELSE 'other' END AS category,
  CASE WHEN k IN (4, 5) THEN '' ELSE 'a,b,c,d,e,f' END AS tags,
  CASE WHEN k NOT IN (4, 5) AND id % 2 = 0 THEN 'contract' END AS employment_type FROM v""", "fetch_events!")
def clean_votes():
    raise NotImplementedError


@query(f"WITH gl AS ({R.language('documents', 'doc_id', 'text', 'language')}) SELECT doc_id, language FROM gl")
def detect_language():
    raise NotImplementedError


@query(f"WITH {R.gate('postings')} SELECT * FROM gate", "postings")
def geo_gate(postings):
    return geo.geo_gate(postings).select("id", "gate_scope", "gate_eligibility", "gate_evidence")


@query(f"WITH {R.gate('postings', chars=1500)} SELECT * FROM gate", "postings")
def geo_gate_1500(postings):
    """The gate on the beginning of a description only."""
    return geo.geo_gate(postings, chars=1500).select("id", "gate_scope", "gate_eligibility", "gate_evidence")


VISIBLE = R.squeeze("regexp_replace(" + R.no_tags("regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g')") + ", '&[a-z#0-9]+;', ' ', 'gi')")
# Every fourth page gets one of the phrases that decide.
MARKED = """CASE page_id % 8 WHEN 0 THEN '<p>Applicants must be based in the UK.</p>' WHEN 3 THEN '<p>Open in Manila. US only.</p>' WHEN 5 THEN '<b>citizenship required</b>' ELSE '' END || html"""


def _landing_sql(visible: str) -> str:
    return f"""WITH q AS (SELECT page_id, {visible} AS v FROM (SELECT page_id, {MARKED} AS h FROM pages)),
l AS ({R.language('q', 'page_id', 'v', 'lang_v')})
SELECT page_id, CASE WHEN length(v) < 200 OR {R.hits('v', V.PH_POSITIVE)} THEN NULL WHEN lang_v <> 'en' THEN 'Landing page is non-English (detected: ' || lang_v || ')'
  ELSE 'Landing page states: "' || nullif(regexp_extract(v, {pattern(V.RESIDENCE_LOCKS, False)}, 0, 'i'), '') || '"' END AS geo_lock FROM q JOIN l USING (page_id)"""


MARKER = "list_filter([" + ", ".join(literal(m) for m in V.PARKED_MARKERS) + "], lambda m: contains(lower(coalesce(body, '')), m))[1]"
STATUS = f"""SELECT *, CASE WHEN status BETWEEN 200 AND 299 THEN {MARKER} END AS mk FROM checks"""
CLASS = f"""SELECT *, CASE WHEN mk IS NOT NULL THEN 'parked' WHEN status BETWEEN 200 AND 399 THEN 'ok' WHEN status IN (404, 410, 451) THEN 'dead_http'
  WHEN status IS NOT NULL THEN 'bot_wall' END AS link_status FROM ({STATUS})"""


@query(f"""SELECT id, link_status, CASE WHEN mk IS NOT NULL THEN 'Body contains "' || mk || '" (HTTP ' || status || ')' WHEN link_status IN ('ok', 'dead_http')
  THEN 'HTTP ' || status WHEN status IN (401, 403, 405, 406, 409, 418, 429) THEN 'HTTP ' || status || ' (bot wall — site alive)'
  WHEN status >= 500 THEN 'HTTP ' || status || ' (edge/origin transient — not counted dead)' WHEN status IS NOT NULL THEN 'HTTP ' || status || ' (ambiguous — not counted dead)' END AS link_evidence,
  coalesce(link_status IN ('parked', 'dead_http'), false) AS hard_dead FROM ({CLASS})""", "checks")
def classify_links(checks):
    return links.classify_links(checks).select("id", "link_status", "link_evidence", "hard_dead")


def _reason() -> str:
    out = "CASE "
    for name, (codes, texts) in V.UNREACHABLE_RULES.items():
        test = f"regexp_matches(msg, '{texts}')"
        if codes:
            test = f"(regexp_matches(code, '{codes}') OR {test})"
        out += f"WHEN {test} THEN '{name}' "
    return out + "WHEN error_name = 'TypeError' OR regexp_matches(msg, 'fetch failed|failed to fetch') THEN 'REQUEST_ERROR' ELSE 'UNKNOWN_NETWORK' END"


REASONS = f"""SELECT *, {_reason()} AS reason FROM (SELECT *, upper(coalesce(cause_code, '') || ' ' || coalesce(error_code, '') || ' ' || error_name) AS code,
  lower(error_message) AS msg FROM checks WHERE status IS NULL)"""


@query(f"SELECT id, coalesce(cause_code, error_code, error_name) AS reason_code, reason FROM ({REASONS})", "checks")
def classify_unreachable(checks):
    return links.classify_unreachable(checks.where("status is null")).select("id", "reason_code", "reason")


def checked(checks):
    """Checks with their class; a network failure is unreachable with its reason."""
    lost = links.classify_unreachable(links.classify_links(checks))
    none = F.col("status").isNull()
    return lost.withColumns({"link_status": F.when(none, "unreachable").otherwise(F.col("link_status")),
                             "reason": F.when(none, F.col("reason"))})


TALLY = f"""t AS (SELECT coalesce(link_status, 'unreachable') AS link_status, reason FROM ({CLASS}) c LEFT JOIN (SELECT id, reason FROM ({REASONS})) r USING (id)),
k AS (SELECT 'status' AS kind, unnest({'[' + ', '.join(literal(s) for s in V.LINK_STATUSES) + ']'}) AS key UNION ALL SELECT 'reason', unnest({'[' + ', '.join(literal(s) for s in V.UNREACHABLE_REASONS) + ']'}))"""


@query(f"""WITH {TALLY} SELECT kind, key, (SELECT count(*) FROM t WHERE CASE kind WHEN 'status' THEN link_status ELSE reason END = key) AS n,
  (SELECT count(*) FROM t) AS checked, (SELECT count(*) FROM t) >= 10 AND (SELECT count(*) FILTER (WHERE link_status = 'unreachable') >= 0.8 * count(*) FROM t) AS degraded FROM k""", "checks")
def link_tally(checks):
    return links.link_tally(checked(checks))


@query(f"""SELECT count(*) AS attempted, count(*) FILTER (WHERE status IS NOT NULL) AS succeeded, count(*) FILTER (WHERE status IS NULL) AS failed,
  CAST(sum(CASE WHEN status = 410 THEN 1 ELSE 0 END) AS BIGINT) AS deactivated FROM checks""", "checks")
def attempt_rollup(checks):
    return links.attempt_rollup(checks.select(F.col("status").isNotNull().alias("succeeded"), F.coalesce(
        (F.col("status") == 410).cast("int"), F.lit(0)).alias("deactivated")))


STRIKES = f"""s0 AS (SELECT id, company_id, ts, coalesce(link_status IN ('parked', 'dead_http'), false) AS dead, link_status IS NULL AS lost FROM ({CLASS})),
s1 AS (SELECT *, sum(CASE WHEN NOT dead AND NOT lost THEN 1 ELSE 0 END) OVER (PARTITION BY company_id ORDER BY ts, id) AS island FROM s0),
s2 AS (SELECT *, sum(CASE WHEN dead THEN 1 ELSE 0 END) OVER (PARTITION BY company_id, island ORDER BY ts, id) AS strikes FROM s1)"""


@query(f"""WITH {STRIKES} SELECT company_id, count(*) AS checks, CAST(arg_max(strikes, (ts, id)) AS BIGINT) AS strikes, CAST(max(strikes) AS BIGINT) AS max_strikes,
  max(strikes) >= 3 AS reached_threshold FROM s2 GROUP BY 1""", "checks")
def link_strikes(checks):
    return links.link_strikes(checked(checks))


# ---- queries on given tables ------------------------------------------------------------------
def _on_table(name: str, source: str, sql: str | None = None):
    def wrap(fn):
        from .registry import ORACLES, QUERIES
        from .views import oracle
        from listingspark.session import configure
        if sql is not None:
            ORACLES[name] = oracle(sql)
        load = texts if source in ("documents", "pages") else table
        QUERIES[name] = lambda spark, sf: fn(load(configure(spark), sf, source))
        return fn
    return wrap


@_on_table("clean_text_page", "pages")
def _clean_page(pages):
    return N.clean_text(pages.select("page_id", "html"), ["html"], "page")


@_on_table("page_hosts", "pages")
def _page_hosts(pages):
    return U.with_url(pages, "url", "u").select("page_id", "url", U.render(U.Url("u")).alias("normal"), U.host_of(U.Url("u")).alias("host"))


@_on_table("detect_language", "documents")
def _language(documents):
    return geo.detect_language(documents, "text").select("doc_id", "language")


def _marked(pages):
    k = F.col("page_id") % 8
    mark = F.when(k == 0, "<p>Applicants must be based in the UK.</p>").when(k == 3, "<p>Open in Manila. US only.</p>").when(
        k == 5, "<b>citizenship required</b>").otherwise("")
    return pages.withColumn("html", F.concat(mark, "html"))


@_on_table("scan_landing_pages", "pages", _landing_sql(VISIBLE.replace("html", "h")))
def _landing(pages):
    return geo.scan_landing_pages(_marked(pages)).select("page_id", "geo_lock")


@_on_table("scan_landing_pages_4000", "pages", _landing_sql(f"substr({VISIBLE.replace('html', 'h')}, 1, 4000)"))
def _landing_4000(pages):
    """Landing pages judged on their beginning only."""
    return geo.scan_landing_pages(_marked(pages), chars=4000).select("page_id", "geo_lock")


@_on_table("clean_votes", "events")
def _votes(events):
    k = F.col("event_id") % 6
    flag = F.when(F.col("user_id") % 2 == 0, "true").otherwise("false")
    body = F.concat(F.lit('{"eligibleForFilipinos": '), flag, F.lit(', "reason": "'), F.col("event_type"), F.lit('", "category": "'),
                    F.when(F.col("user_id") % 3 == 0, "tech").otherwise("sports"), F.lit('", "tags": ["a","b","c","d","e","f"], "payRange": 7, "employmentType": "'),
                    F.when(F.col("event_id") % 2 == 0, "contract").otherwise("gig"), F.lit('"}'))
    text = (F.when(k == 0, body).when(k == 1, F.concat(F.lit("Sure! Here it is: "), body, F.lit(" Done.")))
            .when(k == 2, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 3, F.concat(F.lit("  "), body))
            .when(k == 4, F.lit("I cannot answer { that")).otherwise(F.lit('{"eligibleForFilipinos": "yes", "reason": "text only"}')))
    raw = events.select(F.col("event_id").alias("id"), text.alias("response"))
    return N.clean_votes(raw).select("id", "available", F.col("eligible").cast("string"), "reason", "category", F.array_join("tags", ",").alias("tags"), "employment_type")


