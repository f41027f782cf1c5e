"""Published cases of the text, URL, geographic, link and crawl rules."""

import pytest
from pyspark.sql import functions as F

from listingspark.functions import text as T, urls as U
from listingspark.functions.times import parse_epoch_or_text, parse_time
from listingspark.operators import cleaning, geo, links, robots


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x"))).first()[0]


def many(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in sorted(df.select("i", fn(F.col("x"))).collect())]


def test_entities(spark):
    cases = {
        'Tom &amp; Jerry &quot;show&quot;': 'Tom & Jerry "show"', "&#65;&#x42;": "AB", "evil &#1114112; payload": "evil  payload",
        "&#x110000;": "", "&#x1F600;&#X1f600;": "😀😀", "&#55296;&#57343;": "", "&amp;quot;": '"', "&#999999999999999999999;x": "x",
        "a &# b &#; c &#x; d": "a &# b &#; c &#x; d", "&apos;&nbsp;&#39;": "' '", "&#38;#x41;": "A", "none": "none", "&lt;": "&lt;",
    }
    assert many(spark, list(cases), T.decode_entities) == list(cases.values())


def test_mojibake(spark):
    cases = {"CasinÃ²": "Casinò", "Casinò": "Casinò", "Â": "Â", "Ãé": "Ãé", "MÃ¼nchen – ok": "MÃ¼nchen – ok", "attivitÃ ": "attività"}
    assert many(spark, list(cases), T.repair_mojibake) == list(cases.values())


@pytest.mark.parametrize("variant,raw,want", [
    ("rss", "<p>Hi</p> &lt;b&gt;x&lt;/b&gt; &amp; y", "Hi x & y"), ("json", "a<br/>b <i>c</i>", "a b c"), ("ats", " a<br>b ", "ab"),
    ("page", "<script>var a='<p>';</script><style>p{}</style><p>Hi&nbsp;<b>you</b></p>", "Hi you")])
def test_markup(spark, variant, raw, want):
    assert one(spark, raw, lambda c: T.strip_markup(c, variant)) == want


def test_times(spark):
    cases = {"2024-01-02T03:04:05Z": "2024-01-02 03:04:05", "2024-01-02 03:04:05": "2024-01-02 03:04:05", "Tue, 02 Jan 2024 03:04:05 GMT": "2024-01-02 03:04:05",
             "2 Jan 2024 05:04:05 +0200": "2024-01-02 03:04:05", "garbage-date": None, "": None, "2024-01-02T05:04:05+02:00": "2024-01-02 03:04:05"}
    got = many(spark, list(cases), lambda c: F.date_format(parse_time(c), "yyyy-MM-dd HH:mm:ss"))
    assert got == list(cases.values())
    assert one(spark, "1704164645000", lambda c: F.date_format(parse_epoch_or_text(c), "yyyy-MM-dd HH:mm:ss")) == "2024-01-02 03:04:05"


def test_small_text_rules(spark):
    pay = spark.createDataFrame([(0, 0), (10, 20), (10, 0), (0, 20), (-5, 7)], "a long, b long").select(T.pay_range(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in pay] == [None, "USD 10-20", "USD 10", "USD 20", "USD -5"]
    split = lambda c: T.split_company(c, F.lit(None).cast("string"))
    assert tuple(one(spark, "Acme: Dev: Senior", split)) == ("Acme", "Dev: Senior")
    assert tuple(one(spark, "x" * 40 + ": Dev", split)) == (None, "x" * 40 + ": Dev")
    shown = lambda c: T.excerpt(c, F.lit("Remotive"))
    assert one(spark, "short", shown) == "short"
    assert one(spark, "w" * 450 + " " + "z" * 100, shown) == "w" * 450
    assert one(spark, "w" * 300 + " " + "z" * 300, shown) == "w" * 300 + " " + "z" * 199
    assert one(spark, "short", lambda c: T.excerpt(c, F.lit("Elsewhere"))) is None
    names = {"Unknown": False, "Solutions": False, "123": False, "ab": False, "Acme Labs": True, " Tech  Solutions ": True, "-": False, "Stealth  Startup": False}
    assert many(spark, list(names), T.is_quality_company) == list(names.values())


def with_parts(spark, urls, fn):
    df = U.with_url(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, x string"), "x", "_t")
    return [r[1] for r in sorted(df.select("i", fn(U.Url("_t"), F.col("x"))).collect(), key=lambda r: r[0])]


def test_source_urls(spark):
    cases = {
        "HTTPS://Example.COM": "https://example.com/", "http://example.com:80/a?b#c": "http://example.com/a?b#c", "https://u:p@example.com/": None,
        "http://localhost/x": None, "http://a.localhost/x": None, "http://127.0.0.1/": None, "ftp://example.com": None, "javascript:alert(1)": None,
        "https://nodot/": None, "": None, "https://example.com/" + "a" * 2048: None, "http://[::1]/": None, " https://example.com:8443/x ": "https://example.com:8443/x",
        "https://exa mple.com/": None}
    assert with_parts(spark, list(cases), U.safe_source) == list(cases.values())


def test_apply_urls(spark):
    cases = {"hr@acme.com": "mailto:hr@acme.com", "mailto:hr@acme.com?subject=x": "mailto:hr@acme.com", "mailto:nobody": None, "https://acme.com/apply": "https://acme.com/apply",
             "javascript:alert(1)": None, "not a url": None, "https://nodot": None}
    assert with_parts(spark, list(cases), U.safe_apply) == list(cases.values())


def test_apply_trust(spark):
    cases = [("https://www.acme.com/a", "https://acme.com/b", "https://www.acme.com/a"), ("https://evil.com/a", "https://acme.com/b", None),
             ("https://jobs.lever.co/Acme/1", "https://api.lever.co/v0/postings/acme", "https://jobs.lever.co/Acme/1"),
             ("https://jobs.lever.co/other/1", "https://api.lever.co/v0/postings/acme", None), ("mailto:hr@acme.com", "https://acme.com/", None),
             ("https://boards.greenhouse.io/acme", "https://boards-api.greenhouse.io/v1/boards/acme/jobs", "https://boards.greenhouse.io/acme")]
    df = spark.createDataFrame([(i, a, s) for i, (a, s, _) in enumerate(cases)], "i int, application_url string, source_url string")
    out = sorted(cleaning.sanitize_urls(df).select("i", "quarantined", "application_url").collect())
    assert [(r.quarantined, r.application_url) for r in out] == [(w is None, w or s) for _, s, w in cases]


def test_tracking_tenants(spark):
    cases = {"https://boards.greenhouse.io/Acme/jobs/1": ("greenhouse", "acme"), "https://boards-api.greenhouse.io/v1/boards/acme/jobs": ("greenhouse", "acme"),
             "https://jobs.ashbyhq.com/acme/1": ("ashby", "acme"), "https://jobs.lever.co/acme/1": ("lever", "acme"), "https://acme.breezy.hr/p/1": ("breezy", "acme"),
             "https://apply.workable.com/acme/j/1": ("workable", "acme"), "https://evilbreezy.hr/p": None, "https://example.com/acme": None, "https://jobs.lever.co/": None}
    got = with_parts(spark, list(cases), lambda u, _: U.ats_of(u))
    assert [tuple(g) if g else None for g in got] == list(cases.values())


ITALIAN = ("Per il nostro reparto online stiamo cercando la seguente figura: Addetto Customer Service (100%) Mansioni: Occuparsi di assicurare la soddisfazione del cliente "
           "durante lo svolgimento di tutte le attività di gioco, gestione delle richieste dei clienti tramite live chat ed email, collaborazione con il team per garantire un servizio di qualità.")
GATE = [  # title, description, location, tags -> scope, eligibility
    ("Addetto a Customer Service", ITALIAN, None, ["italian", "german"], "country_locked", "ineligible"),
    ("Customer Support Specialist", "Join our fully distributed support team.", "Florida, Florida, United States", [], "country_locked", "ineligible"),
    ("Virtual Assistant", "Support our leadership team with scheduling.", "Anywhere in the World", [], "worldwide", "eligible_likely"),
    ("Customer Service", "Must reside in the Philippines.", "Philippines", [], "ph_only", "eligible_verified"),
    ("Executive Assistant", "Must be based in the Philippines. Dayshift.", None, [], "apac_incl_ph", "eligible_verified"),
    ("Support", "Any.", "Philippines, United States", [], "apac_incl_ph", "eligible_verified"),
    ("Customer Support (APAC)", "Supporting customers.", None, [], "apac_incl_ph", "eligible_verified"),
    ("Assistant", "Must overlap 4 hours with EST.", None, [], "unknown", "unclear"),
    ("Assistant", "You must be located in the US.", None, [], "region_excl_ph", "ineligible"),
    ("Assistant (Hybrid)", "Nice work.", None, [], "country_locked", "ineligible"),
    ("Assistant", "We use a hybrid of async and sync.", None, [], "unknown", "unclear"),
    ("Engineer - London", "Nice work.", None, [], "country_locked", "ineligible"),
    ("Assistant", "Work from anywhere.", None, [], "worldwide", "eligible_likely"),
    ("Assistant", "Nice work.", "EMEA", [], "region_excl_ph", "ineligible"),
    ("Assistant", "Nice work.", None, ["German"], "country_locked", "ineligible"),
    ("Assistant", "Nice work.", None, ["german", "english"], "unknown", "unclear"),
    ("Assistant", "Nice work.", "Perú", [], "unknown", "unclear"),
]


def test_gate(spark):
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(GATE)], "i int, title string, description string, location_raw string, tags array<string>")
    out = sorted(geo.geo_gate(df).select("i", "gate_scope", "gate_eligibility", "gate_evidence").collect())
    assert [(r.gate_scope, r.gate_eligibility) for r in out] == [g[4:] for g in GATE]
    assert out[0].gate_evidence == "Non-English posting (detected: it)"
    assert out[1].gate_evidence == 'Location pinned: "Florida" in "Florida, Florida, United States"'
    assert out[8].gate_evidence == 'Residence/authorization lock: "must be located in the U"'


def test_landing_pages(spark):
    pad = "We are a friendly remote team that works with you and your skills on our role. " * 5
    pages = spark.createDataFrame([(1, f"<p>{pad}</p><p>US only.</p>"), (2, f"<p>{pad} Manila</p><p>US only.</p>"), (3, "<p>US only.</p>"), (4, f"<p>{pad}</p>"),
                                   (5, f"<p>{ITALIAN} {ITALIAN}</p>")], "id int, html string")
    assert [r.geo_lock for r in sorted(geo.scan_landing_pages(pages).select("id", "geo_lock").collect())] == [
        'Landing page states: "US only"', None, None, None, "Landing page is non-English (detected: it)"]


def test_link_classes(spark):
    cases = {(200, "hi"): ("ok", False), (301, ""): ("ok", False), (200, "This Domain Is For Sale"): ("parked", True), (404, "this domain is for sale"): ("dead_http", True),
             (410, ""): ("dead_http", True), (403, ""): ("bot_wall", False), (418, ""): ("bot_wall", False), (526, ""): ("bot_wall", False), (400, ""): ("bot_wall", False)}
    df = spark.createDataFrame([(i, s, b) for i, (s, b) in enumerate(cases)], "i int, status int, body string")
    assert [(r.link_status, r.hard_dead) for r in sorted(links.classify_links(df).select("i", "link_status", "hard_dead").collect())] == list(cases.values())


def test_unreachable_reasons(spark):
    cases = [("ENOTFOUND", None, "TypeError", "fetch failed", "DNS_FAILURE"), (None, None, "TimeoutError", "x", "TIMEOUT"), ("CERT_HAS_EXPIRED", None, "TypeError", "", "TLS_FAILURE"),
             ("ECONNREFUSED", None, "TypeError", "", "CONNECT_FAILURE"), (None, None, "TypeError", "Network connection lost.", "EGRESS_BLOCKED"),
             (None, None, "TypeError", "fetch failed", "REQUEST_ERROR"), (None, None, None, None, "UNKNOWN_NETWORK")]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, cause_code string, error_code string, error_name string, error_message string")
    assert [r.reason for r in sorted(links.classify_unreachable(df).select("i", "reason").collect())] == [c[4] for c in cases]


ROBOTS = [  # document, agent, path -> verdict
    ("User-agent: *\nDisallow: /\nAllow: /public/", "mybot", "/private", "disallowed"),
    ("User-agent: *\nDisallow: /\nAllow: /public/", "mybot", "/public/jobs", "allowed"),
    ("User-agent: *\nAllow: /jobs\nDisallow: /jobs", "mybot", "/jobs", "allowed"),
    ("User-agent: *\nDisallow: /\n\nUser-agent: MyBot\nAllow: /", "mybot", "/anything", "allowed"),
    ("User-agent: *\nDisallow: /\n\nUser-agent: MyBot\nAllow: /", "someothercrawler", "/anything", "disallowed"),
    ("User-agent: bot\nDisallow: /\n\nUser-agent: mybot\nAllow: /", "mybot", "/x", "allowed"),
    ("User-agent: a\nUser-agent: mybot\nDisallow: /x", "mybot", "/x/y", "disallowed"),
    ("User-agent: a\nSitemap: https://e.com/s\nUser-agent: mybot\nDisallow: /x", "a", "/x/y", "allowed"),
    ("Disallow: /\nUser-agent: *\nDisallow:", "mybot", "/x", "allowed"),
    ("User-agent: *\nDisallow: /*.php$", "mybot", "/a/b.php", "disallowed"),
    ("User-agent: *\nDisallow: /*.php$", "mybot", "/a/b.php?x=1", "allowed"),
    ("User-agent: *\nDisallow: /a+b(c", "mybot", "/a+b(c/d", "disallowed"),
    ("User-agent: *\nDisallow: /q?x=", "mybot", "/q?x=1", "disallowed"),
    ("user-agent: * # all\r\nDISALLOW : /x # no\r\n", "mybot", "/x", "disallowed"),
    ("User-agent: *\nDisallow: x", "mybot", "/x", "allowed"),
]


def test_robots(spark):
    got = []
    for agent in sorted({r[1] for r in ROBOTS}):
        mine = [(i, r) for i, r in enumerate(ROBOTS) if r[1] == agent]
        docs = spark.createDataFrame([(f"https://h{i}.com", r[0]) for i, r in mine], "origin string, body string")
        urls = spark.createDataFrame([(i, f"https://h{i}.com{r[2]}") for i, r in mine], "i int, url string")
        got += [tuple(r) for r in robots.robots_verdicts(urls, docs, agent).select("i", "verdict").collect()]
    assert sorted(got) == [(i, r[3]) for i, r in enumerate(ROBOTS)]


def test_content_signals(spark):
    docs = spark.createDataFrame([("a", "# Content-Signal: search=yes, ai-train=no, use=reference"), ("b", "User-agent: *\nDisallow: /"),
                                  ("c", "Content-Signal: ai-input=no\nContent-Signal: ai-input=maybe")], "origin string, body string")
    assert [tuple(r) for r in sorted(robots.robots_signals(docs).collect())] == [
        ("a", True, None, False, "reference"), ("b", None, None, None, None), ("c", None, None, None, None)]


def test_votes(spark):
    texts = ['{"eligibleForFilipinos": true, "category": "tech", "tags": ["a","b","c","d","e","f"], "employmentType": "contract"}',
             'Sure! {"eligibleForFilipinos": false, "reason": "US"} bye', '```json\n{"eligibleForFilipinos": true}\n```', '{"eligibleForFilipinos": "true"}', "nothing", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, response string")
    out = sorted(cleaning.clean_votes(df, max_tags=5).select("i", "available", "eligible", "reason", "category", F.size("tags")).collect())
    assert [tuple(r)[1:] for r in out] == [
        (True, True, "AI classified", "tech", 5), (True, False, "US", "other", 0), (True, True, "AI classified", "other", 0),
        (False, None, "AI classified", "other", 0), (False, None, "AI classified", "other", 0), (False, None, "AI classified", "other", 0)]
