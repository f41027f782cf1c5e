"""Comparison SQL fragments for text, URL and geographic rules."""

from __future__ import annotations

from listingspark import values as V

from .registry import in_list, literal, pattern

SPACE = "[\\s\\x0B\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
URL = r"(?is)^(https?)://(?:([^/?#@]*)@)?([^/?#:]+)(?::([0-9]+))?([^?#]*)([?][^#]*)?(#.*)?$"


def trim(e: str) -> str:
    return f"regexp_replace({e}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def squeeze(e: str) -> str:
    return trim(f"regexp_replace({e}, '{SPACE}+', ' ', 'g')")


def no_tags(e: str, by: str = " ") -> str:
    return f"regexp_replace({e}, '<[^>]*>', '{by}', 'g')"


def first(e: str, tokens: list[str], close: bool = True) -> str:
    """First word hit or NULL."""
    return f"nullif(regexp_extract({e}, {pattern(tokens, close)}, 1, 'i'), '')"


def hits(e: str, tokens: list[str], close: bool = True) -> str:
    return f"regexp_matches({e}, {pattern(tokens, close)}, 'i')"


def any_substring(e: str, alternatives: str) -> str:
    return "(" + " OR ".join(f"contains({e}, {literal(w)})" for w in alternatives.split("|")) + ")"


def url_struct(column: str) -> str:
    """Parts of a URL as a struct, NULL when it is none."""
    t = trim(column)
    part = lambda i: f"regexp_extract({t}, '{URL}', {i})"
    bad = "[\\s<>^|%\"`\\\\{}\\[\\]]"
    return (f"CASE WHEN regexp_matches({t}, '{URL}') AND NOT regexp_matches({part(3)}, '{bad}') THEN {{'scheme': lower({part(1)}), "
            f"'login': {part(2)}, 'host': lower({part(3)}), 'port': CASE WHEN {part(4)} = '' OR {part(4)} = (CASE lower({part(1)}) "
            f"WHEN 'https' THEN '443' ELSE '80' END) THEN '' ELSE ':' || {part(4)} END, 'path': CASE WHEN {part(5)} = '' THEN '/' "
            f"ELSE {part(5)} END, 'tail': {part(6)} || {part(7)}}} END")


def render(u: str) -> str:
    return f"{u}.scheme || '://' || CASE WHEN {u}.login <> '' THEN {u}.login || '@' ELSE '' END || {u}.host || {u}.port || {u}.path || {u}.tail"


def bare_host(u: str) -> str:
    return f"regexp_replace(regexp_replace({u}.host, '\\.$', ''), '^www\\.', '')"


def safe_source(u: str, raw: str) -> str:
    host = f"regexp_replace({u}.host, '\\.$', '')"
    return (f"CASE WHEN contains({u}.host, '.') AND {u}.login = '' AND NOT ({host} = 'localhost' OR {host} LIKE '%.localhost' "
            f"OR regexp_matches({host}, '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$')) AND length({raw}) <= 2048 THEN {render(u)} END")


EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$"


def safe_apply(u: str, raw: str) -> str:
    return (f"CASE WHEN {u} IS NOT NULL THEN CASE WHEN contains({u}.host, '.') THEN {render(u)} END "
            f"WHEN regexp_matches({raw}, '(?i)^mailto:') THEN CASE WHEN regexp_matches(regexp_extract({raw}, '(?i)^mailto:([^?#]*)', 1), "
            f"'{EMAIL}') THEN 'mailto:' || regexp_extract({raw}, '(?i)^mailto:([^?#]*)', 1) END "
            f"WHEN NOT regexp_matches({raw}, '(?i)^[a-z][a-z0-9+.\\-]*:') AND regexp_matches({raw}, '{EMAIL}') THEN 'mailto:' || {raw} END")


def tenant(u: str) -> str:
    seg = lambda p: f"nullif(lower(regexp_extract({u}.path, '{p}', 1)), '')"
    rows = [("boards.greenhouse.io", "greenhouse", "^/*([^/]+)"), ("boards-api.greenhouse.io", "greenhouse", "(?i)^/*v1/+boards/+([^/]+)"),
            ("jobs.lever.co", "lever", "^/*([^/]+)"), ("api.lever.co", "lever", "(?i)^/*v0/+postings/+([^/]+)"),
            ("jobs.ashbyhq.com", "ashby", "^/*([^/]+)"), ("api.ashbyhq.com", "ashby", "(?i)^/*posting-api/+job-board/+([^/]+)")]
    return f"CASE {bare_host(u)} " + " ".join(f"WHEN '{h}' THEN '{n}:' || {seg(p)}" for h, n, p in rows) + " END"


def under(host: str, names: list[str]) -> str:
    return "coalesce(" + " OR ".join(f"{host} = '{n}' OR {host} LIKE '%.{n}'" for n in names) + ", false)"


def attributable(a: str, s: str) -> str:
    return (f"(coalesce({bare_host(a)} = {bare_host(s)}, false) OR coalesce(({tenant(a)}) = ({tenant(s)}), false))")


def trusted_apply(a: str, raw_a: str, s: str, raw_s: str) -> str:
    return (f"CASE WHEN {a} IS NOT NULL AND ({safe_source(s, raw_s)}) IS NOT NULL AND {attributable(a, s)} "
            f"THEN {safe_apply(a, raw_a)} END")


def ats(u: str) -> str:
    """``platform:token`` of a tracking-system URL."""
    h = bare_host(u)
    tok = lambda p, n: f"nullif(nullif(lower(regexp_extract({u}.path, '{p}/([^/]+)', 1)), '{n}'), '')"
    return (f"CASE WHEN {under(h, ['greenhouse.io'])} THEN 'greenhouse:' || {tok('(?:/v[0-9]+/boards)?', 'boards')} "
            f"WHEN {under(h, ['ashbyhq.com'])} THEN 'ashby:' || {tok('(?:/posting-api/job-board)?', 'posting-api')} "
            f"WHEN {under(h, ['lever.co'])} THEN 'lever:' || {tok('(?:/v[0-9]+/postings)?', 'postings')} "
            f"WHEN {under(h, ['breezy.hr'])} THEN 'breezy:' || nullif(regexp_replace({h}, '\\.breezy\\.hr$', ''), 'breezy') "
            f"WHEN {under(h, ['workable.com'])} THEN 'workable:' || {tok('', '')} END")


def language(source: str, key: str, text: str, name: str = "lang_found") -> str:
    """CTE body: ``key`` and the dominant language of ``text`` per row of ``source``."""
    langs = list(V.STOPWORDS)
    cols = []
    for lang, words in V.STOPWORDS.items():
        lst = "[" + ", ".join(literal(w) for w in words) + "]"
        cols.append(f"list_filter(w, lambda x: list_contains({lst}, x)) AS f_{lang}")
    en = "[" + ", ".join(literal(w) for w in V.ENGLISH_STOPWORDS) + "]"
    score = lambda i, c: f"CASE WHEN len(list_distinct(f_{c})) >= 4 AND len(f_{c}) >= 6 THEN len(f_{c}) * 10 + {9 - i} ELSE 0 END"
    best = "greatest(" + ", ".join(score(i, c) for i, c in enumerate(langs)) + ")"
    pick = " ".join(f"WHEN {9 - i} THEN '{c}'" for i, c in enumerate(langs))
    return f"""SELECT {key}, CASE WHEN n >= 8 AND best > 0 AND (best // 10) > en * 1.5 THEN CASE best % 10 {pick} END ELSE 'en' END AS {name}
  FROM (SELECT {key}, len(w) AS n, len(list_filter(w, lambda x: list_contains({en}, x))) AS en, {best} AS best
    FROM (SELECT {key}, w, {', '.join(cols)} FROM (SELECT {key}, list_filter(regexp_split_to_array(lower({text}), '[^{V.WORD_CHARS}]+'),
      lambda x: x <> '') AS w FROM {source})))"""


def gate(source: str, key: str = "id", chars: int | None = None) -> str:
    """CTE list ``g0, g1, g2, gl, gate`` over ``source(title, description, location_raw, tags)``."""
    tags = in_list(V.LANGUAGE_TAGS)
    description = "coalesce(description, '')" if chars is None else f"substr(coalesce(description, ''), 1, {chars})"
    return f"""g0 AS (SELECT {key}, {trim("coalesce(title, '')")} AS t, {trim("coalesce(location_raw, '')")} AS l,
  list_transform(coalesce(tags, []), lambda x: lower(trim(x))) AS tg, description FROM {source}),
g1 AS (SELECT *, t || ' ' || {description} AS x FROM g0),
g2 AS (SELECT *, {first('l', V.PH_POSITIVE)} AS ph_l, {first('x', V.PH_POSITIVE)} AS ph_x,
  coalesce({first('l', V.APAC_POSITIVE)}, {first('t', V.APAC_POSITIVE)}) AS apac, {first('l', V.US_STATES)} AS state,
  {first('l', V.COUNTRIES)} AS country, {first('l', V.CITIES)} AS city, {hits('l', V.WORLDWIDE)} AS world,
  {first('l', V.REGIONS_EXCLUDING_PH)} AS region, coalesce({first('t', V.ONSITE)}, {first('l', V.ONSITE)}) AS onsite,
  coalesce({first('t', V.US_STATES)}, {first('t', V.CITIES)}) AS tplace,
  CASE WHEN NOT list_contains(tg, 'english') THEN list_filter(tg, lambda y: y IN {tags})[1] END AS ltag,
  {first('x', V.RESIDENCE_LOCKS, False)} AS lock_, {hits('x', V.WORLDWIDE)} AS world_x FROM g1),
gl AS ({language('g1', key, 'x', 'lang_x')}),
gate AS (SELECT {key}, CASE WHEN ph_l IS NOT NULL AND country IS NULL AND state IS NULL THEN 'ph_only'
    WHEN ph_l IS NOT NULL OR ph_x IS NOT NULL OR apac IS NOT NULL THEN 'apac_incl_ph' WHEN lang_x <> 'en' OR ltag IS NOT NULL THEN 'country_locked'
    WHEN world THEN 'worldwide' WHEN region IS NOT NULL THEN 'region_excl_ph' WHEN coalesce(state, country, city, onsite, tplace) IS NOT NULL
    THEN 'country_locked' WHEN lock_ IS NOT NULL THEN 'region_excl_ph' WHEN world_x THEN 'worldwide' ELSE 'unknown' END AS gate_scope,
  CASE WHEN ph_l IS NOT NULL OR ph_x IS NOT NULL OR apac IS NOT NULL THEN 'eligible_verified' WHEN lang_x <> 'en' OR ltag IS NOT NULL THEN 'ineligible'
    WHEN world THEN 'eligible_likely' WHEN coalesce(region, state, country, city, onsite, tplace, lock_) IS NOT NULL THEN 'ineligible'
    WHEN world_x THEN 'eligible_likely' ELSE 'unclear' END AS gate_eligibility,
  CASE WHEN ph_l IS NOT NULL AND country IS NULL AND state IS NULL THEN 'Philippines-targeted: location "' || l || '"'
    WHEN ph_l IS NOT NULL THEN 'Philippines named: location "' || l || '"' WHEN ph_x IS NOT NULL THEN 'Philippines named: text mention "' || ph_x || '"'
    WHEN apac IS NOT NULL THEN 'APAC region named: "' || apac || '"' WHEN lang_x <> 'en' THEN 'Non-English posting (detected: ' || lang_x || ')'
    WHEN ltag IS NOT NULL THEN 'Source tagged language: "' || ltag || '"' WHEN world THEN 'Location listed: "' || l || '"'
    WHEN region IS NOT NULL THEN 'Region excludes PH: "' || region || '" in "' || l || '"'
    WHEN coalesce(state, country, city) IS NOT NULL THEN 'Location pinned: "' || coalesce(state, country, city) || '" in "' || l || '"'
    WHEN onsite IS NOT NULL THEN 'Not fully remote: "' || onsite || '" marker' WHEN tplace IS NOT NULL THEN 'Title names location: "' || tplace || '"'
    WHEN lock_ IS NOT NULL THEN 'Residence/authorization lock: "' || lock_ || '"'
    WHEN world_x THEN 'Worldwide/anywhere language in posting' ELSE 'No deterministic geo signal' END AS gate_evidence
  FROM g2 JOIN gl USING ({key}))"""
