"""URL rules.

A URL is taken apart once per column; every rule reads those parts.  Percent
re-encoding, dot segments and punycode are left as written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import values as V
from ..stages import once, once_sql
from .regex import has_text, trim

URL = r"(?is)^(https?)://(?:([^/?#@]*)@)?([^/?#:]+)(?::([0-9]+))?([^?#]*)([?][^#]*)?(#.*)?$"
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$"
IP_HOST = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"
BAD_HOST = r"[\s<>^|%\"`\\{}\[\]]"
_SEP = "\u0001"
_FIELDS = ["scheme", "user", "host", "port", "path", "query", "fragment"]
MAX_LENGTH = 2048
# Host, vendor and where in the path the tenant stands.
TENANT_PATHS = [
    ("boards.greenhouse.io", "greenhouse", "^/*([^/]+)"),
    ("boards-api.greenhouse.io", "greenhouse", "(?i)^/*v1/+boards/+([^/]+)"),
    ("jobs.lever.co", "lever", "^/*([^/]+)"),
    ("api.lever.co", "lever", "(?i)^/*v0/+postings/+([^/]+)"),
    ("jobs.ashbyhq.com", "ashby", "^/*([^/]+)"),
    ("api.ashbyhq.com", "ashby", "(?i)^/*posting-api/+job-board/+([^/]+)"),
]
# Domain of each tracking system.
ATS_DOMAINS = {"greenhouse": "greenhouse.io", "ashby": "ashbyhq.com", "lever": "lever.co", "breezy": "breezy.hr", "workable": "workable.com"}


class Url:
    """Handle on the parts of one taken-apart URL column; the parts are flat columns, NULL for other text."""

    def __init__(self, name: str) -> None:
        self.name = name

    def __getitem__(self, part: str) -> Column:
        return F.col(f"{self.name}__{part}")

    @property
    def known(self) -> Column:
        return self["host"].isNotNull()

    @property
    def columns(self) -> list[str]:
        return [f"{self.name}__{part}" for part in (*_FIELDS, "bare", "tenant")]


def with_url(df: DataFrame, source: str | Column, name: str) -> DataFrame:
    """Add the parts of an http(s) URL, to be read through ``Url(name)``.

    One regular expression runs per row; the pieces come from splitting its rewrite.
    """
    text = trim(F.col(source) if isinstance(source, str) else source)
    raw = f"{name}__raw"
    df = once(df, {raw: F.split(F.regexp_replace(text, URL, _SEP.join(f"${i}" for i in range(1, 8))), _SEP)})
    part = [f"CASE WHEN {raw}_ok THEN get({raw}, {i}) END" for i in range(len(_FIELDS))]
    df = df.withColumn(f"{raw}_ok", (F.size(raw) == len(_FIELDS)) & ~F.get(F.col(raw), 2).rlike(BAD_HOST))
    default = f"CASE WHEN lower({part[0]}) = 'https' THEN '443' ELSE '80' END"
    df = once_sql(df, {
        f"{name}__scheme": f"lower({part[0]})", f"{name}__user": part[1], f"{name}__host": f"lower({part[2]})",
        f"{name}__port": f"CASE WHEN {part[3]} IN ('', {default}) THEN '' ELSE concat(':', {part[3]}) END",
        f"{name}__path": f"CASE WHEN {part[4]} = '' THEN '/' ELSE {part[4]} END",
        f"{name}__query": part[5], f"{name}__fragment": part[6],
        f"{name}__bare": f"regexp_replace(regexp_replace(lower({part[2]}), '[.]$', ''), '^www[.]', '')"})
    tenants = " ".join(
        f"WHEN '{host}' THEN concat('{vendor}:', nullif(lower(regexp_extract({name}__path, '{path}', 1)), ''))"
        for host, vendor, path in TENANT_PATHS)
    return once_sql(df, {f"{name}__tenant": f"CASE {name}__bare {tenants} END"}).drop(raw, f"{raw}_ok")


def drop_url(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*[c for name in names for c in Url(name).columns])


def render(u: Url) -> Column:
    """Normalised text: lower-case host, no default port, ``/`` for an empty path."""
    login = F.when(u["user"] != "", F.concat(u["user"], F.lit("@"))).otherwise("")
    return F.concat(u["scheme"], F.lit("://"), login, u["host"], u["port"], u["path"], u["query"], u["fragment"])


def host_of(u: Url) -> Column:
    """Host without a trailing dot and without ``www.``."""
    return u["bare"]


def origin_of(u: Url) -> Column:
    return F.concat(u["scheme"], F.lit("://"), u["host"], u["port"])


def safe_source(u: Url, raw: Column) -> Column:
    """Normalised public web address, or NULL."""
    host = F.regexp_replace(u["host"], r"\.$", "")
    local = (host == "localhost") | F.endswith(host, F.lit(".localhost")) | host.rlike(IP_HOST)
    ok = F.contains(u["host"], F.lit(".")) & (u["user"] == "") & ~local & (F.length(trim(raw)) <= MAX_LENGTH)
    return F.when(ok, render(u))


def safe_apply(u: Url, raw: Column) -> Column:
    """Normalised http(s) or mailto target; a bare address becomes mailto."""
    text = trim(raw)
    mailbox = F.regexp_extract(text, r"(?i)^mailto:([^?#]*)", 1)
    has_scheme = text.rlike(r"(?i)^[a-z][a-z0-9+.\-]*:")
    target = (
        F.when(u.known, F.when(F.contains(u["host"], F.lit(".")), render(u)))
        .when(text.rlike("(?i)^mailto:"), F.when(mailbox.rlike(EMAIL), F.concat(F.lit("mailto:"), mailbox)))
        .when(~has_scheme & text.rlike(EMAIL), F.concat(F.lit("mailto:"), text))
    )
    return F.when((text != "") & (F.length(text) <= MAX_LENGTH), target)


def tenant_of(u: Url) -> Column:
    """Applicant-tracking tenant such as ``lever:acme``."""
    return u["tenant"]


def attributable(apply: Url, source: Url) -> Column:
    """Both URLs belong to one host or to one tracking tenant."""
    return F.coalesce(host_of(apply) == host_of(source), F.lit(False)) | F.coalesce(
        tenant_of(apply) == tenant_of(source), F.lit(False))


def trusted_apply(apply: Url, raw_apply: Column, source: Url, raw_source: Column) -> Column:
    """Apply link that may be stored for its source, else NULL; mailto is never trusted."""
    ok = apply.known & safe_source(source, raw_source).isNotNull() & attributable(apply, source)
    return F.when(ok, safe_apply(apply, raw_apply))


def under_host(host: Column, trusted: list[str]) -> Column:
    """Host equals one of ``trusted`` or is below it."""
    test = F.lit(False)
    for name in trusted:
        test = test | (host == name) | F.endswith(host, F.lit("." + name))
    return F.coalesce(test, F.lit(False))


def is_trusted_source(u: Url) -> Column:
    return under_host(host_of(u), V.TRUSTED_HOSTS)


def ats_platform(u: Url) -> Column:
    """Tracking system that a host belongs to, NULL for other sites."""
    name = F
    for platform, domain in ATS_DOMAINS.items():
        name = name.when(under_host(host_of(u), [domain]), platform)
    return name


def ats_token(u: Url) -> Column:
    """Tenant of a tracking-system URL, NULL for other sites and where the path names none."""
    host = host_of(u)

    def token(prefix: str, not_token: str = "") -> Column:
        raw = F.regexp_extract(u["path"], prefix + "/([^/]+)", 1)
        return F.when(~raw.isin("", not_token), F.lower(trim(raw)))

    sub = F.regexp_replace(host, r"\.breezy\.hr$", "")
    tokens = {"greenhouse": token(r"(?:/v\d+/boards)?", "boards"), "ashby": token("(?:/posting-api/job-board)?", "posting-api"),
              "lever": token(r"(?:/v\d+/postings)?", "postings"), "breezy": F.when((sub != "") & (sub != "breezy"), sub), "workable": token("")}
    found = F
    for platform, domain in ATS_DOMAINS.items():
        found = found.when(under_host(host, [domain]), tokens[platform])
    return found


def ats_of(u: Url) -> Column:
    """Struct(platform, token) of a tracking-system URL, NULL for other sites."""
    token = ats_token(u)
    return F.when(token.isNotNull(), F.struct(ats_platform(u).alias("platform"), token.alias("token")))


def ats_url(platform: Column, token: Column, pages: dict[str, str]) -> Column:
    """Endpoint or career page of a tenant from a ``{}`` template per platform."""
    out = None
    for name, template in pages.items():
        head, tail = template.split("{}")
        out = (F if out is None else out).when(platform == name, F.concat(F.lit(head), token, F.lit(tail)))
    return F.when(has_text(token), out)


def check_url(raw: Column) -> Column:
    """URL to probe; https is assumed when no scheme is given."""
    text = trim(raw)
    return F.when(text != "", F.when(text.rlike("(?i)^https?://"), text).otherwise(F.concat(F.lit("https://"), text)))


def on_single_host(u: Url, host: str) -> Column:
    """Canonical https URL of a board that lives on exactly one host."""
    return F.when(u["host"] == host, F.concat(
        F.lit("https://"), u["host"], F.when(u["port"] == ":443", "").otherwise(u["port"]),
        u["path"], u["query"], u["fragment"]))
