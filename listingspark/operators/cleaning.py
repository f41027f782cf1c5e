"""Table-cleaning jobs N1-N6: each is one pass over the table, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import values as V
from ..functions import text as T, urls as U
from ..functions.regex import blank_to_null, text_or_null, trim
from ..functions.times import effective_at, parse_time, EFFECTIVE_ORDERS
from ..schemas import fill
from ..stages import once


def clean_text(df: DataFrame, cols: list[str], variant: str) -> DataFrame:
    """Markup, entities and encoding of the named columns; what ends up empty becomes NULL."""
    return df.withColumns({c: blank_to_null(T.strip_markup(F.col(c), variant)) for c in cols})


def normalize_times(df: DataFrame, cols: list[str]) -> DataFrame:
    """Date text columns to UTC timestamps; what is no date becomes NULL."""
    types = dict(df.dtypes)
    return df.withColumns({
        c: parse_time(F.col(c)) if types[c] == "string" else F.col(c).cast("timestamp") for c in cols})


def with_effective_dates(df: DataFrame) -> DataFrame:
    """The five effective dates of a listing as ``effective_<order>`` columns."""
    df = fill(df, "listings", "updated_at")
    return df.withColumns({f"effective_{o}": effective_at(o) for o in EFFECTIVE_ORDERS})


def sanitize_urls(df: DataFrame) -> DataFrame:
    """Safe source and apply addresses with their host and tracking tenant.

    ``source_url`` is NULL when unsafe.  ``application_url`` falls back to the source; ``quarantined``
    marks rows whose own apply link was refused.
    """
    df = U.with_url(U.with_url(df, "source_url", "_src"), "application_url", "_app")
    src, app = U.Url("_src"), U.Url("_app")
    df = once(df, {"_safe": U.safe_source(src, F.col("source_url"))})
    df = once(df, {
        "_trusted": F.when(F.col("_safe").isNotNull() & app.known & U.attributable(app, src),
                           U.safe_apply(app, F.col("application_url"))),
        "_had": F.coalesce(F.col("application_url") != "", F.lit(False)),
    })
    # Steps of their own: together their generated code is too long for the JVM to compile.
    df = once(df, {"_trusted_source": F.coalesce(U.is_trusted_source(src), F.lit(False))})
    df = once(df, {"_token": U.ats_token(src)})
    df = once(df, {"_platform": F.when(F.col("_token").isNotNull(), U.ats_platform(src))})
    return U.drop_url(df.withColumns({
        "source_url": F.col("_safe"),
        "application_url": F.when(F.col("_safe").isNotNull(), F.coalesce("_trusted", "_safe")),
        "quarantined": F.col("_safe").isNotNull() & F.col("_had") & F.col("_trusted").isNull(),
        "host": U.host_of(src),
        "trusted_source": F.col("_trusted_source"),
        "ats_platform": F.col("_platform"),
        "ats_token": F.col("_token"),
    }).drop("_safe", "_trusted", "_had", "_trusted_source", "_token", "_platform"), "_src", "_app")


def description_key(chars: int | None = None):
    """Duplicate key of title and description, or its first ``chars``."""
    return F.sha2(F.concat("title", T.head(F.coalesce("description", F.lit("")), chars)), 256)


def add_keys(df: DataFrame, chars: int | None = None) -> DataFrame:
    """Duplicate keys of a listing and the canonical company name; the key takes the whole description or ``chars`` of it."""
    return df.withColumns({
        "content_hash": F.sha2(F.concat_ws("::", "title", "source_url"), 256),
        "description_hash": description_key(chars),
        "company_key": T.company_key(F.col("company")),
    })


def enrich_columns(df: DataFrame) -> DataFrame:
    """Company split, relevance, categories, niche and excerpt derived from the listing text."""
    df = fill(df, "listings", "tags", "type", "experience_level")
    split = T.split_company(trim(F.col("title")), text_or_null(F.col("company")))
    df = df.select(*[c for c in df.columns if c not in ("title", "company")], F.inline(F.array(split)))
    title, body, lowered = F.col("title"), F.col("description"), F.col("_lowered")
    df = once(df, {"_lowered": T.whole_text(title, body)})
    df = once(df, {"guessed_category": T.heuristic_category(lowered)})
    return df.withColumns({
        "is_placeholder": T.is_placeholder_title(title),
        "is_relevant": T.is_relevant_role(title, body),
        "geo_restricted": T.is_geo_restricted(lowered),
        "local_only": T.is_local_only(lowered),
        "board_category": T.board_category(title, F.col("tags"), F.col("category")),
        "guessed_tags": T.heuristic_tags(F.col("guessed_category")),
        "niche": T.niche_of(F.col("category")),
        "excerpt": T.excerpt(body, F.col("source_platform")),
        "quality_company": T.is_quality_company(F.col("company")),
        "type": T.one_of(F.col("type"), V.JOB_TYPES, "freelance"),
        "experience_level": T.one_of(F.col("experience_level"), V.EXPERIENCE_LEVELS),
    }).drop("_lowered")


def clean_votes(raw: DataFrame, text_col: str = "response", max_tags: int | None = None) -> DataFrame:
    """Typed vote table from free model text.

    The JSON object is the whole text or its outermost ``{...}``.  A text without an eligibility
    boolean stays unavailable, so nothing is ever published on it.
    All tags are kept unless ``max_tags`` limits them.
    """
    body = trim(F.col(text_col))
    body = trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(body, "^```json", ""), "^```", ""), "```$", ""))
    whole = F.try_parse_json(body)
    span = F.try_parse_json(F.nullif(F.regexp_extract(body, r"(?s)\{.*\}", 0), F.lit("")))
    df = once(raw, {"_v": F.coalesce(whole, span)})

    def typed(field: str, kind: str):
        return F.when(F.schema_of_variant(F.try_variant_get("_v", f"$.{field}", "variant")) == kind,
                      F.try_variant_get("_v", f"$.{field}", kind.lower()))

    eligible = typed("eligibleForFilipinos", "BOOLEAN")
    said = F.coalesce(F.try_variant_get("_v", "$.tags", "array<string>"), F.array().cast("array<string>"))
    tags = F.filter(said if max_tags is None else F.slice(said, 1, max_tags), lambda t: t.isNotNull())
    return df.withColumns({
        "available": eligible.isNotNull(),
        "eligible": eligible,
        "reason": F.coalesce(blank_to_null(typed("reason", "STRING")), F.lit("AI classified")),
        "category": T.one_of(typed("category", "STRING"), V.VOTE_CATEGORIES, "other"),
        "tags": tags,
        "pay_range": typed("payRange", "STRING"),
        "client_timezone": typed("clientTimezone", "STRING"),
        "application_url": typed("applicationUrl", "STRING"),
        "employment_type": T.one_of(typed("employmentType", "STRING"), V.VOTE_EMPLOYMENT),
        "experience_level": T.one_of(typed("experienceLevel", "STRING"), V.EXPERIENCE_LEVELS),
        "company_name": typed("companyName", "STRING"),
    }).drop("_v", text_col)
