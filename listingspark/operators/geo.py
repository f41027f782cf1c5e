"""Geographic eligibility: language (C1), gate (C2) and landing-page scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import values as V
from ..functions import text as T
from ..functions.lang import with_language
from ..functions.regex import first_match, hits, trim, words
from ..schemas import fill
from ..stages import once, once_sql

PH, APAC, WORLD = words(V.PH_POSITIVE), words(V.APAC_POSITIVE), words(V.WORLDWIDE)
COUNTRY, STATE, CITY = words(V.COUNTRIES), words(V.US_STATES), words(V.CITIES)
REGION, ONSITE = words(V.REGIONS_EXCLUDING_PH), words(V.ONSITE)
LOCK = words(V.RESIDENCE_LOCKS, close=False)
PAGE_MIN = 200


def detect_language(df: DataFrame, col: str, name: str = "language") -> DataFrame:
    """Dominant language of a text column."""
    return with_language(df, F.coalesce(F.col(col), F.lit("")), name)


def _quoted(head: str, value: Column, tail: str = '"') -> Column:
    return F.concat(F.lit(head), value, F.lit(tail))


def geo_gate(df: DataFrame, chars: int | None = None, evidence_chars: int | None = None) -> DataFrame:
    """Add ``gate_scope``, ``gate_eligibility`` and ``gate_evidence``.

    Eight steps, the first that speaks decides.  Every pattern is matched once, in an inner select,
    and the ordered choice reads those hits; patterns over the long text run only for rows that the
    short fields left open.  ``chars`` limits the description and ``evidence_chars`` a quoted phrase;
    by default both are read and kept whole.
    """
    keep = df.columns
    df = fill(df, "listings", "tags", "location_raw", "description")
    df = once(df, {
        "_title": trim(F.coalesce("title", F.lit(""))),
        "_loc": trim(F.coalesce("location_raw", F.lit(""))),
        "_tags": F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: trim(F.lower(t))),
    })
    df = once(df, {"_text": F.concat("_title", F.lit(" "), T.head(F.coalesce("description", F.lit("")), chars))})
    loc, title = F.col("_loc"), F.col("_title")
    df = once(df, {"_low_text": F.lower("_text"), "_low_title": F.lower("_title"), "_low_loc": F.lower("_loc")})
    in_loc = lambda p: first_match(loc, F.col("_low_loc"), p)
    in_title = lambda p: first_match(title, F.col("_low_title"), p)
    in_text = lambda p: first_match(F.col("_text"), F.col("_low_text"), p)
    df = once(df, {
        "_ph_loc": in_loc(PH), "_ph_text": in_text(PH), "_apac": F.coalesce(in_loc(APAC), in_title(APAC)),
        "_state": in_loc(STATE), "_country": in_loc(COUNTRY), "_city": in_loc(CITY),
        "_world": hits(F.col("_low_loc"), WORLD), "_region": in_loc(REGION),
        "_onsite": F.coalesce(in_title(ONSITE), in_loc(ONSITE)), "_title_place": F.coalesce(in_title(STATE), in_title(CITY)),
        "_lang_tag": F.when(~F.array_contains("_tags", "english"), F.try_element_at(
            F.expr(f"filter(_tags, t -> t IN {tuple(V.LANGUAGE_TAGS)})"), F.lit(1))),
    })
    # Texts already decided by a Philippine or Asian mention need no language count.
    open_text = F.expr("CASE WHEN coalesce(_ph_loc, _ph_text, _apac) IS NOT NULL THEN '' ELSE _low_text END")
    df = with_language(df, open_text, "_lang")
    df = once_sql(df, {"_place": "coalesce(_state, _country, _city)"})
    df = once_sql(df, {"_short": f"CASE {' '.join(map(_when, SHORT_RULES))} END"})
    df = once(df, {"_lock": F.when(F.col("_short").isNull(), in_text(LOCK)),
                   "_world_text": F.col("_short").isNull() & hits(F.col("_low_text"), WORLD)})
    rest = f"CASE {' '.join(map(_when, long_rules(evidence_chars)))} END"
    return df.selectExpr(*[f"`{c}`" for c in keep],
                         f"inline(array(coalesce(_short, {rest}))) AS (gate_scope, gate_eligibility, gate_evidence)")


# (test, scope, eligibility, evidence); the first test that holds decides.
SHORT_RULES = [
    ("_ph_loc IS NOT NULL AND _country IS NULL AND _state IS NULL", "ph_only", "eligible_verified",
     """'Philippines-targeted: location "', _loc, '"'"""),
    ("_ph_loc IS NOT NULL", "apac_incl_ph", "eligible_verified", """'Philippines named: location "', _loc, '"'"""),
    ("_ph_text IS NOT NULL", "apac_incl_ph", "eligible_verified", """'Philippines named: text mention "', _ph_text, '"'"""),
    ("_apac IS NOT NULL", "apac_incl_ph", "eligible_verified", """'APAC region named: "', _apac, '"'"""),
    ("_lang <> 'en'", "country_locked", "ineligible", "'Non-English posting (detected: ', _lang, ')'"),
    ("_lang_tag IS NOT NULL", "country_locked", "ineligible", """'Source tagged language: "', _lang_tag, '"'"""),
    ("_world", "worldwide", "eligible_likely", """'Location listed: "', _loc, '"'"""),
    ("_region IS NOT NULL", "region_excl_ph", "ineligible", """'Region excludes PH: "', _region, '" in "', _loc, '"'"""),
    ("_place IS NOT NULL", "country_locked", "ineligible", """'Location pinned: "', _place, '" in "', _loc, '"'"""),
    ("_onsite IS NOT NULL", "country_locked", "ineligible", """'Not fully remote: "', _onsite, '" marker'"""),
    ("_title_place IS NOT NULL", "country_locked", "ineligible", """'Title names location: "', _title_place, '"'"""),
]


def long_rules(evidence_chars: int | None) -> list[tuple[str, str, str, str]]:
    lock = "_lock" if evidence_chars is None else f"substring(_lock, 1, {evidence_chars})"
    return [
        ("_lock IS NOT NULL", "region_excl_ph", "ineligible", f"""'Residence/authorization lock: "', {lock}, '"'"""),
        ("_world_text", "worldwide", "eligible_likely", "'Worldwide/anywhere language in posting'"),
        ("true", "unknown", "unclear", "'No deterministic geo signal'"),
    ]


def _when(rule: tuple[str, str, str, str]) -> str:
    test, scope, eligibility, evidence = rule
    return (f"WHEN {test} THEN named_struct('scope', '{scope}', 'eligibility', '{eligibility}', "
            f"'evidence', concat({evidence}))")


def scan_landing_pages(pages: DataFrame, html: str = "html", chars: int | None = None, lock_chars: int | None = None,
                       min_chars: int = PAGE_MIN) -> DataFrame:
    """Add ``geo_lock``: why a page is closed to Philippine applicants, NULL when nothing says so.

    A page with fewer than ``min_chars`` visible characters says too little to be judged.  ``chars`` limits
    the visible text and ``lock_chars`` the quoted phrase; by default both are whole.
    """
    df = once(pages, {"_visible": T.head(T.strip_markup(F.coalesce(F.col(html), F.lit("")), "page"), chars)})
    df = once(df, {"_low": F.lower("_visible")})
    df = once(df, {"_open": (F.length("_visible") >= min_chars) & ~hits(F.col("_low"), PH)})
    df = with_language(df, F.when(F.col("_open"), F.col("_low")).otherwise(""), "_lang")
    lock = T.head(first_match(F.col("_visible"), F.col("_low"), LOCK, 0), lock_chars)
    return once(df, {"geo_lock": F.when(F.col("_open"), F.when(
        F.col("_lang") != "en", _quoted("Landing page is non-English (detected: ", F.col("_lang"), ")")
    ).otherwise(_quoted('Landing page states: "', lock)))}).drop("_visible", "_low", "_open", "_lang")
