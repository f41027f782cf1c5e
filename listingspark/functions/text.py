"""Markup, entity and encoding rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import values as V
from ..stages import let
from .regex import SPACE, hits, squeeze, trim, words

TAG = "<[^>]*>"
# Markup of a visible page that carries no text.
PAGE_DROPS = ["(?is)<script.*?</script>", "(?is)<style.*?</style>", TAG, "(?i)&[a-z#0-9]+;"]


def _character(code: Column) -> Column:
    """One Unicode scalar value as text; empty outside Unicode and for surrogates."""
    valid = (code >= 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("")


def _expand(text: Column, opener: str, digits: str, radix: int) -> Column:
    """Replace every numeric reference in one pass over the pieces between openers."""
    def piece(p: Column) -> Column:
        number = F.regexp_extract(p, f"^({digits}+);", 1)
        # Twelve digits are far beyond Unicode and still fit a long.
        code = F.when(F.length(number) <= 12, F.conv(number, radix, 10).cast("long")).otherwise(F.lit(-1))
        rest = F.regexp_replace(p, f"^{digits}+;", "")
        return F.when(number == "", F.concat(F.lit(opener), p)).otherwise(F.concat(_character(code), rest))

    def joined(parts: Column) -> Column:
        tail = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), piece)
        return F.concat(F.element_at(parts, 1), F.array_join(tail, ""))

    return let(F.split(text, opener), joined)


def decode_entities(c: Column) -> Column:
    """Decimal references, then hexadecimal, then the named ones in fixed order (B1).

    ``&amp;`` goes before the other names, so ``&amp;quot;`` ends as a quote.
    """
    def decoded(text: Column) -> Column:
        out = _expand(text, "&#", "[0-9]", 10)
        for marker in ("&#x", "&#X"):
            out = _expand(out, marker, "[0-9A-Fa-f]", 16)
        for name, char in V.NAMED_ENTITIES:
            out = F.replace(out, F.lit(name), F.lit(char))
        return F.when(F.contains(text, F.lit("&")), out).otherwise(text)

    return let(c, decoded)


def repair_mojibake(c: Column) -> Column:
    """Undo UTF-8 that was read as Latin-1, only when that provably shortens the text.

    Text holding any character above U+00FF is left alone: it cannot have come from Latin-1.
    """
    def repaired(text: Column) -> Column:
        marked = text.rlike("[ÂÃ][\\x{80}-\\x{FF}]") & ~text.rlike("[^\\x{00}-\\x{FF}]")
        decoded = F.try_validate_utf8(F.encode(text, "ISO-8859-1").cast("string"))
        shorter = let(decoded, lambda d: F.when(F.length(d) < F.length(text), d))
        return F.when(marked, F.coalesce(shorter, text)).otherwise(text)

    return let(c, repaired)


def strip_markup(c: Column, variant: str) -> Column:
    """Plain text of a payload field; the four feed families differ (B2)."""
    if variant == "rss":
        out = F.regexp_replace(decode_entities(c), "(?i)&lt;[^&]*&gt;", " ")
        return squeeze(F.regexp_replace(out, TAG, " "))
    if variant == "json":
        return squeeze(F.regexp_replace(decode_entities(repair_mojibake(c)), TAG, " "))
    if variant == "ats":
        return trim(F.regexp_replace(c, TAG, ""))
    if variant == "page":
        for pattern in PAGE_DROPS:
            c = F.regexp_replace(c, pattern, " ")
        return squeeze(c)
    raise ValueError(f"unknown markup variant {variant!r}")


def split_company(title: Column, company: Column) -> Column:
    """``Company: Title`` split when no company is known and the prefix is short."""
    def split(known: Column) -> Column:
        name, text = known["company"], known["title"]
        prefix = F.substring_index(text, ":", 1)
        applies = name.isNull() & F.contains(text, F.lit(":")) & (F.length(prefix) < 40)
        rest = F.substr(text, F.length(prefix) + F.lit(2))
        return F.struct(
            F.when(applies, trim(prefix)).otherwise(name).alias("company"),
            F.when(applies, trim(rest)).otherwise(text).alias("title"))

    return let(F.struct(company.alias("company"), title.alias("title")), split)


def pay_range(low: Column, high: Column) -> Column:
    """Pay text from bounds; NULL when neither is positive."""
    lo, hi = F.coalesce(low, F.lit(0)), F.coalesce(high, F.lit(0))
    return (
        F.when((lo <= 0) & (hi <= 0), F.lit(None).cast("string"))
        .when((lo > 0) & (hi > 0), F.concat(F.lit("USD "), lo.cast("string"), F.lit("-"), hi.cast("string")))
        .otherwise(F.concat(F.lit("USD "), F.when(lo != 0, lo).otherwise(hi).cast("string")))
    )


def head(text: Column, chars: int | None) -> Column:
    """The first ``chars`` characters, or all of a text when there is no limit."""
    return text if chars is None else F.substring(text, 1, chars)


def merge_tags(*lists: Column, cap: int | None = None, normalise: bool = False, distinct: bool = True) -> Column:
    """Concatenate tag lists in order; first occurrence wins."""
    empty = F.array().cast("array<string>")
    tags = F.concat(*[F.coalesce(x, empty) for x in lists])
    if distinct:
        tags = F.array_distinct(tags)
    if normalise:
        tags = F.transform(tags, lambda t: trim(F.lower(t)))
    tags = F.filter(tags, lambda t: t.isNotNull() & (t != ""))
    return F.slice(tags, 1, cap) if cap else tags


def is_placeholder_title(title: Column) -> Column:
    return trim(F.lower(title)).isin(V.PLACEHOLDER_TITLES)


def is_relevant_role(title: Column, description: Column, chars: int | None = None) -> Column:
    """A role the board carries, judged on the title and the description, or its first ``chars``."""
    text = F.lower(F.concat(title, F.lit(" "), head(F.coalesce(description, F.lit("")), chars)))
    return let(text, lambda t: hits(t, words(V.RELEVANT_ROLES)) & ~hits(t, words(V.PHYSICAL_ROLES)))


def company_key(name: Column) -> Column:
    """Canonical company name: lower case, single blanks."""
    return squeeze(F.lower(name))


def is_quality_company(name: Column) -> Column:
    """Specific enough to be a company: not a placeholder, not one bare generic word."""
    return F.coalesce(let(company_key(name), lambda key: (
        (F.length(key) >= 3) & ~key.isin(V.NAME_BLOCKLIST) & key.rlike("[a-z]") & ~key.isin(V.GENERIC_WORDS))), F.lit(False))


def niche_of(category: Column) -> Column:
    return F.when(category == "tech", "tech").otherwise("global-va")


def fold_category(category: Column) -> Column:
    """Vote category folded to a board category."""
    aliases = F.create_map(*[F.lit(x) for pair in V.CATEGORY_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, F.coalesce(category, F.lit(""))), F.lit("other"))


def board_category(title: Column, tags: Column, category: Column) -> Column:
    """Stored category, else the first word family found in title and tags."""
    text = F.lower(F.concat(title, F.lit(" "), F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " ")))

    def guess(lowered: Column) -> Column:
        found = None
        for name, pattern in V.BOARD_CATEGORY_WORDS.items():
            found = (F if found is None else found).when(lowered.rlike(pattern), name)
        return found

    return F.when(category.isNotNull() & (category != "other"), category).otherwise(
        F.coalesce(let(text, guess), category, F.lit("other")))


def heuristic_category(lowered: Column) -> Column:
    """Category guessed from plain substrings when no vote exists."""
    name = None
    for label, (pattern, _) in V.HEURISTIC_CATEGORY_WORDS.items():
        test = F.lit(False)
        for word in pattern.split("|"):
            test = test | F.contains(lowered, F.lit(word))
        name = (F if name is None else name).when(test, label)
    return name.otherwise("other")


def heuristic_tags(category: Column) -> Column:
    """Tags that go with a guessed category."""
    tags = None
    for label, (_, found) in V.HEURISTIC_CATEGORY_WORDS.items():
        tags = (F if tags is None else tags).when(category == label, F.array(*[F.lit(t) for t in found]))
    return tags.otherwise(F.array(F.lit("remote")))


def whole_text(title: Column, description: Column) -> Column:
    """Title and description as one lowered text."""
    return F.lower(F.concat(title, F.lit(" "), F.coalesce(description, F.lit(""))))


def is_geo_restricted(lowered: Column) -> Column:
    """The posting names a country restriction outright."""
    return hits(lowered, words(V.GEO_RESTRICTIONS))


def is_local_only(lowered: Column) -> Column:
    """The posting uses terms of one domestic labour market."""
    return hits(lowered, words(V.LOCAL_ONLY))


def excerpt(description: Column, platform: Column) -> Column:
    """Description shown to readers: allowed platforms only, long text cut at a word."""
    def cut_at_word(head: Column) -> Column:
        last_blank = F.length(head) - F.locate(" ", F.reverse(head))  # zero-based position
        return F.when((F.locate(" ", head) > 0) & (last_blank > 400), F.substring(head, F.lit(1), last_blank)).otherwise(head)

    cut = let(F.regexp_replace(F.substring(description, 1, 500), f"{SPACE}+$", ""), cut_at_word)
    return F.when(platform.isin(V.EXCERPT_PLATFORMS) & (description != ""),
                  F.when(F.length(description) < 300, description).otherwise(cut))


def one_of(c: Column, allowed: list[str], default: str | None = None) -> Column:
    """Value when it belongs to the enumeration, else the default."""
    return F.when(c.isin(allowed), c).otherwise(F.lit(default).cast("string"))
