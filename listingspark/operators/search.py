"""Ranked full-text search over title, company and tags."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import fill

K1, B, MIN_IDF = 1.2, 0.75, 1e-6
FIELDS = ["title", "company", "tags"]


def _folds() -> tuple[str, str]:
    """Lower-case letters that fold to a plain Latin one, and what they fold to; marks of their own fold to nothing.

    A letter folds when it is decomposed into one of a to z and marks; two that aren't decomposed are added.
    """
    letters = {"ø": "o", "ł": "l"}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        low = chr(code).lower()
        plain, *marks = unicodedata.normalize("NFKD", low)
        if len(low) == 1 and "a" <= plain <= "z" and marks and all(map(unicodedata.combining, marks)):
            letters[low] = plain
    return "".join([*letters, *map(chr, range(0x300, 0x370))]), "".join(letters.values())


_ACCENTED, _PLAIN = _folds()
_FOLD = dict(zip(map(ord, _ACCENTED), [*_PLAIN, *[None] * (len(_ACCENTED) - len(_PLAIN))], strict=True))


def query_tokens(text: str) -> list[str]:
    """The tokens of a text, by the rule that :func:`tokens` has for columns."""
    folded = text.lower().translate(_FOLD)
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in folded).split(" ")


def query_phrases(query: str) -> list[list[str]]:
    """Query words as token phrases; ``e-commerce`` is the phrase ``e commerce``."""
    phrases = [[t for t in query_tokens(word) if t] for word in query.split()]
    return [p for p in phrases if p]


def tokens(c: Column) -> Column:
    folded = F.translate(F.lower(F.coalesce(c, F.lit(""))), _ACCENTED, _PLAIN)
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def with_tokens(listings: DataFrame) -> DataFrame:
    """Add the tokens of each field and their number ``_len``."""
    df = fill(listings, "listings", "tags")
    df = df.withColumns({
        "_title": tokens(F.col("title")), "_company": tokens(F.col("company")),
        "_tags": tokens(F.array_join("tags", " "))})
    return df.withColumn("_len", reduce(lambda a, b: a + b, [F.size(f"_{f}") for f in FIELDS]))


def filtered(category: str | None = None, type: str | None = None, platform: str | None = None) -> Column:
    """Visible listings that pass the filters."""
    hit = F.col("is_active")
    for column, value in (("category", category), ("type", type), ("source_platform", platform)):
        if value is not None:
            hit = hit & (F.col(column) == value)
    return hit


def _spans(column: str, size: int) -> Column:
    """Every run of ``size`` tokens of a field."""
    return F.transform(F.col(column), lambda _, i: F.slice(F.col(column), i + 1, F.lit(size)))


def _frequency(phrase: list[str]) -> Column:
    """How often a phrase occurs, over all fields; it never spans two fields."""
    if len(phrase) == 1:
        per_field = [F.size(F.filter(f"_{f}", lambda t: t == phrase[0])) for f in FIELDS]
    else:
        wanted = F.array(*[F.lit(t) for t in phrase])
        per_field = [F.size(F.filter(_spans(f"_{f}", len(phrase)), lambda s: s == wanted)) for f in FIELDS]
    return reduce(lambda a, b: a + b, per_field)


def _score(frequencies: list[Column], found: list[Column], total: Column, average: Column, length: Column) -> Column:
    parts = []
    for tf, df_ in zip(frequencies, found):
        idf = F.greatest(F.log((total - df_ + 0.5) / (df_ + 0.5)), F.lit(MIN_IDF))
        parts.append(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average)))
    return reduce(lambda a, b: a + b, parts)


def matches(listings: DataFrame, query: str, category: str | None = None, type: str | None = None,
            platform: str | None = None) -> DataFrame:
    """Visible listings that hold every query phrase, with their BM25 ``score``.

    Statistics cover all rows; they are one aggregate row and enter as scalar subqueries.  The listing
    side is a single scan without a shuffle.
    """
    phrases = query_phrases(query)
    df = with_tokens(listings)
    df = df.withColumns({f"_tf{i}": _frequency(p) for i, p in enumerate(phrases)})
    if not phrases:
        return df.where(F.lit(False)).withColumn("score", F.lit(0.0)).drop(*[c for c in df.columns if c.startswith("_")])
    names = [f"_tf{i}" for i in range(len(phrases))]
    stats = df.agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.avg("_len").alias("avg"),
        *[F.count_if(F.col(n) > 0).alias(f"df{n}") for n in names])).scalar()
    hit = filtered(category, type, platform)
    for n in names:
        hit = hit & (F.col(n) > 0)
    scored = df.where(hit).withColumn("_st", stats)
    st = F.col("_st")
    score = _score([F.col(n) for n in names], [st[f"df{n}"] for n in names], st["n"], st["avg"], F.col("_len"))
    return scored.withColumn("score", score).drop(*[c for c in scored.columns if c.startswith("_")])


def search(listings: DataFrame, query: str, size: int = 30, page: int = 1, **filters) -> DataFrame:
    """H3: one page of ranked hits; equal scores are ordered by id."""
    return matches(listings, query, **filters).orderBy(F.desc(F.round("score", 9)), "id").offset(
        size * (page - 1)).limit(size)


def search_total(listings: DataFrame, query: str, **filters) -> DataFrame:
    """H3: number of hits."""
    return matches(listings, query, **filters).agg(F.count(F.lit(1)).alias("total"))
