"""Dominant language by stopword counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import values as V
from ..stages import once, once_sql

MIN_WORDS, MIN_HITS, MIN_DISTINCT, OVER_ENGLISH = 8, 6, 4, 1.5


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def with_language(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Add column ``name``: a language code when the text is clearly not English, else ``en``.

    The words are cut down once to the foreign stopwords; the count per language works on that rest.
    """
    lists = V.STOPWORDS
    foreign = sorted({w for words in lists.values() for w in words})
    # Matching the words is several times faster than splitting at the negated class.
    df = once(df, {"_words": F.regexp_extract_all(F.lower(text), F.lit(f"[{V.WORD_CHARS}]+"), F.lit(0))})
    df = once_sql(df, {
        "_n": "size(_words)", "_en": f"size(filter(_words, w -> w IN {_in(V.ENGLISH_STOPWORDS)}))",
        "_stops": f"filter(_words, w -> w IN {_in(foreign)})"})
    mine = {lang: f"filter(_stops, w -> w IN {_in(words)})" for lang, words in lists.items()}
    scores = ", ".join(
        f"struct(size({m}) AS hits, {-rank} AS order, '{lang}' AS lang, size(array_distinct({m})) AS kinds)"
        for rank, (lang, m) in enumerate(mine.items()))
    best = f"array_max(filter(array({scores}), s -> s.kinds >= {MIN_DISTINCT} AND s.hits >= {MIN_HITS}))"
    df = df.selectExpr("*", f"inline(array({best})) AS (_hits, _order, _best, _kinds)")
    verdict = f"CASE WHEN _n >= {MIN_WORDS} AND _hits > _en * {OVER_ENGLISH} THEN _best ELSE 'en' END"
    return df.selectExpr("*", f"{verdict} AS {name}").drop("_words", "_n", "_en", "_stops", "_hits", "_order", "_best", "_kinds")
