"""Regular-expression rendering.

Two portability points decide results.  Word boundaries are ASCII-only (``perú`` therefore has
none at its end unless a letter follows), and white space is the wide set that browsers trim.  Both
are spelled out so that the pattern does not depend on the Java version.

Word lists run over every character of every text, so their patterns are built to fail early: the
first letter is tested before anything else, and texts are lowered once instead of matching
case-insensitively.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BOUNDARY = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
# The ranges in front of ``&&`` rule out a visible ASCII character by two comparisons instead of one per member.
SPACE = "[\\x00-\\x20\\x80-\\uFFFF&&[\\s\\x0B\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]]"


WORD = "[0-9A-Za-z_]"


def words(tokens: list[str], close: bool = True) -> str:
    """Pattern for any of ``tokens`` between word boundaries, over lowered text; group 1 is the hit.

    Every token starts with an ASCII word character.  Behind a word character the boundary means that
    no further one follows; behind any other character it means that one does.
    """
    starts = "".join(sorted({t[0] for t in tokens} if all(t[0].isascii() and t[0].isalnum() for t in tokens)
                            else set("0123456789abcdefghijklmnopqrstuvwxyz")))

    def ended(token: str) -> str:
        if not close:
            return token.replace(r"\b", BOUNDARY)
        word_end = token[-1].isascii() and (token[-1].isalnum() or token[-1] == "_")
        return token + (f"(?!{WORD})" if word_end else f"(?={WORD})")

    return f"(?=[{starts}])(?<!{WORD})({'|'.join(ended(t) for t in tokens)})"


def hits(lowered: Column, pattern: str) -> Column:
    """Does a word pattern occur in a lowered text."""
    return lowered.rlike(pattern)


def first_match(c: Column, lowered: Column, pattern: str, group: int = 1) -> Column:
    """Hit of a word pattern as written in ``c``, NULL when there is none; most texts have none."""
    return F.when(lowered.rlike(pattern), F.nullif(F.regexp_extract(c, "(?iu)" + pattern, group), F.lit("")))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(c: Column) -> Column:
    """Collapse runs of white space to one blank, then trim."""
    return trim(F.regexp_replace(c, f"{SPACE}+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def text_or_null(c: Column) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return blank_to_null(trim(c))


def has_text(c: Column) -> Column:
    return F.coalesce(trim(c) != "", F.lit(False))
