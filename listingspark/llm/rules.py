"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Metrics of a text (a null text has no words): words are runs of anything but space, tab, line feed,
vertical tab, form feed and carriage return.

* ``n_words``, ``word_chars`` (code points in words), ``n_symbols`` (characters of ``#*$%&|<>``)
* ``n_lines`` (lines with a word), ``n_dup_lines`` (of these, equal to an earlier line)
* ``n_repeat_words``: words in three-word windows found twice or more in the text, the first included
* ``n_stop_words``: lower-case pieces, cut at white space and ``.,;:``, that are stop words

A rule holds ``least <= 1000 * over / under <= most``, in integers, where ``under`` is not zero.  A text
with fewer than 50 words, or of which windows that repeat hold over half the words, fails before any rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from listingspark.stages import once_sql

# Common words of English, German, French and Spanish running text.
STOP_WORDS = [
    "the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "by", "be", "this", "are", "at", "from",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als",
    "de", "la", "le", "et", "les", "en", "un", "du", "une", "que", "pour", "dans", "qui", "par", "sur", "pas", "au", "avec",
    "el", "y", "los", "se", "las", "del", "por", "con", "no", "una", "su", "para", "al", "es", "lo",
]
MIN_WORDS = 50
MOST_REPEATED = 50  # per cent


@dataclass(frozen=True)
class Rule:
    """1000 * over / under lies between least and most; a missing bound does not bind."""

    name: str
    over: str
    under: str
    least: int | None = None
    most: int | None = None

    def passes(self) -> Column:
        over, under = F.col(self.over) * 1000, F.col(self.under)
        checks = [over >= self.least * under] if self.least is not None else []
        checks += [over <= self.most * under] if self.most is not None else []
        out = checks[0]
        for c in checks[1:]:
            out = out & c
        return out

    def sql(self) -> str:
        parts = [f"1000 * {self.over} >= {self.least} * {self.under}"] if self.least is not None else []
        parts += [f"1000 * {self.over} <= {self.most} * {self.under}"] if self.most is not None else []
        return "(" + " AND ".join(parts) + ")"


RULES = [
    Rule("word_length", "word_chars", "n_words", 2000, 15000),
    Rule("symbols", "n_symbols", "n_words", None, 100),
    Rule("stop_words", "n_stop_words", "n_words", 60),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 450),
]

_SPACE = r"[\\x20\\x09-\\x0D]+"
METRICS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words"]
_BITS = 24  # of a packed window: its place; the others are the top bits of its hash
_LOW = (1 << _BITS) - 1


def metrics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the metrics, all long; a kept column with the name of a metric gives way to it."""
    keep = tuple(c for c in keep if c not in METRICS)
    df = docs.select(*[docs[c].alias(f"_k{i}") for i, c in enumerate(keep)], F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"))
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    space = "' \\t\\n\\u000b\\u000c\\r'"
    df = once_sql(df, {
        "_words": f"array_remove(split(_text, '{_SPACE}'), '')",
        "_lines": rf"filter(split(_text, '\\n'), l -> l <> '' AND length(btrim(l, {space})) > 0)",
        "n_stop_words": rf"size(filter(split(lower(_text), '[\\x20\\x09-\\x0D.,;:]+'), w -> w IN ({stop})))",
        "word_chars": f"length(translate(_text, {space}, ''))",
        "n_symbols": "8 * octet_length(_text) - " + " - ".join(f"octet_length(replace(_text, '{s}', ''))" for s in "#*$%&|<>"),
    }).drop("_text")
    df = once_sql(df, {
        "n_words": "size(_words)", "n_lines": "size(_lines)", "n_dup_lines": "size(_lines) - size(array_distinct(_lines))",
        "_grams": "IF(size(_words) < 3, array(), transform(sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])))",
    }).drop("_words", "_lines")
    # Windows packed as hash and place sort next to their equals.
    df = once_sql(df, {"_sorted": f"IF(size(array_distinct(_grams)) = size(_grams), array(), sort_array(transform(_grams, (g, i) -> (g & ~{_LOW}L) | i)))"})
    top = lambda a, b: f"shiftrightunsigned({a} ^ {b}, {_BITS}) = 0"
    gram = lambda x: f"_grams[CAST({x} & {_LOW}L AS int)]"
    same = lambda x, y: f"({top(x, y)} AND {gram(x)} = {gram(y)})"
    df = once_sql(df, {
        "_packed": "filter(_sorted, (x, j) -> (j > 0 AND " + same("x", "_sorted[greatest(j - 1, 0)]") + ") OR (j < size(_sorted) - 1 AND "
                   + same("x", "_sorted[least(j + 1, size(_sorted) - 1)]") + "))",
        # Two different windows whose top bits agree could stand between equals: then compare the whole hashes.
        "_clash": f"exists(sequence(1, greatest(size(_sorted) - 1, 1)), j -> j < size(_sorted) AND {top('_sorted[j]', '_sorted[j - 1]')} AND {gram('_sorted[j]')} <> {gram('_sorted[j - 1]')})",
    })
    df = once_sql(df, {"_at": f"""sort_array(IF(_clash,
        filter(sequence(0L, size(_grams) - 1L), i -> size(filter(_grams, g -> g = _grams[CAST(i AS int)])) > 1),
        transform(_packed, x -> x & {_LOW}L)))"""})
    repeated = "aggregate(transform(_at, (x, j) -> IF(j = 0, 3L, least(3L, x - _at[greatest(j - 1, 0)]))), 0L, (a, x) -> a + x)"
    names = METRICS[:-1]
    return df.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(c).cast("long").alias(c) for c in names],
                     F.expr(repeated).alias("n_repeat_words"))


def judge(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: list[Rule] = RULES) -> DataFrame:
    """Metrics with ``base_failed``, one ``failed_<rule>`` column per rule, and ``kept``.

    Null and empty texts fail; repeated rows are judged alike; an empty table gives no rows.
    """
    made = {"base_failed", "kept", *(f"failed_{r.name}" for r in rules)}
    df = metrics(docs, text_col, tuple(c for c in keep if c not in made))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    failed = [(~r.passes()).alias(f"failed_{r.name}") for r in rules]
    passed = ~base
    for r in rules:
        passed = passed & r.passes()
    return df.select("*", base.alias("base_failed"), *failed, passed.alias("kept"))


def oracle() -> str:
    """The same verdicts over ``documents`` in another engine."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
    len(list_filter(string_split_regex(lower(text), '[\\x20\\x09-\\x0D.,;:]+'), lambda x: x IN ({stop}))) AS n_stop_words,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) t(k) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(n_stop_words AS BIGINT) AS n_stop_words, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND {" AND ".join(r.sql() for r in RULES)} AS kept FROM b"""
