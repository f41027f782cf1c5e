"""Document fingerprints by winnowing, in built-in functions alone.

A text's words (runs of anything but ASCII white space) are hashed; polynomial hashes of every ``k`` words
are composed by doubling, as a rolling hash would give them; of every ``w`` consecutive hashes the least is
chosen, of equal ones the rightmost, and each choice is kept once with its position.  Any run of
``w + k - 1`` words that two texts share is therefore found by both.  A hash and its position are one
integer, ``hash << 32 | 4294967295 - position``, so the least integer is the rightmost least hash.

``k`` and ``w`` are powers of two.  A text of fewer than ``k`` words has one hash of them all; a text without
words, null text included, has none.  Likeness is the share of common hashes; two texts without any are alike.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, functions as F

from listingspark.stages import once_sql

K, W = 4, 8
_P = (1 << 31) - 1
_BASE = 1_000_003
_LOW = (1 << 32) - 1
_SPACE = r"[\\x20\\x09-\\x0D]+"


def winnow(df: DataFrame, text: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """Add ``out``: the chosen hashes with their positions, packed, in order of position."""
    if k & (k - 1) or w & (w - 1) or k < 1 or w < 1:
        raise ValueError("k and w must be powers of two")
    pair = lambda a, by, body: f"zip_with(slice({a}, 1, size({a}) - {by}), slice({a}, {by} + 1, size({a}) - {by}), (x, y) -> {body})"
    df = once_sql(df, {"_g": f"transform(array_remove(split(coalesce({text}, ''), '{_SPACE}'), ''), w -> pmod(xxhash64(w), {_P}L))"})
    power, span = _BASE, 1
    short = f"array(aggregate(_g, 0L, (a, x) -> (a * {_BASE}L + x) % {_P}L))"
    first = True
    while span < k:
        step = pair("_g", span, f"(x * {power}L + y) % {_P}L")
        # Fewer than k words: one hash of them all, which later steps leave as it is.
        step = f"IF(size(_g) = 0, _g, IF(size(_g) < {k}, {short}, {step}))" if first else f"IF(size(_g) <= {span}, _g, {step})"
        df = once_sql(df, {"_h": step}).drop("_g").withColumnRenamed("_h", "_g")
        power, span, first = power * power % _P, span * 2, False
    df = once_sql(df, {"_h": f"transform(_g, (x, i) -> shiftleft(x, 32) | ({_LOW}L - i))"}).drop("_g").withColumnRenamed("_h", "_g")
    span = 1
    while span < w:
        step = f"IF(size(_g) = 0, _g, IF(size(_g) <= {span}, array(array_min(_g)), {pair('_g', span, 'least(x, y)')}))"
        df = once_sql(df, {"_h": step}).drop("_g").withColumnRenamed("_h", "_g")
        span *= 2
    return once_sql(df, {out: "array_distinct(_g)"}).drop("_g")


def hashes(chosen: str) -> str:
    """SQL of the set of hashes of a fingerprint."""
    return f"array_distinct(transform({chosen}, x -> shiftright(x, 32)))"


def digest(chosen: str) -> str:
    """SQL of a fingerprint as text: SHA-256 of its hashes and positions."""
    return f"sha2(array_join(transform({chosen}, x -> CAST(x AS string)), ','), 256)"


def likeness(a: str, b: str) -> str:
    """SQL of the share of common hashes of two sets."""
    return f"IF(size({a}) + size({b}) = 0, 1D, size(array_intersect({a}, {b})) / CAST(size(array_union({a}, {b})) AS double))"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """``doc_id, hash, position``: one row per chosen hash of each document."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("_text"))
    chosen = winnow(rows, "_text", "_chosen", k, w).select("doc_id", F.explode("_chosen").alias("_x"))
    return chosen.select("doc_id", F.shiftright("_x", 32).alias("hash"), (F.lit(_LOW) - F.col("_x").bitwiseAND(F.lit(_LOW))).alias("position"))


def _with_next(rows: DataFrame, carried: list[str]) -> DataFrame:
    """Add ``next``: ``carried`` of the next row in descending order of ``doc_id`` (rows without one last, equal
    ones by text; after the last row comes the first).

    Rows are dealt over ranges of the id: 64 quantiles, each cut evenly.  The first row of each range goes to
    the range before it as well, as a guest that comes last there, so one shuffle of the texts is enough.
    """
    spark = rows.sparkSession
    parts = max(1, ceil(4 * int(spark.conf.get("spark.sql.shuffle.partitions")) / 64))
    marks = rows.agg(F.percentile_approx("doc_id", [i / 64 for i in range(65)], 10_000).alias("q")).first().q
    if marks:
        marks = sorted(set(marks))
        low = ", ".join(f"{m}L" for m in marks)
        at = f"greatest(size(filter(array({low}), m -> m <= doc_id)) - 1, 0)"
        range_of = f"IF(doc_id IS NULL, -1L, {at} * {parts}L + CAST(floor({parts}D * greatest(0D, doc_id - array({low})[{at}]) / greatest(1D, (array({low}, {marks[-1]}L)[{at} + 1] - CAST(array({low})[{at}] AS double)))) AS long))"
        range_of = f"least({range_of}, IF(doc_id IS NULL, -1L, ({at} + 1) * {parts}L - 1))"
    else:
        range_of = "-1L"
    rows = rows.withColumn("_range", F.expr(range_of))
    heads = sorted((r._range, r.head) for r in rows.groupBy("_range").agg(F.max("doc_id").alias("head")).collect())
    values = [f"({heads[i][1] if heads[i][1] is not None else 'NULL'}, {heads[(i + 1) % len(heads)][0]})" for i in range(len(heads))]
    table = spark.sql(f"SELECT CAST(col1 AS bigint) AS head, CAST(col2 AS bigint) AS _to FROM VALUES {', '.join(values) or '(NULL, NULL)'}")
    guests = rows.join(table, rows.doc_id.eqNullSafe(table["head"])).select(*[c for c in rows.columns if c != "_range"], F.col("_to").alias("_range"), F.lit(1).alias("_guest"))
    every = rows.withColumn("_guest", F.lit(0)).unionByName(guests)
    every = winnow(every, "text", "chosen")
    every = every.withColumn("own", F.expr(hashes("chosen"))).withColumn("fingerprint", F.expr(digest("chosen"))).drop("chosen")
    fields = ", ".join(f"'{c}', {c}" for c in carried)
    lead = f"lead(named_struct({fields})) OVER (PARTITION BY _range ORDER BY _guest, doc_id DESC NULLS LAST, text) AS next"
    return every.selectExpr("*", lead).filter("_guest = 0").drop("_guest", "_range")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against its edited text, whose last half is replaced by the beginning of the next document:
    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    A null text is empty.  A single document is its own next.  An empty table gives no rows.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    df = _with_next(rows, ["text", "own"])
    df = once_sql(df, {"n_chars": "CAST(char_length(text) AS long)", "next_text": "coalesce(next.text, '')", "next_own": "coalesce(next.own, array())"})
    edited = "substring(text, 1, CAST(n_chars - n_chars DIV 2 AS int)) || substring(next_text, 1, CAST(n_chars DIV 2 AS int))"
    df = once_sql(df, {"edited": edited}).drop("text", "next_text", "next")
    df = winnow(df, "edited", "chosen")
    df = once_sql(df, {"edited_own": hashes("chosen"), "edited_fingerprint": digest("chosen"), "edited_sha256": "sha2(edited, 256)"})
    return df.selectExpr("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                         f"{likeness('own', 'edited_own')} AS near_edited", f"{likeness('own', 'next_own')} AS near_next")
