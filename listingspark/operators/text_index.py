"""Stored positional index over title, company and tags, and ranked search that reads only the blocks it needs.

Listings are sorted by their number of tokens and cut into blocks of like length, the same blocks for all terms.  A
posting row holds one term in one block: the listings that have it, where it stands in them, and ``top``, the greatest
part it can add to a score there (before its rarity counts).  Each file has its rows in the order of term and falling ``top``;
the rows of a term are dealt over a few files.

A page of ``k`` hits first reads the small columns of the query's terms.  A block that holds all terms can't score over
the sum of its tops, weighted by rarity.  The blocks with the highest such bounds are scored; their ``k``-th hit is a
score that other blocks must be able to reach.  Blocks that can't are not read, and per term the least ``top`` that may still
matter is a filter on the scan, which skips row groups.  The rest is scored like the full form in ``search.py``: same
phrases, same statistics over all listings, same filters on the live listings, same order, so the page is the same.

A phrase is an intersection of position lists, each shifted by the term's place in the phrase; a position carries its field,
so no phrase spans two fields.  No group holds more than one block; nothing depends on how common a term is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ship
from .postings import block_postings
from .search import B, FIELDS, K1, MIN_IDF, filtered, query_phrases, with_tokens

BLOCK = 128  # listings; a power of two
SPREAD = 8  # partitions that a term's rows are dealt over
SEEDS = 4  # blocks per block's worth of hits that are scored first
SLACK = 1e-7  # scores are ordered by nine digits


@dataclass(frozen=True)
class TextIndex:
    """``postings(term, block, top, docs, entries)`` and one row of ``corpus(n, average)``."""

    postings: DataFrame
    corpus: DataFrame


def _part(tf: Column, length: Column, average: float) -> Column:
    """What a term adds to a score, before its rarity counts."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_index(listings: DataFrame, path: str, block: int = BLOCK, row_group_bytes: int = 8 << 20) -> TextIndex:
    """Index all listings, inactive ones too, into a new folder.

    The range exchange reads its input twice, to sample it, so it starts from a file of tokens, one text per field.
    """
    if block < 1 or block & (block - 1):
        raise ValueError("block must be a power of two")
    spark = ship(listings.sparkSession)
    texts = [F.array_join(f"_{f}", " ").alias(f) for f in FIELDS]
    rows = _write(with_tokens(listings).select("id", F.col("_len").alias("length"), *texts), f"{path}/tokens")
    corpus = _write(rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("average")), f"{path}/corpus")
    keys = [F.asc("length"), F.asc("id")]
    # Row numbers within a partition have 33 bits of their own, so no block spans two partitions.
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(
        "block", F.shiftright(F.monotonically_increasing_id(), block.bit_length() - 1))
    kinds = dict(placed.dtypes)
    posts = placed.mapInArrow(
        partial(block_postings, fields=FIELDS, average=corpus.first().average or 1.0),
        f"term string, block bigint, top double, docs bigint, entries array<struct<id:{kinds['id']},length:{kinds['length']},places:array<bigint>>>")
    posts.repartition("term", F.pmod("block", F.lit(SPREAD))).sortWithinPartitions(F.asc("term"), F.desc("top"), F.asc("block")).write.option(
        "parquet.block.size", row_group_bytes).parquet(f"{path}/postings")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> TextIndex:
    return TextIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/corpus"))


@dataclass(frozen=True)
class Question:
    """A query with what the index says about its words: rarity per phrase and greatest top per term."""

    phrases: list[list[str]]
    weights: list[float]
    tops: dict[str, float]
    average: float

    @property
    def terms(self) -> list[str]:
        return sorted({t for p in self.phrases for t in p})

    def bound(self, top) -> Column:
        """The score that a block's tops allow: a phrase occurs no more often than its rarest word."""
        parts = [F.least(*[top(t) for t in p]) if len(p) > 1 else top(p[0]) for p in self.phrases]
        return reduce(lambda a, b: a + b, [w * p for w, p in zip(self.weights, parts, strict=True)])

    def least_tops(self, score: float) -> dict[str, float]:
        """Per term the least top with which a block may still reach ``score``."""
        best = [w * min(self.tops[t] for t in p) for w, p in zip(self.weights, self.phrases, strict=True)]
        out = dict.fromkeys(self.terms, 0.0)
        for w, b, p in zip(self.weights, best, self.phrases, strict=True):
            for t in p:
                out[t] = max(out[t], (score - (sum(best) - b)) / w)
        return out


def _ask(index: TextIndex, query: str) -> Question | None:
    """None when no listing can be a hit."""
    phrases = query_phrases(query)
    terms = sorted({t for p in phrases for t in p})
    if not terms:
        return None
    known = {r.term: r for r in index.postings.where(F.col("term").isin(terms)).groupBy("term").agg(
        F.sum("docs").alias("docs"), F.max("top").alias("top")).collect()}
    if len(known) < len(terms):
        return None
    corpus = index.corpus.first()
    tops = {t: known[t].top for t in terms}
    long = {tuple(p) for p in phrases if len(p) > 1}
    found = {(t,): known[t].docs for t in terms}
    for p in sorted(long):
        alone = Question([list(p)], [1.0], tops, corpus.average)
        found[p] = _hits(index, alone, None, None).agg(F.count(F.lit(1)).alias("n")).first().n
    weights = [max(math.log((corpus.n - found[tuple(p)] + 0.5) / (found[tuple(p)] + 0.5)), MIN_IDF) for p in phrases]
    return Question(phrases, weights, tops, corpus.average)


def _blocks(index: TextIndex, q: Question) -> DataFrame:
    """``block, bound`` of the blocks that hold all terms, from the small columns alone."""
    tops = index.postings.where(F.col("term").isin(q.terms)).groupBy("block").agg(
        *[F.max(F.when(F.col("term") == t, F.col("top"))).alias(f"t{i}") for i, t in enumerate(q.terms)])
    names = {t: f"t{i}" for i, t in enumerate(q.terms)}
    return tops.dropna(subset=list(names.values())).select("block", q.bound(lambda t: F.col(names[t])).alias("bound"))


def _hits(index: TextIndex, q: Question, blocks: DataFrame | list[int] | None, score: float | None) -> DataFrame:
    """``id, score`` of the listings with all phrases, in some blocks or all; ``score`` is what a hit must reach."""
    least = q.least_tops(score - SLACK) if score is not None else dict.fromkeys(q.terms, None)
    wanted = reduce(lambda a, b: a | b, [(F.col("term") == t) if c is None else (F.col("term") == t) & (F.col("top") >= c) for t, c in least.items()])
    posts = index.postings.where(wanted)
    if isinstance(blocks, list):
        posts = posts.where(F.col("block").isin(blocks))
    elif blocks is not None:
        posts = posts.join(blocks.select("block"), "block", "left_semi")
    names = {t: f"e{i}" for i, t in enumerate(q.terms)}
    rows = posts.groupBy("block").agg(*[F.max(F.when(F.col("term") == t, F.col("entries"))).alias(n) for t, n in names.items()]).dropna(subset=list(names.values()))
    first, *others = names.values()
    lists = [F.map_from_entries(F.transform(n, lambda e: F.struct(e["id"], e["places"]))).alias(n) for n in others]
    rows = rows.select(*lists, F.explode(first).alias("e"))
    rows = rows.select(F.col("e.id").alias("id"), F.col("e.length").alias("length"), F.col("e.places").alias(first),
                       *[F.element_at(n, F.col("e.id")).alias(n) for n in others]).dropna(subset=others or ["id"])
    frequencies = []
    for p in q.phrases:
        shifted = [F.expr(f"transform({names[t]}, x -> x - {i})") for i, t in enumerate(p)]
        frequencies.append(F.size(reduce(F.array_intersect, shifted)))
    rows = rows.select("id", "length", *[f.cast("double").alias(f"f{i}") for i, f in enumerate(frequencies)])
    rows = rows.where(reduce(lambda a, b: a & b, [F.col(f"f{i}") > 0 for i in range(len(frequencies))]))
    parts = [w * _part(F.col(f"f{i}"), F.col("length"), q.average or 1.0) for i, w in enumerate(q.weights)]
    return rows.select("id", reduce(lambda a, b: a + b, parts).alias("score"))


def _visible(hits: DataFrame, listings: DataFrame, filters: dict) -> DataFrame:
    return listings.where(filtered(**filters)).join(hits, "id")


def reach(index: TextIndex, q: Question, listings: DataFrame, k: int, filters: dict, seeds: int = SEEDS) -> float | None:
    """A score that at least ``k`` visible hits have, found in few blocks; None if no such few blocks are found."""
    blocks = _blocks(index, q)
    want = seeds * -(-k // BLOCK) + seeds
    while want <= max(1024, 4 * k):
        found = [r.block for r in blocks.orderBy(F.desc("bound"), "block").limit(want).collect()]
        best = _visible(_hits(index, q, found, None), listings, filters).select("score").orderBy(F.desc("score")).limit(k)
        scores = best.agg(F.count("score").alias("n"), F.min("score").alias("least")).first()
        if scores.n >= k:
            return scores.least
        if len(found) < want:
            return None  # all blocks were read
        want *= 8
    return None


def _none(listings: DataFrame) -> DataFrame:
    return listings.where(F.lit(False)).withColumn("score", F.lit(0.0))


def search_index(index: TextIndex, listings: DataFrame, query: str, size: int = 30, page: int = 1, **filters) -> DataFrame:
    """H3 on a stored index: the same page of ranked hits as ``search.search``."""
    q = _ask(index, query)
    if q is None:
        return _none(listings)
    least = reach(index, q, listings, size * page, filters)
    blocks = _blocks(index, q)
    if least is not None:
        blocks = blocks.where(F.col("bound") >= least - SLACK)
    hits = _visible(_hits(index, q, blocks if least is not None else None, least), listings, filters)
    return hits.orderBy(F.desc(F.round("score", 9)), "id").offset(size * (page - 1)).limit(size)


def search_index_total(index: TextIndex, listings: DataFrame, query: str, **filters) -> DataFrame:
    """H3 on a stored index: the same number of hits as ``search.search_total``; all blocks that hold the terms are read."""
    q = _ask(index, query)
    hits = _none(listings) if q is None else _visible(_hits(index, q, None, None), listings, filters)
    return hits.agg(F.count(F.lit(1)).alias("total"))


def blocks_read(index: TextIndex, listings: DataFrame, query: str, k: int, **filters) -> tuple[int, int]:
    """How many posting rows a page of ``k`` hits reads, and how many the query's terms have."""
    q = _ask(index, query)
    if q is None:
        return 0, 0
    posts = index.postings.where(F.col("term").isin(q.terms))
    least = reach(index, q, listings, k, filters)
    if least is None:
        return posts.count(), posts.count()
    tops = q.least_tops(least - SLACK)
    kept = reduce(lambda a, b: a | b, [(F.col("term") == t) & (F.col("top") >= c) for t, c in tops.items()])
    blocks = _blocks(index, q).where(F.col("bound") >= least - SLACK)
    return posts.where(kept).join(blocks, "block", "left_semi").count(), posts.count()
