"""Benchmark decontamination: the words of documents that lie inside passages of benchmark items.

ASCII letters are lower-cased; words are runs of ASCII letters, digits and all characters beyond ASCII.  A window is
``window`` consecutive words of an item; an item of fewer words, but not none, is one window.

*Wu-Manber search.*  Words take the place of characters.  Windows are patterns, in one class per number of words.  A
class has a table that says, for each block of two words (one for single words), how far a search may move on when its
place ends in that block: never beyond the next possible occurrence.  Where it may not move, the hash of the last words
selects a bucket of patterns and the hash of the whole place tells whether one of them can be meant; then the
words themselves are compared.  The tables have a fixed size, whatever the number of items: they are made by Spark, one
part per task, joined by least shift and by union, and sent to the tasks.  With very many patterns the shifts get shorter
and the buckets fuller; results don't change.  Texts are searched whole, many places of a text at a time.

*Comparison* is a join of the places that passed the tables with the patterns on their words, salted, since one passage may
be in a third of all documents.  Patterns with the same items form one class of items, found by order-free sums over the
items, so that an item list is made once per set of such classes and not for every document.

Null text has no words.  Empty texts, texts without words and documents without hits have zeros and no items.  Repeated
rows and rows with equal or null ids are answered one by one.  An item id that occurs twice is one item, a null item id
is none, but its words are hit.  Extra columns are not read and may have any names.  Without patterns or documents the
result has no hits, or no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ship, slices, stored, texts

WINDOW = 10
BLOCK = 2  # words that decide a shift
SUFFIX = 4  # words that select a bucket
SHIFT_BITS, BUCKET_BITS, WHOLE_BITS = 20, 22, 24  # sizes of the tables, as powers of two
LANE = 512  # places of a text that one search goes through
SALTS = 16
_UPPER = bytes(range(65, 91))
_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_PLAIN = bytes(b if b in _WORD_BYTES else 0x20 for b in bytes(range(256)).translate(bytes.maketrans(_UPPER, _UPPER.lower())))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def hashes(words: list[bytes]) -> np.ndarray:
    return _mix(np.fromiter(map(crc32, words), np.uint64, len(words)))


def spans(word: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive words, by its first."""
    if len(word) < size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(word) - size + 1, np.uint64)
    for j in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + word[j:j + len(out)]
    return _mix(out)


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


class Tables:
    """Shifts, buckets and whole places of the patterns of one number of words."""

    def __init__(self, size: int):
        self.size, self.block, self.suffix = size, min(BLOCK, size), min(SUFFIX, size)
        self.shift = np.full(1 << SHIFT_BITS, size - self.block + 1, np.uint8)
        self.bucket = np.zeros(1 << BUCKET_BITS - 3, np.uint8)
        self.whole = np.zeros(1 << WHOLE_BITS - 3, np.uint8)

    def add(self, patterns: list[list[bytes]]) -> None:
        word = hashes([w for p in patterns for w in p])
        begin = np.arange(len(patterns)) * self.size
        blocks = _slot(spans(word, self.block), SHIFT_BITS)
        for at in range(self.size - self.block + 1):
            np.minimum.at(self.shift, blocks[begin + at], np.uint8(self.size - self.block - at))
        ends = begin + self.size - self.suffix
        for table, h, bits in ((self.bucket, spans(word, self.suffix)[ends], BUCKET_BITS), (self.whole, spans(word, self.size)[begin], WHOLE_BITS)):
            at = _slot(h, bits)
            np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def parts(self) -> list[bytes]:
        import zstandard

        return [zstandard.compress(t.tobytes(), 1) for t in (self.shift, self.bucket, self.whole)]

    def join(self, parts: list[bytes]) -> Tables:
        import zstandard

        shift, bucket, whole = (np.frombuffer(zstandard.decompress(p), np.uint8) for p in parts)
        np.minimum(self.shift, shift, out=self.shift)
        self.bucket |= bucket
        self.whole |= whole
        return self

    def search(self, word: np.ndarray, first: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Places that may hold a pattern, among ``places`` from each ``first`` on."""
        lanes = -(-places // LANE)
        owner = np.repeat(np.arange(len(first)), lanes)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = first[owner] + inside * LANE
        end = first[owner] + np.minimum((inside + 1) * LANE, places[owner])
        step = self.shift[_slot(spans(word, self.block), SHIFT_BITS)]
        tail = self.size - self.block
        found = []
        while len(at):
            move = step[at + tail].astype(np.int64)
            found.append(at[move == 0])
            at = at + np.maximum(move, 1)
            on = at < end
            at, end = at[on], end[on]
        if not found:
            return np.zeros(0, np.int64)
        at = np.sort(np.concatenate(found))
        h = _slot(spans(word, self.suffix), BUCKET_BITS)[at + self.size - self.suffix]
        at = at[(self.bucket[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1]
        h = _slot(spans(word, self.size), WHOLE_BITS)[at]
        return at[(self.whole[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1]


def patterns_of(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``n_words, pattern, item_id``: the windows of all items, each window of an item once."""
    rows = items.select(items[id_col].cast("string").alias("item_id"), items[text_col].cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sizes, found, items_ = [], [], []
                for item, text in zip(part.column(0).to_pylist(), texts(part.column(1)), strict=True):
                    words = words_of(text)
                    size = min(window, len(words))
                    own = dict.fromkeys(b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)) if size else {}
                    found += own
                    sizes += [size] * len(own)
                    items_ += [item] * len(own)
                yield pa.RecordBatch.from_pydict({"n_words": pa.array(sizes, pa.int32()), "pattern": pa.array(found, pa.binary()).cast(pa.string()), "item_id": pa.array(items_, pa.string())})

    return rows.mapInArrow(cut, "n_words int, pattern string, item_id string").distinct()


def tables_of(patterns: DataFrame) -> dict[int, Tables]:
    """The joined tables of each number of words; at most ``window`` times some 4 MB, before compression."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Tables] = {}
        for batch in batches:
            for part in slices(batch):
                by_size: dict[int, list[list[bytes]]] = {}
                for size, pattern in zip(part.column(0).to_pylist(), texts(part.column(1)), strict=True):
                    by_size.setdefault(size, []).append(pattern.split(b" "))
                for size, own in by_size.items():
                    if size not in made:
                        made[size] = Tables(size)
                    made[size].add(own)
        if made:
            yield _rows(made.values())

    def _rows(made) -> pa.RecordBatch:
        parts = [t.parts() for t in made]
        return pa.RecordBatch.from_pydict({"n_words": pa.array([t.size for t in made], pa.int32()),
                                           **{n: pa.array([p[i] for p in parts], pa.binary()) for i, n in enumerate(("shift", "bucket", "whole"))}})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Tables] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["n_words"] not in made:
                    made[row["n_words"]] = Tables(row["n_words"])
                made[row["n_words"]].join([row["shift"], row["bucket"], row["whole"]])
        if made:
            yield _rows(made.values())

    schema = "n_words int, shift binary, bucket binary, whole binary"
    parts = patterns.select("n_words", "pattern").distinct().mapInArrow(make, schema)
    rows = parts.repartition("n_words").mapInArrow(join, schema).collect()
    made: dict[int, Tables] = {}
    for r in rows:
        made.setdefault(r.n_words, Tables(r.n_words)).join([r.shift, r.bucket, r.whole])
    return made


def _scan(docs: DataFrame, tables: dict[int, Tables]) -> DataFrame:
    """``row_id, doc_id, n_words, found``: the places of each text that passed the tables, by their words."""
    shipped = docs.sparkSession.sparkContext.broadcast({n: t.parts() for n, t in tables.items()})
    place = pa.struct([("n_words", pa.int32()), ("pattern", pa.string()), ("places", pa.list_(pa.int32()))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = {n: Tables(n).join(parts) for n, parts in shipped.value.items()}
        base, done = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for part in slices(batch):
                split = [words_of(t) for t in texts(part.column(1))]
                sizes = np.fromiter(map(len, split), np.int64, len(split))
                words = [w for ws in split for w in ws]
                first = np.cumsum(sizes) - sizes
                word = hashes(words)
                found: list[dict] = [{} for _ in split]
                for n, tables in own.items():
                    rows = np.flatnonzero(sizes >= n)
                    if len(rows):
                        at = tables.search(word, first[rows], sizes[rows] - n + 1)
                        for i, r in zip(at.tolist(), (np.searchsorted(first, at, "right") - 1).tolist(), strict=True):
                            found[r].setdefault((n, b" ".join(words[i:i + n])), []).append(i - int(first[r]))
                ids = np.arange(base + done, base + done + len(split))
                done += len(split)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), part.column(0), pa.array(sizes), pa.array([[{"n_words": n, "pattern": p.decode(), "places": at} for (n, p), at in f.items()] for f in found],
                                                                               pa.list_(place))], names=["row_id", "doc_id", "n_words", "found"])

    return docs.mapInArrow(search, "row_id long, doc_id long, n_words long, found array<struct<n_words:int,pattern:string,places:array<int>>>")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of words that lie inside some occurrence, per text."""
    for batch in batches:
        count, out = [], []
        for hits in batch.column(1).to_pylist():
            begin = np.concatenate([np.array(h["places"], np.int64) for h in hits])
            end = np.concatenate([np.array(h["places"], np.int64) + h["n_words"] for h in hits])
            order = np.argsort(begin, kind="stable")
            begin, end = begin[order], np.maximum.accumulate(end[order])
            new = np.flatnonzero(np.concatenate(([True], begin[1:] > end[:-1])))
            begin, end = begin[new], end[np.append(new[1:], len(end)) - 1]
            count.append(int((end - begin).sum()))
            out.append([{"start": int(a), "length": int(b - a)} for a, b in zip(begin, end, strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), batch.column(2)],
                                         names=["row_id", "n_hit", "spans", "classes"])


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  window: int = WINDOW) -> DataFrame:
    """Per document ``doc_id, n_words, n_hit, spans`` (stretches of hit words)``, n_items, items`` (ids of the items with
    windows in the text, in ascending order as strings)."""
    spark = ship(docs.sparkSession)
    patterns = stored(patterns_of(items, item_col, item_text_col, window), "contamination-patterns")
    scanned = stored(_scan(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), tables_of(patterns)), "contamination-places")

    # Patterns with the same items share a class, named by sums over its items.
    one = F.when(F.col("item_id").isNotNull(), F.xxhash64("item_id", F.lit(1))), F.when(F.col("item_id").isNotNull(), F.xxhash64("item_id", F.lit(2)))
    owned = patterns.groupBy("n_words", "pattern").agg(F.count("item_id").alias("n"), F.bit_xor(one[0]).alias("x"), F.bit_xor(one[1]).alias("y"))
    owned = stored(owned.select("n_words", "pattern", F.concat_ws(" ", "n", "x", "y").alias("class")), "contamination-classes")

    places = scanned.filter(F.size("found") > 0).select("row_id", F.inline("found"))
    places = places.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int"))
    known = owned.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = places.join(known, ["n_words", "pattern", "salt"]).groupBy("row_id").agg(
        F.collect_list(F.struct("n_words", "places")).alias("hits"), F.sort_array(F.collect_set("class")).alias("classes"))
    merged = stored(hits.select("row_id", "hits", "classes").mapInArrow(
        _merge, "row_id long, n_hit long, spans array<struct<start:bigint,length:bigint>>, classes array<string>"), "contamination-hits")

    # Each set of classes that occurs gets its items once.
    sets = merged.select("classes").distinct().withColumn("class", F.explode("classes"))
    models = owned.groupBy("class").agg(F.min(F.struct("n_words", "pattern")).alias("model")).select("class", "model.*")
    listed = models.join(patterns.filter("item_id IS NOT NULL"), ["n_words", "pattern"]).select("class", "item_id")
    items_of = sets.join(listed, "class").select("classes", "item_id").distinct().groupBy("classes").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    # One set may belong to a third of all documents with hits.
    salted = merged.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int"))
    items_of = items_of.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = salted.join(items_of, ["classes", "salt"], "left").select("row_id", "n_hit", "spans", "items")
    found = scanned.select("row_id", "doc_id", "n_words").join(named, "row_id", "left")
    nothing = F.array().cast("array<string>")
    return found.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                        F.coalesce("spans", F.array().cast("array<struct<start:bigint,length:bigint>>")).alias("spans"),
                        F.size(F.coalesce("items", nothing)).cast("long").alias("n_items"), F.coalesce("items", nothing).alias("items"))


def oracle(window: int = WINDOW) -> str:
    """The same by SQL, with every window of every text written out."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    split = f"regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    none = hashlib.sha256(b"").hexdigest()
    return f"""
WITH i AS (SELECT item_id::VARCHAR AS item_id, {split} AS w FROM benchmark),
s AS (SELECT item_id, w, least(len(w), {window}) AS k FROM i WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, k, array_to_string(w[a + 1:a + k], ' ') AS pattern FROM (SELECT *, unnest(range(len(w) - k + 1)) AS a FROM s)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({split}, []) AS w FROM documents),
v AS (SELECT r, k, a, array_to_string(w[a + 1:a + k], ' ') AS pattern FROM (SELECT r, w, k, unnest(range(len(w) - k + 1)) AS a FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k)),
h AS (SELECT r, a, v.k, item_id FROM v JOIN p ON v.k = p.k AND v.pattern = p.pattern),
n AS (SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT DISTINCT r, unnest(range(a, a + k)) AS spot FROM (SELECT DISTINCT r, a, k FROM h)) GROUP BY r),
l AS (SELECT r, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items FROM (SELECT DISTINCT r, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    coalesce(items, '{none}') AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (r) LEFT JOIN l USING (r)"""
