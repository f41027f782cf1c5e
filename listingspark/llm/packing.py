"""Packing of documents into sequences of a fixed number of tokens.

Full windows of a long document are sequences of their own.  What is left of each document, its rest,
is packed by lengths alone: shallow combinations of two to four lengths that fill a window exactly are
enumerated, non-negative least squares gives how often to repeat each against the histogram of rests,
the counts are rounded to what the histogram holds, and the rests that no combination took are laid
end to end, longest first, and cut at the window borders.  The very last, partly filled window becomes
sequences whose lengths are powers of two, so no padding is left at all.

Only the histogram (at most one row per length below the window) reaches the driver.  A rest finds its
place by its rank among the rests of its length: the rank in its partition, stored with the tokens,
plus the counts of the partitions before it.

A null text is empty and has the end token alone.  Repeated rows are packed as often as they come;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import documents, ship, slices, stored, texts
from .tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenize(docs: DataFrame, tokenizer: str, window: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Per document: token count, checksums of its full windows, its rest (ids, length, checksum), and its place
    in its partition among rests of that length and among full windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        end, wide = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        seen, full = Counter(), 0
        for batch in batches:
            out = {k: [] for k in ("n", "window_crcs", "rest", "rest_ids", "rest_crc", "rank", "first_full")}
            for coded in chain.from_iterable(enc.encode_all(texts(p.column(1))) for p in slices(batch, 1 << 20)):
                ids = coded + end
                n = len(ids) // wide
                as_four = np.frombuffer(ids, enc.dtype).astype("<u4")
                cut = n - n % window
                out["n"].append(n)
                out["window_crcs"].append([zlib.crc32(as_four[i:i + window]) for i in range(0, cut, window)])
                out["rest"].append(n - cut)
                out["rest_ids"].append(ids[cut * wide:])
                out["rest_crc"].append(zlib.crc32(as_four[cut:]))
                out["rank"].append(seen[n - cut])
                out["first_full"].append(full)
                seen[n - cut] += 1
                full += cut // window
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * batch.num_rows, pa.int32()), *(pa.array(out[k], pa.list_(pa.int64()) if k == "window_crcs" else pa.binary() if k == "rest_ids" else pa.int64()) for k in out)],
                names=["doc_id", "part", *out])

    return documents(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, part int, n long, window_crcs array<long>, rest long, rest_ids binary, rest_crc long, rank long, first_full long")


def combinations(histogram: np.ndarray, window: int, wide: tuple[int, int] = (128, 24)) -> np.ndarray:
    """Rows of up to four lengths, zero-filled, that sum to the window and occur in the histogram.

    All pairs; triples and quadruples of which all but one length are among the ``wide`` lengths with most tokens.
    """
    have = histogram > 0
    lengths = np.flatnonzero(have)
    found = [np.column_stack((a, window - a, 0 * a, 0 * a)) for a in (lengths[(lengths <= window - lengths) & have[window - lengths]],)]
    heavy = lengths[np.argsort(-histogram[lengths] * lengths, kind="stable")]
    for depth, n in ((2, wide[0]), (3, wide[1])):
        top = np.sort(heavy[:n])
        grid = np.stack(np.meshgrid(*[top] * depth, indexing="ij"), -1).reshape(-1, depth)
        grid = grid[(np.diff(grid, axis=1) >= 0).all(1)]
        last = window - grid.sum(1)
        ok = (last > 0) & have[np.clip(last, 0, window - 1)]
        rows = np.zeros((ok.sum(), 4), np.int64)
        rows[:, :depth], rows[:, depth] = grid[ok], last[ok]
        found.append(rows)
    return np.unique(np.sort(np.concatenate(found), axis=1), axis=0)


def repeats(histogram: np.ndarray, combos: np.ndarray, rounds: int = 300) -> np.ndarray:
    """How often to use each combination: non-negative least squares against the histogram, rounded to what it holds."""
    used = combos > 0
    goal = histogram.astype(float)
    goal[0] = 0
    x = np.where(used, goal[combos], np.inf).min(1) / np.maximum(1, np.bincount(combos[used], minlength=len(goal)))[combos].max(1)
    spread = lambda x: np.bincount(combos.ravel(), weights=(x[:, None] * used).ravel(), minlength=len(goal))
    gather = lambda h: (h[combos] * used).sum(1)
    for _ in range(rounds):  # multiplicative updates keep every count non-negative
        x *= gather(goal) / np.maximum(gather(spread(x)), 1e-9)
    left, out = histogram.copy(), np.zeros(len(combos), np.int64)
    for i in np.argsort(-x, kind="stable"):
        need = Counter(combos[i][used[i]].tolist())
        out[i] = min(round(x[i]), *(int(left[k]) // v for k, v in need.items()))
        for k, v in need.items():
            left[k] -= out[i] * v
    return out


def plan(histogram: dict[int, int], window: int) -> dict:
    """Where the rests go: per length the intervals of ranks that combinations take, and where the others begin."""
    counts = np.zeros(window, np.int64)
    for length, n in histogram.items():
        if length:
            counts[length] = n
    combos = combinations(counts, window)
    times = repeats(counts, combos) if len(combos) else np.zeros(0, np.int64)
    used, rows, sequence = np.zeros(window, np.int64), [], 0
    for combo, n in zip(combos.tolist(), times.tolist(), strict=True):
        if not n:
            continue
        offset = 0
        for length in filter(None, combo):
            rows.append((length, used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    rows.sort()
    rest = (counts - used) * np.arange(window)
    begin = np.zeros(window, np.int64)
    begin[::-1] = np.cumsum(rest[::-1]) - rest[::-1]  # longest first
    total = int(rest.sum())
    whole, tail = divmod(total, window)
    sizes = [1 << b for b in range(tail.bit_length() - 1, -1, -1) if tail >> b & 1]
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3], "used": used, "begin": begin,
            "first": sequence, "whole": whole, "tail": np.cumsum([0, *sizes]), "n": sequence + whole + len(sizes), "window": window}


def pieces_of(p: dict, length: int, rank: int) -> list[tuple[int, int, int, int]]:
    """(start in the rest, length, sequence, offset) of each piece of a rest."""
    if rank < p["used"][length]:
        lo, hi = np.searchsorted(p["length"], [length, length + 1])
        i = lo + np.searchsorted(p["rank"][lo:hi], rank, "right") - 1
        return [(0, length, int(p["sequence"][i] + rank - p["rank"][i]), int(p["offset"][i]))]
    out, at = [], int(p["begin"][length] + (rank - p["used"][length]) * length)
    end, window, whole = at + length, p["window"], p["whole"]
    start = 0
    while at < end:
        k = at // window
        if k < whole:
            border, sequence, offset = (k + 1) * window, p["first"] + k, at - k * window
        else:
            inside = at - whole * window
            j = int(np.searchsorted(p["tail"], inside, "right")) - 1
            border, sequence, offset = whole * window + int(p["tail"][j + 1]), p["first"] + whole + j, inside - int(p["tail"][j])
        n = min(end, border) - at
        out.append((start, n, sequence, offset))
        start, at = start + n, at + n
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    spark = ship(docs.sparkSession)
    tokens = stored(tokenize(docs, tokenizer, window, end_id, id_col, text_col), "packing-tokens")
    counts = tokens.groupBy("part", "rest").agg(F.count("*").alias("n"))
    fulls = tokens.groupBy("part").agg(F.sum(F.size("window_crcs")).alias("n")).select("part", F.lit(-1).cast("long").alias("rest"), "n")
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    bases = stored(counts.unionByName(fulls).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "packing-bases")
    histogram = {r.rest: r.n for r in bases.filter("rest >= 0").groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    p = plan(histogram, window)
    placed = (tokens.join(bases.filter("rest >= 0").select("part", "rest", F.col("base").alias("rest_base")), ["part", "rest"])
              .join(bases.filter("rest < 0").select("part", F.col("base").alias("full_base")), ["part"])
              .select("doc_id", "n", "window_crcs", "rest", "rest_ids", "rest_crc", F.col("rank") + F.col("rest_base"), F.col("first_full") + F.col("full_base")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(tokenizer).dtype
        for batch in batches:
            out = []
            for doc, n, crcs, rest, ids, crc, rank, full in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i, c in enumerate(crcs):
                    out.append((doc, i * window, window, c, n, p["n"] + full + i, 0))
                if rest:
                    parts = pieces_of(p, rest, rank)
                    four = np.frombuffer(ids, dtype).astype("<u4") if len(parts) > 1 else None
                    for start, length, sequence, offset in parts:
                        c = crc if four is None else zlib.crc32(four[start:start + length])
                        out.append((doc, len(crcs) * window + start, length, c, n, sequence, offset))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in PIECES.split(", ")])

    return placed.mapInArrow(run, PIECES)
