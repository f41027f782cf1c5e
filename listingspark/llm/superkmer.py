"""Substring deduplication: words covered by a window of words that an earlier document has too.

*Super-k-mers.*  A window is ``window`` consecutive words; its minimiser is the least hash among its runs of
``seed`` words, so equal windows have equal minimisers.  Consecutive windows that share a minimiser travel
together as one string of words to the bucket of that minimiser.

*Requests.*  Documents are dealt over batches of some megabytes by a hash of their id.  A batch has for each bucket its distinct
strings once, in sorted order, with the least and the greatest id that holds each,
packed and compressed: a passage in a third of all documents is one entry per batch.  What goes to the buckets of one lane
travels as one message, and lanes are as many as tasks, so messages grow with the batches and not with their square.  Spark takes
the messages of a lane apart and sorts the requests by bucket, outside Python's memory; one bucket is judged at a time.  A minimiser that would fill much of a bucket
(a very common line with a different surrounding each time) is found by counts over all documents first;
its windows travel one by one and are dealt by the hash of the whole window.

*Verdicts.*  A bucket groups its strings by minimiser.  Where different strings meet, their windows are
sorted and equal windows counted exactly, by their words, not by a hash.  It answers each batch with the
least document id of every window found in more than one document.

*Removal.*  The batch makes its strings again, looks up the answers, and drops the covered words.

A window is judged on the input.  Null text has no words.  A row without an id keeps all its words and is no
earlier document.  Rows with equal ids are one document to each other.  An empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import documents, ship, texts

WINDOW = 13
SEED = 3
BATCH_BYTES = 5 << 19  # of texts, before any packing
LONGEST_RUN = 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Runs:
    """Super-k-mers of a batch of texts: for each run its first word, windows, minimiser and row."""

    def __init__(self, rows: list[bytes], window: int, seed: int, skip: np.ndarray, hot: np.ndarray):
        split = [r.split() for r in rows]
        self.words = [w for ws in split for w in ws]
        self.sizes = np.array([len(ws) for ws in split], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.window = window
        n = len(self.words)
        self.joined = b" ".join(self.words)
        self.ends = np.cumsum(np.fromiter(map(len, self.words), np.int64, n) + 1) - 1
        self.begins = np.concatenate(([0], self.ends[:-1] + 1)) if n else np.zeros(0, np.int64)
        self.start = self.count = self.row = np.zeros(0, np.int64)
        self.key = np.zeros(0, np.uint64)
        if n < window:
            return
        word = _mix(np.fromiter(map(crc32, self.words), np.uint64, n))
        grams = n - seed + 1
        gram = np.zeros(grams, np.uint64)
        for j in range(seed):
            gram = gram * np.uint64(0xD6E8FEB86659FD93) + word[j:j + grams]
        least, span, want = _mix(gram), 1, window - seed + 1
        while span < want:
            by = min(span, want - span)
            least = np.minimum(least[:-by], least[by:])
            span += by
        row_of = np.repeat(np.arange(len(rows)), self.sizes)
        ok = np.flatnonzero((row_of[:n - window + 1] == row_of[window - 1:]) & ~skip[row_of[:n - window + 1]])
        if not len(ok):
            return
        key, row = least[ok], row_of[ok]
        alone = np.isin(key, hot) if len(hot) else np.zeros(len(ok), bool)
        new = np.concatenate(([True], (np.diff(ok) != 1) | (key[1:] != key[:-1]) | (row[1:] != row[:-1]) | alone[1:] | alone[:-1]))
        at = np.flatnonzero(new)
        length = np.diff(np.concatenate((at, [len(ok)])))
        if (length > LONGEST_RUN).any():  # periodic text
            parts = -(-length // LONGEST_RUN)
            inside = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            at = np.repeat(at, parts) + inside * LONGEST_RUN
            length = np.minimum(np.repeat(length, parts) - inside * LONGEST_RUN, LONGEST_RUN)
        self.start, self.count, self.row, self.key = ok[at], length, row[at], key[at]
        if len(hot):
            for i in np.flatnonzero(alone[at]).tolist():
                a = int(self.start[i])
                text = self.joined[self.begins[a]:self.ends[a + window - 1]]
                self.key[i] = crc32(text) << 32 | crc32(text[::-1])

    def strings(self) -> list[bytes]:
        joined = self.joined
        return [joined[a:b] for a, b in zip(self.begins[self.start].tolist(), self.ends[self.start + self.count + self.window - 2].tolist(), strict=True)]


def _slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose words fit beside one another."""
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def _columns(part: pa.RecordBatch, rows: np.ndarray) -> np.ndarray:
    """The columns after the third of some rows, as bytes."""
    sink = pa.BufferOutputStream()
    chosen = pa.RecordBatch.from_arrays([c.take(pa.array(rows)) for c in part.columns[3:]], schema=pa.schema(list(part.schema)[3:]))
    with pa.ipc.new_stream(sink, chosen.schema) as stream:
        stream.write_batch(chosen)
    return np.frombuffer(sink.getvalue(), np.uint8)


def _pack(*arrays: np.ndarray, blob: bytes = b"") -> bytes:
    import zstandard

    parts = [struct.pack("<H", len(arrays))]
    for a in arrays:
        parts.append(struct.pack("<cBQ", a.dtype.kind.encode(), a.dtype.itemsize, len(a)))
        parts.append(a.tobytes())
    return zstandard.compress(b"".join(parts) + blob, 3)


def _unpack(data: bytes) -> tuple[list[np.ndarray], bytes]:
    import zstandard

    raw = zstandard.decompress(data)
    n, = struct.unpack_from("<H", raw)
    at, out = 2, []
    for _ in range(n):
        kind, wide, size = struct.unpack_from("<cBQ", raw, at)
        at += 10
        out.append(np.frombuffer(raw, f"<{kind.decode()}{wide}", size, at))
        at += wide * size
    return out, raw[at:]


def _order(runs: Runs, buckets: int) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Distinct strings of a batch by bucket, minimiser and text: the number of each run's string, a run of each
    number, all strings by run, and the bucket of each number."""
    strings = runs.strings()
    seen: dict[bytes, int] = {}
    first = np.fromiter((seen.setdefault(s, i) for i, s in enumerate(strings)), np.int64, len(strings))
    run = np.fromiter(seen.values(), np.int64, len(seen))
    bucket, key = _bucket(runs.key[run], buckets), _short(runs.key[run])
    order = np.lexsort((key, bucket))
    run, bucket, key = run[order], bucket[order], key[order]
    tied = np.flatnonzero((bucket[1:] == bucket[:-1]) & (key[1:] == key[:-1]))
    for group in np.split(tied, np.flatnonzero(np.diff(tied) != 1) + 1) if len(tied) else ():
        i, j = int(group[0]), int(group[-1]) + 2
        run[i:j] = sorted(run[i:j].tolist(), key=strings.__getitem__)
    number = np.empty(len(strings), np.int64)
    number[run] = np.arange(len(run))
    return number[first], run, strings, bucket


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _short(key: np.ndarray) -> np.ndarray:
    """What travels of a minimiser: inside a bucket 32 bits; where two agree, their strings just meet in vain."""
    return (key & np.uint64(0xFFFFFFFF)).astype("<u4")


def heavy_minimisers(docs: DataFrame, buckets: int, window: int, seed: int) -> np.ndarray:
    """Minimisers that hold over a quarter of an average bucket, counted over all documents.

    A share of the whole is that share of some partition at least, so partitions report only what is over
    half the limit; at most ``4 * buckets`` minimisers can be over it.
    """
    share = 1 / (4 * buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for batch in batches:
            found = [Runs(texts(part.column(1)), window, seed, np.zeros(part.num_rows, bool), np.zeros(0, np.uint64)).key for part in _slices(batch)]
            k, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            total += int(n.sum())
            keys, at = np.unique(np.concatenate((keys, k)), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate((counts, n)), minlength=len(keys)).astype(np.int64)
            if len(keys) > 1 << 20:  # what is far below the limit so far is set aside; its later rows still count
                keep = counts >= share * total / 16
                keys, counts = keys[keep], counts[keep]
        keep = counts >= max(64, share * total / 2)
        yield pa.RecordBatch.from_pydict({"key": np.concatenate((keys[keep].view(np.int64), [0])),
                                          "n": np.concatenate((counts[keep], [0])), "total": np.concatenate((0 * counts[keep], [total]))})

    found = docs.mapInArrow(run, "key long, n long, total long")
    sums = found.groupBy("key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    least = int(share / 2 * (found.agg(F.sum("total")).first()[0] or 0))
    rows = sums.filter((F.col("n") > 0) & (F.col("n") >= least)).select("key").collect()
    return np.sort(np.array([r.key for r in rows], np.int64).view(np.uint64))


def _verdicts(payloads: list[bytes], window: int) -> list[bytes | None]:
    """For each request the least ids of its shared windows; None where nothing is shared."""
    keys, lows, highs, strings, owner = [], [], [], [], []
    for request, payload in enumerate(payloads):
        (step, low, above, size), blob = _unpack(payload)
        key = np.cumsum(step, dtype="<u4")
        keys.append(key)
        lows.append(low)
        highs.append(low + above)
        owner.append(np.full(len(key), request))
        at = np.concatenate(([0], np.cumsum(size.astype(np.int64)))).tolist()
        strings += [blob[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    key, low, high, owner = (np.concatenate(x) for x in (keys, lows, highs, owner))
    number = np.concatenate([np.arange(len(k)) for k in keys])
    order = np.argsort(key, kind="stable")
    edges = np.flatnonzero(np.diff(key[order])) + 1
    starts = np.concatenate(([0], edges)).tolist()
    stops = [*edges.tolist(), len(order)]
    low_l, high_l = low.tolist(), high.tolist()
    out: list[tuple[list, list, list]] = [([], [], []) for _ in payloads]
    for a, b in zip(starts, stops, strict=True):
        members = order[a:b].tolist()
        if b - a == 1 and low_l[members[0]] == high_l[members[0]]:
            continue  # one string of one document
        by_text: dict[bytes, list[int]] = {}
        for m in members:
            by_text.setdefault(strings[m], []).append(m)
        entries = [(s, min(low_l[m] for m in ms), max(high_l[m] for m in ms), ms) for s, ms in by_text.items()]
        if len(entries) == 1:
            s, lo, hi, ms = entries[0]
            answers = [[lo] * (s.count(b" ") + 2 - window)] if lo != hi else [None]
        else:
            windows = []
            for e, (s, _, _, _) in enumerate(entries):
                ws = s.split(b" ")
                windows += [(b" ".join(ws[i:i + window]), e, i) for i in range(len(ws) - window + 1)]
            windows.sort()
            answers: list = [None] * len(entries)
            for _, same in groupby(windows, key=lambda w: w[0]):
                same = list(same)
                lo, hi = min(entries[e][1] for _, e, _ in same), max(entries[e][2] for _, e, _ in same)
                if lo != hi:
                    for _, e, i in same:
                        if answers[e] is None:
                            s, own, _, _ = entries[e]
                            answers[e] = [np.iinfo(np.int64).max] * (s.count(b" ") + 2 - window)
                        answers[e][i] = lo
        for (_, _, _, ms), answer in zip(entries, answers, strict=True):
            if answer is not None:
                for m in ms:
                    at, size, mins = out[owner[m]]
                    at.append(number[m])
                    size.append(len(answer))
                    mins.extend(answer)
    return [_pack(np.array(at, "<u4"), np.array(size, "<u2"), np.array(mins, "<i8")) if at else None for at, size, mins in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED,
                   batch_bytes: int = BATCH_BYTES, lanes: int | None = None, carry: tuple[str, ...] = (), untouched: bool = False) -> DataFrame:
    """``doc_id, kept`` (the words that stay, joined by one space)``, n_words, n_removed``, and the columns of ``carry``.

    ``lanes`` is the number of tasks that judge, by default that of shuffle partitions.  With ``untouched`` a text that loses
    no word is kept as it is.  A carried column with the name of one of the
    first four gives way to it.
    """
    carry = tuple(c for c in carry if c not in ("doc_id", "kept", "n_words", "n_removed"))
    ship(docs.sparkSession)
    rows = documents(docs, id_col, text_col)
    others = docs.select(*[docs[c].alias(f"_c{i}") for i, c in enumerate(carry)]).schema
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = buckets = max(1, -(-size // batch_bytes))
    lanes = min(buckets, lanes or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = heavy_minimisers(rows, buckets, window, seed)

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of one batch travel together, compressed."""
        for part in parts:
            batch = part.column(2).to_numpy(zero_copy_only=False)
            known, ids, rows = part.column(0).is_valid().to_numpy(zero_copy_only=False), part.column(0).fill_null(0).to_numpy(), texts(part.column(1))
            names, payload = [], []
            order = np.argsort(batch, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(batch[order])) + 1) if len(order) else ():
                own = [rows[i] for i in group.tolist()]
                names.append(int(batch[group[0]]))
                rest = _columns(part, group) if part.num_columns > 3 else np.zeros(0, np.uint8)
                payload.append(_pack(known[group].astype(np.uint8), ids[group], np.array([len(t) for t in own], "<u4"), rest, blob=b"".join(own)))
            yield pa.RecordBatch.from_pydict({"batch": pa.array(names, pa.int64()), "payload": pa.array(payload, pa.binary())})

    place = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("long").alias("batch")
    dealt = documents(docs, id_col, text_col, carry).select("doc_id", "text", place, *others.names).mapInArrow(deal, "batch long, payload binary").repartition("batch")

    def runs_of(table: pa.Table) -> tuple[Runs, np.ndarray, np.ndarray, list[bytes], list[np.ndarray]]:
        known, ids, own, rest = [], [], [], []
        for payload in table.column("payload").to_pylist():
            (valid, number, size, other), blob = _unpack(payload)
            rest.append(other)
            known.append(valid)
            ids.append(number)
            at = np.concatenate(([0], np.cumsum(size.astype(np.int64)))).tolist()
            own += [blob[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        valid, ids = np.concatenate(known) == 1, np.concatenate(ids)
        return Runs(own, window, seed, ~valid, hot), ids, valid, own, rest

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        runs, ids, *_ = runs_of(table)
        number, run, strings, begins = _order(runs, buckets)
        low, high = np.full(len(run), np.iinfo(np.int64).max), np.full(len(run), np.iinfo(np.int64).min)
        owner = ids[runs.row]
        np.minimum.at(low, number, owner)
        np.maximum.at(high, number, owner)
        short = _short(runs.key[run])
        bucket, part = [], []
        edges = [*np.flatnonzero(np.diff(begins, prepend=-1)).tolist(), len(run)]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            own = [strings[k] for k in run[i:j].tolist()]
            bucket.append(int(begins[i]))
            part.append(_pack(np.diff(short[i:j], prepend=short.dtype.type(0)), low[i:j], high[i:j] - low[i:j], np.array([len(s) for s in own], "<u2" if max(map(len, own)) < 1 << 16 else "<u4"),
                              blob=b"".join(own)))
        lane = np.array(bucket, np.int64) % lanes
        order = np.argsort(lane, kind="stable")
        found, first = np.unique(lane[order], return_index=True)
        requests_ = pa.StructArray.from_arrays([pa.array([bucket[k] for k in order.tolist()], pa.int64()), pa.array([part[k] for k in order.tolist()], pa.binary())], names=["bucket", "payload"])
        return pa.table({"lane": pa.array(found, pa.int64()), "batch": pa.array([key[0].as_py()] * len(found), pa.int64()),
                         "requests": pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), requests_)})

    def judge(key: tuple, table: pa.Table) -> pa.Table:
        found = _verdicts(table.column("payload").to_pylist(), window)
        batch = [b for b, a in zip(table.column("batch").to_pylist(), found, strict=True) if a is not None]
        return pa.table({"batch": pa.array(batch, pa.int64()), "bucket": pa.array([key[1].as_py()] * len(batch), pa.int64()),
                         "payload": pa.array([a for a in found if a is not None], pa.binary())})

    def drop(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        runs, ids, known, own, rest = runs_of(table)
        number, _, strings, begins = _order(runs, buckets)
        del strings
        least: dict[int, list[int]] = {}
        for bucket, payload in zip(answers.column("bucket").to_pylist(), answers.column("payload").to_pylist(), strict=True):
            (at, size, mins), _ = _unpack(payload)
            ends, flat, base = np.cumsum(size.astype(np.int64)).tolist(), mins.tolist(), int(np.searchsorted(begins, bucket))
            for k, a, b in zip(at.tolist(), [0, *ends[:-1]], ends, strict=True):
                least[base + k] = flat[a:b]
        gone = np.zeros(len(runs.words) + 1, np.int64)
        owner = ids[runs.row].tolist()
        for n, start, doc in zip(number.tolist(), runs.start.tolist(), owner, strict=True):
            found = least.get(n)
            if found is not None:
                for i, lowest in enumerate(found):
                    if lowest < doc:
                        gone[start + i] += 1
                        gone[start + i + window] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        words = runs.words
        kept, removed = [], []
        for text, a, n in zip(own, runs.first.tolist(), runs.sizes.tolist(), strict=True):
            cut = gone[a:a + n]
            removed.append(int(cut.sum()))
            kept.append(text if untouched and not removed[-1] else b" ".join(words[a:a + n] if not removed[-1] else [words[a + i] for i in np.flatnonzero(~cut)]))
        out = pa.table({"doc_id": pa.array(ids, mask=~known), "kept": pa.array(kept, pa.binary()).cast(pa.string()),
                        "n_words": runs.sizes, "n_removed": pa.array(removed, pa.int64())})
        if carry:
            for name, column in zip(others.names, pa.concat_tables([pa.ipc.open_stream(r.tobytes()).read_all() for r in rest]).columns, strict=True):
                out = out.append_column(name, column)
        return out

    messages = dealt.groupBy("batch").applyInArrow(ask, "lane long, batch long, requests array<struct<bucket:bigint,payload:binary>>").repartition(lanes, "lane")
    # Lanes are dealt already, so the buckets inside them are grouped by a sort, without another shuffle.
    requests = messages.select("lane", "batch", F.inline("requests"))
    verdicts = requests.groupBy("lane", "bucket").applyInArrow(judge, "batch long, bucket long, payload binary")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()), *others.fields])
    out = dealt.groupBy("batch").cogroup(verdicts.groupBy("batch")).applyInArrow(drop, schema)
    return out.select("doc_id", "kept", "n_words", "n_removed", *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)])
