"""Posting rows of whole blocks of listings, in Arrow and numpy, for the tasks that write an index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .search import B, K1

FIELD = 1 << 40  # positions of one field


def block_postings(batches: Iterator[pa.RecordBatch], fields: list[str], average: float, tokens: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """``term, block, top, docs, entries`` of rows ``block, id, length`` and fields of tokens between single spaces, in the order of blocks.

    Blocks are taken together up to about ``tokens``, and no block is taken apart.
    """
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        blocks, length = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("block", "length"))
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if size >= tokens and blocks[a] != last:
                yield from _postings(held, fields, average)
                held, size = [], 0
            held.append(batch.slice(a, b - a))
            size, last = size + int(length[a:b].sum()), blocks[a]
    if held:
        yield from _postings(held, fields, average)


def _postings(parts: list[pa.RecordBatch], fields: list[str], average: float) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(parts)
    order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ("block", "id", "length")], null_placement="at_start").to_numpy()
    ids, length, blocks = (table[c].combine_chunks() for c in ("id", "length", "block"))
    # Rows of one block with the same id and length are one entry.
    same = [x.to_numpy(zero_copy_only=False)[order] for x in (ids.dictionary_encode(null_encoding="encode").indices, length, blocks)]
    first = np.concatenate([[True], np.any([np.diff(x) != 0 for x in same], axis=0)])
    doc = np.empty(len(order), np.int64)
    doc[order] = np.cumsum(first) - 1
    docs = order[first]
    words, owner, place = [], [], []
    for i, f in enumerate(fields):
        texts = table[f].combine_chunks()
        lists = pc.split_pattern(pc.if_else(pc.equal(texts, ""), None, texts), " ")
        count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        words.append(lists.flatten())
        owner.append(np.repeat(doc, count))
        place.append(np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + i * FIELD)
    coded = pa.concat_arrays(words).dictionary_encode()
    if not len(coded):
        return
    key, place = coded.indices.to_numpy().astype(np.int64) * len(docs) + np.concatenate(owner), np.concatenate(place)
    order = np.lexsort((place, key))
    key, place = key[order], place[order]
    entry = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
    term, at = np.divmod(key[entry], len(docs))
    block = blocks.to_numpy()[docs][at]
    post = np.concatenate([[0], np.flatnonzero((np.diff(term) != 0) | (np.diff(block) != 0)) + 1])
    tf = np.diff(entry, append=len(key)).astype(float)
    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length.to_numpy()[docs][at] / average))
    rows = pa.array(docs[at])
    entries = pa.StructArray.from_arrays(
        [ids.take(rows), length.take(rows), pa.ListArray.from_arrays(pa.array(np.append(entry, len(key)), pa.int32()), pa.array(place))], names=["id", "length", "places"])
    yield pa.RecordBatch.from_arrays(
        [coded.dictionary.take(pa.array(term[post])), pa.array(block[post]), pa.array(np.maximum.reduceat(part, post)), pa.array(np.diff(post, append=len(entry))),
         pa.ListArray.from_arrays(pa.array(np.append(post, len(entry)), pa.int32()), entries)], names=["term", "block", "top", "docs", "entries"])
