"""Token ids of a corpus as binary files, and back.

A shard file holds the ids of its documents, in ascending ``doc_id`` order (null ids first, equal ids by
text), each followed by the end id::

    magic, ids in the vocabulary | block ... block | per document: id, id known, tokens | size of that, crc32, magic

Blocks are coded by :mod:`range_coder`: the model starts anew in each, and each has checksums of its
bytes and of its ids, so one block is read without the others and damage is found where it is.
Shards are ordered by number; a manifest table names the file that each task has finished, so what
failed or repeated attempts leave behind is never read.

Null text is the empty text (the end id alone); an empty table gives an empty manifest; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import range_coder
from .common import documents, shared_folder, ship, slices, stored, texts
from .tokens import encoder

MAGIC = b"CMRC0001"
BLOCK_IDS = 1 << 21
_TAIL = "<QI8s"
_MANIFEST = "shard int, path string, n_docs long, n_ids long"


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
                      folder: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write all documents and return the manifest: one row per shard with its path, documents and ids.

    ``folder`` is a URI that driver and executors share; by default a new one below the checkpoint folder.
    """
    spark = ship(docs.sparkSession)
    folder = folder or shared_folder(spark, "token-files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        path = f"{base}/shard-{shard:06d}-{uuid.uuid4().hex}.ids"
        end = np.array([end_id], enc.dtype).tobytes()
        ids, sizes, known, total = bytearray(), [], [], 0
        step = block_ids * enc.dtype.itemsize
        with store.open_output_stream(path) as out:
            out.write(MAGIC + struct.pack("<I", enc.n_ids))

            def blocks(least: int) -> None:
                while len(ids) >= least and ids:
                    out.write(range_coder.encode_block(np.frombuffer(bytes(ids[:step]), enc.dtype).astype(np.int64), enc.n_ids))
                    del ids[:step]

            while first is not None:
                column = first.column(0)
                known.append(np.array(column.is_valid().to_pylist(), np.uint8))
                doc_ids = np.array(column.fill_null(0).to_pylist(), "<i8")
                lengths = []
                for part in slices(first, 1 << 20):
                    for coded in enc.encode_all(texts(part.column(1))):
                        lengths.append(len(coded) // enc.dtype.itemsize + 1)
                        ids += coded
                        ids += end
                        if len(ids) >= step:
                            blocks(step)
                sizes.append((doc_ids, np.array(lengths, "<u4")))
                total += int(sizes[-1][1].sum())
                first = next(batches, None)
            blocks(1)
            doc_ids, lengths = (np.concatenate(x) for x in zip(*sizes, strict=True))
            index = zlib.compress(struct.pack("<Q", len(doc_ids)) + doc_ids.tobytes() + np.concatenate(known).tobytes() + lengths.tobytes(), 1)
            out.write(index + struct.pack(_TAIL, len(index), zlib.crc32(index), MAGIC))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [folder.rstrip("/") + path[len(base):]],
                                          "n_docs": [len(doc_ids)], "n_ids": [total]})

    ordered = documents(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(write, _MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Documents of the files that a manifest names: ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens``, ``ids_crc32`` and, with ``with_ids``, ``ids``: little-endian unsigned 32-bit integers."""
    spark = ship(manifest.sparkSession)
    shards = max(1, manifest.count())
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    tasks = manifest.select("shard", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start")).repartition(shards)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _read_shard(row["path"], row["start"], with_ids)

    return tasks.mapInArrow(read, schema)


def _read_shard(path: str, start: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    with store.open_input_file(place) as f:
        if f.read(8) != MAGIC:
            raise ValueError(f"{path} is not a token file")
        n_ids, = struct.unpack("<I", f.read(4))
        f.seek(f.size() - struct.calcsize(_TAIL))
        size, crc, magic = struct.unpack(_TAIL, f.read(struct.calcsize(_TAIL)))
        f.seek(f.size() - struct.calcsize(_TAIL) - size)
        index = f.read(size)
        if magic != MAGIC or zlib.crc32(index) != crc:
            raise ValueError(f"{path}: its index is damaged")
        index = zlib.decompress(index)
        n, = struct.unpack_from("<Q", index)
        doc_ids, known = np.frombuffer(index, "<i8", n, 8), np.frombuffer(index, np.uint8, n, 8 + 8 * n)
        lengths = np.frombuffer(index, "<u4", n, 8 + 9 * n).astype(np.int64)
        ends = np.cumsum(lengths)
        f.seek(12)
        at, left, done = 0, np.zeros(0, "<u4"), 0
        while at < n:
            head = f.read(range_coder.head_size())
            left = np.concatenate((left, range_coder.decode_block(head, f.read(range_coder.body_size(head)), n_ids).astype("<u4")))
            upto = int(np.searchsorted(ends, done + len(left), "right"))
            if upto == at:
                continue  # a document longer than the blocks read so far
            cuts = ends[at:upto] - done
            parts = [left[a:b] for a, b in zip(np.concatenate(([0], cuts[:-1])), cuts, strict=True)]
            columns = {"doc_id": pa.array(doc_ids[at:upto], mask=known[at:upto] == 0), "start": start + ends[at:upto] - lengths[at:upto],
                       "n_tokens": lengths[at:upto], "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64())}
            if with_ids:
                columns["ids"] = pa.array([p.tobytes() for p in parts], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)
            left, done, at = left[cuts[-1]:], done + int(cuts[-1]), upto
