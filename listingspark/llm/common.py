"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from listingspark.session import ship  # noqa: F401


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run below ``spark.checkpoint.dir``, which driver and executors share.

    Without that setting the checkpoint folder of the context is used.  Without either, a session on one machine
    gets a temporary folder, and a cluster an error: a machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="shared-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut of lineage that survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; a null is the empty text."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, most: int = 8 << 20, column: int = 1) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``most`` bytes of one column; a longer text is a part of its own."""
    if not batch.num_rows:
        return
    size = pc.binary_length(batch.column(column).cast(pa.binary())).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def documents(df: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Only the columns in use, as ``doc_id`` and ``text``, and ``carry`` as ``_c0``, ``_c1`` and so on; any names may occur."""
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"),
                     *[df[c].alias(f"_c{i}") for i, c in enumerate(carry)])
