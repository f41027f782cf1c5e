"""Running counts that hold when one key owns a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .session import cut_lineage


def in_pieces(df: DataFrame, key: list[str], at: str, tie: str) -> DataFrame:
    """Add ``_piece``: the rows of a key in order, cut where one range partitioning cuts them.

    A key of any size is spread over as many pieces as partitions, and no piece is larger than a partition.  The result is
    checkpointed, so that all that follows sees the same pieces.
    """
    return cut_lineage(df.repartitionByRange(*key, at, tie).withColumn("_piece", F.spark_partition_id()))


def count_since(df: DataFrame, key: list[str], at: str, tie: str, counted: Column, reset: Column, name: str,
                before: bool = False, bucket: str = "hour", piece: str | None = None) -> DataFrame:
    """Add ``name``: how many ``counted`` rows there were since the last ``reset`` row, per key in order.

    The order is (``at``, ``tie``).  A row counts itself; its own reset applies unless ``before`` is set.
    ``name_any`` tells whether there was a reset at all; without one the count runs from the start.

    Work is split by time bucket: short windows inside (key, bucket) first, one summary row per bucket
    next, and the prefix over those few rows last.  No task ever holds all rows of one key.  ``piece`` names a column to
    use for the buckets instead, such as that of :func:`in_pieces`, which bounds the rows of a bucket.
    """
    df = df.withColumns({"_bucket": F.col(piece) if piece else F.date_trunc(bucket, F.col(at)), "_counted": F.coalesce(counted, F.lit(False)).cast("int"),
                         "_reset": F.coalesce(reset, F.lit(False))})
    inside = Window.partitionBy(*key, "_bucket").orderBy(at, tie)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_count", F.sum("_counted").over(so_far))
    at_reset = F.when(F.col("_reset"), F.col("_count"))
    df = df.withColumn("_mark", F.max(at_reset).over(inside.rowsBetween(Window.unboundedPreceding, -1 if before else 0)))
    summary = df.groupBy(*key, "_bucket").agg(F.max("_count").alias("_total"), F.max(at_reset).alias("_last"))
    earlier = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = summary.withColumn("_base", F.coalesce(F.sum("_total").over(earlier), F.lit(0))).select(
        *key, "_bucket", "_base", F.max(F.col("_base") + F.col("_last")).over(earlier).alias("_base_mark"))
    out = df.join(starts, [*key, "_bucket"])
    mark = F.greatest(F.col("_base_mark"), F.col("_base") + F.col("_mark"))
    out = out.withColumns({name: F.col("_base") + F.col("_count") - F.coalesce(mark, F.lit(0)), f"{name}_any": mark.isNotNull()})
    return out.drop("_bucket", "_counted", "_reset", "_count", "_mark", "_base", "_base_mark")
