"""Event-time windows over fetch events (K2, K7) and click counts (K6).

All take a streaming or a batch DataFrame.  Rows without a time are dropped before the watermark;
rows later than the watermark, which trails the newest event by ``late``, are dropped by it (:func:`late_events` has them).
"""

from __future__ import annotations

from pandas import Timedelta
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.views import outbound_clicks
from ..skew import in_pieces


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.where("ts is not null and source_id is not null").withWatermark("ts", late)


_SUMS = {"attempts": "count(1)", "ok": "count_if(ok)", "skipped": "count_if(skipped)", "items": "sum(cnt)", "failed": "count_if(NOT ok)"}


def health_windows(events: DataFrame, length: str = "24 hours", slide: str | None = "1 hour", late: str = "1 hour") -> DataFrame:
    """K2: source health per window; ``slide=None`` gives tumbling windows for daily or weekly digests.

    Sliding windows are sums of panes as long as the slide: an event counts in one pane, and only panes, one row per
    source and slide, enter the windows that hold them.  So ``length`` must be a multiple of ``slide``.
    """
    timed = _timed(events, late)
    if slide is None:
        out = timed.groupBy("source_id", F.window("ts", length).alias("w")).agg(*[F.expr(c).alias(n) for n, c in _SUMS.items()])
    else:
        if Timedelta(length) % Timedelta(slide) != Timedelta(0):
            raise ValueError("length must be a multiple of slide")
        panes = timed.groupBy("source_id", F.window("ts", slide).alias("p")).agg(*[F.expr(c).alias(n) for n, c in _SUMS.items()])
        out = panes.groupBy("source_id", F.window(F.window_time("p"), length, slide).alias("w")).agg(*[F.sum(n).alias(n) for n in _SUMS])
    return out.select("source_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *_SUMS)


def late_events(events: DataFrame, newest, late: str = "1 hour") -> DataFrame:
    """Rows that a stream whose newest event was at ``newest`` drops: those without time or source, and late ones, with the reason."""
    old = F.col("ts") < F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {late}")
    why = F.when(F.col("ts").isNull(), "undated").when(F.col("source_id").isNull(), "without source").when(old, "late")
    return events.withColumn("reason", why).where("reason is not null")


def activity_sessions(events: DataFrame, gap: str = "3 hours", late: str = "1 hour", tie: str = "id") -> DataFrame:
    """K7: unbroken activity per source; a gap of ``gap`` or more shows that the clock stopped.

    A stream merges sessions before its shuffle.  In a batch the events of a source are cut into pieces; breaks are found
    inside pieces and between them, and a session is a sum over its events, wherever they are.
    """
    if events.isStreaming:
        events.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
        out = _timed(events, late).groupBy("source_id", F.session_window("ts", gap).alias("w")).agg(
            F.count(F.lit(1)).alias("attempts"), F.sum("cnt").alias("items"))
        return out.select("source_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"),
                          "attempts", "items")
    rows = in_pieces(events.where("ts is not null and source_id is not null").select("source_id", "ts", F.col(tie).alias("_tie"), "cnt"), ["source_id"], "ts", "_tie")
    pause = F.expr(f"INTERVAL {gap}")
    inside = Window.partitionBy("source_id", "_piece").orderBy("ts", "_tie")
    rows = rows.withColumn("_break", (F.col("ts") >= F.lag("ts").over(inside) + pause).cast("int"))
    rows = rows.withColumn("_inner", F.coalesce(F.sum("_break").over(inside), F.lit(0)))
    pieces = rows.groupBy("source_id", "_piece").agg(F.min("ts").alias("_first"), F.max("ts").alias("_end"), F.max("_inner").alias("_breaks"))
    over = Window.partitionBy("source_id").orderBy("_piece")  # a row per piece
    begins = F.coalesce((F.col("_first") >= F.lag("_end").over(over) + pause).cast("int"), F.lit(0))
    pieces = pieces.withColumn("_begins", begins).withColumn(
        "_base", F.sum(F.col("_begins") + F.col("_breaks")).over(over) - F.col("_breaks")).select("source_id", "_piece", "_base")
    out = rows.join(pieces, ["source_id", "_piece"]).groupBy("source_id", F.col("_base") + F.col("_inner")).agg(
        F.min("ts").alias("session_start"), (F.max("ts") + pause).alias("session_end"), F.count(F.lit(1)).alias("attempts"), F.sum("cnt").alias("items"))
    return out.select("source_id", "session_start", "session_end", "attempts", "items")


def click_counts(clicks: DataFrame, listings: DataFrame) -> DataFrame:
    """K6: valid clicks per listing; ``clicks(click_id, id, url)`` joined to the stored addresses.

    In a batch, clicks are counted per listing and address first, so a hot listing meets the table in few rows.
    """
    if not clicks.isStreaming:
        counted = clicks.groupBy("id", "url").agg(F.count(F.lit(1)).alias("_n"))
        return outbound_clicks(counted, listings).where("target is not null").groupBy("id").agg(F.sum("_n").alias("clicks"))
    return outbound_clicks(clicks, listings).where("target is not null").groupBy("id").agg(
        F.count(F.lit(1)).alias("clicks"))
