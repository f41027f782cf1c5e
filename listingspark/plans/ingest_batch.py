"""One ingest run as a single plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.times import moment
from ..operators.cleaning import add_keys, sanitize_urls
from ..operators.geo import geo_gate
from ..operators.lifecycle import seen_again
from ..operators.verdicts import apply_verdicts, merge_verdicts
from ..session import cut_lineage
from ..sources.extract import extract_ats, extract_html_feed, extract_json_board, extract_rss, union_feeds
from ..sources.state import changed_payloads


SPREAD = 2  # partitions per core that the bodies of a kind are dealt over


@dataclass
class IngestResult:
    listings: DataFrame
    inserted: DataFrame
    counts: DataFrame


def extract_all(payloads: DataFrame, state: DataFrame, sources: DataFrame, board_host: str, job_path: str = "/jobseekers/job/",
                site: str | None = None) -> DataFrame:
    """Rows of every changed payload, in the fixed order of feed kinds: of equal addresses the first wins.

    ``job_path`` marks job anchors of HTML feeds and ``site`` completes their relative addresses.  A body is little to move and
    much to take apart, so the bodies of a kind are dealt over all cores, however few files or partitions they come in.
    """
    changed = changed_payloads(payloads, state).where("not unchanged").select(*payloads.columns)
    parts = SPREAD * payloads.sparkSession.sparkContext.defaultParallelism
    of = lambda kind: changed.where(F.col("kind") == kind).repartition(parts)
    return union_feeds(
        extract_rss(of("rss"), sources), extract_html_feed(of("html"), sources, job_path, site or f"https://www.{board_host}"), extract_json_board(of("json"), sources, board_host),
        *[extract_ats(of(v), v) for v in ("lever", "greenhouse", "ashby", "workable", "breezy")])


def flag_batch(items: DataFrame, listings: DataFrame, order: str) -> DataFrame:
    """One row per safe address of the batch, the first in order, and one for rows without any: ``source_url``, the item
    as ``item``, how often it came as ``times``, and the flags ``known`` (the table has the address), ``first`` (no earlier
    address of the batch has its content) and ``taken`` (the table has its content).

    The table is read for its addresses and content keys alone; the batch is the small side of both joins.
    """
    safe = sanitize_urls(items).drop("quarantined").withColumn("content_hash", F.sha2(F.concat_ws("::", "title", "source_url"), 256))
    rows = safe.groupBy("source_url").agg(F.min_by(F.struct(*[c for c in safe.columns if c != "source_url"]), order).alias("item"), F.count(F.lit(1)).alias("times"))
    content = F.col("item.content_hash")
    place = F.row_number().over(Window.partitionBy(content, F.col("source_url").isNull()).orderBy(f"item.{order}"))
    rows = cut_lineage(rows.withColumn("first", content.isNull() | (place == 1)))
    held = listings.select("source_url").join(rows.select("source_url"), "source_url", "left_semi").distinct().withColumn("known", F.lit(True))
    content_held = listings.select("content_hash").where("content_hash is not null").join(
        rows.select(content.alias("content_hash")), "content_hash", "left_semi").distinct().withColumn("taken", F.lit(True))
    flagged = rows.withColumn("content_hash", content).join(held, "source_url", "left").join(content_held, "content_hash", "left").drop("content_hash")
    return cut_lineage(flagged.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("known", "taken")}))


def inserted_rows(flagged: DataFrame, listings: DataFrame, votes: DataFrame, skeptics: DataFrame, as_of, order: str) -> DataFrame:
    """New rows, gated and voted on; ``decision`` tells what was decided.  Text rules cost only rows that an insert accepts.

    Ids follow the greatest one of the table.
    """
    accepted = flagged.where("source_url is not null and first and not known and not taken").select("source_url", "item.*")
    decided = apply_verdicts(merge_verdicts(geo_gate(add_keys(accepted).drop("company_key")), votes, skeptics), as_of)
    now = moment(as_of)
    base = listings.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).scalar()
    rows = decided.withColumns({"scraped_at": now, "last_seen_at": now, "failed_count": F.lit(0)}).drop(order, "source_id", "ordinal")
    return rows.withColumn("id", base + F.monotonically_increasing_id() + 1)


def run_counts(flagged: DataFrame, inserted: DataFrame) -> DataFrame:
    """Closed counts of a run: every item is dropped, repeated, known, conflicting or inserted."""
    safe, decision = F.col("source_url").isNotNull(), F.col("decision")
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("times"))), F.lit(0))
    seen = flagged.agg(total(F.lit(True)).alias("raw"), total(safe).alias("kept"), F.count_if(safe & F.col("known")).alias("known"), F.count_if(safe & ~F.col("known")).alias("new"))
    made = inserted.agg(F.struct(
        F.count(F.lit(1)).alias("inserted"), F.count_if(decision == "eligible").alias("published"), F.count_if(decision == "unavailable").alias("parked"),
        F.count_if(~decision.isin("eligible", "unavailable")).alias("rejected"))).scalar()
    return seen.withColumn("_made", made).select("*", "_made.*").drop("_made").withColumns({
        "dropped": F.col("raw") - F.col("kept"), "repeated": F.col("kept") - F.col("new") - F.col("known"), "conflicting": F.col("new") - F.col("inserted")})


def ingest_items(items: DataFrame, listings: DataFrame, votes: DataFrame, skeptics: DataFrame, as_of,
                 order: str = "batch_order") -> IngestResult:
    """Boundary, known rows touched and revived, new rows gated, voted on and inserted or parked.

    Replaying the batch on the result changes nothing.
    """
    flagged = flag_batch(items, listings, order)
    rows = inserted_rows(flagged, listings, votes, skeptics, as_of, order)
    inserted = rows.drop("decision")
    known = seen_again(listings, flagged.where("known"), as_of)
    return IngestResult(known.unionByName(inserted, allowMissingColumns=True), inserted, run_counts(flagged, rows))


def ingest_batch(payloads: DataFrame, state: DataFrame, sources: DataFrame, listings: DataFrame, votes: DataFrame,
                 skeptics: DataFrame, as_of, board_host: str) -> IngestResult:
    """From landed payloads to the new listing table and its closed-form counts."""
    return ingest_items(extract_all(payloads, state, sources, board_host), listings, votes, skeptics, as_of)
