"""Tables through the shared folder and streams over them, with the SQL of their batch forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from listingspark.schemas import SCHEMAS, conform
from listingspark.session import shared_folder
from listingspark.sources import tables
from listingspark.streaming import ingest, states

from . import extract_queries, rule_queries, source_queries
from .lifecycle_queries import votes
from .registry import ORACLES, QUERIES, query
from .views import AS_OF, view


def landed(df: DataFrame, name: str) -> tuple[SparkSession, str]:
    """A new folder that holds ``df`` as files, as a feed reader or an event log would leave it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/in")
    return df.sparkSession, path


SLICES = 4


def landed_slices(df: DataFrame, name: str) -> tuple[SparkSession, str]:
    """A new folder with the rows of ``df`` in files of equal size by time, written one after the other."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    seconds = F.col("ts").cast("double")
    cuts = df.agg(F.percentile_approx(seconds, [i / SLICES for i in range(1, SLICES)], 10_000).alias("c")).first().c or []
    for i, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        part = df.where(F.lit(True) if low is None else seconds > low).where(F.lit(True) if high is None else seconds <= high)
        part.coalesce(1).write.parquet(f"{path}/in/slice={i}")
    return spark, path


def folded(df: DataFrame, name: str, fold: states.Fold) -> tuple[DataFrame, DataFrame]:
    """All output rows and the last state of a fold over the rows of ``df``, a slice per micro-batch, so that states are read back."""
    spark, path = landed_slices(df, name)
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/slice=*")
    states.run_fold(live, fold, f"{path}/fold", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/fold/out"), spark.read.parquet(f"{path}/fold/state/version={SLICES}")


@query(f"WITH {source_queries.STREAK} SELECT source_id AS key, streak, backoff_minutes FROM sb", "fetch_events")
def streak_stream(events):
    """K3: the last output per source of the refusal stream."""
    rows, _ = folded(source_queries.limited(events).select("id", "source_id", "ts", "skipped", "error"), "streaks", states.streak_fold())
    return rows.groupBy("key").agg(F.max(F.struct("version", "streak", "backoff_minutes")).alias("m")).select("key", "m.streak", "m.backoff_minutes")


@query(f"""WITH {rule_queries.STRIKES} SELECT CAST(company_id AS VARCHAR) AS key, CAST(arg_max(strikes, (ts, id)) AS INT) AS strikes, max(strikes) >= 3 AS reached_threshold
  FROM s2 GROUP BY 1""", "checks")
def strikes_stream(checks):
    """K5: the last state per company of the link-check stream."""
    _, state = folded(rule_queries.checked(checks).select("id", "company_id", "ts", "hard_dead", "link_status"), "strikes", states.strikes_fold())
    return state.select("key", "strikes", "reached_threshold")


def incident_stream(events):
    """K4: one action per signal."""
    i = F.col("id")
    signal = F.when(i % 5 == 0, "failing").when((i % 5 == 4) & (i % 3 == 0), "failing").when(i % 5 == 4, "unknown").otherwise("healthy")
    signals = events.select("id", F.concat(F.lit("K"), (i % 6).cast("string")).alias("incident_key"), "ts", signal.alias("signal"))
    rows, _ = folded(signals, "incidents", states.incident_fold())
    return rows.select(F.col("key").alias("incident_key"), "id", "action", "healthy_streak")


query(None, "fetch_events", name="incident_stream")(incident_stream)
ORACLES["incident_stream"] = ORACLES["incident_actions"]


@query("""SELECT kind, count(*) AS bodies FROM (SELECT DISTINCT source_platform, id // 1000 AS block FROM listings),
  (SELECT unnest(['rss', 'html', 'json', 'lever', 'greenhouse', 'ashby', 'workable', 'breezy']) AS kind) GROUP BY 1""", "listings")
def landed_payloads(listings):
    """A1: payloads written to a folder and scanned from there."""
    spark, path = landed(conform(extract_queries.all_payloads(listings), "payloads"), "payloads")
    return tables.read_payloads(spark, f"{path}/in").where("body is not null").groupBy("kind").agg(F.count(F.lit(1)).alias("bodies"))


@query("SELECT day, count(*) AS attempts, count(*) FILTER (WHERE ok) AS ok FROM (SELECT *, CAST(strftime(ts, '%Y-%m-%d') AS VARCHAR) AS day FROM fetch_events) GROUP BY 1", "fetch_events")
def written_report(events):
    """A report written to a folder and read back."""
    report = events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("attempts"), F.count_if("ok").alias("ok"))
    path = f"{shared_folder(events.sparkSession)}/report-{uuid.uuid4().hex}"
    tables.write_report(report, path)
    return events.sparkSession.read.schema(report.schema).parquet(path)


def ingest_stream(listings, sources) -> tuple[SparkSession, str]:
    """The payload stream over three slices, each landed as many files and taken in by one micro-batch: all payloads; repeats, undated
    and newer ones; late ones and repeats."""
    spark = listings.sparkSession
    path = f"{shared_folder(spark)}/payload-stream-{uuid.uuid4().hex}"
    bodies = conform(extract_queries.all_payloads(listings), "payloads")
    other, later = F.concat("body", F.lit(" ")), lambda hours: F.col("fetched_at") + F.make_dt_interval(hours=F.lit(hours))
    newer = bodies.where("kind = 'json'").withColumns({"body": other, "fetched_at": later(3)})
    slices = [bodies, bodies.where("kind = 'lever'").withColumn("fetched_at", later(1)).unionByName(
        bodies.where("kind = 'rss'").withColumns({"body": other, "fetched_at": F.lit(None).cast("timestamp")})).unionByName(newer),
        newer.unionByName(bodies.where("kind = 'html'").withColumns({"body": other, "fetched_at": later(-5)}))]
    ingest.start_table(extract_queries.stored_half(listings), f"{path}/table", buckets=8)
    live = spark.readStream.schema(SCHEMAS["payloads"]).parquet(f"{path}/in/slice=*")
    v, s = votes(listings, "source_url")
    for i, part in enumerate(slices):
        part.write.parquet(f"{path}/in/slice={i}")
        ingest.run_ingest(live, f"{path}/table", extract_queries.registered(sources), lambda: v, lambda: s, lambda: extract_queries.no_state(sources),
                          extract_queries.HOST, lambda: AS_OF, f"{path}/state").awaitTermination()
    return spark, f"{path}/table"


@query("""WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE source_platform NOT IN (SELECT platform FROM sources WHERE position % 5 <> 1)) AS u
  FROM (SELECT DISTINCT source_platform, id // 1000 FROM listings))
SELECT 1 AS version, 8 * n AS payloads, 0 AS undated, 3 * u AS unregistered, 0 AS late, 0 AS repeated, 8 * n - 3 * u AS taken, 0 AS unaccounted FROM n
UNION ALL SELECT 2, 3 * n, n, u, 0, n, n - u, 0 FROM n UNION ALL SELECT 3, 2 * n, 0, 2 * u, n - u, n - u, 0, 0 FROM n""", "listings", "sources")
def payload_account(listings, sources):
    """K1: what became of every payload, per micro-batch; nothing is lost."""
    spark, folder = ingest_stream(listings, sources)
    return ingest.account(spark, folder).select("version", "payloads", *ingest.REASONS, "unaccounted")


ORACLES["ingest_stream_table"] = ORACLES["ingest_full"]

def _stream_table(spark: SparkSession, sf: str) -> DataFrame:
    """K1: the table after three micro-batches, the same as that of one run over all bodies that count."""
    folder = ingest_stream(view(spark, sf, "listings"), view(spark, sf, "sources"))[1]
    return ingest.read_version(spark, folder, 3).select("source_url", "title")


QUERIES["ingest_stream_table"] = _stream_table
