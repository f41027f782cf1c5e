"""Payload stream into the ingest plan (K1), with an account of every payload and versions by partition.

Layout below one folder, ``v`` being a version; a micro-batch ``n`` makes version ``n + 1`` from version ``n``:

* ``manifest/version=v``: which data version holds each bucket of listings, the newest fetch time and the versions
  whose payloads a later one may repeat;
* ``data/version=v/bucket=b``: the buckets that changed in ``v``; a bucket is a hash of the address;
* ``landed/version=v``: all payloads of the batch, numbered; ``verdicts/version=v``: what became of each.

Replaying a batch reads version ``n`` and overwrites version ``n + 1``, so it adds nothing twice.  A batch writes its own
payloads and the buckets it changes, nothing else.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.ingest_batch import extract_all, flag_batch, inserted_rows, run_counts
from ..operators.lifecycle import seen_again
from ..schemas import SCHEMAS, conform
from ..session import cut_lineage
from ..sources.extract import FEED_KINDS

BUCKETS = 64
# What became of a payload; the first that holds counts.
REASONS = ("undated", "unregistered", "late", "repeated", "taken")
ASIDE = REASONS[:3]


def bucket_of(url: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


def _write_manifest(spark: SparkSession, folder: str, version: int, manifest: dict) -> None:
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest/version={version}")


def read_manifest(spark: SparkSession, folder: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{folder}/manifest/version={version}").first().value)


def start_table(listings: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Write version 0, from which the stream starts."""
    held = _write_data(listings, folder, 0, buckets)
    _write_manifest(listings.sparkSession, folder, 0, {"n": buckets, "buckets": dict.fromkeys(map(str, held), 0), "newest": None, "recent": []})


def _write_data(listings: DataFrame, folder: str, version: int, buckets: int) -> list[int]:
    path = f"{folder}/data/version={version}"
    conform(listings, "listings").withColumn("bucket", bucket_of("source_url", buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    rows = listings.sparkSession.read.schema("bucket int").parquet(path).select("bucket").distinct().collect()  # at most ``buckets``
    return sorted(r.bucket for r in rows)


def read_version(spark: SparkSession, folder: str, version: int, only: list[int] | None = None) -> DataFrame:
    """Listings as of a version, or those of some buckets; one path per bucket."""
    return _read_data(spark, folder, read_manifest(spark, folder, version), only)


def _read_data(spark: SparkSession, folder: str, manifest: dict, only: list[int] | None = None) -> DataFrame:
    paths = [f"{folder}/data/version={v}/bucket={b}" for b, v in manifest["buckets"].items() if only is None or int(b) in only]
    return spark.read.schema(SCHEMAS["listings"]).parquet(*paths) if paths else spark.createDataFrame([], SCHEMAS["listings"])


def payload_verdicts(landed: DataFrame, sources: DataFrame, seen: DataFrame, watermark: datetime | None) -> DataFrame:
    """``number, source_id, body_hash, fetched_at, reason`` of numbered payloads.

    ``seen(source_id, body_hash)`` were taken before.  Of equal payloads of a batch the first by fetch time counts; it is
    found by an aggregate and joined back on the number, so a payload that makes up half a batch stays spread.
    """
    key = ["source_id", "body_hash"]
    rows = landed.select("number", "source_id", "kind", "fetched_at", F.sha2(F.coalesce("body", F.lit("")), 256).alias("body_hash"))
    known = sources.select("source_id").distinct().withColumn("_known", F.lit(True))
    rows = rows.join(known, "source_id", "left")
    late = F.col("fetched_at") < F.lit(watermark) if watermark is not None else F.lit(False)
    rows = rows.withColumn("_why", F.when(F.col("fetched_at").isNull(), "undated").when(
        F.col("kind").isin(*FEED_KINDS) & F.col("_known").isNull(), "unregistered").when(late, "late")).drop("_known", "kind")
    fit = rows.where("_why is null")
    firsts = fit.groupBy(*key).agg(F.min(F.struct("fetched_at", "number"))["number"].alias("number"))
    firsts = firsts.alias("f").join(seen.select(*key).distinct().alias("s"), F.expr("f.source_id <=> s.source_id AND f.body_hash = s.body_hash"), "left_anti")
    rows = rows.join(firsts.select("number", F.lit(True).alias("_first")), "number", "left")
    return rows.select("number", *key, "fetched_at", F.coalesce("_why", F.when(F.col("_first"), "taken").otherwise("repeated")).alias("reason"))


def account(spark: SparkSession, folder: str) -> DataFrame:
    """Per version: payloads that came in, what became of them, and ``unaccounted``, which must be zero."""
    came = spark.read.parquet(f"{folder}/landed").groupBy("version").agg(F.count(F.lit(1)).alias("payloads"))
    went = spark.read.parquet(f"{folder}/verdicts").groupBy("version").agg(*[F.count_if(F.col("reason") == r).alias(r) for r in REASONS])
    return came.join(went, "version").withColumn("unaccounted", F.expr("payloads - " + " - ".join(REASONS)))


def set_aside(spark: SparkSession, folder: str) -> DataFrame:
    """Payloads that no run took in though they aren't repeats, with the reason: late, undated or unregistered."""
    why = spark.read.parquet(f"{folder}/verdicts").where(F.col("reason").isin(*ASIDE)).select("version", "number", "reason")
    return spark.read.parquet(f"{folder}/landed").join(why, ["version", "number"])


def run_ingest(payloads: DataFrame, folder: str, sources: DataFrame, votes: Callable[[], DataFrame],
               skeptics: Callable[[], DataFrame], state: Callable[[], DataFrame], board_host: str, as_of: Callable,
               checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """K1: every micro-batch turns listing version ``n`` into version ``n + 1``.  :func:`start_table` makes version 0.

    A payload is late when it is older than the newest of the versions before by more than ``late``.
    """
    def step(batch: DataFrame, n: int) -> None:
        spark: SparkSession = batch.sparkSession
        manifest, version = read_manifest(spark, folder, n), n + 1
        conform(batch, "payloads").withColumn("number", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{folder}/landed/version={version}")
        landed = spark.read.parquet(f"{folder}/landed/version={version}")
        watermark, recent = _watermark(spark, manifest, late)
        seen = spark.read.parquet(*[f"{folder}/verdicts/version={v}" for v in recent]).where("reason = 'taken'") if recent else landed.selectExpr(
            "source_id", "'' AS body_hash").where("false")
        payload_verdicts(landed, sources, seen, watermark).write.mode("overwrite").parquet(f"{folder}/verdicts/version={version}")
        verdicts = spark.read.parquet(f"{folder}/verdicts/version={version}")
        taken = landed.join(verdicts.where("reason = 'taken'").select("number"), "number", "left_semi").drop("number")

        listings = _read_data(spark, folder, manifest)
        flagged = flag_batch(extract_all(taken, state(), sources, board_host), listings, "batch_order")
        new = cut_lineage(inserted_rows(flagged, listings, votes(), skeptics(), as_of(), "batch_order"))
        at = bucket_of("source_url", manifest["n"]).alias("bucket")
        changed = seen_again(listings, flagged.where("known"), as_of(), flag="_changed").where("_changed").select(at).union(new.select(at)).distinct()
        changed = [r.bucket for r in changed.collect()]  # at most the number of buckets
        if changed:
            rows = seen_again(_read_data(spark, folder, manifest, changed), flagged.where("known"), as_of())
            held = _write_data(rows.unionByName(conform(new, "listings"), allowMissingColumns=True), folder, version, manifest["n"])
            manifest["buckets"].update(dict.fromkeys(map(str, held), version))
        run_counts(flagged, new).write.mode("overwrite").parquet(f"{folder}/counts/version={version}")
        newest = verdicts.agg(F.max("fetched_at").alias("t")).first().t
        manifest["recent"] = [[v, t] for v, t in manifest["recent"] if v in recent] + [[version, newest and newest.replace(tzinfo=timezone.utc).isoformat()]]
        manifest["newest"] = max(filter(None, [manifest["newest"], manifest["recent"][-1][1]]), default=None)
        _write_manifest(spark, folder, version, manifest)

    return payloads.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _watermark(spark: SparkSession, manifest: dict, late: str) -> tuple[datetime | None, list[int]]:
    """The fetch time below which a payload is late, and the versions that hold payloads after it."""
    if manifest["newest"] is None:
        return None, []
    mark = spark.sql(f"SELECT TIMESTAMP '{manifest['newest']}' - INTERVAL {late} AS t").first().t
    limit = mark.replace(tzinfo=timezone.utc).isoformat()
    return mark, [v for v, newest in manifest["recent"] if newest is not None and newest >= limit]


def unreferenced(spark: SparkSession, folder: str, latest: int, keep: int = 2) -> list[str]:
    """Retention: data folders that none of the last ``keep`` versions up to ``latest`` refers to."""
    used = {(int(b), v) for n in range(max(0, latest - keep + 1), latest + 1) for b, v in read_manifest(spark, folder, n)["buckets"].items()}
    held = spark.read.schema("version int, bucket int").parquet(f"{folder}/data").select("version", "bucket").distinct().collect()
    return sorted(f"{folder}/data/version={r.version}/bucket={r.bucket}" for r in held if (r.bucket, r.version) not in used)


def drop_unreferenced(spark: SparkSession, folder: str, latest: int, keep: int = 2) -> list[str]:
    """Remove what :func:`unreferenced` names; versions before the last ``keep`` can't be read afterwards."""
    paths = unreferenced(spark, folder, latest, keep)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return paths
