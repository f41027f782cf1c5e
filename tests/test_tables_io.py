"""Scans and sinks."""

from pyspark.sql import functions as F

from listingspark.schemas import conform
from listingspark.sources import tables


def payloads(spark):
    return conform(spark.range(6).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("source_id"), F.lit("rss").alias("kind"), F.lit(200).alias("status"),
                                         F.lit("2024-01-01").cast("timestamp").alias("fetched_at"), F.lit("<rss/>").alias("body")), "payloads")


def test_payload_scan_and_stream(spark, tmp_path):
    path = str(tmp_path / "landed")
    tables.write_table(payloads(spark), path, ["kind"])
    assert tables.read_payloads(spark, path).where("kind = 'rss'").count() == 6
    live = tables.stream_payloads(spark, path)
    assert live.isStreaming and live.schema == tables.read_payloads(spark, path).schema
    query = live.select("source_id").writeStream.format("memory").queryName("landed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    assert spark.table("landed").count() == 6


def test_reports(spark, tmp_path):
    report = spark.createDataFrame([("active", 3)], "metric string, value long")
    for form in ("parquet", "csv"):
        path = str(tmp_path / form)
        tables.write_report(report, path, form)
        tables.write_report(report, path, form)
        assert spark.read.format(form).option("header", "true").load(path).count() == 1


def test_listing_scan_prunes_partitions(spark, tmp_path):
    t = conform(spark.range(10).select("id", (F.col("id") % 2 == 0).alias("is_active"), F.lit("x").alias("title")), "listings")
    path = str(tmp_path / "listings")
    tables.write_table(t, path, ["is_active"])
    plan = tables.read_table(spark, path, "listings").where("is_active").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(is_active" in plan and "ReadSchema: struct<id:bigint>" in plan
