"""Scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import SCHEMAS


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """A1: landed payloads; the declared schema lets the scan read only the columns in use."""
    return spark.read.schema(SCHEMAS["payloads"]).parquet(path)


def stream_payloads(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A1 as a stream over the same folder."""
    return spark.readStream.schema(SCHEMAS["payloads"]).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write a new version of a table to ``path``, which must not be the folder it is computed from.

    Listings are best partitioned by ``is_active``: every board and quality query filters on it.
    """
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_report(df: DataFrame, path: str, form: str = "parquet") -> None:
    """A report table of one run."""
    df.write.mode("overwrite").format(form).option("header", "true").save(path)
