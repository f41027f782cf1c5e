"""Table schemas and the helper that brings a DataFrame to one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType,
)

_TABLES = {
    "listings": """id bigint, title string, company string, type string, source_url string,
        application_url string, source_platform string, tags array<string>, category string,
        location_type string, client_timezone string, pay_range string, location_raw string,
        description string, posted_at timestamp, scraped_at timestamp, updated_at timestamp,
        last_seen_at timestamp, last_verified_at timestamp, failed_count int, is_active boolean,
        inactive_reason string, content_hash string, description_hash string, experience_level string,
        click_count bigint, geo_scope string, ph_eligibility string, geo_evidence string,
        geo_checked_at timestamp""",
    "companies": """id bigint, company_name string, website string, hires boolean, niche string,
        is_verified boolean, verified_at timestamp, is_remote boolean, is_dayshift boolean,
        is_marketplace boolean, hiring_page_url string, notes string, ats_platform string,
        ats_token string, link_status string, link_evidence string, link_checked_at timestamp,
        link_fail_count int, created_at timestamp""",
    "digests": """creator_name string, video_id string, video_title string, video_url string,
        transcript_raw string, action_plan array<string>, tags array<string>, published_at timestamp,
        processed_at timestamp""",
    "fetch_events": """id bigint, source_id string, ts timestamp, ok boolean, skipped boolean, cnt int,
        error string, skip_reason string, robots_origin string, robots_verdict string,
        robots_evidence string, robots_crawl_delay double, robots_would_block boolean, robots_mode string""",
    "source_state": """source_id string, last_attempt_at timestamp, last_success_at timestamp,
        last_count int, last_error string, etag string, last_modified string, body_hash string""",
    "sources": """source_id string, name string, url string, type string, status string, notes string,
        platform string, default_type string, tags array<string>, max_items int,
        min_interval_minutes int, cadence_group string, position int""",
    "pauses": "source_id string, reason string, paused_at string, paused_by string",
    "payloads": """source_id string, kind string, company string, token string, status int, etag string,
        last_modified string, fetched_at timestamp, body string""",
    "robots_docs": """origin string, fetched_at timestamp, status int, body string, error string""",
    "votes": """listing_key string, available boolean, eligible boolean, reason string, category string,
        tags array<string>, pay_range string, client_timezone string, application_url string,
        employment_type string, experience_level string, company_name string""",
    "skeptics": "listing_key string, available boolean, eligible boolean, reason string",
}
_TYPES = {
    "string": StringType(), "bigint": LongType(), "int": IntegerType(), "double": DoubleType(),
    "boolean": BooleanType(), "timestamp": TimestampType(), "array<string>": ArrayType(StringType()),
}


def _schema(text: str) -> StructType:
    pairs = [column.split() for column in text.split(",")]
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


SCHEMAS = {name: _schema(text) for name, text in _TABLES.items()}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of ``table`` in order; absent ones become NULL, others are dropped."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[table]
    ])


def fill(df: DataFrame, table: str, *names: str) -> DataFrame:
    """Add named columns of ``table`` that ``df`` lacks, as NULL."""
    have = set(df.columns)
    types = {f.name: f.dataType for f in SCHEMAS[table]}
    return df.withColumns({n: F.lit(None).cast(types[n]) for n in names if n not in have})
