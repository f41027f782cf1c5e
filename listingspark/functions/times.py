"""Timestamps: parsing of feed dates and the effective-date family."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from ..stages import let
from .regex import trim

# Which dates stand for "how fresh is this row", first known wins; each reader has its own order.
EFFECTIVE_ORDERS = {
    "board": ["posted_at", "scraped_at"],
    "dedup": ["last_seen_at", "posted_at", "scraped_at"],
    "prospect": ["scraped_at", "posted_at"],
    "sitemap": ["updated_at", "posted_at", "scraped_at"],
    "stale": ["last_seen_at", "scraped_at"],
}


# Zone names of mail dates.
ZONES = {"GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
         "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
# Pattern of the day and the shape of texts it is tried on.
_DAYS = {"d MMM yyyy": "^[0-9]{1,2} [A-Za-z]{3} [0-9]{4}", "MMM d yyyy": "^[A-Za-z]{3} [0-9]{1,2} [0-9]{4}",
         "yyyy/M/d": "^[0-9]{4}/[0-9]", "M/d/yyyy": "^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"}


def parse_time(c: Column) -> Column:
    """Any feed date text as a UTC timestamp, NULL when it is not one.

    Takes ISO-8601, mail-style dates, dates with the month first, and dates with slashes; a time of day and a
    zone (offset or name) may follow or be missing, and none means midnight and UTC.
    """
    def read(text: Column) -> Column:
        # One spelling for all but ISO: no weekday, no comma, three letters of the month.
        plain = F.regexp_replace(text, "^(?i)(mon|tue|wed|thu|fri|sat|sun)[a-z]*[.,]* *", "")
        plain = F.regexp_replace(plain, "(?i)\\b(" + "|".join(_MONTHS) + ")[a-z]*[.]?,?", "$1")
        return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_timestamp(text)).otherwise(
            let(trim(F.regexp_replace(plain, "[, ]+", " ")), lambda p: let(_with_offset(p), _read_plain)))

    return let(trim(c), read)


def _with_offset(plain: Column) -> Column:
    """Seconds and an offset at the end, whatever of time and zone was there."""
    zone = F.upper(F.regexp_extract(plain, "(?i)[0-9] ?([a-z]{1,4})$", 1))
    offset = F.coalesce(*[F.when(zone == name, F.lit(at)) for name, at in ZONES.items()])
    text = F.when(offset.isNotNull(), F.concat(trim(F.regexp_replace(plain, "(?i)[a-z]{1,4}$", "")), F.lit(" "), offset)).otherwise(
        F.when(plain.rlike("[+-][0-9]{2}:?[0-9]{2}$"), F.regexp_replace(plain, " ?([+-][0-9]{2}):?([0-9]{2})$", " $1$2")).otherwise(F.concat(plain, F.lit(" +0000"))))
    text = F.regexp_replace(text, "^([^:]*) ([+-][0-9]{4})$", "$1 00:00:00 $2")
    return F.regexp_replace(text, "^([^:]*:[0-9]{2}) ([+-][0-9]{4})$", "$1:00 $2")


def _read_plain(text: Column) -> Column:
    return F.coalesce(*[F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(f"{day} H:mm:ss xx"))) for day, shape in _DAYS.items()])


def unread_dates(df, cols: list[str]):
    """How many non-empty texts of each column are no date, as one row."""
    return df.agg(*[F.count_if((trim(F.col(c)) != "") & parse_time(F.col(c)).isNull()).alias(c) for c in cols])


def parse_epoch_or_text(c: Column) -> Column:
    """Epoch milliseconds (as some vendors send) or date text."""
    return F.when(c.rlike("^[0-9]{9,14}$"), F.timestamp_millis(F.try_to_number(c, F.lit("99999999999999")).cast("long"))
                  ).otherwise(parse_time(c))


def effective_at(order: str) -> Column:
    return F.coalesce(*[F.col(name) for name in EFFECTIVE_ORDERS[order]])


def moment(as_of: str | dt.datetime | Column) -> Column:
    """Literal instant; text is read as UTC session time."""
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def before(as_of, days: float = 0, hours: float = 0) -> Column:
    return moment(as_of) - F.make_dt_interval(F.lit(int(days)), F.lit(int(hours)))


def iso(c: Column) -> Column:
    """UTC ISO-8601 text with milliseconds."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
