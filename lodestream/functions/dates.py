"""Dates and times as column expressions; the session's zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_text(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd")


def month_text(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM")


def day(epoch: Column) -> Column:
    return F.to_date(F.timestamp_seconds(epoch))


def filename_epoch(name: Column) -> Column:
    """Epoch of a date in a file name: YYYYMMDD[_T]HHMMSS between non-digits, else YYYY-MM-DD; else null."""
    long = F.regexp_extract(name, r"(?<!\d)(\d{8})[_T]?(\d{6})(?!\d)", 0)
    digits = F.regexp_replace(long, "[_T]", "")
    short = F.regexp_extract(name, r"(?<!\d)(\d{4}-\d{2}-\d{2})(?!\d)", 1)
    return F.coalesce(F.unix_seconds(F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMddHHmmss"))), F.unix_seconds(F.try_to_timestamp(F.nullif(short, F.lit("")), F.lit("yyyy-MM-dd"))))


def exif_epoch(text: Column) -> Column:
    return F.unix_seconds(F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")))


def iso_display(iso: Column) -> Column:
    """Like "Jan 5, 3:07 PM"; the text itself if it isn't a time."""
    at = F.try_to_timestamp(F.regexp_replace(iso, "Z$", "+00:00"))
    return F.coalesce(F.date_format(at, "MMM d, h:mm a"), iso)


def date_label(iso: Column) -> Column:
    """Month and year of an ISO date, else its first seven characters."""
    return F.coalesce(F.date_format(F.try_to_timestamp(iso), "MMM yyyy"), F.left(iso, F.lit(7)))


def takeout_time(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(F.coalesce(epoch, F.lit(0))), "MMM d, yyyy, h:mm:ss a 'UTC'")
