"""Instants, buckets and their text forms."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.text import as_col, trim_all

RFC3339 = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})\z"
BUCKET_SECONDS = {"minute": 60, "hour": 3600, "day": 86400}


def parse_instant(value: Column | str) -> Column:
    """RFC 3339 text to an instant; NULL for anything else."""
    text = trim_all(value)
    # more than six fractional digits are cut, the store keeps milliseconds
    short = F.regexp_replace(F.replace(text, F.lit(","), F.lit(".")), r"(\.\d{6})\d+", "$1")
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(short))


def to_millis(value: Column | str) -> Column:
    return F.date_trunc("millisecond", as_col(value))


def instant(value: datetime | str) -> Column:
    """A literal instant at millisecond precision."""
    return to_millis(F.lit(as_datetime(value)))


def as_datetime(value: datetime | str) -> datetime:
    if isinstance(value, str):
        if not re.match(RFC3339.replace(r"\z", r"\Z"), value.strip()):
            raise ValueError(f"not an RFC3339 timestamp: {value!r}")
        value = datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
    if value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    return value.astimezone(timezone.utc)


def bucket_start(value: Column | str, bucket: str) -> Column:
    return F.date_trunc(bucket, as_col(value))


def iso_seconds(value: Column | str) -> Column:
    return F.date_format(as_col(value), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_millis(value: Column | str) -> Column:
    return F.date_format(as_col(value), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def plus_seconds(value: Column | str, seconds: Column | int) -> Column:
    seconds = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_micros(F.unix_micros(as_col(value)) + seconds.cast("bigint") * 1_000_000)


def epoch_slice(value: Column | str, seconds: int) -> Column:
    """Number of the fixed-width time slice an instant falls into."""
    return F.floor(F.unix_seconds(as_col(value)) / seconds).cast("bigint")
