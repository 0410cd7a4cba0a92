"""Log search: mandatory tenant and time range, exact filters, newest first, pages."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import SAFE_KEY, free_text
from logloom.functions.timefns import as_datetime, instant
from logloom.limits import DEFAULT, Limits, RequestError
from logloom.schemas import LOG_COLUMNS



def safe_filter(value: str | None, name: str) -> str:
    value = (value or "").strip()
    if value and not re.match(SAFE_KEY.replace(r"\z", r"\Z"), value):
        raise RequestError(f"{name} contains unsupported characters")
    return value


def check_range(start, end, longest, text: str) -> tuple[datetime, datetime]:
    if start is None or start == "":
        raise RequestError("start is required")
    if end is None or end == "":
        raise RequestError("end is required")
    try:
        first = as_datetime(start)
    except ValueError as error:
        raise RequestError("start must be a valid RFC3339 timestamp") from error
    try:
        last = as_datetime(end)
    except ValueError as error:
        raise RequestError("end must be a valid RFC3339 timestamp") from error
    if not first < last:
        raise RequestError("start must be before end")
    if longest is not None and last - first > longest:
        raise RequestError(f"time range cannot exceed {text}")
    return first, last


def positive(value, default: int | None, most: int | None, name: str) -> int | None:
    """A positive whole number, at most `most`; None for a bound means there is none.
    """
    if value in (None, ""):
        return default
    try:
        number = int(value)
    except (TypeError, ValueError) as error:
        raise RequestError(f"{name} must be a positive integer") from error
    if number <= 0:
        raise RequestError(f"{name} must be a positive integer")
    return number if most is None else min(number, most)


def bounded_offset(value, most: int) -> int:
    if value in (None, ""):
        return 0
    try:
        number = int(value)
    except (TypeError, ValueError) as error:
        raise RequestError("offset must be a non-negative integer") from error
    if number < 0:
        raise RequestError("offset must be a non-negative integer")
    if number > most:
        raise RequestError("offset exceeds maximum")
    return number


def in_scope(logs: DataFrame, tenant_id: int, start, end) -> DataFrame:
    """Tenant and half-open time range, with the day range beside it where the
    table has day partitions."""
    if not tenant_id:
        raise RequestError("tenant id is required")
    first, last = as_datetime(start), as_datetime(end)
    scoped = logs.filter(
        (F.col("tenant_id") == tenant_id)
        & (F.col("timestamp") >= instant(first))
        & (F.col("timestamp") < instant(last))
    )
    if "event_date" in logs.columns:
        scoped = scoped.filter(F.col("event_date").between(first.date(), last.date()))
    return scoped


def newest_first(df: DataFrame) -> list[Column]:
    """Total order: time descending, then whatever identifies a row."""
    ties = [c for c in ("ingest_id", "fingerprint", "event_id") if c in df.columns]
    return [F.col("timestamp").desc(), *[F.col(c).desc() for c in ties]]


def oldest_first(df: DataFrame) -> list[Column]:
    ties = [c for c in ("ingest_id", "fingerprint", "event_id") if c in df.columns]
    return [F.col("timestamp").asc(), *[F.col(c).asc() for c in ties]]


@dataclass(frozen=True)
class LogQuery:
    tenant_id: int
    start: datetime
    end: datetime
    service: str = ""
    level: str = ""
    trace_id: str = ""
    limit: int = 100
    offset: int = 0


def log_query(
    tenant_id: int,
    start,
    end,
    service: str = "",
    level: str = "",
    trace_id: str = "",
    limit=None,
    offset=None,
    limits: Limits = DEFAULT,
) -> LogQuery:
    """Check the arguments of a log search."""
    first, last = check_range(start, end, limits.log_window, "7 days")
    return LogQuery(
        tenant_id,
        first,
        last,
        safe_filter(service, "service"),
        safe_filter((level or "").lower(), "level"),
        safe_filter(trace_id, "trace_id"),
        positive(limit, limits.log_page, limits.log_page_max, "limit"),
        bounded_offset(offset, limits.log_offset_max),
    )


def matching_logs(logs: DataFrame, query: LogQuery) -> DataFrame:
    found = in_scope(logs, query.tenant_id, query.start, query.end)
    for name in ("service", "level", "trace_id"):
        wanted = getattr(query, name)
        if wanted:
            found = found.filter(F.col(name) == wanted)
    return found


def search_logs(logs: DataFrame, query: LogQuery) -> DataFrame:
    """One page, newest first."""
    columns = [c for c in LOG_COLUMNS if c in logs.columns]
    extra = [c for c in ("event_id",) if c in logs.columns]
    page = matching_logs(logs, query).select(*columns, *extra)
    page = page.orderBy(*newest_first(page))
    if query.offset:
        page = page.offset(query.offset)
    return page.limit(query.limit)


def next_offset(count: int, query: LogQuery, limits: Limits = DEFAULT) -> int | None:
    """Offset of the next page; None after a short page or past the bound."""
    following = query.offset + query.limit
    return following if count == query.limit and following <= limits.log_offset_max else None


def search_after(logs: DataFrame, query: LogQuery, last_row: dict) -> DataFrame:
    """Deep paging by key: rows after `last_row` in newest-first order, without
    re-sorting everything before it."""
    found = matching_logs(logs, query)
    # the struct comparison is not pushed down to the files, these bounds are
    found = found.filter(F.col("timestamp") <= instant(last_row["timestamp"]))
    if "event_date" in logs.columns:
        found = found.filter(F.col("event_date") <= F.lit(as_datetime(last_row["timestamp"]).date()))
    keys = ["timestamp", *[c for c in ("ingest_id", "fingerprint", "event_id") if c in logs.columns]]
    after = F.struct(*keys) < F.struct(
        *[(instant(last_row[k]) if k == "timestamp" else F.lit(last_row[k])).alias(k) for k in keys]
    )
    return found.filter(after).orderBy(*newest_first(found)).limit(query.limit)


def text_search(logs: DataFrame, tenant_id: int, start, end, needle: str, level: str = "all") -> DataFrame:
    """Case-insensitive substring over service, message and trace id of a tenant's rows in [start, end)."""
    found = in_scope(logs, tenant_id, start, end).filter(free_text(["service", "message", "trace_id"], needle))
    return found if level == "all" else found.filter(F.col("level") == level)


def as_ndjson(logs: DataFrame) -> DataFrame:
    """One JSON document per row, ready for `write.text`."""
    names = [c for c in logs.columns if c != "fields_json"]
    record = F.struct(
        *names, F.coalesce(F.try_parse_json("fields_json"), F.parse_json(F.lit("{}"))).alias("fields")
    )
    return logs.select(F.to_json(record).alias("value"))


def overview(logs: DataFrame, alerts: DataFrame) -> DataFrame:
    """Headline numbers in one row: events, errors, error share, services, newest
    log, active alerts. Logs are reduced to one row per service first."""
    by_service = logs.groupBy("service").agg(
        F.count("*").alias("events"),
        F.count_if(F.col("level") == "error").alias("errors"),
        F.max("timestamp").alias("newest"),
    )
    parts = by_service.select(
        "events", "errors", F.lit(1).cast("bigint").alias("services"), "newest",
        F.lit(0).cast("bigint").alias("active"),
    ).unionByName(
        alerts.groupBy("status").count().filter(F.col("status") == "firing").select(
            F.lit(0).cast("bigint").alias("events"),
            F.lit(0).cast("bigint").alias("errors"),
            F.lit(0).cast("bigint").alias("services"),
            F.lit(None).cast("timestamp").alias("newest"),
            F.col("count").alias("active"),
        )
    )

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).alias(name)

    sums = parts.agg(
        total("events"), total("errors"), total("services"),
        F.max("newest").alias("newest"), total("active"),
    )
    share = F.when(F.col("events") > 0, F.round(F.col("errors") * 100.0 / F.col("events"), 1))
    return sums.select(
        "events", "errors", F.coalesce(share, F.lit(0.0)).cast("double").alias("error_percent"),
        "services", "newest", F.col("active").alias("active_alerts"),
    )
