"""Counts, rates and percentiles over the log table, by time bucket and group."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.jsonfields import field_number, field_text
from logloom.functions.text import SAFE_KEY
from logloom.functions.timefns import BUCKET_SECONDS, bucket_start, instant, iso_seconds
from logloom.limits import DEFAULT, Limits, RequestError
from logloom.operators.quantiles import exact_quantile
from logloom.operators.search import check_range, in_scope, positive, safe_filter

GROUP_FIELDS = {"service": "service", "env": "environment", "level": "level", "error_code": None}


@dataclass(frozen=True)
class AnalyticsQuery:
    tenant_id: int
    start: datetime
    end: datetime
    aggregation: str
    service: str = ""
    environment: str = ""
    level: str = ""
    error_code: str = ""
    group_by: tuple[str, ...] = field(default_factory=tuple)
    bucket: str = ""
    top_k: int = 0
    percentile: float = 0.0
    value_field: str = ""
    limit: int = 100


def _group_fields(values) -> tuple[str, ...]:
    parts = values.split(",") if isinstance(values, str) else list(values or [])
    names: list[str] = []
    for part in parts:
        name = part.strip().lower()
        if name and name not in GROUP_FIELDS:
            raise RequestError("group_by contains unsupported field")
        if name and name not in names:
            names.append(name)
    return tuple(names)


def is_value_field(name: str) -> bool:
    if name == "raw_size_bytes":
        return True
    pattern = SAFE_KEY.replace(r"\z", r"\Z")
    return name.startswith("field.") and re.match(pattern, name[len("field.") :]) is not None


def analytics_query(
    tenant_id: int,
    start,
    end,
    aggregation: str,
    service: str = "",
    env: str = "",
    level: str = "",
    error_code: str = "",
    group_by=(),
    bucket: str = "",
    top_k=None,
    percentile=None,
    value_field: str = "",
    limit=None,
    limits: Limits = DEFAULT,
) -> AnalyticsQuery:
    """Check the arguments of an analytics request."""
    first, last = check_range(start, end, limits.analytics_window, "31 days")
    aggregation = (aggregation or "").strip().lower()
    if aggregation not in ("count", "rate", "percentile"):
        raise RequestError("aggregation must be one of count, rate, or percentile")
    filters = (
        safe_filter(service, "service"),
        safe_filter(env, "env"),
        safe_filter((level or "").lower(), "level"),
        safe_filter(error_code, "error_code"),
    )
    groups = _group_fields(group_by)
    if len(groups) > limits.analytics_groups:
        raise RequestError("group_by cannot contain more than 3 fields")
    bucket = (bucket or "").strip().lower()
    if bucket and bucket not in BUCKET_SECONDS:
        raise RequestError("bucket must be one of minute, hour, or day")
    if bucket:
        spans = (last - first).total_seconds() // BUCKET_SECONDS[bucket] + 1
        if spans > limits.analytics_buckets:
            raise RequestError("bucketed query would produce too many time buckets")
    top = 0
    if top_k not in (None, ""):
        top = positive(top_k, 0, limits.top_k_max, "top_k")
        if not groups:
            raise RequestError("top_k requires at least one group_by field")
        if bucket:
            raise RequestError("top_k does not support time bucketing")
    rows = top or positive(limit, limits.log_page, limits.log_page_max, "limit")
    if aggregation == "rate" and not bucket:
        raise RequestError("rate aggregation requires a bucket")
    share, value_name = 0.0, ""
    if aggregation == "percentile":
        if percentile in (None, ""):
            raise RequestError("percentile is required for percentile aggregation")
        try:
            share = float(percentile)
        except (TypeError, ValueError) as error:
            raise RequestError("percentile must be a number between 0 and 100") from error
        if not 0 < share < 100:
            raise RequestError("percentile must be a number between 0 and 100")
        value_name = (value_field or "").strip()
        if not is_value_field(value_name):
            raise RequestError("value_field must be raw_size_bytes or field.<name>")
    return AnalyticsQuery(
        tenant_id, first, last, aggregation, *filters, groups, bucket, top, share, value_name, rows
    )


def error_code(logs: DataFrame) -> Column:
    """The stored column where the table has one, else read from the JSON text."""
    if "error_code" in logs.columns:
        return F.col("error_code")
    return field_text("fields_json", "error_code")


def _value(name: str) -> Column:
    if name == "raw_size_bytes":
        return F.col("raw_size_bytes").cast("double")
    return field_number("fields_json", name[len("field.") :])


def analytics(logs: DataFrame, query: AnalyticsQuery, approximate: bool = False) -> DataFrame:
    """bucket?, group_*, value. Exact percentiles by default; `approximate` uses a
    mergeable sketch with one shuffle of partial states."""
    found = in_scope(logs, query.tenant_id, query.start, query.end)
    for name in ("service", "environment", "level"):
        if getattr(query, name):
            found = found.filter(F.col(name) == getattr(query, name))
    if query.error_code:
        found = found.filter(error_code(logs) == query.error_code)

    groups: list[Column] = []
    if query.bucket:
        groups.append(bucket_start("timestamp", query.bucket).alias("bucket"))
    for name in query.group_by:
        source = GROUP_FIELDS[name]
        groups.append((F.col(source) if source else error_code(logs)).alias(f"group_{name}"))
    names = (["bucket"] if query.bucket else []) + [f"group_{g}" for g in query.group_by]

    if query.aggregation == "percentile":
        rows = found.select(*groups, _value(query.value_field).alias("_v"))
        if approximate:
            share = query.percentile / 100
            result = rows.groupBy(*names).agg(F.percentile_approx("_v", share).alias("value"))
        else:
            result = exact_quantile(rows, names, "_v", query.percentile)
            if not names:
                result = result.agg(F.max("value").alias("value"))
    else:
        count = F.count("*").cast("double")
        if query.aggregation == "rate":
            count = count / F.lit(BUCKET_SECONDS[query.bucket])
        result = found.groupBy(*groups).agg(count.alias("value"))

    if query.top_k:
        order = [F.col("value").desc_nulls_last(), *[F.col(n).asc() for n in names]]
    else:
        order = [F.col(n).desc() if n == "bucket" else F.col(n).asc() for n in names]
    if order:
        result = result.orderBy(*order).limit(query.limit)
    value = F.coalesce("value", F.lit(0.0)).alias("value")
    shown = [iso_seconds(n).alias(n) if n == "bucket" else F.col(n) for n in names]
    return result.select(*shown, value)


def volume_series(logs: DataFrame, tenant_id: int, start, end, bucket: str) -> DataFrame:
    """Events and error events per bucket, with empty buckets filled in."""
    counts = (
        in_scope(logs, tenant_id, start, end)
        .groupBy(bucket_start("timestamp", bucket).alias("bucket"))
        .agg(F.count("*").alias("events"), F.count_if(F.col("level") == "error").alias("errors"))
    )
    step = F.expr(f"interval {BUCKET_SECONDS[bucket]} seconds")
    # one literal row: the time axis, bounded by the requested range
    axis = logs.sparkSession.range(1).select(
        F.explode(
            F.sequence(
                bucket_start(instant(start), bucket),
                bucket_start(F.timestamp_micros(F.unix_micros(instant(end)) - 1), bucket),
                step,
            )
        ).alias("bucket")
    )
    return (
        axis.join(counts, "bucket", "left")
        .select(
            "bucket",
            F.coalesce("events", F.lit(0)).alias("events"),
            F.coalesce("errors", F.lit(0)).alias("errors"),
        )
        .orderBy("bucket")
    )
