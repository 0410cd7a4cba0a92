"""Retry timing and notification targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.text import blank_to_null

# fixed values: delivery policy defaults
BASE_DELAY_MS = 30_000
MAX_DELAY_MS = 1_800_000
MAX_ATTEMPTS = 5
LEASE_SECONDS = 120
DELIVERY_BATCH = 50
CHANNEL = "log"


def retry_delay_ms(
    delivery_id: Column,
    attempt: Column,
    base_ms: int = BASE_DELAY_MS,
    max_ms: int = MAX_DELAY_MS,
) -> Column:
    """Doubling delay with a stable jitter of up to a tenth, kept in [base, max]."""
    base = base_ms if base_ms > 0 else BASE_DELAY_MS
    top = max_ms if max_ms >= base else MAX_DELAY_MS
    doublings = F.least(F.greatest(attempt.cast("bigint") - 1, F.lit(0)), F.lit(40))
    delay = F.least(F.lit(float(base)) * F.pow(F.lit(2.0), doublings), F.lit(float(top))).cast("bigint")
    # reduced before multiplying: ids may use all 64 bits
    small_id, small_try = (F.pmod(c.cast("bigint"), F.lit(201)) for c in (delivery_id, attempt))
    jitter = F.pmod(small_id * 31 + small_try * 17, F.lit(201)) - 100
    # nanoseconds, truncated towards zero like integer division
    step_ns = F.floor(delay * F.lit(1_000_000) / 10)
    offset_ns = F.when(jitter >= 0, F.floor(jitter * step_ns / 100)).otherwise(
        -F.floor(-jitter * step_ns / 100)
    )
    moved = F.floor((delay * F.lit(1_000_000) + offset_ns) / 1_000_000)
    return F.greatest(F.lit(base), F.least(F.lit(top), moved)).cast("bigint")


def notification_target(owner: Column, service: Column, environment: Column, tenant_id: Column) -> Column:
    """Owner, else service with environment, else service, else the tenant."""
    name, env = blank_to_null(service), blank_to_null(environment)
    return F.coalesce(
        blank_to_null(owner),
        F.concat(name, F.lit(":"), env),
        name,
        F.concat(F.lit("tenant:"), tenant_id.cast("string")),
    )
