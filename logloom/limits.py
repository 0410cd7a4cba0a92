"""Request bounds. They protect a shared service; a batch job may lift any of them."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta


@dataclass(frozen=True)
class Limits:
    # fixed values: request bounds
    log_window: timedelta | None = timedelta(days=7)
    log_page: int = 100
    log_page_max: int = 1000
    log_offset_max: int = 10_000
    analytics_window: timedelta | None = timedelta(days=31)
    analytics_buckets: int = 5000
    analytics_groups: int = 3
    top_k_max: int = 100
    graph_window: timedelta | None = timedelta(hours=24)
    graph_rows: int | None = 5000
    graph_rows_max: int | None = 10_000
    identifier_chars: int = 256
    history_window: timedelta | None = timedelta(days=90)
    history_page_max: int = 500
    batch_bytes: int = 1 << 20
    batch_logs: int = 1000
    template_rows: int = 5
    incident_rows: int = 100
    rule_page_max: int = 500
    delivery_batch_max: int = 500
    request_bytes: int = 64 * 1024


DEFAULT = Limits()
UNBOUNDED = Limits(
    log_window=None,
    log_page_max=2**31 - 1,
    log_offset_max=2**31 - 1,
    analytics_window=None,
    analytics_buckets=2**31 - 1,
    top_k_max=2**31 - 1,
    graph_window=None,
    graph_rows=None,
    graph_rows_max=None,
    history_window=None,
    history_page_max=2**31 - 1,
    analytics_groups=2**31 - 1,
    identifier_chars=2**31 - 1,
    batch_bytes=2**31 - 1,
    batch_logs=2**31 - 1,
    rule_page_max=2**31 - 1,
    delivery_batch_max=2**31 - 1,
    request_bytes=2**31 - 1,
)


class RequestError(ValueError):
    """A request argument is missing, malformed or out of bounds."""
