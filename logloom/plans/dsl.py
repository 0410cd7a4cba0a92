"""The JSON query form: one document, either a log search or an analytics request."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from logloom.limits import DEFAULT, Limits, RequestError
from logloom.operators.analytics import analytics, analytics_query
from logloom.operators.search import as_ndjson, log_query, search_logs

# fixed values: keys of a query document
TEXT_KEYS = ["type", "start", "end", "service", "env", "level", "error_code", "aggregation", "bucket", "value_field"]
WHOLE_KEYS = ["top_k", "limit", "page_size", "offset"]


def _document(request: str | dict, limits: Limits = DEFAULT) -> dict:
    if isinstance(request, str):
        if len(request.encode()) > limits.request_bytes:
            raise RequestError("invalid query DSL")
        try:
            request = json.loads(request)
        except ValueError as error:
            raise RequestError("invalid query DSL") from error
    if not isinstance(request, dict):
        raise RequestError("invalid query DSL")
    checks = {k: lambda v: isinstance(v, str) for k in TEXT_KEYS}
    checks |= {k: lambda v: isinstance(v, int) and not isinstance(v, bool) for k in WHOLE_KEYS}
    checks["percentile"] = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    checks["stream"] = lambda v: isinstance(v, bool)
    checks["group_by"] = lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v)
    for key, value in request.items():
        if key not in checks or (value is not None and not checks[key](value)):
            raise RequestError("invalid query DSL")
    return {k: v for k, v in request.items() if v is not None}


def _positive(value):
    return value if value and value > 0 else None


def run_query(logs: DataFrame, tenant_id: int, request: str | dict, limits: Limits = DEFAULT) -> DataFrame:
    """Run one query document for a tenant."""
    doc = _document(request, limits)
    kind = doc.get("type", "").strip().lower()
    common = {"start": doc.get("start", ""), "end": doc.get("end", ""), "limits": limits}
    if kind == "logs":
        query = log_query(
            tenant_id,
            service=doc.get("service", ""),
            level=doc.get("level", ""),
            limit=_positive(doc.get("page_size")) or _positive(doc.get("limit")),
            offset=_positive(doc.get("offset")),
            **common,
        )
        found = search_logs(logs, query)
        return as_ndjson(found) if doc.get("stream") else found
    if kind == "analytics":
        return analytics(
            logs,
            analytics_query(
                tenant_id,
                aggregation=doc.get("aggregation", ""),
                service=doc.get("service", ""),
                env=doc.get("env", ""),
                level=doc.get("level", ""),
                error_code=doc.get("error_code", ""),
                group_by=doc.get("group_by", []),
                bucket=doc.get("bucket", ""),
                top_k=_positive(doc.get("top_k")),
                percentile=_positive(doc.get("percentile")),
                value_field=doc.get("value_field", ""),
                limit=_positive(doc.get("limit")),
                **common,
            ),
        )
    raise RequestError("type must be logs or analytics")
