"""Table schemas."""

from __future__ import annotations

# One normalised log row.
LOGS = (
    "timestamp timestamp, tenant_id bigint, service string, environment string, source string, "
    "host string, level string, trace_id string, fingerprint string, message string, "
    "message_template string, template_id string, fields_json string, ingest_id string, "
    "raw_size_bytes bigint"
)
LOG_COLUMNS = [part.split()[0] for part in LOGS.split(", ")]

# One accepted batch on the durable queue. `fields` stays JSON text per record.
RECORD = "struct<timestamp:string,level:string,message:string,fields:string>"
RAW_EVENTS = (
    "schema_version string, request_id string, correlation_id string, trace_id string, "
    "fingerprint string, received_at string, tenant_id bigint, service string, env string, "
    f"source string, logs array<{RECORD}>"
)

DEAD_LETTERS = (
    "schema_version string, failed_at timestamp, reason string, error string, request_id string, "
    "tenant_id bigint, service string, env string, source string, attempts bigint, "
    "raw_payload binary, event string"
)

# fixed values: contract versions
INGEST_VERSION = "logs.ingest.v1"
RAW_VERSION = "logs.raw.v1"
DEAD_LETTER_VERSION = "logs.dlq.v1"
