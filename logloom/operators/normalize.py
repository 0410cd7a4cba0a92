"""From accepted raw batches to normalised log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.hashing import log_fingerprint
from logloom.functions.jsonfields import (
    HOST_KEYS,
    TRACE_KEYS,
    json_string,
    loose_keys,
    matching_keys,
    sorted_json,
    value_map,
    value_text,
    without_keys,
)
from logloom.functions.templates import message_template, template_id
from logloom.functions.text import canon_tag, stored_level, trim_all
from logloom.functions.timefns import parse_instant, to_millis
from logloom.operators.binding import bind
from logloom.schemas import LOG_COLUMNS, RAW_VERSION

SEPARATORS = "-_"


def extract_field(fields: Column, loose: Column, names: list[str]) -> tuple[Column, Column]:
    """(value, matched keys): trimmed text under the smallest matching key."""
    keys = matching_keys(loose, names, SEPARATORS)
    first = F.get(keys, F.lit(0))
    return F.coalesce(trim_all(value_text(F.try_element_at(fields, first))), F.lit("")), keys


# fixed values: texts of contract breaches, which dead letters carry
def contract_error() -> Column:
    """First breach of the raw batch contract, NULL if there is none."""

    def blank(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) == ""

    return F.coalesce(
        F.when(~F.col("schema_version").eqNullSafe(F.lit(RAW_VERSION)), "invalid schema version"),
        F.when(blank("request_id"), "request_id is required"),
        F.when(blank("fingerprint"), "fingerprint is required"),
        F.when(blank("received_at"), "received_at is required"),
        F.when(F.coalesce("tenant_id", F.lit(0)) == 0, "tenant_id is required"),
        F.when(blank("service"), "service is required"),
        F.when(blank("env"), "env is required"),
        F.when(F.coalesce(F.size("logs"), F.lit(0)) <= 0, "at least one log entry is required"),
    )


def _bad_time(record: Column) -> Column:
    text = trim_all(F.coalesce(record["timestamp"], F.lit("")))
    return (text != "") & parse_instant(text).isNull()


def _bad_fields(record: Column) -> Column:
    text = record["fields"]
    return text.isNotNull() & value_map(text).isNull()


def batch_error() -> Column:
    """Contract breach, unreadable received_at, or any unreadable record: one bad
    record rejects the whole batch."""
    contract = contract_error()
    return F.coalesce(
        F.when(contract.isNotNull(), F.concat(F.lit("invalid logs.raw event: "), contract)),
        F.when(parse_instant("received_at").isNull(), "normalize logs.raw event: parse received_at"),
        F.when(F.exists("logs", _bad_time), "normalize logs.raw event: parse log timestamp"),
        F.when(F.exists("logs", _bad_fields), "normalize logs.raw event: decode log fields"),
    )


def correlation_defaults(batches: DataFrame, header_request: str, header_trace: str) -> DataFrame:
    """Correlation id from the batch, else the request header, else request_id;
    trace id from the batch, else the trace header."""

    def first_text(*values: Column) -> Column:
        return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))

    return batches.withColumn(
        "correlation_id",
        first_text(F.col("correlation_id"), trim_all(header_request), F.col("request_id")),
    ).withColumn("trace_id", first_text(F.col("trace_id"), trim_all(header_trace)))


def record_json(record: Column) -> Column:
    """JSON text of one raw record, the text its stored size is measured on."""
    parts = [
        F.lit('{"timestamp":'), json_string(F.coalesce(record["timestamp"], F.lit(""))),
        F.lit(',"level":'), json_string(F.coalesce(record["level"], F.lit(""))),
        F.lit(',"message":'), json_string(F.coalesce(record["message"], F.lit(""))),
    ]
    fields = F.coalesce(F.nullif(record["fields"], F.lit("{}")), F.lit(""))
    tail = F.when(fields == "", F.lit("}")).otherwise(F.concat(F.lit(',"fields":'), fields, F.lit("}")))
    return F.concat(*parts, tail)


def normalize_batches(batches: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Explode valid batches to log rows. Filter on `batch_error()` IS NULL first."""
    extra = [F.col(c) for c in keep or []]
    rows = batches.select(
        "request_id",
        "tenant_id",
        F.coalesce("trace_id", F.lit("")).alias("batch_trace"),
        parse_instant("received_at").alias("received"),
        canon_tag("service").alias("service"),
        canon_tag("env").alias("environment"),
        canon_tag(F.coalesce("source", F.lit(""))).alias("source"),
        *extra,
        F.posexplode("logs").alias("position", "record"),
    )
    record = F.col("record")
    fields, message = F.col("_fields"), F.col("_message")
    parsed = bind(rows, "_fields", value_map(F.coalesce(record["fields"], F.lit("{}"))))
    parsed = parsed.withColumn("_message", trim_all(F.coalesce(record["message"], F.lit(""))))
    parsed = bind(parsed, "_loose", loose_keys(fields, SEPARATORS))
    host, host_keys = extract_field(fields, F.col("_loose"), HOST_KEYS)
    trace, trace_keys = extract_field(fields, F.col("_loose"), TRACE_KEYS)
    parsed = bind(parsed, "_dropped", F.concat(host_keys, trace_keys))
    built = parsed.select(
        to_millis(
            F.coalesce(parse_instant(F.coalesce(record["timestamp"], F.lit(""))), F.col("received"))
        ).alias("timestamp"),
        "tenant_id",
        "service",
        "environment",
        "source",
        host.alias("host"),
        stored_level(record["level"]).alias("level"),
        F.coalesce(F.nullif(trace, F.lit("")), trim_all("batch_trace")).alias("trace_id"),
        message.alias("message"),
        message_template(message).alias("message_template"),
        sorted_json(without_keys(fields, F.col("_dropped"))).alias("fields_json"),
        F.col("request_id").alias("ingest_id"),
        F.octet_length(record_json(record)).cast("bigint").alias("raw_size_bytes"),
        "position",
        *[F.col(c) for c in keep or []],
    )
    hashed = built.withColumn("template_id", template_id(F.col("message_template"))).withColumn(
        "fingerprint",
        log_fingerprint("service", "environment", "source", "level", "message", "fields_json"),
    )
    return hashed.select(*LOG_COLUMNS, "position", *(keep or []))


def with_templates(logs: DataFrame) -> DataFrame:
    """Add message_template, template_id and fingerprint to rows that lack them."""
    built = logs.withColumn("message_template", message_template(F.col("message")))
    return built.withColumn("template_id", template_id(F.col("message_template"))).withColumn(
        "fingerprint",
        log_fingerprint("service", "environment", "source", "level", "message", "fields_json"),
    )
