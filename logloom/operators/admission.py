"""Admission of ingest batches: validate, authorise, limit, fingerprint, count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.hashing import short_sha
from logloom.functions.jsonfields import canonical_fields, fields_error, json_string
from logloom.functions.text import canon_tag, ingest_level, is_safe_tag, trim_all
from logloom.functions.timefns import parse_instant
from logloom.limits import DEFAULT, Limits
from logloom.operators.binding import bind
from logloom.operators.skew import admit_first, lookup_join
from logloom.schemas import INGEST_VERSION, RAW_VERSION

# fixed values: admission outcomes
OUTCOMES = [
    "authorized",
    "missing_api_key",
    "invalid_api_key",
    "forbidden_scope",
    "backend_error",
    "authenticator_unavailable",
    "rate_limited",
    "request_body_too_large",
    "invalid_request_body",
    "batch_too_large",
]


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


# fixed values: texts of complaints about batches and records, which callers match on
def record_error(record: Column) -> Column:
    """First complaint about one record (fields as a map of typed values)."""
    stamp = trim_all(_text(record["timestamp"]))
    return F.coalesce(
        F.when(stamp == "", "timestamp is required"),
        F.when(parse_instant(stamp).isNull(), "timestamp must be RFC3339"),
        F.when(ingest_level(_text(record["level"])).isNull(), "level is unsupported"),
        F.when(trim_all(_text(record["message"])) == "", "message is required"),
        fields_error(record["fields"]),
    )


def batch_validation_error(limits: Limits = DEFAULT) -> Column:
    """First complaint about a decoded batch, NULL if it is fine."""

    def tag_error(name: str) -> Column:
        tag = canon_tag(_text(F.col(name)))
        return F.when(tag == "", f"{name} is required").when(
            ~is_safe_tag(tag), f"{name} contains unsupported characters"
        )

    version = trim_all(_text(F.col("schema_version")))
    count = F.greatest(F.coalesce(F.size("logs"), F.lit(0)), F.lit(0))

    def numbered(record: Column, index: Column) -> Column:
        return F.concat(
            F.lit("log["), index.cast("string"), F.lit("]: "), record_error(record)
        )

    complaints = F.filter(F.transform("logs", numbered), lambda c: c.isNotNull())
    return F.coalesce(
        F.when(version == "", "schema_version is required"),
        F.when(
            version != INGEST_VERSION,
            F.concat(F.lit("unsupported schema_version "), json_string(version)),
        ),
        tag_error("service"),
        tag_error("env"),
        tag_error("source"),
        F.when(count == 0, "at least one log entry is required"),
        F.when(count > limits.batch_logs, f"batch exceeds {limits.batch_logs} log entries"),
        F.get(complaints, F.lit(0)),
    )


def canonical_record(record: Column) -> Column:
    """Canonical form of a valid record."""
    instant = parse_instant(record["timestamp"])
    digits = F.regexp_replace(F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0+$", "")
    # a whole second loses its fraction only, never seconds that end in zero
    whole = F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss")
    stamp = F.when(F.unix_micros(instant) % 1_000_000 == 0, whole).otherwise(digits)
    return F.struct(
        F.concat(stamp, F.lit("Z")).alias("timestamp"),
        ingest_level(record["level"]).alias("level"),
        trim_all(record["message"]).alias("message"),
        F.nullif(canonical_fields(record["fields"]), F.lit("{}")).alias("fields"),
    )


def validate_batches(batches: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Add `decision` (accepted / rejected) and `reason`; never throws."""
    error = batch_validation_error(limits)
    if "decode_error" in batches.columns:
        error = F.coalesce("decode_error", error)
    return bind(batches, "reason", error).withColumn(
        "decision", F.when(F.col("reason").isNull(), "accepted").otherwise("rejected")
    )


def canonical_batches(accepted: DataFrame) -> DataFrame:
    """Canonical tags and records of batches that passed validation."""
    for name in ("service", "env", "source"):
        accepted = accepted.withColumn(name, canon_tag(name))
    return bind(accepted, "logs", F.transform("logs", canonical_record))


def batch_fingerprint() -> Column:
    """Hash of the canonical batch with its tenant: equal content, equal hash."""

    def item(record: Column) -> Column:
        return F.concat(
            F.lit('{"timestamp":'), json_string(record["timestamp"]),
            F.lit(',"level":'), json_string(record["level"]),
            F.lit(',"message":'), json_string(record["message"]),
            F.coalesce(F.concat(F.lit(',"fields":'), record["fields"]), F.lit("")),
            F.lit("}"),
        )

    return short_sha(
        F.concat(
            F.lit('{"tenant_id":'), F.col("tenant_id").cast("string"),
            F.lit(',"service":'), json_string(F.col("service")),
            F.lit(',"env":'), json_string(F.col("env")),
            F.lit(',"source":'), json_string(F.col("source")),
            F.lit(',"logs":['), F.array_join(F.transform("logs", item), ","), F.lit("]}"),
        )
    )


def to_raw_events(canonical: DataFrame, received_at: Column) -> DataFrame:
    """Envelope of an accepted batch; the fingerprint doubles as request id."""
    columns = canonical.columns
    header = {
        "correlation_id": "header_request_id",
        "trace_id": "header_trace_id",
    }
    marked = bind(canonical, "fingerprint", batch_fingerprint())
    carried = [
        (F.col(source) if source in columns else F.lit("")).alias(name)
        for name, source in header.items()
    ]
    return marked.select(
        F.lit(RAW_VERSION).alias("schema_version"),
        F.col("fingerprint").alias("request_id"),
        *carried,
        "fingerprint",
        received_at.alias("received_at"),
        F.col("tenant_id").cast("bigint").alias("tenant_id"),
        "service",
        "env",
        "source",
        "logs",
    )


def key_hash(api_key: Column) -> Column:
    return F.sha2(api_key, 256)


def _active_keys(api_keys: DataFrame) -> DataFrame:
    return api_keys.filter(F.col("status") == "active").select(
        "key_hash",
        F.col("id").alias("api_key_id"),
        F.col("tenant_id").alias("key_tenant"),
        F.col("service_id").alias("key_service"),
        F.col("rate_limit_per_sec").alias("rate_limit"),
    )


def resolve_tenant(requests: DataFrame, api_keys: DataFrame, key: str = "api_key") -> DataFrame:
    """Add the tenant of an active key, NULL where the key is unknown or inactive."""
    keyed = requests.withColumn("key_hash", key_hash(F.col(key)))
    found = lookup_join(keyed, _active_keys(api_keys), ["key_hash"], how="left")
    tenant = F.when(F.col("key_tenant") > 0, F.col("key_tenant"))
    return found.withColumn("resolved_tenant", tenant).drop(
        "key_hash", "key_tenant", "key_service", "rate_limit"
    )


def authorize(
    requests: DataFrame, api_keys: DataFrame, services: DataFrame, key: str = "api_key"
) -> DataFrame:
    """Add outcome, api_key_id, tenant_id, service_id and rate_limit.

    No key, an unknown or inactive key: invalid. No such service for the tenant,
    or a key pinned to another service: forbidden.
    """
    keyed = requests.withColumn("key_hash", key_hash(trim_all(_text(F.col(key)))))
    found = lookup_join(keyed, _active_keys(api_keys), ["key_hash"], how="left")
    known = services.select(
        F.col("tenant_id").alias("key_tenant"),
        F.col("name").alias("service"),
        F.col("environment").alias("env"),
        F.col("id").alias("found_service"),
    )
    pinned = F.col("l.key_service").isNull() | (F.col("r.found_service") == F.col("l.key_service"))
    scoped = lookup_join(
        found, known, ["key_tenant", "service", "env"], condition=pinned, how="left"
    )
    outcome = (
        F.when(trim_all(_text(F.col(key))) == "", "missing_api_key")
        .when(F.col("api_key_id").isNull(), "invalid_api_key")
        .when(F.col("found_service").isNull(), "forbidden_scope")
        .otherwise("authorized")
    )
    return (
        scoped.withColumn("outcome", outcome)
        .withColumnRenamed("key_tenant", "tenant_id")
        .withColumnRenamed("found_service", "service_id")
        .drop("key_hash", "key_service")
    )


def rate_limit(
    requests: DataFrame,
    key: str = "api_key_id",
    limit: str = "rate_limit",
    arrival: str = "received_at",
    ties: list[str] | None = None,
    spent: DataFrame | None = None,
) -> DataFrame:
    """Add `admitted`: the first `limit` requests of a key in each whole second.
    A limit or key that is not positive always admits.

    `spent` (key, second, used) has requests admitted before these, as `spending` counts them.
    """
    unlimited = (F.coalesce(key, F.lit(0)) <= 0) | (F.coalesce(limit, F.lit(0)) <= 0)
    free = requests.filter(unlimited).withColumn("admitted", F.lit(True))
    bound = requests.filter(~unlimited).withColumn("_second", F.date_trunc("second", arrival))
    if spent is not None:
        used = spent.groupBy(key, F.col("second").alias("_second")).agg(F.sum("used").alias("_used"))
        bound = lookup_join(bound, used, [key, "_second"], how="left")
    else:
        bound = bound.withColumn("_used", F.lit(0))
    bound = bound.withColumn("_left", F.col(limit) - F.coalesce("_used", F.lit(0)))
    ranked = admit_first(bound, [key, "_second"], [arrival, *(ties or [])], "_left", "admitted")
    return ranked.drop("_second", "_used", "_left").unionByName(free)


def spending(limited: DataFrame, key: str = "api_key_id", limit: str = "rate_limit", arrival: str = "received_at") -> DataFrame:
    """Admitted requests per key and second: (key, second, used), for keys with a limit."""
    counted = limited.filter(F.col("admitted") & (F.col(key) > 0) & (F.col(limit) > 0))
    return counted.groupBy(key, F.date_trunc("second", arrival).alias("second")).agg(F.count("*").alias("used"))


def key_last_used(api_keys: DataFrame, authorized: DataFrame, arrival: str = "received_at") -> DataFrame:
    """Keys with last_used_at raised to the newest authorised request."""
    used = (
        authorized.filter(F.col("outcome") == "authorized")
        .groupBy(F.col("api_key_id").alias("id"))
        .agg(F.max(arrival).alias("_used"))
    )
    old = F.col("last_used_at") if "last_used_at" in api_keys.columns else F.lit(None).cast("timestamp")
    return (
        api_keys.withColumn("last_used_at", old)
        .join(used, "id", "left")
        .withColumn("last_used_at", F.greatest("last_used_at", "_used"))
        .drop("_used")
    )


def outcome_counts(requests: DataFrame) -> DataFrame:
    """Requests per outcome, and accepted batches, logs and bytes.

    Expects outcome, log_count and body_bytes.
    """
    accepted = F.col("outcome") == "authorized"
    return requests.groupBy("outcome").agg(
        F.count("*").alias("requests"),
        F.sum(F.when(accepted, 1).otherwise(0)).alias("accepted_batches"),
        F.sum(F.when(accepted, F.greatest("log_count", F.lit(0))).otherwise(0)).alias("accepted_logs"),
        F.sum(F.when(accepted, F.greatest("body_bytes", F.lit(0))).otherwise(0)).alias("accepted_bytes"),
    )
