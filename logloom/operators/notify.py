"""Notification outbox: enqueue, pick due rows, apply attempt results."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions import retry
from logloom.functions.hashing import stable_id
from logloom.functions.timefns import instant, plus_seconds
from logloom.limits import DEFAULT, Limits
from logloom.operators.lifecycle import group_map
from logloom.operators.skew import carry_forward, lookup_join

DELIVERY_COLUMNS = [
    "id", "alert_instance_id", "tenant_id", "rule_id", "channel", "target", "status",
    "attempt_count", "max_attempts", "available_at", "next_retry_at", "locked_at", "locked_by",
    "last_error", "sent_at", "created_at", "updated_at", "payload_json",
]


def enqueue(events: DataFrame, rules: DataFrame) -> DataFrame:
    """A pending delivery for every triggered and resolved event.

    `events` come from the lifecycle; `rules` are active rules with the name,
    environment and owner of their service.
    """
    owners = rules.select(
        F.col("id").alias("rule_id"), "service_name", "environment", "owner"
    )
    due = events.filter(F.col("event_type").isin("triggered", "resolved"))
    sent = lookup_join(due, owners, ["rule_id"])
    target = retry.notification_target(
        F.col("owner"), F.col("service_name"), F.col("environment"), F.col("tenant_id")
    )
    resolved = F.col("event_type") == "resolved"
    payload = F.to_json(
        F.struct(
            "rule_id",
            "rule_name",
            "severity",
            "event_type",
            "status",
            "dedupe_key",
            F.when(resolved, "").otherwise(F.col("dedupe_key")).alias("group_key"),
            F.when(~resolved, group_map(F.col("dedupe_key"))).alias("group"),
            F.coalesce("match_count", F.lit(0)).alias("match_count"),
            F.nullif("service_name", F.lit("")).alias("service"),
            F.nullif("environment", F.lit("")).alias("environment"),
            "target",
            F.lit(retry.CHANNEL).alias("channel"),
            F.date_format("tick", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("observed_at_utc"),
        )
    )
    nothing = F.lit(None)
    return (
        sent.withColumn("target", target)
        .withColumn("payload_json", payload)
        .select(
            stable_id(
                F.lit("delivery"), F.col("rule_id"), F.col("dedupe_key"), F.unix_seconds("tick")
            ).alias("id"),
            stable_id(F.col("rule_id"), F.col("dedupe_key")).alias("alert_instance_id"),
            "tenant_id",
            "rule_id",
            F.lit(retry.CHANNEL).alias("channel"),
            "target",
            F.lit("pending").alias("status"),
            F.lit(0).alias("attempt_count"),
            F.lit(retry.MAX_ATTEMPTS).alias("max_attempts"),
            F.col("tick").alias("available_at"),
            nothing.cast("timestamp").alias("next_retry_at"),
            nothing.cast("timestamp").alias("locked_at"),
            nothing.cast("string").alias("locked_by"),
            nothing.cast("string").alias("last_error"),
            nothing.cast("timestamp").alias("sent_at"),
            F.col("tick").alias("created_at"),
            F.col("tick").alias("updated_at"),
            "payload_json",
        )
    )


def enqueued_events(deliveries: DataFrame) -> DataFrame:
    """The `notification_enqueued` event of each delivery: its payload with the id."""
    body = F.concat(
        F.lit('{"delivery_id":'), F.col("id").cast("string"), F.lit(","),
        F.substring("payload_json", F.lit(2), F.length("payload_json")),
    )
    return deliveries.select(
        stable_id(F.lit("enqueued"), F.col("id")).alias("id"),
        "alert_instance_id",
        "tenant_id",
        "rule_id",
        F.lit("notification_enqueued").alias("event_type"),
        body.alias("payload_json"),
        "created_at",
    )


def due(
    deliveries: DataFrame,
    at: datetime | str,
    batch_size: int = retry.DELIVERY_BATCH,
    lease_seconds: int = retry.LEASE_SECONDS,
    limits: Limits = DEFAULT,
) -> DataFrame:
    """The next deliveries to send: due, or held by a worker past its lease.
    `batch_size` is the feature (one worker batch, at most `limits.delivery_batch_max`)."""
    size = min(batch_size if batch_size > 0 else retry.DELIVERY_BATCH, limits.delivery_batch_max)
    now = instant(at)
    ready = F.col("status").isin("pending", "retrying") & (F.col("available_at") <= now)
    lost = (F.col("status") == "processing") & (
        F.col("locked_at") < plus_seconds(now, -lease_seconds)
    )
    return deliveries.filter(ready | lost).orderBy("available_at", "id").limit(size)


def claim(
    deliveries: DataFrame, at: datetime | str, worker: str = "notification-worker", **options
) -> DataFrame:
    """All deliveries, with the due batch marked as processing by `worker`."""
    batch = due(deliveries, at, **options).select("id", F.lit(True).alias("_due"))
    now = instant(at)
    marked = deliveries.join(batch, "id", "left")
    taken = F.coalesce("_due", F.lit(False))
    return marked.select(
        *[
            {
                "status": F.when(taken, "processing").otherwise(F.col("status")),
                "locked_at": F.when(taken, now).otherwise(F.col("locked_at")),
                "locked_by": F.when(taken, worker).otherwise(F.col("locked_by")),
                "updated_at": F.when(taken, now).otherwise(F.col("updated_at")),
            }.get(c, F.col(c)).alias(c)
            for c in deliveries.columns
        ]
    )


def apply_results(
    deliveries: DataFrame,
    results: DataFrame,
    base_ms: int = retry.BASE_DELAY_MS,
    max_ms: int = retry.MAX_DELAY_MS,
) -> DataFrame:
    """Deliveries after one attempt each.

    results: delivery_id, error (NULL or '' on success), completed_at.
    """
    once = results.groupBy(F.col("delivery_id").alias("id")).agg(
        F.min_by(F.struct("error", "completed_at"), F.col("completed_at")).alias("_r")
    )
    both = deliveries.join(once, "id", "left")
    hit = F.col("_r").isNotNull()
    done = F.col("_r.completed_at")
    error = F.trim(F.coalesce(F.col("_r.error"), F.lit("")))
    failed = error != ""
    attempt = F.col("attempt_count") + 1
    last = attempt >= F.col("max_attempts")
    delay = retry.retry_delay_ms(F.col("id"), attempt, base_ms, max_ms)
    next_try = F.timestamp_micros(F.unix_micros(done) + delay * 1000)
    status = F.when(~failed, "sent").when(last, "failed").otherwise("retrying")
    changed = {
        "status": status,
        "attempt_count": attempt,
        "available_at": F.when(failed, next_try).otherwise(done),
        "next_retry_at": F.when(failed & ~last, next_try),
        "last_error": F.when(failed, error),
        "sent_at": F.when(~failed, done),
        "locked_at": F.lit(None).cast("timestamp"),
        "locked_by": F.lit(None).cast("string"),
        "updated_at": done,
    }
    return both.select(
        *[
            (F.when(hit, changed[c]).otherwise(F.col(c)) if c in changed else F.col(c)).alias(c)
            for c in deliveries.columns
        ]
    )


def attempts_of(deliveries: DataFrame, results: DataFrame) -> DataFrame:
    """Attempt rows, one per (delivery, attempt number); a repeat is ignored."""
    numbered = results.join(
        deliveries.select(
            F.col("id").alias("delivery_id"), (F.col("attempt_count") + 1).alias("attempt_number")
        ),
        "delivery_id",
    )
    error = F.trim(F.coalesce("error", F.lit("")))
    once = numbered.groupBy("delivery_id", "attempt_number").agg(
        F.min_by(F.struct(error.alias("error"), "started_at", "completed_at"), F.col("completed_at")).alias("_r")
    )
    return once.select(
        stable_id(F.lit("attempt"), F.col("delivery_id"), F.col("attempt_number")).alias("id"),
        "delivery_id",
        "attempt_number",
        F.when(F.col("_r.error") == "", "sent").otherwise("failed").alias("status"),
        F.nullif(F.col("_r.error"), F.lit("")).alias("error"),
        F.col("_r.started_at").alias("started_at"),
        F.col("_r.completed_at").alias("completed_at"),
    )


def backfill_payload(deliveries: DataFrame, events: DataFrame) -> DataFrame:
    """Payload of the latest enqueue event at or before each delivery, else `{}`.

    An as-of join: both sides are merged on the instance's time line and the last
    payload is carried forward.
    """
    marks = events.filter(F.col("event_type") == "notification_enqueued").select(
        "alert_instance_id",
        "created_at",
        F.lit(0).alias("_side"),
        F.col("id").alias("_id"),
        F.col("payload_json").alias("_payload"),
    )
    rows = deliveries.select(
        "alert_instance_id",
        "created_at",
        F.lit(1).alias("_side"),
        F.col("id").alias("_id"),
        F.lit(None).cast("string").alias("_payload"),
    )
    line = carry_forward(
        marks.unionByName(rows), ["alert_instance_id"], "created_at", ["_side", "_id"], "_payload", "_found"
    )
    found = line.filter(F.col("_side") == 1).select(
        F.col("_id").alias("id"), F.coalesce("_found", F.lit("{}")).alias("payload_json")
    )
    return deliveries.drop("payload_json").join(found, "id")


def default_availability(deliveries: DataFrame) -> DataFrame:
    """available_at from next_retry_at, else created_at."""
    return deliveries.withColumn("available_at", F.coalesce("next_retry_at", "created_at"))
