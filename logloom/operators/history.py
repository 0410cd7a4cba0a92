"""Alert history, audit trail and delivery history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.timefns import instant
from logloom.limits import DEFAULT, Limits
from logloom.operators.search import bounded_offset, check_range, positive


def _page(df: DataFrame, limit, offset, limits: Limits) -> DataFrame:
    skip = bounded_offset(offset, limits.log_offset_max)
    paged = df.offset(skip) if skip else df
    return paged.limit(positive(limit, limits.log_page, limits.history_page_max, "limit"))


def _rule_names(rules: DataFrame, tenant_id: int) -> DataFrame:
    return rules.filter(F.col("tenant_id") == tenant_id).select(
        F.col("id").alias("rule_id"), F.col("name").alias("rule_name"), "severity"
    )


def alert_history(
    instances: DataFrame,
    rules: DataFrame,
    events: DataFrame,
    deliveries: DataFrame,
    tenant_id: int,
    start,
    end,
    rule_id: int | None = None,
    status: str = "",
    limit=None,
    offset=None,
    limits: Limits = DEFAULT,
) -> DataFrame:
    """Alerts whose firing time overlaps [start, end), with the value that fired
    last and the latest delivery. The latest rows are partial aggregates, so an
    alert with very many events does not fill one task."""
    first, last = check_range(start, end, limits.history_window, "90 days")
    payload = F.col("payload_json")
    metric = F.get_json_object(payload, "$.metric_value")
    count = F.get_json_object(payload, "$.match_count")
    number = metric.try_cast("double")
    value = F.coalesce(F.when(number != 0, number), F.nullif(count, F.lit("")).try_cast("double"))
    found = instances.drop("tenant_id").join(_rule_names(rules, tenant_id), "rule_id").filter(
        (F.col("last_fired_at") >= instant(first)) & (F.col("first_fired_at") < instant(last))
    )
    if rule_id:
        found = found.filter(F.col("rule_id") == rule_id)
    if status:
        found = found.filter(F.col("status") == status.lower())
    # only events and deliveries of the chosen alerts are aggregated
    chosen = found.select(F.col("id").alias("alert_instance_id"))
    events = events.join(chosen, "alert_instance_id", "left_semi")
    deliveries = deliveries.join(chosen, "alert_instance_id", "left_semi")
    fired = (
        events.filter(F.col("event_type").isin("triggered", "suppressed") & metric.isNotNull())
        .groupBy(F.col("alert_instance_id").alias("id"))
        .agg(F.max_by(value, F.struct("created_at", "id")).alias("triggering_value"))
    )
    sent = deliveries.groupBy(F.col("alert_instance_id").alias("id")).agg(
        F.max_by(
            F.struct("status", "attempt_count", "last_error", "sent_at"), F.struct("updated_at", "id")
        ).alias("_d")
    )
    full = (
        found.join(fired, "id", "left")
        .join(sent, "id", "left")
        .select(
            F.col("id").alias("alert_instance_id"),
            "rule_id",
            "rule_name",
            "severity",
            "dedupe_key",
            "status",
            F.col("first_fired_at").alias("triggered_at"),
            "first_fired_at",
            "last_fired_at",
            "resolved_at",
            "triggering_value",
            F.col("_d.status").alias("notification_status"),
            F.col("_d.attempt_count").alias("notification_attempts"),
            F.col("_d.last_error").alias("notification_error"),
            F.col("_d.sent_at").alias("notification_sent_at"),
        )
    )
    ordered = full.orderBy(F.desc("last_fired_at"), F.desc("alert_instance_id"))
    return _page(ordered, limit, offset, limits)


def alert_audit(
    events: DataFrame,
    attempts: DataFrame,
    deliveries: DataFrame,
    instances: DataFrame,
    rules: DataFrame,
    tenant_id: int,
    start,
    end,
    rule_id: int | None = None,
    event_type: str = "",
    limit=None,
    offset=None,
    limits: Limits = DEFAULT,
) -> DataFrame:
    """Events and delivery attempts as one time line with tagged ids."""
    first, last = check_range(start, end, limits.history_window, "90 days")
    names = _rule_names(rules, tenant_id).drop("severity")
    owned = instances.select(F.col("id").alias("alert_instance_id"), "rule_id").join(names, "rule_id")

    def between(column: str):
        return (F.col(column) >= instant(first)) & (F.col(column) < instant(last))

    logged = (
        events.filter(between("created_at"))
        .select("id", "alert_instance_id", "event_type", "payload_json", "created_at")
        .join(owned, "alert_instance_id")
        .withColumn("audit_id", F.concat(F.lit("event:"), F.col("id").cast("string")))
    )
    tried = (
        attempts.filter(between("completed_at"))
        .join(
            deliveries.select(
                F.col("id").alias("delivery_id"), "alert_instance_id", "channel", "target"
            ),
            "delivery_id",
        )
        .join(owned, "alert_instance_id")
        .select(
            "alert_instance_id", "rule_id", "rule_name",
            F.lit("notification_attempt").alias("event_type"),
            F.to_json(
                F.struct(
                    "delivery_id", "attempt_number", "status", "error", "channel", "target",
                    "started_at", "completed_at",
                ),
                {"ignoreNullFields": "false"},
            ).alias("payload_json"),
            F.col("completed_at").alias("created_at"),
            F.concat(F.lit("attempt:"), F.col("id").cast("string")).alias("audit_id"),
        )
    )
    both = logged.select(*tried.columns).unionByName(tried)
    if rule_id:
        both = both.filter(F.col("rule_id") == rule_id)
    if event_type:
        both = both.filter(F.col("event_type") == event_type.lower())
    return _page(both.orderBy(F.desc("created_at"), F.desc("audit_id")), limit, offset, limits)


def delivery_history(
    deliveries: DataFrame,
    instances: DataFrame,
    rules: DataFrame,
    tenant_id: int,
    start,
    end,
    rule_id: int | None = None,
    status: str = "",
    limit=None,
    offset=None,
    limits: Limits = DEFAULT,
) -> DataFrame:
    first, last = check_range(start, end, limits.history_window, "90 days")
    names = _rule_names(rules, tenant_id).drop("severity")
    owned = instances.select(F.col("id").alias("alert_instance_id"), "rule_id").join(names, "rule_id")
    found = deliveries.drop("rule_id", "tenant_id").filter(
        (F.col("created_at") >= instant(first)) & (F.col("created_at") < instant(last))
    )
    if status:
        found = found.filter(F.col("status") == status.lower())
    full = found.join(owned, "alert_instance_id")
    if rule_id:
        full = full.filter(F.col("rule_id") == rule_id)
    shown = full.select(
        F.col("id").alias("delivery_id"), "alert_instance_id", "rule_id", "rule_name", "channel",
        "target", "status", "attempt_count", "max_attempts", "available_at", "next_retry_at",
        "last_error", "created_at", "updated_at", "sent_at",
    )
    return _page(shown.orderBy(F.desc("created_at"), F.desc("delivery_id")), limit, offset, limits)
