"""Alert lifecycle: one reconciliation step, and the fold over many ticks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.hashing import stable_id
from logloom.functions.timefns import instant, plus_seconds
from logloom.operators.skew import lookup_join

KEY = ["rule_id", "dedupe_key"]


def _by_key(triggers: DataFrame) -> DataFrame:
    return triggers.withColumnRenamed("group_key", "dedupe_key")


def reconcile(
    triggers: DataFrame, instances: DataFrame, evaluated: DataFrame, at: datetime | str | None = None
) -> DataFrame:
    """Next state of every (rule, key) after one evaluation at `at`.

    instances: rule_id, dedupe_key, status, first_fired_at, last_fired_at,
    resolved_at. evaluated: rule_id, cooldown_seconds of the rules that ran, and
    observed_at where rules were evaluated at times of their own.
    Rows without an event keep event_type NULL.
    """
    fired = _by_key(triggers).select(
        *KEY, "match_count", "metric_value", F.lit(True).alias("_fired")
    )
    seen = F.col("observed_at") if "observed_at" in evaluated.columns else instant(at)
    ran = evaluated.select("rule_id", F.col("cooldown_seconds").alias("_cooldown"), seen.alias("_now")).distinct()
    now = F.col("_now")
    both = (
        instances.join(fired, KEY, "full")
        .join(ran, "rule_id", "left")
        .withColumn("_fired", F.coalesce("_fired", F.lit(False)))
    )
    fresh = F.col("status").isNull()
    was_firing = F.col("status") == "firing"
    was_resolved = F.col("status") == "resolved"
    reopened = F.col("_fired") & (fresh | was_resolved)
    since_last = F.unix_micros(now) - F.unix_micros("last_fired_at")
    cooling = (F.col("_cooldown") > 0) & (since_last < F.col("_cooldown") * 1_000_000)
    closes = was_firing & ~F.col("_fired") & F.col("_cooldown").isNotNull()
    event = (
        F.when(F.col("_fired") & fresh, "triggered")
        .when(F.col("_fired") & was_resolved & F.coalesce(cooling, F.lit(False)), "suppressed")
        .when(F.col("_fired") & was_resolved, "triggered")
        .when(F.col("_fired") & was_firing, "suppressed")
        .when(closes, "resolved")
    )
    return both.select(
        *KEY,
        F.when(F.col("_fired"), "firing").when(closes, "resolved").otherwise(F.col("status")).alias("status"),
        F.when(reopened, now).otherwise(F.col("first_fired_at")).alias("first_fired_at"),
        F.when(reopened, now).otherwise(F.col("last_fired_at")).alias("last_fired_at"),
        F.when(closes, now).when(~reopened, F.col("resolved_at")).alias("resolved_at"),
        event.alias("event_type"),
        "match_count",
        "metric_value",
        *([now.alias("observed_at")] if "observed_at" in evaluated.columns else []),
    )


def lifecycle(
    triggers: DataFrame, rules: DataFrame, first: datetime | str, last: datetime | str, step_seconds: int
) -> DataFrame:
    """Events of all keys over a run of ticks, folded with windows.

    `triggers` has one row per (rule_id, group_key, tick) that fired. Every rule
    counts as evaluated at every tick, so a key resolves one step after the last
    tick of an episode. Only fired ticks are read; a window holds those of one key,
    a number set by the time range and not by the volume of logs.
    """
    facts = rules.select(
        "rule_id", "cooldown_seconds", "rule_name", "severity", "kind", "threshold",
        "window_seconds", "percentile", "value_field", "tenant_id",
    )
    fired = _by_key(triggers).filter(F.col("tick").between(instant(first), instant(last)))
    fired = lookup_join(fired.select(*KEY, "tick", "match_count", "metric_value"), facts, ["rule_id"], sized_by=rules)
    order = Window.partitionBy(*KEY).orderBy("tick")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    through = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    follows = F.coalesce(F.lag("tick").over(order) == plus_seconds("tick", -step_seconds), F.lit(False))
    goes_on = F.coalesce(F.lead("tick").over(order) == plus_seconds("tick", step_seconds), F.lit(False))
    folded = (
        fired.withColumn("_start", F.when(~follows, F.col("tick")))
        .withColumn("_ends", ~goes_on)
        .withColumn("_earlier", F.max("_start").over(before))
        .withColumn("episode_start", F.max("_start").over(through))
    )
    gap = F.unix_seconds("_start") - F.unix_seconds("_earlier")
    cooling = (F.col("cooldown_seconds") > 0) & (gap < F.col("cooldown_seconds"))
    opened = F.when(
        F.col("_start").isNull() | F.coalesce(cooling, F.lit(False)), "suppressed"
    ).otherwise("triggered")

    def event(kind: Column, status: str, at: Column, count: Column, metric: Column) -> Column:
        return F.struct(
            kind.alias("event_type"), F.lit(status).alias("status"), at.alias("tick"),
            count.alias("match_count"), metric.alias("metric_value"),
        )

    closing = plus_seconds("tick", step_seconds)
    firing = event(opened, "firing", F.col("tick"), F.col("match_count"), F.col("metric_value"))
    resolved = event(
        F.lit("resolved"), "resolved", closing, F.lit(None).cast("bigint"), F.lit(None).cast("double")
    )
    closes = F.col("_ends") & (closing <= instant(last))
    pair = F.when(closes, F.array(firing, resolved)).otherwise(F.array(firing))
    kept = [c for c in fired.columns if c not in ("tick", "match_count", "metric_value")]
    return folded.select(*kept, "episode_start", F.inline(pair))


def instances_of(events: DataFrame) -> DataFrame:
    """Current instance per (rule, key) from its events."""
    latest = events.groupBy(*KEY).agg(
        F.max_by(F.struct("status", "episode_start", "tick", "tenant_id"), F.col("tick")).alias("_s")
    )
    status = F.col("_s.status")
    return latest.select(
        stable_id(F.col("rule_id"), F.col("dedupe_key")).alias("id"),
        *KEY,
        F.col("_s.tenant_id").alias("tenant_id"),
        status.alias("status"),
        F.col("_s.episode_start").alias("first_fired_at"),
        F.col("_s.episode_start").alias("last_fired_at"),
        F.when(status == "resolved", F.col("_s.tick")).alias("resolved_at"),
    )


def event_payload() -> Column:
    """Event payload. Counting rules carry no threshold or window, and resolved
    events carry no measurements at all."""
    resolved = F.col("event_type") == "resolved"
    metric = ~resolved & F.col("kind").isin("rate", "percentile")
    share = F.when(~resolved & (F.col("percentile") > 0), F.col("percentile"))
    return F.to_json(
        F.struct(
            "rule_id",
            "rule_name",
            "dedupe_key",
            "status",
            "event_type",
            F.coalesce("match_count", F.lit(0)).alias("match_count"),
            F.coalesce("metric_value", F.lit(0.0)).alias("metric_value"),
            F.when(metric, F.col("threshold")).otherwise(F.lit(0.0)).alias("threshold"),
            F.when(metric, F.col("window_seconds")).otherwise(F.lit(0)).alias("window_seconds"),
            F.when(resolved, "").otherwise(F.col("dedupe_key")).alias("group_key"),
            F.when(~resolved, group_map(F.col("dedupe_key"))).alias("group"),
            share.alias("percentile"),
            F.when(~resolved, F.col("value_field")).alias("value_field"),
        )
    )


def alert_events(events: DataFrame) -> DataFrame:
    """Stored form of lifecycle events, with the event payload as JSON."""
    return events.select(
        stable_id(
            F.col("rule_id"), F.col("dedupe_key"), F.unix_seconds("tick"), F.col("event_type")
        ).alias("id"),
        stable_id(F.col("rule_id"), F.col("dedupe_key")).alias("alert_instance_id"),
        "tenant_id",
        "rule_id",
        "dedupe_key",
        "event_type",
        "status",
        F.coalesce("match_count", F.lit(0)).alias("match_count"),
        F.coalesce("metric_value", F.lit(0.0)).alias("metric_value"),
        event_payload().alias("payload_json"),
        F.col("tick").alias("created_at"),
    )


def group_map(key):
    """Group fields of a key as a map, for payloads."""
    pairs = F.transform(
        F.split(key, r"\|"),
        lambda part: F.struct(
            F.substring_index(part, "=", 1).alias("key"),
            F.regexp_replace(part, "^[^=]*=", "").alias("value"),
        ),
    )
    # repeated group fields carry equal values; keep the first of each
    return F.map_from_entries(
        F.filter(
            pairs,
            lambda p, i: F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda q: q["key"] == p["key"])) == 0,
        )
    )


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type", "status").agg(F.count("*").alias("changes"))
