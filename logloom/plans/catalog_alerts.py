"""Alert rules, lifecycle, notification and history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.functions.timefns import instant, plus_seconds
from logloom.operators import authoring, history, lifecycle, notify, opsmetrics, rules
from logloom.plans import fixtures as fx
from logloom.plans.registry import query, sql_stamp, stamp
from logloom.session import cut_lineage

FIRST_TICK, LAST_TICK, STEP = "2024-01-02T00:00:00Z", "2024-01-31T00:00:00Z", 86400
AT = "2024-01-20T00:00:00Z"
RANGE = ("2024-01-01T00:00:00Z", "2024-02-15T00:00:00Z")
BASE = ("logs", "services", "rules")

COMP = """SELECT r.id AS rule_id, r.tenant_id, r.name AS rule_name, r.rule_type, r.severity, r.service_id,
 s.name AS sname, s.environment AS senv, s.owner, coalesce(s.name, r.filter_json->>'$.service', '') AS f_service,
 coalesce(s.environment, r.filter_json->>'$.environment', '') AS f_env, lower(coalesce(r.log_level, r.filter_json->>'$.level', '')) AS f_level,
 lower(trim(coalesce(r.filter_json->>'$.source', ''))) AS f_source, coalesce(r.filter_json->>'$.host', '') AS f_host,
 lower(trim(coalesce(r.filter_json->>'$.message_contains', ''))) AS f_contains, lower(r.filter_json->>'$.pattern') AS f_pattern,
 coalesce(r.filter_json->>'$.target', 'message') AS f_target, r.filter_json->>'$.field_equals.error_code' AS f_code,
 r.filter_json->>'$.value_field' AS value_field, TRY_CAST(r.filter_json->>'$.percentile' AS DOUBLE) AS pct,
 CAST(CAST(r.group_by AS JSON) AS VARCHAR[]) AS gb, CAST(r.window_seconds AS BIGINT) AS w, CAST(r.threshold AS DOUBLE) AS threshold,
 r.cooldown_seconds AS cool, CASE r.rule_type WHEN 'count_threshold' THEN 'count' WHEN 'pattern_match' THEN 'pattern'
 WHEN 'rate_threshold' THEN 'rate' WHEN 'rate_based' THEN 'rate' ELSE 'percentile' END AS kind
 FROM rules r LEFT JOIN services s ON s.id = r.service_id WHERE r.status = 'active' AND r.id <> 5"""

ANCHOR = """SELECT c.rule_id, max(l.timestamp) AS anchor FROM logs l JOIN comp c ON l.tenant_id = c.tenant_id
 AND (c.service_id IS NULL OR (l.service = c.sname AND l.environment = c.senv)) GROUP BY c.rule_id"""

TARGET = """CASE {t} WHEN 'message' THEN l.message WHEN 'service' THEN l.service WHEN 'environment' THEN l.environment
 WHEN 'source' THEN l.source WHEN 'host' THEN l.host WHEN 'level' THEN l.level WHEN 'trace_id' THEN l.trace_id
 WHEN 'field.region' THEN coalesce(json_extract_string(l.fields_json, '$.region'), '<nil>') ELSE '' END"""

MATCHES = f"""SELECT c.rule_id, c.kind, c.pct, c.w, l.timestamp, CASE WHEN len(c.gb) = 0 THEN 'scope=all' ELSE
 concat(c.gb[1], '=', {TARGET.format(t='c.gb[1]')}) || CASE WHEN len(c.gb) > 1 THEN concat('|', c.gb[2], '=', {TARGET.format(t='c.gb[2]')}) ELSE '' END
 END AS k, CASE WHEN c.kind = 'percentile' THEN CASE c.value_field WHEN 'raw_size_bytes' THEN CAST(l.raw_size_bytes AS DOUBLE)
 ELSE TRY_CAST(json_extract_string(l.fields_json, '$.duration_ms') AS DOUBLE) END END AS v, a.anchor
 FROM logs l JOIN comp c ON l.tenant_id = c.tenant_id AND (c.service_id IS NULL OR (l.service = c.sname AND l.environment = c.senv))
 JOIN anchor a ON a.rule_id = c.rule_id
 WHERE (c.f_service = '' OR l.service = c.f_service) AND (c.f_env = '' OR l.environment = c.f_env)
 AND (c.f_level = '' OR l.level = c.f_level) AND (c.f_source = '' OR l.source = c.f_source) AND (c.f_host = '' OR l.host = c.f_host)
 AND (c.f_contains = '' OR contains(lower(l.message), c.f_contains))
 AND (c.f_code IS NULL OR coalesce(json_extract_string(l.fields_json, '$.error_code'), '<nil>') = c.f_code)
 AND (c.kind <> 'pattern' OR contains(lower({TARGET.format(t='c.f_target')}), c.f_pattern))"""


def _measure(source: str, keys: str = "") -> str:
    """Triggers of a set of matches; `keys` are extra grouping columns."""
    extra = f", {keys}" if keys else ""
    return (
        "SELECT g.*, c.tenant_id, c.rule_name, c.severity, c.threshold, c.w AS window_seconds, c.cool, c.value_field, c.kind, c.pct, CASE c.kind WHEN 'rate' THEN n / CAST(c.w AS DOUBLE) "
        "WHEN 'percentile' THEN vs[lo + 1] + (pos - lo) * (vs[CAST(least(lo + 2, n) AS INTEGER)] - vs[lo + 1]) ELSE 0.0 END AS metric "
        "FROM (SELECT *, CAST(floor(pos) AS INTEGER) AS lo FROM (SELECT rule_id, k" + extra + ", count(*) AS n, list_sort(list(v)) AS vs, "
        f"coalesce(any_value(pct), 0) / 100 * (count(*) - 1) AS pos FROM {source} GROUP BY rule_id, k{extra})) g "
        "JOIN comp c ON c.rule_id = g.rule_id WHERE CASE WHEN c.kind IN ('count', 'pattern') THEN n >= c.threshold ELSE metric >= c.threshold END"
    )


NEWEST = {
    "comp": COMP,
    "anchor": ANCHOR,
    "matches": MATCHES,
    "recent": "SELECT * FROM matches WHERE w <= 0 OR timestamp >= anchor - to_seconds(CAST(w AS INTEGER))",
    "fired": _measure("recent"),
}
SHOWN = "rule_id, k AS group_key, n AS match_count, round(metric, 9) AS metric_value"


def _active(spark, sf):
    return rules.active_rules(fx.rules(spark, sf), fx.services(spark, sf))


def _compiled(spark, sf):
    return rules.load_rules(fx.rules(spark, sf), fx.services(spark, sf))


def _triggers(spark, sf, *kinds):
    ready = _compiled(spark, sf)
    if kinds:
        ready = ready.filter(F.col("kind").isin(*kinds))
    found = rules.evaluate_newest(fx.logs(spark, sf), ready)
    return found.select("rule_id", "group_key", "match_count", F.round("metric_value", 9).alias("metric_value"))


for _name, _kinds in {
    "alert_count": ["count"],
    "alert_pattern": ["pattern"],
    "alert_rate": ["rate"],
    "alert_percentile": ["percentile"],
    "alert_all_rules": ["count", "pattern", "rate", "percentile"],
}.items():
    _list = ", ".join(f"'{k}'" for k in _kinds)
    query(_name, fx.with_ctes(f"SELECT {SHOWN} FROM fired WHERE kind IN ({_list})", *BASE, **NEWEST))(
        lambda spark, sf, kinds=tuple(_kinds): _triggers(spark, sf, *kinds)
    )


@query(
    "rule_filter",
    fx.with_ctes("SELECT rule_id, count(*) AS row_count FROM matches GROUP BY rule_id", *BASE, **NEWEST),
)
def rule_filter(spark, sf):
    matches = rules.match_rules(fx.logs(spark, sf), _compiled(spark, sf))
    return matches.groupBy("rule_id").agg(F.count("*").alias("row_count"))


@query(
    "alert_group_keys",
    fx.with_ctes("SELECT rule_id, k AS group_key, count(*) AS row_count FROM matches GROUP BY ALL", *BASE, **NEWEST),
)
def alert_group_keys(spark, sf):
    matches = rules.match_rules(fx.logs(spark, sf), _compiled(spark, sf))
    return matches.groupBy("rule_id", "group_key").agg(F.count("*").alias("row_count"))


@query(
    "alert_records",
    fx.with_ctes(
        f"SELECT event_id, {sql_stamp('timestamp')}, message FROM templated WHERE tenant_id = 1 AND timestamp >= TIMESTAMP '2024-01-10 00:00:00' "
        "AND timestamp < TIMESTAMP '2024-01-20 00:00:00' AND service = 'payments' AND environment = 'prod' AND level = 'error' "
        "ORDER BY templated.timestamp DESC, ingest_id DESC, fingerprint DESC, event_id DESC LIMIT 50000",
        "logs", "templated",
    ),
)
def alert_records(spark, sf):
    rows = rules.alert_records(
        fx.templated_logs(spark, sf), 1, "2024-01-10T00:00:00Z", "2024-01-20T00:00:00Z",
        service="payments", environment="prod", level=" ERROR", limit=50_000,
    )
    return rows.select("event_id", stamp("timestamp"), "message")


@query(
    "active_rules",
    fx.with_ctes(
        "SELECT r.id, r.tenant_id, r.service_id, s.name AS service_name, s.environment, s.owner, r.rule_type, r.threshold "
        "FROM many_rules r LEFT JOIN many_services s ON s.id = r.service_id WHERE r.status = 'active'",
        "many_rules", "many_services",
    ),
)
def active_rules(spark, sf):
    found = rules.active_rules(fx.many_rules(spark, sf), fx.many_services(spark, sf))
    return found.select(
        "id", "tenant_id", "service_id", "service_name", "environment", "owner", "rule_type", "threshold"
    )


@query(
    "rules_for_scope",
    fx.with_ctes(
        "SELECT r.id FROM many_rules r LEFT JOIN many_services s ON s.id = r.service_id WHERE r.status = 'active' AND r.tenant_id = 2 "
        "AND (r.service_id IS NULL OR (s.name = 'svc-15' AND s.environment = 'prod'))",
        "many_rules", "many_services",
    ),
)
def rules_for_scope(spark, sf):
    found = rules.rules_for_scope(fx.many_rules(spark, sf), fx.many_services(spark, sf), 2, "svc-15", "prod")
    return found.select("id")


@query(
    "rules_list",
    fx.with_ctes(
        "SELECT r.id, r.name, coalesce(s.name, '') AS service, coalesce(s.environment, '') AS environment, coalesce(r.log_level, '') AS log_level, "
        "r.status, r.window_seconds FROM many_rules r LEFT JOIN many_services s ON s.id = r.service_id "
        "WHERE r.tenant_id = 3 AND r.status <> 'deleted' AND s.environment = 'prod' AND r.status = 'active' ORDER BY r.id LIMIT 500",
        "many_rules", "many_services",
    ),
)
def rules_list(spark, sf):
    rows = fx.many_rules(spark, sf).withColumn("fingerprint", F.lit(None).cast("string"))
    found = authoring.list_rules(
        rows, fx.many_services(spark, sf), 3, environment="prod", status="Active", limit=500
    )
    return found.select("id", "name", "service", "environment", "log_level", "status", "window_seconds")


VALID = """SELECT id, CASE WHEN fj % 9 = 1 THEN 'parse filter_json' WHEN fj % 8 = 1 THEN 'parse group_by'
 WHEN kind IS NULL THEN 'unsupported rule_type "ratio"'
 WHEN kind IN ('count', 'pattern') AND fj % 7 IN (1, 2, 4) THEN 'parse threshold: not an integer'
 WHEN kind IN ('count', 'pattern') AND fj % 7 IN (3, 6) THEN 'parse threshold: threshold must be positive'
 WHEN kind IN ('rate', 'percentile') AND fj % 7 IN (2, 3, 4) THEN 'parse threshold: threshold must be a finite non-negative number'
 WHEN kind IN ('rate', 'percentile') AND window_seconds <= 0 THEN kind || '_threshold rules require positive window_seconds'
 WHEN kind = 'pattern' AND fj % 9 NOT IN (2, 6) THEN 'pattern_match rules require filter_json.pattern'
 WHEN kind = 'percentile' AND fj % 9 NOT IN (3, 4, 6) THEN 'percentile_threshold rules require filter_json.value_field as raw_size_bytes or field.<name>'
 WHEN kind = 'percentile' AND fj % 9 = 4 THEN 'percentile_threshold rules require filter_json.percentile between 0 and 100' END AS rule_error
 FROM (SELECT *, id - 1 AS fj, CASE lower(trim(rule_type)) WHEN 'count_threshold' THEN 'count' WHEN 'pattern_match' THEN 'pattern'
 WHEN 'rate_threshold' THEN 'rate' WHEN 'rate_based' THEN 'rate' WHEN 'percentile_threshold' THEN 'percentile' WHEN 'percentile_based' THEN 'percentile' END AS kind
 FROM many_rules)"""


@query("rule_validation", fx.with_ctes(VALID, "many_rules"))
def rule_validation(spark, sf):
    found = rules.compile_rules(fx.many_rules(spark, sf))
    return found.select(F.col("rule_id").alias("id"), "rule_error")


@query(
    "alert_evaluate_at",
    fx.with_ctes(
        f"SELECT {SHOWN} FROM fired", *BASE, comp=COMP, anchor=ANCHOR, matches=MATCHES,
        recent="SELECT * FROM matches WHERE w > 0 AND timestamp >= TIMESTAMP '2024-01-20 00:00:00' - to_seconds(CAST(w AS INTEGER)) "
        "AND timestamp < TIMESTAMP '2024-01-20 00:00:00'",
        fired=_measure("recent"),
    ),
)
def alert_evaluate_at(spark, sf):
    found = rules.evaluate_at(fx.logs(spark, sf), _compiled(spark, sf), AT)
    return found.select("rule_id", "group_key", "match_count", F.round("metric_value", 9).alias("metric_value"))


# --- many ticks and what follows from them

TICKS = {
    "comp": COMP,
    "anchor": ANCHOR,
    "matches": MATCHES,
    "axis": "SELECT unnest(generate_series(TIMESTAMP '2024-01-02 00:00:00', TIMESTAMP '2024-01-31 00:00:00', INTERVAL 1 DAY)) AS tick",
    "spread": "SELECT m.*, a.tick FROM matches m JOIN axis a ON m.w > 0 AND m.timestamp >= a.tick - to_seconds(CAST(m.w AS INTEGER)) AND m.timestamp < a.tick",
    "fired": _measure("spread", "tick"),
    "grid": "SELECT x.rule_id, x.k, a.tick FROM (SELECT DISTINCT rule_id, k FROM fired) x CROSS JOIN axis a",
    "states": "SELECT g.rule_id, g.k, g.tick, f.n, f.metric, f.n IS NOT NULL AS trig, c.* EXCLUDE (rule_id) FROM grid g "
    "LEFT JOIN fired f ON f.rule_id = g.rule_id AND f.k = g.k AND f.tick = g.tick JOIN comp c ON c.rule_id = g.rule_id",
    "s1": "SELECT *, lag(trig) OVER (PARTITION BY rule_id, k ORDER BY tick) AS p FROM states",
    "s2": "SELECT *, CASE WHEN trig AND NOT coalesce(p, false) THEN tick END AS st FROM s1",
    "s3": "SELECT *, max(st) OVER (PARTITION BY rule_id, k ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ps, "
    "max(st) OVER (PARTITION BY rule_id, k ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS episode FROM s2",
    "changes": "SELECT *, CASE WHEN event_type = 'resolved' THEN 'resolved' ELSE 'firing' END AS status FROM (SELECT *, "
    "CASE WHEN st IS NOT NULL THEN CASE WHEN ps IS NOT NULL AND cool > 0 AND epoch(st) - epoch(ps) < cool THEN 'suppressed' ELSE 'triggered' END "
    "WHEN trig THEN 'suppressed' WHEN p THEN 'resolved' END AS event_type FROM s3) WHERE event_type IS NOT NULL",
}


def _id(*parts: str) -> str:
    return f"CAST(concat('0x', substr(sha256(concat_ws('|', {', '.join(parts)})), 1, 15)) AS BIGINT)"


SECONDS = "CAST(epoch(tick) AS BIGINT)"
STORED = {
    **TICKS,
    "instances": f"SELECT {_id('rule_id', 'k')} AS id, rule_id, k, tenant_id, arg_max(status, tick) AS status, arg_max(episode, tick) AS fired_at, "
    "CASE WHEN arg_max(status, tick) = 'resolved' THEN max(tick) END AS resolved_at FROM changes GROUP BY rule_id, k, tenant_id",
    "stored_events": f"SELECT {_id('rule_id', 'k', SECONDS, 'event_type')} AS id, {_id('rule_id', 'k')} AS alert_instance_id, rule_id, tenant_id, k, event_type, "
    "status, coalesce(n, 0) AS match_count, coalesce(metric, 0.0) AS metric_value, tick AS created_at FROM changes",
    "deliveries": f"SELECT {_id(chr(39) + 'delivery' + chr(39), 'rule_id', 'k', SECONDS)} AS id, {_id('rule_id', 'k')} AS alert_instance_id, tenant_id, rule_id, "
    "coalesce(nullif(trim(owner), ''), sname || ':' || senv, 'tenant:' || tenant_id) AS target, event_type, tick AS created_at "
    "FROM changes WHERE event_type IN ('triggered', 'resolved')",
    "tried": "SELECT *, id % 3 = 0 AS failed, created_at + INTERVAL 5 SECOND AS completed_at, "
    "CASE WHEN id % 3 = 0 THEN 'retrying' ELSE 'sent' END AS status, "
    "CAST(greatest(30000, (30000::HUGEINT * 1000000 + CASE WHEN j >= 0 THEN (j * 3000000000) // 100 ELSE -((-j * 3000000000) // 100) END) // 1000000) AS BIGINT) AS delay_ms "
    "FROM (SELECT *, (id * 31 + 17) % 201 - 100 AS j FROM (SELECT * REPLACE (id::HUGEINT AS id) FROM deliveries))",
}


def _fired(spark, sf):
    return rules.evaluate_ticks(fx.logs(spark, sf), _compiled(spark, sf), FIRST_TICK, LAST_TICK, STEP)


def _events(spark, sf):
    ready = _compiled(spark, sf)
    fired = rules.evaluate_ticks(fx.logs(spark, sf), ready, FIRST_TICK, LAST_TICK, STEP)
    return lifecycle.lifecycle(fired, ready, FIRST_TICK, LAST_TICK, STEP)


def _stored_events(spark, sf):
    """The event table that notification and history queries start from."""
    return cut_lineage(_events(spark, sf))


def _deliveries(spark, sf, events=None):
    events = _stored_events(spark, sf) if events is None else events
    return notify.enqueue(events, _active(spark, sf))


def _results(deliveries):
    """One attempt per delivery; every third id fails."""
    done = plus_seconds("created_at", 5)
    return deliveries.select(
        F.col("id").alias("delivery_id"),
        F.when(F.col("id") % 3 == 0, " connection refused ").otherwise("").alias("error"),
        F.col("created_at").alias("started_at"),
        done.alias("completed_at"),
    )


@query(
    "alert_evaluate_ticks",
    fx.with_ctes(f"SELECT {sql_stamp('tick')}, {SHOWN} FROM fired", *BASE, **TICKS),
)
def alert_evaluate_ticks(spark, sf):
    return _fired(spark, sf).select(
        stamp("tick"), "rule_id", "group_key", "match_count", F.round("metric_value", 9).alias("metric_value")
    )


@query(
    "alert_reconcile",
    fx.with_ctes(
        "SELECT coalesce(i.rule_id, f.rule_id) AS rule_id, coalesce(i.k, f.k) AS dedupe_key, "
        "CASE WHEN f.n IS NOT NULL THEN 'firing' WHEN i.status = 'firing' AND coalesce(i.rule_id, 0) <> 1 THEN 'resolved' ELSE i.status END AS status, "
        "CASE WHEN f.n IS NOT NULL AND i.status IS NULL THEN 'triggered' WHEN f.n IS NOT NULL AND i.status = 'resolved' THEN "
        "CASE WHEN c.cool > 0 AND epoch(TIMESTAMP '2024-01-20 00:00:00') - epoch(i.last_at) < c.cool THEN 'suppressed' ELSE 'triggered' END "
        "WHEN f.n IS NOT NULL THEN 'suppressed' WHEN i.status = 'firing' AND i.rule_id <> 1 THEN 'resolved' END AS event_type, "
        f"{sql_stamp('CASE WHEN f.n IS NOT NULL AND (i.status IS NULL OR i.status <> ' + chr(39) + 'firing' + chr(39) + ') THEN TIMESTAMP ' + chr(39) + '2024-01-20 00:00:00' + chr(39) + ' ELSE i.last_at END', 'last_fired_at')} "
        "FROM before i FULL JOIN at_tick f ON f.rule_id = i.rule_id AND f.k = i.k LEFT JOIN comp c ON c.rule_id = coalesce(i.rule_id, f.rule_id)",
        *BASE, **TICKS,
        before="SELECT rule_id, k, CASE WHEN length(k) % 2 = 0 THEN 'firing' ELSE 'resolved' END AS status, tick AS last_at FROM fired WHERE tick = TIMESTAMP '2024-01-19 00:00:00'",
        at_tick="SELECT * FROM fired WHERE tick = TIMESTAMP '2024-01-20 00:00:00' AND rule_id <> 1",
    ),
)
def alert_reconcile(spark, sf):
    """One step: rule 1 did not run, so its open alerts stay as they are."""
    fired = cut_lineage(_fired(spark, sf))
    status = F.when(F.length("group_key") % 2 == 0, "firing").otherwise("resolved")
    before = fired.filter(F.col("tick") == instant("2024-01-19T00:00:00Z")).select(
        "rule_id",
        F.col("group_key").alias("dedupe_key"),
        status.alias("status"),
        F.col("tick").alias("first_fired_at"),
        F.col("tick").alias("last_fired_at"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
    )
    now = fired.filter((F.col("tick") == instant(AT)) & (F.col("rule_id") != 1)).drop("tick")
    ran = _compiled(spark, sf).filter("rule_id <> 1")
    step = lifecycle.reconcile(now, before, ran, AT)
    return step.select("rule_id", "dedupe_key", "status", "event_type", stamp("last_fired_at"))


@query(
    "alert_lifecycle",
    fx.with_ctes(
        f"SELECT rule_id, k AS dedupe_key, {sql_stamp('tick')}, event_type, status, n AS match_count, round(metric, 9) AS metric_value FROM changes",
        *BASE, **TICKS,
    ),
)
def alert_lifecycle(spark, sf):
    return _events(spark, sf).select(
        "rule_id", "dedupe_key", stamp("tick"), "event_type", "status", "match_count",
        F.round("metric_value", 9).alias("metric_value"),
    )


@query(
    "alert_instances",
    fx.with_ctes(
        f"SELECT id, rule_id, k AS dedupe_key, status, {sql_stamp('fired_at', 'last_fired_at')}, {sql_stamp('resolved_at')} FROM instances",
        *BASE, **STORED,
    ),
)
def alert_instances(spark, sf):
    found = lifecycle.instances_of(_events(spark, sf))
    return found.select("id", "rule_id", "dedupe_key", "status", stamp("last_fired_at"), stamp("resolved_at"))


@query(
    "alert_events",
    fx.with_ctes(
        f"SELECT id, alert_instance_id, rule_id, event_type, status, match_count, round(metric_value, 9) AS metric_value, {sql_stamp('created_at')}, "
        "match_count AS payload_count, k AS payload_key FROM stored_events",
        *BASE, **STORED,
    ),
)
def alert_events(spark, sf):
    found = lifecycle.alert_events(_events(spark, sf))
    return found.select(
        "id", "alert_instance_id", "rule_id", "event_type", "status", "match_count",
        F.round("metric_value", 9).alias("metric_value"), stamp("created_at"),
        F.get_json_object("payload_json", "$.match_count").cast("bigint").alias("payload_count"),
        F.get_json_object("payload_json", "$.dedupe_key").alias("payload_key"),
    )


@query(
    "state_change_counts",
    fx.with_ctes("SELECT event_type, status, count(*) AS changes FROM changes GROUP BY ALL", *BASE, **TICKS),
)
def state_change_counts(spark, sf):
    return lifecycle.event_counts(_events(spark, sf))


@query(
    "alert_volume",
    fx.with_ctes(
        "SELECT strftime(to_timestamp(floor(epoch(tick) / 604800) * 604800)::TIMESTAMP, '%Y-%m-%d %H:%M:%S.%g') AS window_start, event_type, "
        "count(*) AS events, round(count(*) / 604800.0::DOUBLE, 12) AS per_second FROM changes GROUP BY ALL",
        *BASE, **TICKS,
    ),
)
def alert_volume(spark, sf):
    found = opsmetrics.per_second(_events(spark, sf), ["event_type"], "tick", 604800)
    return found.select(
        stamp("window_start"), "event_type", "events", F.round("per_second", 12).alias("per_second")
    )


@query(
    "notification_outbox",
    fx.with_ctes(
        f"SELECT id, alert_instance_id, tenant_id, rule_id, 'log' AS channel, target, 'pending' AS status, event_type, {sql_stamp('created_at')} FROM deliveries",
        *BASE, **STORED,
    ),
)
def notification_outbox(spark, sf):
    return _deliveries(spark, sf).select(
        "id", "alert_instance_id", "tenant_id", "rule_id", "channel", "target", "status",
        F.get_json_object("payload_json", "$.event_type").alias("event_type"), stamp("created_at"),
    )


@query(
    "deliveries_due",
    fx.with_ctes(
        "SELECT id, rule_id, status FROM (SELECT id::BIGINT AS id, rule_id, created_at AS available_at, CASE id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'retrying' "
        "WHEN 2 THEN 'processing' ELSE 'sent' END AS status, created_at AS locked_at FROM deliveries) "
        "WHERE (status IN ('pending', 'retrying') AND available_at <= TIMESTAMP '2024-01-20 00:00:00') "
        "OR (status = 'processing' AND locked_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 2 MINUTE) ORDER BY available_at, id LIMIT 500",
        *BASE, **STORED,
    ),
)
def deliveries_due(spark, sf):
    kind = F.col("id") % 4
    queue = _deliveries(spark, sf).withColumn(
        "status",
        F.when(kind == 0, "pending").when(kind == 1, "retrying").when(kind == 2, "processing").otherwise("sent"),
    )
    queue = queue.withColumn("locked_at", F.col("created_at"))
    return notify.due(queue, AT, batch_size=9000).select("id", "rule_id", "status")


@query(
    "delivery_transitions",
    fx.with_ctes(
        "SELECT id::BIGINT AS id, status, CAST(1 AS INTEGER) AS attempt_count, CASE WHEN failed THEN 'connection refused' END AS last_error, "
        f"{sql_stamp('CASE WHEN failed THEN completed_at + to_milliseconds(delay_ms) ELSE completed_at END', 'available_at')}, "
        f"{sql_stamp('CASE WHEN NOT failed THEN completed_at END', 'sent_at')} FROM tried",
        *BASE, **STORED,
    ),
)
def delivery_transitions(spark, sf):
    queue = _deliveries(spark, sf)
    moved = notify.apply_results(queue, _results(queue))
    return moved.select("id", "status", "attempt_count", "last_error", stamp("available_at"), stamp("sent_at"))


@query(
    "payload_backfill",
    fx.with_ctes(
        "SELECT d.id, (SELECT e.id FROM deliveries e WHERE e.alert_instance_id = d.alert_instance_id AND e.created_at <= d.created_at AND e.event_type = 'triggered' "
        "ORDER BY e.created_at DESC LIMIT 1) AS payload_delivery FROM deliveries d",
        *BASE, **STORED,
    ),
)
def payload_backfill(spark, sf):
    """Only triggered deliveries left an enqueue event behind."""
    queue = _deliveries(spark, sf)
    kept = queue.filter(F.get_json_object("payload_json", "$.event_type") == "triggered")
    filled = notify.backfill_payload(queue, notify.enqueued_events(kept))
    return filled.select(
        "id", F.get_json_object("payload_json", "$.delivery_id").cast("bigint").alias("payload_delivery")
    )


@query(
    "alert_history",
    fx.with_ctes(
        f"SELECT i.id AS alert_instance_id, i.rule_id, c.rule_name, i.k AS dedupe_key, i.status, {sql_stamp('i.fired_at', 'first_fired_at')}, {sql_stamp('i.resolved_at', 'resolved_at')}, "
        "round(e.value, 9) AS triggering_value, d.status AS notification_status FROM instances i JOIN comp c ON c.rule_id = i.rule_id "
        "LEFT JOIN (SELECT alert_instance_id, arg_max(coalesce(nullif(metric_value, 0), CAST(match_count AS DOUBLE)), created_at) AS value FROM stored_events "
        "WHERE event_type IN ('triggered', 'suppressed') GROUP BY ALL) e ON e.alert_instance_id = i.id "
        "LEFT JOIN (SELECT alert_instance_id, arg_max(status, completed_at) AS status FROM tried GROUP BY ALL) d ON d.alert_instance_id = i.id "
        "WHERE i.tenant_id = 1 ORDER BY i.fired_at DESC, i.id DESC LIMIT 500",
        *BASE, **STORED,
    ),
)
def alert_history(spark, sf):
    events = _stored_events(spark, sf)
    queue = _deliveries(spark, sf, events)
    found = history.alert_history(
        lifecycle.instances_of(events), fx.rules(spark, sf), lifecycle.alert_events(events),
        notify.apply_results(queue, _results(queue)), 1, *RANGE, limit=500,
    )
    return found.select(
        "alert_instance_id", "rule_id", "rule_name", "dedupe_key", "status", stamp("first_fired_at"),
        stamp("resolved_at"), F.round("triggering_value", 9).alias("triggering_value"), "notification_status",
    )


@query(
    "alert_audit",
    fx.with_ctes(
        f"SELECT audit_id, alert_instance_id, rule_id, event_type, {sql_stamp('created_at')} FROM ("
        "SELECT 'event:' || id AS audit_id, alert_instance_id, rule_id, event_type, created_at FROM stored_events WHERE tenant_id = 1 UNION ALL "
        f"SELECT 'attempt:' || {_id(chr(39) + 'attempt' + chr(39), 'id', '1')}, alert_instance_id, rule_id, 'notification_attempt', completed_at FROM tried WHERE tenant_id = 1) x "
        "WHERE x.created_at >= TIMESTAMP '2024-01-01 00:00:00' AND x.created_at < TIMESTAMP '2024-02-15 00:00:00' ORDER BY x.created_at DESC, audit_id DESC LIMIT 500 OFFSET 20",
        *BASE, **STORED,
    ),
)
def alert_audit(spark, sf):
    events = _stored_events(spark, sf)
    queue = _deliveries(spark, sf, events)
    found = history.alert_audit(
        lifecycle.alert_events(events), notify.attempts_of(queue, _results(queue)), queue,
        lifecycle.instances_of(events), fx.rules(spark, sf), 1, *RANGE, limit=500, offset=20,
    )
    return found.select("audit_id", "alert_instance_id", "rule_id", "event_type", stamp("created_at"))


@query(
    "delivery_history",
    fx.with_ctes(
        f"SELECT id::BIGINT AS delivery_id, alert_instance_id, rule_id, target, status, {sql_stamp('created_at')}, {sql_stamp('completed_at', 'updated_at')} FROM tried "
        "WHERE tenant_id = 1 AND status = 'retrying' ORDER BY tried.created_at DESC, id DESC LIMIT 500",
        *BASE, **STORED,
    ),
)
def delivery_history(spark, sf):
    events = _stored_events(spark, sf)
    queue = _deliveries(spark, sf, events)
    found = history.delivery_history(
        notify.apply_results(queue, _results(queue)), lifecycle.instances_of(events),
        fx.rules(spark, sf), 1, *RANGE, status="retrying", limit=500,
    )
    return found.select(
        "delivery_id", "alert_instance_id", "rule_id", "target", "status", stamp("created_at"), stamp("updated_at")
    )


# --- rule authoring from a change log: one change per order

@query(
    "rules_current",
    fx.with_ctes(
        "SELECT rule_id, service, environment, name, severity, group_by, window_seconds, threshold, cooldown_seconds, status FROM ("
        "SELECT rule_id, arg_max(service, seq) FILTER (service IS NOT NULL) AS service, arg_max(environment, seq) FILTER (environment IS NOT NULL) AS environment, "
        "trim(arg_max(name, seq)) AS name, arg_max(severity, seq) FILTER (severity IS NOT NULL) AS severity, "
        "coalesce(arg_max(group_by, seq) FILTER (group_by IS NOT NULL), '[]') AS group_by, "
        "arg_max(window_seconds, seq) FILTER (window_seconds IS NOT NULL) AS window_seconds, arg_max(threshold, seq) FILTER (threshold IS NOT NULL) AS threshold, "
        "CASE coalesce(arg_max(cooldown_seconds, seq) FILTER (cooldown_seconds IS NOT NULL), 0) WHEN 0 THEN 600 ELSE 120 END AS cooldown_seconds, "
        "coalesce(lower(arg_max(status, seq) FILTER (status IS NOT NULL)), 'active') AS status, "
        "bool_or(action = 'create') AS created, bool_or(deleted) AS gone FROM (SELECT *, action = 'delete' AS deleted FROM changes WHERE NOT bad) "
        "WHERE true GROUP BY rule_id) WHERE created AND NOT gone",
        "rule_changes",
        changes="SELECT * REPLACE (CASE WHEN action = 'delete' THEN NULL ELSE name END AS name, CASE WHEN action = 'delete' THEN NULL ELSE service END AS service, "
        "CASE WHEN action = 'delete' THEN NULL ELSE environment END AS environment, CASE WHEN action = 'delete' THEN NULL ELSE severity END AS severity, "
        "CASE WHEN action = 'delete' THEN NULL ELSE group_by END AS group_by, CASE WHEN action = 'delete' THEN NULL ELSE window_seconds END AS window_seconds, "
        "CASE WHEN action = 'delete' THEN NULL ELSE threshold END AS threshold, CASE WHEN action = 'delete' THEN NULL ELSE cooldown_seconds END AS cooldown_seconds, "
        "CASE WHEN action = 'delete' THEN NULL ELSE status END AS status), "
        "action <> 'delete' AND (log_level = 'bad level' OR coalesce(window_seconds, 1) <= 0) AS bad FROM rule_changes",
    ),
)
def rules_current(spark, sf):
    found = authoring.current_rules(fx.rule_changes(spark, sf))
    return found.select(
        "rule_id", "service", "environment", "name", "severity", "group_by", "window_seconds", "threshold",
        "cooldown_seconds", "status",
    )
