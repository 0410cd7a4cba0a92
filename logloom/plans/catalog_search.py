"""Search, analytics, query documents and service graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.limits import DEFAULT, UNBOUNDED
from logloom.operators import analytics as an
from logloom.operators import graph, search
from logloom.operators.quantiles import exact_quantile
from logloom.plans import fixtures as fx
from logloom.plans.dsl import run_query
from logloom.plans.registry import query, sql_stamp, stamp

FIRST, LAST = "2024-01-01T00:00:00Z", "2024-01-31T00:00:00Z"
WEEK = ("2024-01-08T00:00:00Z", "2024-01-15T00:00:00Z")
IN_MONTH = "timestamp >= TIMESTAMP '2024-01-01 00:00:00' AND timestamp < TIMESTAMP '2024-01-31 00:00:00'"
IN_WEEK = "timestamp >= TIMESTAMP '2024-01-08 00:00:00' AND timestamp < TIMESTAMP '2024-01-15 00:00:00'"
CODE = "coalesce(json_extract_string(fields_json, '$.error_code'), '')"
DURATION = "TRY_CAST(json_extract_string(fields_json, '$.duration_ms') AS DOUBLE)"
ISO = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"
LOG_TEXT = (
    "tenant_id, service, environment, source, host, level, trace_id, message, fields_json, "
    "ingest_id, raw_size_bytes, event_id"
)


def _shown(df):
    return df.select(stamp("timestamp"), *LOG_TEXT.split(", "))


@query(
    "logs_search",
    fx.with_ctes(
        f"SELECT {sql_stamp('timestamp')}, {LOG_TEXT} FROM logs WHERE tenant_id = 2 AND {IN_WEEK} "
        "AND service = 'payments' AND level = 'error' ORDER BY logs.timestamp DESC, ingest_id DESC, event_id DESC LIMIT 1000",
        "logs",
    ),
)
def logs_search(spark, sf):
    wanted = search.log_query(2, *WEEK, service="payments", level="ERROR", limit=1000)
    return _shown(search.search_logs(fx.logs(spark, sf), wanted))


@query(
    "logs_page",
    fx.with_ctes(
        f"SELECT {sql_stamp('timestamp')}, {LOG_TEXT} FROM logs WHERE tenant_id = 1 AND {IN_WEEK} "
        "ORDER BY logs.timestamp DESC, ingest_id DESC, event_id DESC LIMIT 50 OFFSET 100",
        "logs",
    ),
)
def logs_page(spark, sf):
    wanted = search.log_query(1, *WEEK, limit=50, offset=100)
    return _shown(search.search_logs(fx.logs(spark, sf), wanted))


@query(
    "logs_page_after",
    fx.with_ctes(
        f"SELECT {sql_stamp('timestamp')}, {LOG_TEXT} FROM logs WHERE tenant_id = 1 AND {IN_WEEK} "
        "AND (logs.timestamp < TIMESTAMP '2024-01-12 00:00:00' OR (logs.timestamp = TIMESTAMP '2024-01-12 00:00:00' AND ingest_id < 'ing-1')) "
        "ORDER BY logs.timestamp DESC, ingest_id DESC, event_id DESC LIMIT 100",
        "logs",
    ),
)
def logs_page_after(spark, sf):
    wanted = search.log_query(1, *WEEK)
    cursor = {"timestamp": "2024-01-12T00:00:00Z", "ingest_id": "ing-1", "event_id": -1}
    return _shown(search.search_after(fx.logs(spark, sf), wanted, cursor))


@query(
    "trace_lookup",
    fx.with_ctes(
        f"SELECT {sql_stamp('timestamp')}, {LOG_TEXT} FROM logs WHERE tenant_id = 2 AND {IN_WEEK} "
        "AND trace_id = 't-1-2024-01-10' ORDER BY logs.timestamp DESC, ingest_id DESC, event_id DESC LIMIT 100",
        "logs",
    ),
)
def trace_lookup(spark, sf):
    wanted = search.log_query(2, *WEEK, trace_id="t-1-2024-01-10")
    return _shown(search.search_logs(fx.logs(spark, sf), wanted))


@query(
    "free_text_search",
    fx.with_ctes(
        f"SELECT {sql_stamp('timestamp')}, {LOG_TEXT} FROM logs WHERE level = 'fatal' AND tenant_id = 2 AND {IN_WEEK} "
        "AND contains(lower(service || ' ' || message || ' ' || trace_id), 'checkout purchase request')",
        "logs",
    ),
)
def free_text_search(spark, sf):
    return _shown(search.text_search(fx.logs(spark, sf), 2, *WEEK, "Checkout purchase REQUEST", "fatal"))


@query(
    "logs_ndjson",
    fx.with_ctes(
        "SELECT event_id, message, duration_ms FROM (SELECT event_id, message, "
        "CAST(json_extract_string(fields_json, '$.duration_ms') AS BIGINT) AS duration_ms, timestamp, ingest_id "
        f"FROM logs WHERE tenant_id = 3 AND {IN_WEEK} ORDER BY timestamp DESC, ingest_id DESC, event_id DESC LIMIT 1000)",
        "logs",
    ),
)
def logs_ndjson(spark, sf):
    wanted = search.log_query(3, *WEEK, limit=1000)
    lines = search.as_ndjson(search.search_logs(fx.logs(spark, sf), wanted))
    return lines.select(
        F.get_json_object("value", "$.event_id").cast("bigint").alias("event_id"),
        F.get_json_object("value", "$.message").alias("message"),
        F.get_json_object("value", "$.fields.duration_ms").cast("bigint").alias("duration_ms"),
    )


@query(
    "overview_kpis",
    fx.with_ctes(
        "SELECT count(*) AS events, count(*) FILTER (level = 'error') AS errors, "
        "CAST(round(count(*) FILTER (level = 'error') * 100.0 / count(*), 1) AS DOUBLE) AS error_percent, "
        f"count(DISTINCT service) AS services, {sql_stamp('max(timestamp)', 'newest')}, "
        "(SELECT count(*) FROM many_rules WHERE status = 'active') AS active_alerts FROM logs",
        "logs",
        "many_rules",
    ),
)
def overview_kpis(spark, sf):
    alerts = fx.many_rules(spark, sf).select(
        F.when(F.col("status") == "active", "firing").otherwise("resolved").alias("status")
    )
    shown = search.overview(fx.logs(spark, sf), alerts)
    return shown.withColumn("newest", stamp("newest"))


# --- analytics


def _analytics(spark, sf, tenant, aggregation, approximate=False, **options):
    wanted = an.analytics_query(tenant, FIRST, LAST, aggregation, limits=UNBOUNDED, **options)
    return an.analytics(fx.logs(spark, sf), wanted, approximate)


@query(
    "analytics_bucket_count",
    fx.with_ctes(
        f"SELECT {ISO.format('date_trunc(' + chr(39) + 'day' + chr(39) + ', timestamp)')} AS bucket, service AS group_service, "
        f"{CODE} AS group_error_code, CAST(count(*) AS DOUBLE) AS value FROM logs "
        f"WHERE tenant_id = 1 AND {IN_MONTH} GROUP BY ALL ORDER BY bucket DESC, group_service, group_error_code LIMIT 10000",
        "logs",
    ),
)
def analytics_bucket_count(spark, sf):
    return _analytics(spark, sf, 1, "count", bucket="day", group_by=["service", "error_code"], limit=10000)


@query(
    "analytics_count",
    fx.with_ctes(
        f"SELECT environment AS group_env, level AS group_level, CAST(count(*) AS DOUBLE) AS value FROM logs "
        f"WHERE tenant_id = 2 AND {IN_MONTH} GROUP BY ALL ORDER BY 1, 2 LIMIT 100",
        "logs",
    ),
)
def analytics_count(spark, sf):
    return _analytics(spark, sf, 2, "count", group_by="env,level")


@query(
    "analytics_total",
    fx.with_ctes(f"SELECT CAST(count(*) AS DOUBLE) AS value FROM logs WHERE tenant_id = 3 AND {IN_MONTH}", "logs"),
)
def analytics_total(spark, sf):
    return _analytics(spark, sf, 3, "count")


@query(
    "analytics_empty_total",
    fx.with_ctes(f"SELECT CAST(count(*) AS DOUBLE) AS value FROM logs WHERE tenant_id = 99 AND {IN_MONTH}", "logs"),
)
def analytics_empty_total(spark, sf):
    return _analytics(spark, sf, 99, "count")


@query(
    "analytics_rate",
    fx.with_ctes(
        f"SELECT {ISO.format('date_trunc(' + chr(39) + 'hour' + chr(39) + ', timestamp)')} AS bucket, level AS group_level, "
        f"round(count(*) / 3600.0::DOUBLE, 9) AS value FROM logs WHERE tenant_id = 1 AND {IN_MONTH} GROUP BY ALL "
        "ORDER BY bucket DESC, group_level LIMIT 10000",
        "logs",
    ),
)
def analytics_rate(spark, sf):
    found = _analytics(spark, sf, 1, "rate", bucket="hour", group_by=["level"], limit=10000)
    return found.withColumn("value", F.round("value", 9))


@query(
    "analytics_filtered",
    fx.with_ctes(
        f"SELECT {ISO.format('date_trunc(' + chr(39) + 'day' + chr(39) + ', timestamp)')} AS bucket, CAST(count(*) AS DOUBLE) AS value "
        f"FROM logs WHERE tenant_id = 1 AND {IN_MONTH} AND service = 'payments' AND environment = 'prod' AND level = 'error' "
        f"AND {CODE} = 'E3' GROUP BY ALL ORDER BY bucket DESC LIMIT 100",
        "logs",
    ),
)
def analytics_filtered(spark, sf):
    return _analytics(
        spark, sf, 1, "count", bucket="day", service="payments", env="prod", level="Error", error_code="E3"
    )


@query(
    "analytics_percentile",
    fx.with_ctes(
        f"SELECT service AS group_service, round(coalesce(quantile_cont({DURATION}, 0.95), 0.0), 6) AS value FROM logs "
        f"WHERE tenant_id = 1 AND {IN_MONTH} GROUP BY ALL ORDER BY 1 LIMIT 100",
        "logs",
    ),
)
def analytics_percentile(spark, sf):
    found = _analytics(
        spark, sf, 1, "percentile", percentile=95, value_field="field.duration_ms", group_by=["service"]
    )
    return found.withColumn("value", F.round("value", 6))


@query(
    "analytics_percentile_bucketed",
    fx.with_ctes(
        f"SELECT {ISO.format('date_trunc(' + chr(39) + 'day' + chr(39) + ', timestamp)')} AS bucket, level AS group_level, "
        "round(quantile_cont(CAST(raw_size_bytes AS DOUBLE), 0.5), 6) AS value FROM logs "
        f"WHERE tenant_id = 2 AND {IN_MONTH} GROUP BY ALL ORDER BY bucket DESC, group_level LIMIT 10000",
        "logs",
    ),
)
def analytics_percentile_bucketed(spark, sf):
    found = _analytics(
        spark, sf, 2, "percentile", percentile=50, value_field="raw_size_bytes", bucket="day",
        group_by=["level"], limit=10000,
    )
    return found.withColumn("value", F.round("value", 6))


@query(
    "analytics_percentile_missing",
    fx.with_ctes(
        f"SELECT service AS group_service, 0.0::DOUBLE AS value FROM logs WHERE tenant_id = 1 AND {IN_MONTH} "
        "GROUP BY ALL ORDER BY 1 LIMIT 100",
        "logs",
    ),
)
def analytics_percentile_missing(spark, sf):
    """A value field no row has reports 0 for every group."""
    return _analytics(
        spark, sf, 1, "percentile", percentile=95, value_field="field.absent", group_by=["service"]
    )


@query(
    "analytics_percentile_approx",
    fx.with_ctes(
        f"SELECT service AS group_service, true AS within FROM logs WHERE tenant_id = 1 AND {IN_MONTH} GROUP BY ALL ORDER BY 1 LIMIT 100",
        "logs",
    ),
)
def analytics_percentile_approx(spark, sf):
    """The sketched percentile lies between the exact ones three percent of the ranks to either side."""
    asked = {"value_field": "field.duration_ms", "group_by": ["service"]}
    rough = _analytics(spark, sf, 1, "percentile", approximate=True, percentile=95, **asked)
    low, high = (
        _analytics(spark, sf, 1, "percentile", percentile=p, **asked).withColumnRenamed("value", name)
        for p, name in ((92, "low"), (98, "high"))
    )
    return rough.join(low, "group_service").join(high, "group_service").select(
        "group_service", F.col("value").between(F.floor("low"), F.ceil("high")).alias("within"))


@query(
    "close_values_percentile",
    "SELECT l_returnflag, round(quantile_cont(CAST(1700000000 + l_orderkey AS DOUBLE), 0.95), 3) AS key_p95, "
    "round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.5), 3) AS price_p50 FROM lineitem GROUP BY ALL",
)
def close_values_percentile(spark, sf):
    """Percentiles of numbers of close magnitude, which share one coarse range."""
    rows = fx.table(spark, sf, "lineitem").select(
        "l_returnflag", (F.lit(1700000000) + F.col("l_orderkey")).cast("double").alias("key"),
        F.col("l_extendedprice").cast("double").alias("price"))
    keys = exact_quantile(rows, ["l_returnflag"], "key", 95.0, "key_p95")
    prices = exact_quantile(rows, ["l_returnflag"], "price", 50.0, "price_p50")
    return keys.join(prices, "l_returnflag").select(
        "l_returnflag", F.round("key_p95", 3).alias("key_p95"), F.round("price_p50", 3).alias("price_p50"))


@query(
    "analytics_topk",
    fx.with_ctes(
        f"SELECT service AS group_service, level AS group_level, {CODE} AS group_error_code, CAST(count(*) AS DOUBLE) AS value "
        f"FROM logs WHERE tenant_id = 3 AND {IN_MONTH} GROUP BY ALL "
        "ORDER BY value DESC, group_service, group_level, group_error_code LIMIT 5",
        "logs",
    ),
)
def analytics_topk(spark, sf):
    return _analytics(spark, sf, 3, "count", group_by=["service", "level", "error_code"], top_k=5)


@query(
    "volume_series",
    fx.with_ctes(
        f"SELECT {sql_stamp('g.bucket', 'bucket')}, count(l.event_id) AS events, count(l.event_id) FILTER (l.level = 'error') AS errors "
        "FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-31 00:00:00', TIMESTAMP '2024-01-31 23:00:00', INTERVAL 1 HOUR)) AS bucket) g "
        "LEFT JOIN logs l ON date_trunc('hour', l.timestamp) = g.bucket AND l.tenant_id = 1 GROUP BY g.bucket",
        "logs",
    ),
)
def volume_series(spark, sf):
    rows = an.volume_series(fx.logs(spark, sf), 1, "2023-12-31T00:00:00Z", "2024-02-01T00:00:00Z", "hour")
    return rows.select(stamp("bucket"), "events", "errors")


@query(
    "dsl_logs",
    fx.with_ctes(
        f"SELECT {sql_stamp('timestamp')}, {LOG_TEXT} FROM logs WHERE tenant_id = 3 AND {IN_WEEK} AND service = 'gateway' "
        "ORDER BY logs.timestamp DESC, ingest_id DESC, event_id DESC LIMIT 25 OFFSET 10",
        "logs",
    ),
)
def dsl_logs(spark, sf):
    request = {"type": "logs", "start": WEEK[0], "end": WEEK[1], "service": "gateway", "page_size": 25, "offset": 10}
    return _shown(run_query(fx.logs(spark, sf), 3, request))


@query(
    "dsl_analytics",
    fx.with_ctes(
        f"SELECT service AS group_service, CAST(count(*) AS DOUBLE) AS value FROM logs WHERE tenant_id = 2 AND {IN_MONTH} "
        "AND level = 'info' GROUP BY ALL ORDER BY value DESC, group_service LIMIT 2",
        "logs",
    ),
)
def dsl_analytics(spark, sf):
    request = (
        '{"type":"analytics","start":"%s","end":"%s","aggregation":"count","group_by":["service"],'
        '"level":"info","top_k":2}' % (FIRST, LAST)
    )
    return run_query(fx.logs(spark, sf), 2, request)


# --- service graph

J = "json_extract_string(fields_json, '$.{}')"
FLOWS = (
    "SELECT *, CASE WHEN sid <> '' THEN 'session' WHEN rid <> '' THEN 'request' WHEN trace_id <> '' THEN 'trace' "
    "WHEN user_key <> '' THEN 'user' END AS flow_kind, "
    "coalesce(nullif(sid, ''), nullif(rid, ''), nullif(trace_id, ''), nullif(user_key, '')) AS flow_id, "
    "level IN ('error', 'fatal') AS is_error FROM (SELECT *, "
    f"coalesce({J.format('session_id')}, '') AS sid, coalesce({J.format('request_id')}, '') AS rid, "
    f"coalesce({J.format('user_id')}, '') AS user_key, "
    f"lower(trim(coalesce(json_extract_string(fields_json, '$.\"Caller-Service\"'), ''))) AS up, "
    f"lower(trim(coalesce({J.format('downstream_service')}, ''))) AS down "
    f"FROM logs WHERE tenant_id = 1 AND {IN_MONTH})"
)
EDGES = (
    "SELECT flow_kind, flow_id, source, target, bool_or(error) AS error, bool_or(propagated) AS propagated FROM ("
    "SELECT flow_kind, flow_id, up AS source, service AS target, is_error AS error, false AS propagated FROM flows WHERE up <> '' AND up <> service "
    "UNION ALL SELECT flow_kind, flow_id, service, down, is_error, false FROM flows WHERE down <> '' AND down <> service "
    "UNION ALL SELECT flow_kind, flow_id, p, service, is_error, is_error AND pe FROM (SELECT *, "
    "lag(service) OVER w AS p, lag(is_error) OVER w AS pe FROM flows "
    "WINDOW w AS (PARTITION BY flow_kind, flow_id ORDER BY timestamp, ingest_id, event_id)) WHERE p <> service) "
    "GROUP BY ALL"
)
SEEN = (
    "SELECT DISTINCT flow_kind, flow_id, s AS service FROM (SELECT flow_kind, flow_id, service AS s FROM flows "
    "UNION ALL SELECT flow_kind, flow_id, up FROM flows UNION ALL SELECT flow_kind, flow_id, down FROM flows) WHERE s <> ''"
)


def _graph_rows(spark, sf, **filters):
    return graph.graph_rows(fx.logs(spark, sf), 1, FIRST, LAST, limits=UNBOUNDED, **filters)


@query(
    "flow_identity",
    fx.with_ctes("SELECT event_id, flow_kind, flow_id, user_key AS user_id, up AS upstream, down AS downstream FROM flows",
                 "logs", flows=FLOWS),
)
def flow_identity(spark, sf):
    return graph.flow_rows(_graph_rows(spark, sf)).select(
        "event_id", "flow_kind", "flow_id", "user_id", "upstream", "downstream"
    )


@query(
    "service_edges",
    fx.with_ctes(
        "SELECT source, target, count(*) AS flow_count, count(*) FILTER (error) AS error_flow_count, "
        "count(*) FILTER (propagated) AS propagated_error_count FROM edges GROUP BY ALL",
        "logs", flows=FLOWS, edges=EDGES,
    ),
)
def service_edges(spark, sf):
    return graph.service_edges(_graph_rows(spark, sf))


@query(
    "service_nodes",
    fx.with_ctes(
        "SELECT coalesce(a.service, b.service) AS service, coalesce(log_count, 0) AS log_count, "
        "coalesce(error_count, 0) AS error_count, coalesce(flow_count, 0) AS flow_count FROM "
        "(SELECT service, count(*) AS log_count, count(*) FILTER (is_error) AS error_count FROM flows GROUP BY ALL) a "
        "FULL JOIN (SELECT service, count(*) AS flow_count FROM seen GROUP BY ALL) b ON a.service = b.service",
        "logs", flows=FLOWS, seen=SEEN,
    ),
)
def service_nodes(spark, sf):
    return graph.service_nodes(_graph_rows(spark, sf))


SESSIONS = (
    "SELECT flow_kind AS kind, flow_id AS id, arg_min(user_key, (timestamp, ingest_id, event_id)) FILTER (user_key <> '') AS user_id, "
    "count(DISTINCT trace_id) FILTER (trace_id <> '') AS trace_count, min(timestamp) AS started_at, max(timestamp) AS ended_at, "
    "count(*) AS log_count, count(*) FILTER (is_error) AS error_count FROM flows GROUP BY ALL"
)


@query(
    "flow_sessions",
    fx.with_ctes(
        f"SELECT x.kind, x.id, coalesce(x.user_id, '') AS user_id, x.trace_count, y.services, {sql_stamp('x.started_at', 'started_at')}, "
        f"{sql_stamp('x.ended_at', 'ended_at')}, x.log_count, x.error_count FROM sessions x JOIN "
        "(SELECT flow_kind, flow_id, string_agg(service, ',' ORDER BY service) AS services FROM seen GROUP BY ALL) y "
        "ON x.kind = y.flow_kind AND x.id = y.flow_id",
        "logs", flows=FLOWS, seen=SEEN, sessions=SESSIONS,
    ),
)
def flow_sessions(spark, sf):
    found = graph.flow_sessions(_graph_rows(spark, sf))
    return found.select(
        "kind", "id", "user_id", "trace_count", F.array_join("services", ",").alias("services"),
        stamp("started_at"), stamp("ended_at"), "log_count", "error_count",
    )


@query(
    "flow_traces",
    fx.with_ctes(
        "SELECT DISTINCT flow_kind, flow_id, trace_id FROM flows WHERE trace_id <> ''", "logs", flows=FLOWS
    ),
)
def flow_traces(spark, sf):
    return graph.flow_traces(_graph_rows(spark, sf))


@query(
    "session_page",
    fx.with_ctes(
        f"SELECT x.kind, x.id, {sql_stamp('x.started_at', 'started_at')}, x.log_count, "
        "coalesce(string_agg(DISTINCT f.trace_id, ',' ORDER BY f.trace_id) FILTER (f.trace_id <> ''), '') AS trace_ids "
        "FROM (SELECT * FROM sessions ORDER BY started_at DESC, id, kind LIMIT 20) x "
        "JOIN flows f ON f.flow_kind = x.kind AND f.flow_id = x.id GROUP BY ALL",
        "logs", flows=FLOWS, sessions=SESSIONS,
    ),
)
def session_page(spark, sf):
    page = graph.session_page(_graph_rows(spark, sf), 20)
    return page.select(
        "kind", "id", stamp("started_at"), "log_count", F.array_join("trace_ids", ",").alias("trace_ids")
    )


@query(
    "graph_filtered",
    fx.with_ctes(
        f"SELECT event_id, service, level, trace_id, {sql_stamp('timestamp')} FROM logs WHERE tenant_id = 1 AND {IN_MONTH} "
        f"AND coalesce({J.format('session_id')}, '') = 's-6' AND coalesce({J.format('user_id')}, '') = 'u-6'",
        "logs",
    ),
)
def graph_filtered(spark, sf):
    rows = _graph_rows(spark, sf, session_id="s-6", user_id=" u-6 ")
    return rows.select("event_id", "service", "level", "trace_id", stamp("timestamp"))


@query(
    "graph_truncation",
    fx.with_ctes(
        f"SELECT least(count(*), 1000) AS record_count, count(*) > 1000 AS truncated FROM logs WHERE tenant_id = 1 AND {IN_MONTH}",
        "logs",
    ),
)
def graph_truncation(spark, sf):
    return graph.truncation(_graph_rows(spark, sf), 1000, DEFAULT)


@query(
    "graph_capped",
    fx.with_ctes(
        f"SELECT event_id, service, (SELECT count(*) > 500 FROM logs WHERE tenant_id = 1 AND {IN_MONTH}) AS truncated "
        f"FROM logs WHERE tenant_id = 1 AND {IN_MONTH} ORDER BY timestamp, ingest_id, event_id LIMIT 500",
        "logs",
    ),
)
def graph_capped(spark, sf):
    return graph.capped(_graph_rows(spark, sf), 500, DEFAULT).select("event_id", "service", "truncated")


