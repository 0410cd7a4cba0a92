"""Admission, normalisation, template and delivery queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.functions import retry
from logloom.functions.hashing import log_fingerprint
from logloom.functions.jsonfields import (
    HOST_KEYS,
    TRACE_KEYS,
    canonical_fields,
    loose_keys,
    sorted_json,
    value_map,
    without_keys,
)
from logloom.functions.templates import message_template, template_id
from logloom.functions.text import ingest_level, stored_level
from logloom.operators import admission, integrity, normalize
from logloom.plans import fixtures as fx
from logloom.plans.registry import query, sql_stamp, stamp
from logloom.session import run_folder
from logloom.sources import batches, logs_table
from logloom.streaming import pipeline


# --- admission


def _decoded(spark, sf):
    return batches.decode_batches(fx.ingest_bodies(spark, sf))


@query(
    "ingest_decode",
    fx.with_ctes(
        "SELECT b, copy, decode_error, CASE WHEN decode_error IS NULL THEN concat('  Svc-', b % 5, ' ') END AS service, "
        "CASE WHEN decode_error IS NULL THEN log_count ELSE -1 END AS log_count FROM bodies",
        "records", "bodies",
    ),
)
def ingest_decode(spark, sf):
    return _decoded(spark, sf).select(
        "b", "copy", "decode_error", "service",
        F.coalesce(F.size("logs"), F.lit(-1)).cast("bigint").alias("log_count"),
    )


@query(
    "validate_batches",
    fx.with_ctes(
        "SELECT b, copy, coalesce(decode_error, invalid) AS reason, "
        "CASE WHEN coalesce(decode_error, invalid) IS NULL THEN 'accepted' ELSE 'rejected' END AS decision FROM bodies",
        "records", "bodies",
    ),
)
def validate_batches(spark, sf):
    return admission.validate_batches(_decoded(spark, sf)).select("b", "copy", "reason", "decision")


RECORD_CASES = """CASE event_id % 11 WHEN 0 THEN 'timestamp is required' WHEN 1 THEN 'timestamp must be RFC3339'
 WHEN 2 THEN 'level is unsupported' WHEN 3 THEN 'message is required'
 WHEN 4 THEN 'fields["zz"]: unsupported field value type object'
 WHEN 5 THEN 'fields key "bad key" contains unsupported characters' WHEN 6 THEN 'fields keys must be non-empty'
 WHEN 7 THEN 'fields["list"]: unsupported field value type object' END"""


@query(
    "validate_records",
    fx.with_ctes(f"SELECT event_id, {RECORD_CASES} AS reason FROM events"),
)
def validate_records(spark, sf):
    case = F.col("event_id") % 11
    added = (
        F.when(case == 4, '{"zz":{"a":"b"},')
        .when(case == 5, '{" bad key ":"x",')
        .when(case == 6, '{"  ":1,')
        .when(case == 7, '{"list":["{",[{"a":1}]],')
        .when(case == 8, '{"text":"a { brace","list":["{}",null,true],')
        .otherwise("{")
    )
    record = F.struct(
        F.when(case == 0, " ").when(case == 1, F.expr("CAST(ts_millis AS STRING)")).otherwise(F.col("raw_ts")).alias("timestamp"),
        F.when(case == 2, "verbose").otherwise(F.col("raw_level")).alias("level"),
        F.when(case == 3, " \t\n").otherwise(F.col("message")).alias("message"),
        value_map(F.concat(added, F.substring("raw_fields", F.lit(2), F.length("raw_fields")))).alias("fields"),
    )
    rows = fx.records(spark, sf).withColumn("record", record)
    return rows.select("event_id", admission.record_error(F.col("record")).alias("reason"))


LEVEL_TEXT = (
    "CASE event_id % 12 WHEN 0 THEN '' WHEN 1 THEN ' Info' WHEN 2 THEN 'INFORMATIONAL' WHEN 3 THEN 'Warning ' "
    "WHEN 4 THEN 'warn' WHEN 5 THEN 'Err' WHEN 6 THEN 'ERROR' WHEN 7 THEN 'Debug' WHEN 8 THEN 'trace' "
    "WHEN 9 THEN 'Panic' WHEN 10 THEN 'critical' ELSE concat('Odd-', event_type) END"
)


@query(
    "level_canon",
    "SELECT event_id, CASE event_id % 12 WHEN 1 THEN 'info' WHEN 2 THEN 'info' WHEN 3 THEN 'warn' WHEN 4 THEN 'warn' "
    "WHEN 5 THEN 'error' WHEN 6 THEN 'error' WHEN 7 THEN 'debug' WHEN 8 THEN 'trace' WHEN 9 THEN 'fatal' WHEN 10 THEN 'fatal' END AS ingest_level, "
    "CASE event_id % 12 WHEN 0 THEN 'info' WHEN 1 THEN 'info' WHEN 2 THEN 'info' WHEN 3 THEN 'warn' WHEN 4 THEN 'warn' "
    "WHEN 5 THEN 'error' WHEN 6 THEN 'error' WHEN 7 THEN 'debug' WHEN 8 THEN 'trace' WHEN 9 THEN 'fatal' WHEN 10 THEN 'fatal' "
    "ELSE lower(concat('Odd-', event_type)) END AS stored_level FROM events",
)
def level_canon(spark, sf):
    rows = fx.table(spark, sf, "events").selectExpr("event_id", f"{LEVEL_TEXT} AS raw")
    return rows.select(
        "event_id", ingest_level("raw").alias("ingest_level"), stored_level("raw").alias("stored_level")
    )


@query("field_canon", fx.with_ctes("SELECT event_id, canonical_fields FROM records", "records"))
def field_canon(spark, sf):
    return fx.records(spark, sf).select(
        "event_id", canonical_fields(value_map("raw_fields")).alias("canonical_fields")
    )


@query("contract_check", fx.with_ctes("SELECT b, error AS reason FROM raw_batches", "records", "raw_batches"))
def contract_check(spark, sf):
    return fx.raw_events(spark, sf).select("b", normalize.batch_error().alias("reason"))


def _accepted(spark, sf):
    valid = admission.validate_batches(_decoded(spark, sf)).filter("reason IS NULL")
    return admission.canonical_batches(valid)


FINGERPRINTS = (
    "SELECT x.b, x.copy, x.tenant_id, x.log_count, substr(sha256(concat('{\"tenant_id\":', x.tenant_id, ',\"service\":\"svc-', x.b % 5, "
    "'\",\"env\":\"prod\",\"source\":\"app\",\"logs\":[', y.items, ']}')), 1, 32) AS fingerprint FROM bodies x JOIN "
    "(SELECT b, string_agg(concat('{\"timestamp\":\"', canonical_ts, '\",\"level\":\"', level, '\",\"message\":\"', message, "
    "'\",\"fields\":', canonical_fields, '}'), ',' ORDER BY position) AS items FROM records GROUP BY b) y USING (b) "
    "WHERE decode_error IS NULL AND invalid IS NULL"
)


@query(
    "batch_fingerprint",
    fx.with_ctes("SELECT b, copy, fingerprint FROM prints", "records", "bodies", prints=FINGERPRINTS),
)
def batch_fingerprint(spark, sf):
    return _accepted(spark, sf).select("b", "copy", admission.batch_fingerprint().alias("fingerprint"))


@query(
    "publish_raw",
    fx.with_ctes(
        "SELECT fingerprint AS msg_id, fingerprint AS request_id, tenant_id, concat('svc-', b % 5) AS service, 'prod' AS env, "
        "'2024-02-01T00:00:00Z' AS received_at, log_count FROM prints",
        "records", "bodies", prints=FINGERPRINTS,
    ),
)
def publish_raw(spark, sf):
    events = admission.to_raw_events(_accepted(spark, sf), F.lit("2024-02-01T00:00:00Z"))
    return events.select(
        batches.message_id().alias("msg_id"), "request_id", "tenant_id", "service", "env", "received_at",
        F.size("logs").cast("bigint").alias("log_count"),
    )


AUTH = (
    "SELECT q.*, k.id AS api_key_id, k.tenant_id, k.rate_limit_per_sec AS rate_limit, s.id AS service_id, "
    "CASE WHEN api_key = '' THEN 'missing_api_key' WHEN k.id IS NULL THEN 'invalid_api_key' "
    "WHEN s.id IS NULL THEN 'forbidden_scope' ELSE 'authorized' END AS outcome "
    "FROM api_requests q LEFT JOIN api_keys k ON sha256(q.api_key) = sha256(k.plain_key) AND k.status = 'active' "
    "LEFT JOIN services s ON s.tenant_id = k.tenant_id AND s.name = q.service AND s.environment = q.env "
    "AND (k.service_id IS NULL OR s.id = k.service_id)"
)
AUTH_TABLES = ("api_requests", "api_keys", "services")


@query(
    "resolve_tenant",
    fx.with_ctes(
        "SELECT request, k.id AS api_key_id, k.tenant_id AS resolved_tenant FROM api_requests q "
        "LEFT JOIN api_keys k ON sha256(q.api_key) = sha256(k.plain_key) AND k.status = 'active'",
        "api_requests", "api_keys",
    ),
)
def resolve_tenant(spark, sf):
    found = admission.resolve_tenant(fx.api_requests(spark, sf), fx.api_keys(spark, sf))
    return found.select("request", "api_key_id", "resolved_tenant")


def _authorized(spark, sf):
    return admission.authorize(fx.api_requests(spark, sf), fx.api_keys(spark, sf), fx.services(spark, sf))


@query(
    "authorize_batches",
    fx.with_ctes(
        "SELECT request, outcome, api_key_id, tenant_id, service_id, rate_limit FROM auth", *AUTH_TABLES, auth=AUTH
    ),
)
def authorize_batches(spark, sf):
    return _authorized(spark, sf).select(
        "request", "outcome", "api_key_id", "tenant_id", "service_id", "rate_limit"
    )


@query(
    "key_last_used",
    fx.with_ctes(
        f"SELECT k.id, {sql_stamp('max(received_at) FILTER (outcome = ' + chr(39) + 'authorized' + chr(39) + ')', 'last_used_at')} "
        "FROM api_keys k LEFT JOIN auth a ON a.api_key_id = k.id GROUP BY k.id",
        *AUTH_TABLES, auth=AUTH,
    ),
)
def key_last_used(spark, sf):
    used = admission.key_last_used(fx.api_keys(spark, sf), _authorized(spark, sf))
    return used.select("id", stamp("last_used_at"))


@query(
    "rate_limit",
    fx.with_ctes(
        "SELECT request, row_number() OVER (PARTITION BY api_key_id, date_trunc('second', received_at) "
        "ORDER BY received_at, request) <= rate_limit AS admitted FROM auth WHERE outcome = 'authorized'",
        *AUTH_TABLES, auth=AUTH,
    ),
)
def rate_limit(spark, sf):
    known = _authorized(spark, sf).filter("outcome = 'authorized'")
    return admission.rate_limit(known, ties=["request"]).select("request", "admitted")


@query(
    "ingest_outcomes",
    fx.with_ctes(
        "SELECT outcome, count(*) AS requests, CAST(sum(CASE WHEN outcome = 'authorized' THEN 1 ELSE 0 END) AS BIGINT) AS accepted_batches, "
        "CAST(sum(CASE WHEN outcome = 'authorized' THEN log_count ELSE 0 END) AS BIGINT) AS accepted_logs, "
        "CAST(sum(CASE WHEN outcome = 'authorized' THEN body_bytes ELSE 0 END) AS BIGINT) AS accepted_bytes FROM limited GROUP BY outcome",
        *AUTH_TABLES, auth=AUTH,
        limited="SELECT log_count, body_bytes, CASE WHEN outcome = 'authorized' AND row_number() OVER (PARTITION BY api_key_id, outcome, "
        "date_trunc('second', received_at) ORDER BY received_at, request) > rate_limit THEN 'rate_limited' ELSE outcome END AS outcome FROM auth",
    ),
)
def ingest_outcomes(spark, sf):
    known = _authorized(spark, sf)
    passed = admission.rate_limit(known.filter("outcome = 'authorized'"), ties=["request"])
    limited = passed.withColumn(
        "outcome", F.when(F.col("admitted"), F.col("outcome")).otherwise("rate_limited")
    ).drop("admitted")
    return admission.outcome_counts(limited.unionByName(known.filter("outcome <> 'authorized'")))


@query(
    "correlation_defaults",
    fx.with_ctes(
        "SELECT b, CASE WHEN b % 3 = 0 THEN concat('corr-', b) ELSE concat('head-', b) END AS correlation_id, "
        "CASE WHEN b % 4 <> 0 THEN concat('bt-', b, ' ') WHEN b % 8 <> 0 THEN concat('ht-', b) ELSE '' END AS trace_id FROM raw_batches",
        "records", "raw_batches",
    ),
)
def correlation_defaults(spark, sf):
    filled = normalize.correlation_defaults(fx.raw_events(spark, sf), "header_request_id", "header_trace_id")
    return filled.select("b", "correlation_id", "trace_id")


# --- normalisation

NORMAL = (
    "SELECT r.event_id, r.b, r.position, CASE WHEN r.event_id % 6 = 5 THEN TIMESTAMP '2024-02-01 00:00:00.123' ELSE ts_millis END AS timestamp, "
    "w.tenant_id, concat('svc-', r.b % 5) AS service, 'prod' AS environment, 'app' AS source, host, level, "
    "CASE WHEN trace_id <> '' THEN trace_id WHEN r.b % 4 = 0 THEN '' ELSE concat('bt-', r.b) END AS trace_id, message, "
    "kept_fields AS fields_json, w.request_id AS ingest_id, CAST(strlen(concat('{\"timestamp\":\"', "
    "CASE WHEN r.event_id % 6 = 5 THEN '  ' ELSE raw_ts END, '\",\"level\":\"', raw_level, '\",\"message\":\"  ', message, ' \",\"fields\":', "
    "raw_fields, '}')) AS BIGINT) AS raw_size_bytes FROM records r JOIN raw_batches w ON w.b = r.b WHERE w.error IS NULL"
)


def _normal(spark, sf):
    good = fx.raw_events(spark, sf).filter(normalize.batch_error().isNull())
    return normalize.normalize_batches(good, keep=["b"])


@query(
    "normalize_logs",
    fx.with_ctes(
        f"SELECT b, position, {sql_stamp('timestamp')}, tenant_id, service, environment, source, host, level, trace_id, "
        "message, message_template, template_id, fingerprint, fields_json, ingest_id, raw_size_bytes FROM templated",
        "records", "raw_batches", logs=NORMAL, templated=fx.SQL["templated"],
    ),
)
def normalize_logs(spark, sf):
    rows = _normal(spark, sf)
    return rows.withColumn("timestamp", stamp("timestamp")).withColumn("position", F.col("position").cast("bigint"))


@query(
    "extract_host_trace",
    fx.with_ctes("SELECT event_id, host, trace_id, kept_fields AS fields_json FROM records", "records"),
)
def extract_host_trace(spark, sf):
    rows = fx.records(spark, sf).select("event_id", value_map("raw_fields").alias("fields"))
    rows = rows.withColumn("loose", loose_keys(F.col("fields"), normalize.SEPARATORS))
    host, host_keys = normalize.extract_field(F.col("fields"), F.col("loose"), HOST_KEYS)
    trace, trace_keys = normalize.extract_field(F.col("fields"), F.col("loose"), TRACE_KEYS)
    rows = rows.withColumn("dropped", F.concat(host_keys, trace_keys))
    kept = without_keys(F.col("fields"), F.col("dropped"))
    return rows.select(
        "event_id", host.alias("host"), trace.alias("trace_id"), sorted_json(kept).alias("fields_json")
    )


@query(
    "log_fingerprint",
    fx.with_ctes("SELECT event_id, fingerprint FROM templated", "logs", "templated"),
)
def log_fingerprint_query(spark, sf):
    found = log_fingerprint("service", "environment", "source", "level", "message", "fields_json")
    return fx.logs(spark, sf).select("event_id", found.alias("fingerprint"))


@query(
    "raw_size",
    fx.with_ctes("SELECT tenant_id, service, sum(raw_size_bytes)::BIGINT AS bytes FROM normal GROUP BY ALL",
                 "records", "raw_batches", normal=NORMAL),
)
def raw_size(spark, sf):
    return _normal(spark, sf).groupBy("tenant_id", "service").agg(F.sum("raw_size_bytes").alias("bytes"))


@query(
    "log_templates",
    "SELECT doc_id, message_template, substr(sha256(message_template), 1, 32) AS template_id FROM "
    f"(SELECT doc_id, {fx.TEMPLATE_SQL.format(m='text')} AS message_template FROM documents)",
)
def log_templates(spark, sf):
    rows = fx.dealt(fx.table(spark, sf, "documents")).select("doc_id", message_template(F.col("text")).alias("message_template"))
    return rows.withColumn("template_id", template_id(F.col("message_template")))


@query(
    "retry_delay",
    "SELECT event_id AS delivery_id, attempt, greatest(30000, least(1800000, (delay * 1000000 + "
    "CASE WHEN j >= 0 THEN (j * (delay * 100000)) // 100 ELSE -((-j * (delay * 100000)) // 100) END) // 1000000))::BIGINT AS delay_ms "
    "FROM (SELECT event_id, attempt, least(30000 * (1::BIGINT << CAST(attempt - 1 AS INTEGER)), 1800000)::BIGINT AS delay, "
    "(event_id * 31 + attempt * 17) % 201 - 100 AS j FROM (SELECT event_id, event_id % 9 + 1 AS attempt FROM events))",
)
def retry_delay(spark, sf):
    rows = fx.table(spark, sf, "events").select(
        F.col("event_id").alias("delivery_id"), (F.col("event_id") % 9 + 1).alias("attempt")
    )
    return rows.withColumn("delay_ms", retry.retry_delay_ms(F.col("delivery_id"), F.col("attempt")))


@query(
    "notification_target",
    fx.with_ctes(
        "SELECT r.id, coalesce(nullif(trim(s.owner), ''), s.name || ':' || s.environment, s.name, 'tenant:' || r.tenant_id) AS target, "
        "'log' AS channel FROM many_rules r LEFT JOIN many_services s ON s.id = r.service_id",
        "many_rules", "many_services",
    ),
)
def notification_target(spark, sf):
    named = fx.many_services(spark, sf).select(
        F.col("id").alias("service_id"), F.col("name").alias("service"), "environment", "owner"
    )
    rows = fx.many_rules(spark, sf).join(named, "service_id", "left")
    target = retry.notification_target(F.col("owner"), F.col("service"), F.col("environment"), F.col("tenant_id"))
    return rows.select("id", target.alias("target"), F.lit(retry.CHANNEL).alias("channel"))


# --- delivery, storage


@query(
    "replay_from_sequence",
    fx.with_ctes("SELECT b, stream_seq, log_count FROM raw_batches WHERE stream_seq >= 101", "records", "raw_batches"),
)
def replay_from_sequence(spark, sf):
    again = batches.replay(fx.raw_events(spark, sf), "sequence", sequence=101)
    return again.select("b", "stream_seq", F.size("logs").cast("bigint").alias("log_count"))


@query(
    "replay_from_time",
    fx.with_ctes(
        "SELECT b, stream_seq, log_count FROM raw_batches WHERE stored_at >= TIMESTAMP '2024-02-01 02:00:00'",
        "records", "raw_batches",
    ),
)
def replay_from_time(spark, sf):
    again = batches.replay(fx.raw_events(spark, sf), "time", since="2024-02-01T04:00:00+02:00")
    return again.select("b", "stream_seq", F.size("logs").cast("bigint").alias("log_count"))


DLQ = (
    "SELECT b, request_id, tenant_id, CASE WHEN error IS NOT NULL THEN 'invalid_batch' "
    "WHEN b % 7 >= 5 THEN 'retry_exhausted' END AS reason, error FROM raw_batches"
)


@query(
    "dlq_route",
    fx.with_ctes(
        "SELECT request_id, reason, coalesce(error, 'delivery attempts used up') AS error, tenant_id, concat(request_id, ':', reason) AS message_id "
        "FROM dlq WHERE reason IS NOT NULL UNION ALL "
        "SELECT '', 'malformed_payload', decode_error, NULL, NULL FROM bodies WHERE decode_error IS NOT NULL",
        "records", "raw_batches", "bodies", dlq=DLQ,
    ),
)
def dlq_route(spark, sf):
    malformed = pipeline.malformed_letters(_decoded(spark, sf).filter("decode_error IS NOT NULL"))
    refused = pipeline.refused_letters(pipeline.classify(fx.raw_events(spark, sf)))
    letters = pipeline.distinct_letters(malformed.unionByName(refused))
    return letters.select(
        F.coalesce("request_id", F.lit("")).alias("request_id"), "reason", "error", "tenant_id",
        F.when(F.col("request_id") != "", F.concat_ws(":", "request_id", "reason")).alias("message_id"),
    )


@query(
    "replay_safe_append",
    fx.with_ctes(
        "SELECT DISTINCT ingest_id, tenant_id FROM logs WHERE CAST(substr(ingest_id, 5) AS BIGINT) % 4 <> 0", "logs"
    ),
)
def replay_safe_append(spark, sf):
    """Batches that are not yet in the sink, where every fourth one is."""
    keys = fx.logs(spark, sf).select("tenant_id", "ingest_id")
    done = keys.filter(F.substring("ingest_id", 5, 20).cast("bigint") % 4 == 0).distinct()
    return pipeline.not_yet_stored(keys, done).select("ingest_id", "tenant_id")


@query("tenant_row_counts", fx.with_ctes("SELECT tenant_id, count(*) AS row_count FROM logs GROUP BY ALL", "logs"))
def tenant_row_counts(spark, sf):
    return integrity.tenant_counts(fx.logs(spark, sf))


@query(
    "retention_keep",
    fx.with_ctes(
        "SELECT tenant_id, count(*) AS row_count FROM logs WHERE timestamp + INTERVAL 30 DAY >= TIMESTAMP '2024-02-10 12:00:00' GROUP BY ALL",
        "logs",
    ),
)
def retention_keep(spark, sf):
    return integrity.tenant_counts(logs_table.retained(fx.logs(spark, sf), "2024-02-10T12:00:00Z"))


@query(
    "reconcile_counts",
    fx.with_ctes(
        "SELECT tenant_id, count(*) AS old_rows, count(*) FILTER (NOT (tenant_id = 2 AND level = 'fatal')) AS new_rows, "
        "count(*) = count(*) FILTER (NOT (tenant_id = 2 AND level = 'fatal')) AS matches FROM logs GROUP BY ALL",
        "logs",
    ),
)
def reconcile_counts(spark, sf):
    """A copy that lost the fatal rows of one tenant is found out."""
    old = fx.logs(spark, sf)
    return integrity.reconcile_counts(old, old.filter("NOT (tenant_id = 2 AND level = 'fatal')"))


@query(
    "evolve_columns",
    fx.with_ctes(
        "SELECT event_id, message, '' AS message_template, '' AS template_id FROM templated WHERE event_id % 2 = 0 UNION ALL "
        "SELECT event_id, message, message_template, template_id FROM templated WHERE event_id % 2 = 1",
        "logs", "templated",
    ),
)
def evolve_columns(spark, sf):
    """Half of the table was written before the template columns existed."""
    rows = fx.templated_logs(spark, sf)
    old = rows.filter("event_id % 2 = 0").drop("message_template", "template_id")
    new = rows.filter("event_id % 2 = 1")
    return logs_table.evolve(old, new).select("event_id", "message", "message_template", "template_id")


@query(
    "read_completeness",
    fx.with_ctes(
        "SELECT coalesce(string_agg(CAST(d AS STRING), ',' ORDER BY d), '') AS missing_days, count(*) > 0 AS partial FROM "
        "(SELECT CAST(unnest(generate_series(TIMESTAMP '2023-12-25 00:00:00', TIMESTAMP '2024-02-04 00:00:00', INTERVAL 1 DAY)) AS DATE) AS d) "
        "WHERE d NOT IN (SELECT CAST(timestamp AS DATE) FROM logs)",
        "logs",
    ),
)
def read_completeness(spark, sf):
    found = logs_table.completeness(fx.logs(spark, sf), "2023-12-25T00:00:00Z", "2024-02-04T12:00:00Z")
    return found.select(F.array_join("missing_days", ",").alias("missing_days"), "partial")


@query(
    "integrity_report",
    fx.with_ctes(
        "SELECT 'services key' AS check_name, concat_ws('|', tenant_id, name, environment) AS key, count(*) AS row_count FROM many_services "
        "GROUP BY tenant_id, name, environment HAVING count(*) > 1 UNION ALL "
        "SELECT 'rule service' , CAST(service_id AS STRING), count(*) FROM many_rules WHERE service_id NOT IN (SELECT id FROM many_services) "
        "GROUP BY service_id UNION ALL "
        "SELECT 'order customer', CAST(o_custkey AS STRING), count(*) FROM orders WHERE o_custkey NOT IN (SELECT id FROM many_rules) GROUP BY o_custkey",
        "many_services", "many_rules",
    ),
)
def integrity_report(spark, sf):
    services, rules = fx.many_services(spark, sf), fx.many_rules(spark, sf)
    orders = fx.table(spark, sf, "orders")
    return integrity.report(
        [
            integrity.duplicate_keys(services, ["tenant_id", "name", "environment"], "services key"),
            integrity.orphans(rules, "service_id", services, "id", "rule service"),
            integrity.orphans(orders, "o_custkey", rules, "id", "order customer"),
        ]
    )


@query("stream_dedupe", fx.with_ctes("SELECT b, concat('req-', b) AS msg_id FROM raw_batches", "records", "raw_batches"))
def stream_dedupe(spark, sf):
    """Every batch is sent, and every 13th once more, through a real stream."""
    rows = fx.ingest_bodies(spark, sf).select(
        "b",
        F.concat(F.lit("req-"), F.col("b").cast("string")).alias("msg_id"),
        F.timestamp_seconds(F.col("b") * 600 + F.col("copy") * 90).alias("received"),
    )
    root = run_folder(spark)
    rows.write.parquet(f"{root}/in")
    stream = pipeline.drop_repeats(spark.readStream.schema(rows.schema).parquet(f"{root}/in"))
    job = (
        stream.writeStream.format("parquet")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    return spark.read.parquet(f"{root}/out").select("b", "msg_id")


STORED = (
    "SELECT b, tenant_id, log_count FROM bodies WHERE copy = 0 AND decode_error IS NULL AND invalid IS NULL"
)


@query(
    "stream_ingest",
    fx.with_ctes(
        "SELECT r.event_id % 25 AS position, s.tenant_id, r.level, count(*) AS row_count FROM records r JOIN stored s ON s.b = r.b GROUP BY ALL",
        "records", "bodies", stored=STORED,
    ),
)
def stream_ingest(spark, sf):
    """JSON bodies through both streams into the log table, counted afterwards."""
    root = run_folder(spark)
    bodies = fx.ingest_bodies(spark, sf).select(
        "body", "tenant_id", F.lit("2024-02-01T00:00:00Z").alias("received_at")
    )
    bodies.write.parquet(f"{root}/bodies")
    tables = pipeline.Tables(f"{root}/tables")
    stream = spark.readStream.schema(bodies.schema).parquet(f"{root}/bodies")
    pipeline.admit_stream(stream, tables).awaitTermination()
    pipeline.process_stream(spark, tables).awaitTermination()
    logs = pipeline.read_stored_logs(spark, tables)
    request = F.regexp_extract("message", r"request (\d+)", 1).cast("bigint")
    return logs.groupBy((request % 25).alias("position"), "tenant_id", "level").agg(
        F.count("*").alias("row_count")
    )
