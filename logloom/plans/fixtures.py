"""Log-shaped tables derived from the sample tables.

Each projection is written once as SQL expressions that Spark and DuckDB read
alike, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.normalize import with_templates
from logloom.session import utc

Projection = list[tuple[str, str]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """The sample tables are one row group each, which one task reads whatever the number of cores. A benchmark
    names a number of partitions to deal them out to; without it tables are left as they are read."""
    parts = df.sparkSession.conf.get("logloom.sample.partitions", None)
    return df.repartition(int(parts)) if parts else df


def _select(projection: Projection, source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {a}" for e, a in projection) + f" FROM {source}"


def _apply(df: DataFrame, projection: Projection) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {a}" for e, a in projection])


LOGS: Projection = [
    ("event_id", "event_id"),
    ("date_trunc('millisecond', ts)", "timestamp"),
    ("user_id % 3 + 1", "tenant_id"),
    (
        "CASE event_type WHEN 'view' THEN 'catalog' WHEN 'click' THEN 'gateway' WHEN 'signup' THEN 'accounts' "
        "WHEN 'purchase' THEN 'checkout' ELSE 'payments' END",
        "service",
    ),
    ("CASE WHEN event_id % 5 = 0 THEN 'dev' ELSE 'prod' END", "environment"),
    ("'app'", "source"),
    ("concat('h', CAST(user_id % 10 AS STRING))", "host"),
    (
        "CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'purchase' AND value > 100 THEN 'fatal' "
        "WHEN event_type = 'signup' THEN 'warn' ELSE 'info' END",
        "level",
    ),
    (
        "CASE WHEN event_id % 5 = 3 THEN '' ELSE concat('t-', CAST(user_id AS STRING), '-', "
        "CAST(CAST(ts AS DATE) AS STRING)) END",
        "trace_id",
    ),
    (
        "concat(event_type, ' request ', CAST(event_id AS STRING), ' took ', "
        "CAST(CAST(floor(value) AS BIGINT) AS STRING), ' ms from 10.0.0.', CAST(user_id % 250 AS STRING))",
        "message",
    ),
    (
        "concat('{\"duration_ms\":', CAST(CAST(floor(value) AS BIGINT) AS STRING), "
        "CASE WHEN event_type = 'error' THEN concat(',\"error_code\":\"E', CAST(user_id % 7 AS STRING), '\"') ELSE '' END, "
        "CASE WHEN event_id % 5 = 0 THEN concat(',\"session_id\":\"s-', CAST(user_id % 40 AS STRING), '\"') "
        "WHEN event_id % 5 = 1 THEN concat(',\"request_id\":\"r-', CAST(user_id % 60 AS STRING), '\"') ELSE '' END, "
        "CASE WHEN event_id % 11 = 0 THEN ',\"downstream_service\":\"ledger\"' ELSE '' END, "
        "CASE WHEN event_id % 13 = 0 THEN ',\"Caller-Service\":\" Edge \"' ELSE '' END, "
        "',\"user_id\":\"u-', CAST(user_id AS STRING), '\"}')",
        "fields_json",
    ),
    ("concat('ing-', CAST(CAST(floor(event_id / 25) AS BIGINT) AS STRING))", "ingest_id"),
    ("CAST(length(event_type) + 80 + event_id % 40 AS BIGINT)", "raw_size_bytes"),
]

REQUESTS: Projection = [
    ("event_id", "event_id"),
    ("ts", "ts"),
    ("CASE WHEN event_type IN ('view','click') THEN 'query-api' ELSE 'ingest-api' END", "service"),
    (
        "concat('/v1/', CASE event_type WHEN 'view' THEN 'logs' WHEN 'click' THEN 'analytics' ELSE 'logs' END)",
        "route",
    ),
    (
        "CASE WHEN event_type = 'error' AND value > 20 THEN 503 WHEN event_type = 'error' THEN 429 "
        "WHEN event_id % 50 = 0 THEN 404 ELSE 200 END",
        "code",
    ),
    ("value / 100", "duration_s"),
]

SERVICES_SQL = """SELECT * FROM (VALUES (1,1,'payments','prod','team-pay'),(2,1,'checkout','prod',NULL),
 (3,2,'payments','prod',NULL),(4,2,'gateway','prod','team-edge'),(5,3,'accounts','dev',NULL))
 AS t(id, tenant_id, name, environment, owner)"""

RULES_SQL = """SELECT * FROM (VALUES
 (1,1,1,   'payment errors',  'count_threshold',     'high',    'error',NULL,'["service"]',604800,'5',600,'active'),
 (2,1,NULL,'any took 4x ms',  'pattern_match',       'medium',  NULL,'{"pattern":"TOOK 4"}','[]',604800,'10',600,'active'),
 (3,2,NULL,'error rate',      'rate_threshold',      'high',    'error',NULL,'["service"]',86400,'0.0001',0,'active'),
 (4,3,NULL,'latency p95',     'percentile_threshold','critical',NULL,'{"value_field":"field.duration_ms","percentile":95}','["service","field.region"]',259200,'50',600,'active'),
 (5,2,3,   'bad threshold',   'count_threshold',     'low',     NULL,NULL,'[]',300,'20.5',600,'active'),
 (6,3,NULL,'off',             'count_threshold',     'low',     NULL,NULL,'[]',300,'1',600,'disabled'),
 (7,1,NULL,'code E3',         'count_threshold',     'low',     NULL,'{"message_contains":"REQUEST 1","field_equals":{"error_code":"E3"}}','["host"]',0,'1',0,'active'),
 (8,2,NULL,'median size',     'percentile_based',    'low',     NULL,'{"value_field":"raw_size_bytes","percentile":50,"source":" APP "}','["level"]',604800,'0',3600,'active'),
 (9,3,NULL,'trace on h3',     'pattern_match',       'medium',  NULL,'{"pattern":"T-1","target":"trace_id","host":"h3"}','["environment"]',1209600,'2',86400,'active'),
 (10,1,NULL,'payments rate',  'rate_based',          'high',    NULL,'{"service":"payments","environment":"prod"}','[]',86400,'0',0,'active'),
 (11,1,NULL,'host errors',    'count_threshold',     'high',    'error',NULL,'["host"]',86400,'3',172800,'active'))
 AS t(id, tenant_id, service_id, name, rule_type, severity, log_level, filter_json, group_by, window_seconds, threshold, cooldown_seconds, status)"""

API_KEYS_SQL = """SELECT * FROM (VALUES (1,1,NULL,'key-1','active',2),(2,2,4,'key-2','active',3),
 (3,3,NULL,'key-3','disabled',100)) AS t(id, tenant_id, service_id, plain_key, status, rate_limit_per_sec)"""

# services, rules and a rule change log in the thousands, from the business tables
MANY_SERVICES: Projection = [
    ("s_suppkey + 1", "id"),
    ("s_suppkey % 3 + 1", "tenant_id"),
    ("concat('svc-', CAST(s_nationkey AS STRING))", "name"),
    ("CASE WHEN s_suppkey % 2 = 0 THEN 'prod' ELSE 'dev' END", "environment"),
    ("CASE WHEN s_suppkey % 4 = 0 THEN s_name WHEN s_suppkey % 4 = 1 THEN '  ' END", "owner"),
]

MANY_RULES: Projection = [
    ("c_custkey + 1", "id"),
    ("c_custkey % 3 + 1", "tenant_id"),
    ("CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 120 + 1 END", "service_id"),
    ("c_name", "name"),
    (
        "CASE c_nationkey % 7 WHEN 0 THEN 'count_threshold' WHEN 1 THEN ' Pattern_Match ' WHEN 2 THEN 'rate_threshold' "
        "WHEN 3 THEN 'rate_based' WHEN 4 THEN 'percentile_threshold' WHEN 5 THEN 'PERCENTILE_BASED' ELSE 'ratio' END",
        "rule_type",
    ),
    ("lower(c_mktsegment)", "severity"),
    ("CASE WHEN c_custkey % 5 = 0 THEN 'error' END", "log_level"),
    (
        "CASE c_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '{' WHEN 2 THEN '{\"pattern\":\"x\"}' "
        "WHEN 3 THEN '{\"value_field\":\"raw_size_bytes\",\"percentile\":95}' "
        "WHEN 4 THEN '{\"value_field\":\"field.a\",\"percentile\":100}' "
        "WHEN 5 THEN '{\"value_field\":\"size\",\"percentile\":50}' "
        "WHEN 6 THEN '{\"pattern\":\"y\",\"value_field\":\"field.b\",\"percentile\":50}' ELSE '{}' END",
        "filter_json",
    ),
    ("CASE c_custkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '[\"service\"' ELSE '[\"service\"]' END", "group_by"),
    ("c_nationkey % 5 * 300", "window_seconds"),
    (
        "CASE c_custkey % 7 WHEN 0 THEN '5' WHEN 1 THEN '0.5' WHEN 2 THEN 'NaN' WHEN 3 THEN '-1' WHEN 4 THEN 'abc' "
        "WHEN 5 THEN ' 7 ' ELSE '0' END",
        "threshold",
    ),
    ("600", "cooldown_seconds"),
    ("CASE c_custkey % 6 WHEN 0 THEN 'disabled' WHEN 1 THEN 'deleted' ELSE 'active' END", "status"),
]

# one change to a rule per order
RULE_CHANGES: Projection = [
    ("o_custkey", "rule_id"),
    ("o_custkey % 3 + 1", "tenant_id"),
    ("o_orderkey", "seq"),
    (
        "CASE WHEN o_orderkey % 41 = 0 THEN 'delete' WHEN o_orderkey % 4 = 0 THEN 'create' ELSE 'patch' END",
        "action",
    ),
    (
        "CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 10 = 1 THEN concat('svc-', CAST(o_orderkey % 30 AS STRING)) END",
        "service",
    ),
    ("CASE WHEN o_orderkey % 4 = 0 THEN 'prod' END", "environment"),
    ("CASE WHEN o_orderkey % 11 = 0 THEN 'bad level' ELSE 'Error' END", "log_level"),
    ("CAST(NULL AS STRING)", "fingerprint"),
    ("concat(' rule ', CAST(o_orderkey AS STRING), ' ')", "name"),
    ("'count_threshold'", "rule_type"),
    ("CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 6 = 1 THEN lower(o_orderpriority) END", "severity"),
    ("CAST(NULL AS STRING)", "filter_json"),
    ("CASE WHEN o_orderkey % 5 = 0 THEN '[\"host\"]' END", "group_by"),
    ("CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 7 = 1 THEN o_orderkey % 900 - 20 END", "window_seconds"),
    ("CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 9 = 1 THEN CAST(o_orderkey % 50 AS STRING) END", "threshold"),
    ("CASE WHEN o_orderkey % 8 = 0 THEN 0 WHEN o_orderkey % 8 = 4 THEN 120 END", "cooldown_seconds"),
    ("CASE WHEN o_orderkey % 13 = 0 THEN 'DISABLED' END", "status"),
]

# one API request per order; all orders of a day arrive in the same second
API_REQUESTS: Projection = [
    ("o_orderkey", "request"),
    ("CASE o_custkey % 5 WHEN 4 THEN '' ELSE concat('key-', CAST(o_custkey % 5 AS STRING)) END", "api_key"),
    (
        "CASE o_orderkey % 3 WHEN 0 THEN 'payments' WHEN 1 THEN 'gateway' ELSE 'checkout' END",
        "service",
    ),
    ("'prod'", "env"),
    ("o_orderdate", "received_at"),
    ("CAST(o_orderkey % 40 AS BIGINT)", "log_count"),
    ("CAST(o_orderkey % 900 AS BIGINT)", "body_bytes"),
]

SQL = {
    "logs": _select(LOGS, "events"),
    "request_outcomes": _select(REQUESTS, "events"),
    "services": SERVICES_SQL,
    "rules": RULES_SQL,
    "api_keys": API_KEYS_SQL,
    "many_services": _select(MANY_SERVICES, "supplier"),
    "many_rules": _select(MANY_RULES, "customer"),
    "api_requests": _select(API_REQUESTS, "orders"),
    "rule_changes": _select(RULE_CHANGES, "orders"),
}


def with_ctes(body: str, *names: str, **more: str) -> str:
    """Oracle text: the named shared tables, further CTEs, then the body."""
    parts = [f"{n} AS ({SQL[n]})" for n in names] + [f"{n} AS ({q})" for n, q in more.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _apply(dealt(table(spark, sf_dir, "events")), LOGS)


def templated_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_templates(logs(spark, sf_dir))


# DuckDB forms of the derived columns (RE2 word boundaries are ASCII already)
TEMPLATE_SQL = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({m}), "
    "'(?i)\\b[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}\\b', '<uuid>', 'g'), "
    "'\\b(?:[0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}\\b', '<ip>', 'g'), "
    "'(?i)\\b(?:0x)?[0-9a-f]{{12,}}\\b', '<hex>', 'g'), "
    "'\\b[0-9]+(?:\\.[0-9]+)?\\b', '<num>', 'g'), "
    "'\\s+', ' ', 'g'))"
)
SQL["templated"] = (
    "SELECT *, substr(sha256(message_template), 1, 32) AS template_id, "
    "substr(sha256(concat_ws(chr(10), service, environment, source, level, message, fields_json)), 1, 32) AS fingerprint "
    f"FROM (SELECT *, {TEMPLATE_SQL.format(m='message')} AS message_template FROM logs)"
)


def request_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _apply(table(spark, sf_dir, "events"), REQUESTS).withColumn("ts", F.col("ts").cast("timestamp"))


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return utc(spark).sql(SERVICES_SQL)


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return utc(spark).sql(RULES_SQL)


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return utc(spark).sql(API_KEYS_SQL).withColumn("key_hash", F.sha2("plain_key", 256)).drop("plain_key")


def many_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _apply(table(spark, sf_dir, "supplier"), MANY_SERVICES)


def many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _apply(table(spark, sf_dir, "customer"), MANY_RULES)


def rule_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _apply(table(spark, sf_dir, "orders"), RULE_CHANGES)


def api_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _apply(table(spark, sf_dir, "orders"), API_REQUESTS)
    return rows.withColumn("received_at", F.col("received_at").cast("timestamp"))


# template embeddings: vectors of `embeddings` with the text of the document of the same number
EMBEDDING_MODEL, EMBEDDING_DIMS = "fixture", 64
SQL["template_embeddings"] = (
    "SELECT e.vec_id, e.vec_id % 3 + 1 AS tenant_id, substr(sha256(d.text), 1, 32) AS template_id, "
    "d.text AS message_template, 'fixture' AS model, 64 AS dims, e.embedding "
    "FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id"
)


def template_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return vectors.join(texts, "vec_id").select(
        "vec_id",
        (F.col("vec_id") % 3 + 1).alias("tenant_id"),
        F.substring(F.sha2("text", 256), 1, 32).alias("template_id"),
        F.col("text").alias("message_template"),
        F.lit(EMBEDDING_MODEL).alias("model"),
        F.lit(EMBEDDING_DIMS).alias("dims"),
        "embedding",
    )


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of row 0 serves as the embedded question."""
    row = table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()
    return [float(x) for x in row[0]]


# raw records: the same events as a client would send them
_SENT = "concat(replace(CAST(ts AS STRING), ' ', 'T'), 'Z')"
_SENT_WEST = "concat(replace(CAST(ts - INTERVAL 7 HOUR AS STRING), ' ', 'T'), '-07:00')"
_HOST_KEY = "CASE event_id % 3 WHEN 0 THEN 'host' WHEN 1 THEN 'Host-Name' ELSE 'HOST' END"
_HOST = "concat('\"', " + _HOST_KEY + ", '\":\" h', CAST(user_id % 10 AS STRING), ' \"')"
_DURATION = "concat('\"duration_ms\":', CAST(CAST(floor(value) AS BIGINT) AS STRING))"
_SECOND_HOST = "CASE WHEN event_id % 7 = 0 THEN ',\"hostname\":\"other\"' ELSE '' END"
_TRACE = "CASE WHEN event_id % 2 = 0 THEN concat(',\"Trace-ID\":\"t-', CAST(user_id AS STRING), '\"') ELSE '' END"
_REST = "concat(',\"region\":\" us-', CAST(event_id % 4 AS STRING), ' \",\"tags\":[\"a \",\"b\",[1,\" c\"]]')"
_B = "CAST(floor(event_id / 25) AS BIGINT)"

RECORDS: Projection = [
    ("event_id", "event_id"),
    (_B, "b"),
    ("event_id % 25", "position"),
    (f"CASE WHEN event_id % 4 = 1 THEN {_SENT_WEST} ELSE concat(' ', {_SENT}) END", "raw_ts"),
    ("date_trunc('millisecond', ts)", "ts_millis"),
    (_SENT, "canonical_ts"),
    (
        "CASE event_type WHEN 'error' THEN ' ERR' WHEN 'purchase' THEN 'Critical ' WHEN 'signup' THEN ' WARNING ' "
        "WHEN 'click' THEN 'debug' ELSE 'Information' END",
        "raw_level",
    ),
    (
        "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'fatal' WHEN 'signup' THEN 'warn' "
        "WHEN 'click' THEN 'debug' ELSE 'info' END",
        "level",
    ),
    (
        "concat(event_type, ' request ', CAST(event_id AS STRING), '  took ', "
        "CAST(CAST(floor(value) AS BIGINT) AS STRING), ' ms')",
        "message",
    ),
    (f"concat('{{', {_HOST}, ',', {_DURATION}, {_SECOND_HOST}, {_TRACE}, {_REST}, '}}')", "raw_fields"),
    # what admission keeps: trimmed strings, sorted keys
    (
        "replace(replace(replace(concat('{', CASE WHEN event_id % 3 = 0 THEN '' ELSE concat(" + _HOST + ", ',') END, "
        "CASE WHEN event_id % 2 = 0 THEN concat('\"Trace-ID\":\"t-', CAST(user_id AS STRING), '\",') ELSE '' END, "
        f"{_DURATION}, CASE WHEN event_id % 3 = 0 THEN concat(',', {_HOST}) ELSE '' END, {_SECOND_HOST}, {_REST}, '}}'), "
        "' \"', '\"'), '\" ', '\"'), '\" c', '\"c')",
        "canonical_fields",
    ),
    # what normalisation keeps of the raw fields: host and trace keys removed
    (f"concat('{{', {_DURATION}, {_REST}, '}}')", "kept_fields"),
    ("concat('h', CAST(user_id % 10 AS STRING))", "host"),
    ("CASE WHEN event_id % 2 = 0 THEN concat('t-', CAST(user_id AS STRING)) ELSE '' END", "trace_id"),
]
SQL["records"] = _select(RECORDS, "events")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _apply(dealt(table(spark, sf_dir, "events")), RECORDS)


def _batched(rows: DataFrame, item) -> DataFrame:
    """One row per batch of 25 consecutive records."""
    packed = F.array_sort(F.collect_list(F.struct("position", item.alias("item"))))
    return rows.groupBy("b").agg(F.transform(packed, lambda x: x["item"]).alias("items"))


def ingest_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON bodies with known damage by batch number; every 13th is sent twice."""
    rows = records(spark, sf_dir)
    b, first = F.col("b"), F.col("position") == 0
    level = F.when(first & (b % 17 == 0), "verbose").otherwise(F.col("raw_level"))
    nested = F.when(first & (b % 29 == 0), F.lit('{"nested":{"a":1},')).otherwise(F.lit("{"))
    fields = F.concat(nested, F.substring("raw_fields", F.lit(2), F.length("raw_fields")))
    extra = F.when(first & (b % 47 == 0), F.lit(',"extra":1')).otherwise(F.lit(""))
    item = F.concat(
        F.lit('{"timestamp":"'), "raw_ts", F.lit('","level":"'), level, F.lit('","message":"  '),
        "message", F.lit(' ","fields":'), fields, extra, F.lit("}"),
    )
    batches = _batched(rows, item)
    version = F.when(b % 19 == 0, "logs.ingest.v2").otherwise(" logs.ingest.v1 ")
    service = F.when(b % 37 == 0, F.lit("7")).otherwise(
        F.concat(F.lit('"  Svc-'), (b % 5).cast("string"), F.lit(' "'))
    )
    whole = F.concat(
        F.lit('{"schema_version":"'), version, F.lit('","service":'), service,
        F.lit(',"env":" PROD","source":"App"'), F.when(b % 31 == 0, ',"region":"x"').otherwise(""),
        F.lit(',"logs":['), F.array_join("items", ","), F.lit("]}"),
    )
    body = (
        F.when(b % 23 == 0, F.substring(whole, F.lit(1), F.length(whole) - 5))
        .when(b % 41 == 0, F.concat(whole, F.lit(" x")))
        .when(b % 43 == 0, F.concat(whole, whole))
        .otherwise(whole)
    )
    copies = F.when(b % 13 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return batches.select(
        "b", F.explode(copies).alias("copy"), (b % 3 + 1).alias("tenant_id"), body.alias("body")
    )


SQL["bodies"] = (
    "SELECT b, c AS copy, b % 3 + 1 AS tenant_id, log_count, CASE WHEN b % 23 = 0 OR b % 31 = 0 OR b % 37 = 0 OR b % 41 = 0 "
    "OR b % 43 = 0 OR b % 47 = 0 THEN 'invalid_request_body' END AS decode_error, "
    "CASE WHEN b % 19 = 0 THEN 'unsupported schema_version \"logs.ingest.v2\"' "
    "WHEN b % 17 = 0 THEN 'log[0]: level is unsupported' "
    "WHEN b % 29 = 0 THEN 'log[0]: fields[\"nested\"]: unsupported field value type object' END AS invalid "
    "FROM (SELECT b, count(*) AS log_count FROM records GROUP BY b) "
    "JOIN (SELECT unnest([0, 1]) AS c) ON c = 0 OR b % 13 = 0"
)


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored raw batches: some records without a time, every 17th batch poisoned,
    others breaking the contract."""
    rows = records(spark, sf_dir)
    b = F.col("b")
    sent = F.when(F.col("event_id") % 6 == 5, F.lit("  ")).otherwise(F.col("raw_ts"))
    item = F.struct(
        F.when((F.col("position") == 0) & (b % 17 == 0), "yesterday").otherwise(sent).alias("timestamp"),
        F.col("raw_level").alias("level"),
        F.concat(F.lit("  "), "message", F.lit(" ")).alias("message"),
        F.col("raw_fields").alias("fields"),
    )
    batches = _batched(rows, item)
    request = F.concat(F.lit("req-"), b.cast("string"))
    return batches.select(
        "b",
        F.when(b % 53 == 0, "logs.raw.v0").otherwise("logs.raw.v1").alias("schema_version"),
        request.alias("request_id"),
        F.when(b % 3 == 0, F.concat(F.lit("corr-"), b.cast("string"))).otherwise("").alias("correlation_id"),
        F.when(b % 4 == 0, "").otherwise(F.concat(F.lit("bt-"), b.cast("string"), F.lit(" "))).alias("trace_id"),
        F.when(b % 59 == 0, "").otherwise(request).alias("fingerprint"),
        F.when(b % 61 == 0, "soon").otherwise("2024-02-01T00:00:00.123456789Z").alias("received_at"),
        F.when(b % 67 == 0, 0).otherwise(b % 3 + 1).cast("bigint").alias("tenant_id"),
        F.concat(F.lit(" Svc-"), (b % 5).cast("string"), F.lit(" ")).alias("service"),
        F.lit(" PROD ").alias("env"),
        F.lit("App").alias("source"),
        F.col("items").alias("logs"),
        (b + 1).alias("stream_seq"),
        F.expr("timestamp'2024-02-01 00:00:00' + make_dt_interval(0, 0, CAST(b AS INT), 0)").alias("stored_at"),
        F.concat(F.lit(" head-"), b.cast("string")).alias("header_request_id"),
        F.when(b % 8 == 0, "").otherwise(F.concat(F.lit("ht-"), b.cast("string"))).alias("header_trace_id"),
        (b % 7).cast("bigint").alias("attempts"),
    )


SQL["raw_batches"] = (
    "SELECT b, count(*) AS log_count, b + 1 AS stream_seq, TIMESTAMP '2024-02-01 00:00:00' + to_minutes(CAST(b AS INTEGER)) AS stored_at, "
    "concat('req-', b) AS request_id, CASE WHEN b % 67 = 0 THEN 0 ELSE b % 3 + 1 END AS tenant_id, "
    "CASE WHEN b % 53 = 0 THEN 'invalid logs.raw event: invalid schema version' "
    "WHEN b % 59 = 0 THEN 'invalid logs.raw event: fingerprint is required' "
    "WHEN b % 67 = 0 THEN 'invalid logs.raw event: tenant_id is required' "
    "WHEN b % 61 = 0 THEN 'normalize logs.raw event: parse received_at' "
    "WHEN b % 17 = 0 THEN 'normalize logs.raw event: parse log timestamp' END AS error "
    "FROM records GROUP BY b"
)
