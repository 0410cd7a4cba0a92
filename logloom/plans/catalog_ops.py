"""Template retrieval, incident evidence and operations metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.functions.vectors import has_all_tokens
from logloom.operators import opsmetrics as om
from logloom.operators import retrieval
from logloom.plans import fixtures as fx
from logloom.plans.registry import query, sql_stamp, stamp

MODEL, DIMS = fx.EMBEDDING_MODEL, fx.EMBEDDING_DIMS
QUESTION = "error request took"
WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w NOT IN ('', 'uuid', 'ip', 'hex', 'num')))"


# --- templates and retrieval


@query(
    "template_catalog",
    fx.with_ctes(
        "SELECT tenant_id, template_id, min(message_template) AS message_template FROM templated GROUP BY ALL ",
        "logs", "templated",
    ),
)
def template_catalog(spark, sf):
    return retrieval.template_catalog(fx.templated_logs(spark, sf))


DOC_CATALOG = (
    "SELECT d.doc_id % 3 + 1 AS tenant_id, substr(sha256(d.text), 1, 32) AS template_id, min(d.text) AS message_template FROM documents d GROUP BY ALL"
)


def _document_catalog(spark, sf):
    rows = fx.table(spark, sf, "documents").select(
        (F.col("doc_id") % 3 + 1).alias("tenant_id"),
        F.substring(F.sha2("text", 256), 1, 32).alias("template_id"),
        F.col("text").alias("message_template"),
    )
    return retrieval.template_catalog(rows)


@query(
    "templates_pending",
    fx.with_ctes(
        "SELECT c.tenant_id, c.template_id FROM catalog c WHERE NOT EXISTS (SELECT 1 FROM template_embeddings e "
        "WHERE e.tenant_id = c.tenant_id AND e.template_id = c.template_id AND e.model = 'fixture' AND e.dims = 64)",
        "template_embeddings", catalog=DOC_CATALOG,
    ),
)
def templates_pending(spark, sf):
    pending = retrieval.templates_pending(
        _document_catalog(spark, sf), fx.template_embeddings(spark, sf), MODEL, DIMS
    )
    return pending.select("tenant_id", "template_id")


@query(
    "embedding_upsert",
    fx.with_ctes(
        "SELECT tenant_id, template_id, model, dims, arg_max(vec_id, (updated_at, message_template)) AS vec_id, "
        "strftime(max(updated_at), '%Y-%m-%d %H:%M:%S.%g') AS updated_at FROM (SELECT tenant_id, template_id, model, dims, vec_id, message_template, "
        "TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(vec_id AS INTEGER)) AS updated_at FROM template_embeddings UNION ALL "
        "SELECT tenant_id, template_id, model, dims, vec_id + 1000000, message_template, TIMESTAMP '2024-06-01 00:00:00' + to_seconds(CAST(vec_id AS INTEGER)) "
        "FROM template_embeddings WHERE vec_id % 3 = 0 AND vec_id % 5 <> 0) GROUP BY ALL",
        "template_embeddings",
    ),
)
def embedding_upsert(spark, sf):
    """A third of the vectors is embedded again; a fifth of those has the wrong length."""
    rows = fx.template_embeddings(spark, sf)
    stored = rows.withColumn(
        "updated_at", F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + F.col("vec_id"))
    )
    cut = F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding"))
    newer = (
        rows.filter("vec_id % 3 = 0")
        .withColumn("embedding", cut)
        .withColumn(
            "updated_at",
            F.timestamp_seconds(F.unix_seconds(F.lit("2024-06-01").cast("timestamp")) + F.col("vec_id")),
        )
        .withColumn("vec_id", F.col("vec_id") + 1000000)
    )
    merged = retrieval.embedding_upsert(stored, newer)
    return merged.select("tenant_id", "template_id", "model", "dims", "vec_id", stamp("updated_at"))


SIMILAR = (
    "SELECT template_id, message_template, list_cosine_similarity(CAST(embedding AS DOUBLE[]), "
    "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS similarity FROM template_embeddings WHERE tenant_id = {tenant}"
)


@query(
    "vector_topk",
    fx.with_ctes(
        "SELECT template_id, message_template, round(similarity, 9) AS similarity FROM similar_rows ORDER BY similar_rows.similarity DESC, template_id LIMIT 5",
        "template_embeddings", similar_rows=SIMILAR.format(tenant=2),
    ),
)
def vector_topk(spark, sf):
    found = retrieval.vector_topk(
        fx.template_embeddings(spark, sf), 2, MODEL, DIMS, fx.query_vector(spark, sf), 5
    )
    return found.withColumn("similarity", F.round("similarity", 9))


@query(
    "keyword_match",
    f"SELECT doc_id, len(list_intersect({WORDS.format('text')}, ['de', 'la'])) = 2 AS matches FROM documents",
)
def keyword_match(spark, sf):
    rows = fx.dealt(fx.table(spark, sf, "documents"))
    return rows.select("doc_id", has_all_tokens(F.col("text"), F.lit("<num> LA de la")).alias("matches"))


@query(
    "hybrid_search",
    fx.with_ctes(
        "SELECT template_id, round(score, 9) AS score FROM (SELECT template_id, 0.8::DOUBLE * similarity + 0.2::DOUBLE * "
        f"CASE WHEN len(list_intersect({WORDS.format('message_template')}, ['de', 'la'])) = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM similar_rows) x "
        "ORDER BY x.score DESC, template_id LIMIT 20",
        "template_embeddings", similar_rows=SIMILAR.format(tenant=1),
    ),
)
def hybrid_search(spark, sf):
    found = retrieval.hybrid_search(
        fx.template_embeddings(spark, sf), 1, MODEL, DIMS, fx.query_vector(spark, sf), " de la ", k=20
    )
    return found.select("template_id", F.round("score", 9).alias("score"))


@query(
    "hybrid_search_many",
    fx.with_ctes(
        "SELECT question_id, template_id, rank, round(score, 9) AS score FROM (SELECT question_id, template_id, score, row_number() OVER (PARTITION BY question_id "
        "ORDER BY score DESC, template_id) AS rank FROM (SELECT q.vec_id AS question_id, e.template_id, 0.8::DOUBLE * list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) "
        f"+ 0.2::DOUBLE * CASE WHEN len(list_intersect({WORDS.format('e.message_template')}, ['de', 'la'])) = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score "
        "FROM template_embeddings e JOIN embeddings q ON q.vec_id % 100 = 0 AND q.vec_id % 3 + 1 = e.tenant_id)) WHERE rank <= 5",
        "template_embeddings",
    ),
)
def hybrid_search_many(spark, sf):
    """Every vector whose id is divisible by 100 is a question to all templates of its tenant."""
    questions = fx.table(spark, sf, "embeddings").filter("vec_id % 100 = 0").select(
        F.col("vec_id").alias("question_id"),
        (F.col("vec_id") % 3 + 1).alias("tenant_id"),
        F.col("embedding").alias("vector"),
        F.lit("de la").alias("question"),
    )
    found = retrieval.hybrid_search_many(fx.template_embeddings(spark, sf), questions, MODEL, DIMS)
    return found.select(
        "question_id", "template_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 9).alias("score")
    )


MATCHED = "SELECT DISTINCT template_id FROM templated WHERE service = 'payments'"


def _matched(spark, sf):
    rows = fx.templated_logs(spark, sf)
    return rows, rows.filter("service = 'payments'").select("template_id").distinct()


@query(
    "template_evidence",
    fx.with_ctes(
        "SELECT event_id, template_id, rank, service, level, message FROM (SELECT *, row_number() OVER (PARTITION BY template_id "
        "ORDER BY timestamp DESC, ingest_id DESC, fingerprint DESC, event_id DESC) AS rank FROM (SELECT * FROM templated WHERE tenant_id = 2 AND template_id IN (SELECT * FROM matched) "
        "ORDER BY timestamp DESC, ingest_id DESC, fingerprint DESC, event_id DESC LIMIT 100)) WHERE rank <= 3",
        "logs", "templated", matched="SELECT DISTINCT template_id FROM templated",
    ),
)
def template_evidence(spark, sf):
    rows = fx.templated_logs(spark, sf)
    found = retrieval.template_evidence(rows, 2, rows.select("template_id").distinct())
    return found.select(
        "event_id", "template_id", F.col("rank").cast("bigint").alias("rank"), "service", "level", "message"
    )


TRACE = (
    "SELECT trace_id FROM templated WHERE tenant_id = 2 AND trace_id <> '' AND template_id IN (SELECT * FROM matched) "
    "GROUP BY trace_id ORDER BY max(timestamp) DESC, trace_id DESC LIMIT 1"
)


@query(
    "incident_trace",
    fx.with_ctes(
        f"SELECT event_id, {sql_stamp('timestamp')}, service, level, trace_id, message, template_id FROM templated WHERE tenant_id = 2 "
        "AND trace_id IN (SELECT * FROM newest) ORDER BY templated.timestamp, ingest_id, fingerprint, event_id LIMIT 100",
        "logs", "templated", matched=MATCHED, newest=TRACE,
    ),
)
def incident_trace(spark, sf):
    rows, matched = _matched(spark, sf)
    found = retrieval.incident_trace(rows, 2, matched)
    return found.select("event_id", stamp("timestamp"), "service", "level", "trace_id", "message", "template_id")


@query(
    "incident_evidence",
    fx.with_ctes(
        f"SELECT {sql_stamp('timestamp')}, service, level, trace_id, message, fields_json AS fields FROM templated WHERE tenant_id = 2 "
        "AND trace_id IN (SELECT * FROM newest) ORDER BY templated.timestamp, ingest_id, fingerprint, event_id LIMIT 100",
        "logs", "templated", matched=MATCHED, newest=TRACE,
    ),
)
def incident_evidence(spark, sf):
    rows, matched = _matched(spark, sf)
    found = retrieval.evidence_rows(retrieval.incident_trace(rows, 2, matched))
    return found.select(stamp("timestamp"), "service", "level", "trace_id", "message", "fields")


# --- operations metrics

HISTOGRAM = (
    "SELECT {group}, b.le, count(*) FILTER (v <= b.le) AS cumulative, count(*) AS total_count, sum(v) AS total_sum "
    "FROM {source}, (SELECT unnest([{bounds}, 'Infinity'::DOUBLE]) AS le) b WHERE v >= 0 GROUP BY ALL"
)


def _bounds(values):
    return ", ".join(f"{v}::DOUBLE" for v in values)


LATENCY = HISTOGRAM.format(
    group="service, route", source="(SELECT service, route, duration_s AS v FROM request_outcomes)",
    bounds=_bounds(om.LATENCY_BOUNDS),
)


def _rounded_le(column="le"):
    return F.when(F.col(column) == float("inf"), F.lit(-1.0)).otherwise(F.col(column)).alias("le")


@query(
    "latency_histogram",
    fx.with_ctes(
        "SELECT service, route, CASE WHEN isinf(le) THEN -1.0::DOUBLE ELSE le END AS le, cumulative, total_count, round(total_sum, 6) AS total_sum FROM h",
        "request_outcomes", h=LATENCY,
    ),
)
def latency_histogram(spark, sf):
    found = om.histogram(fx.request_outcomes(spark, sf), ["service", "route"], "duration_s", om.LATENCY_BOUNDS)
    return found.select(
        "service", "route", _rounded_le(), "cumulative", "total_count", F.round("total_sum", 6).alias("total_sum")
    )


@query(
    "histogram_quantile",
    fx.with_ctes(
        "SELECT service, route, round(CASE WHEN isinf(le) THEN lower_bound ELSE lower_bound + (le - lower_bound) * (rank - below) / greatest(cumulative - below, 1) END, 9) AS p95 "
        "FROM (SELECT *, row_number() OVER (PARTITION BY service, route ORDER BY le) AS r FROM (SELECT *, coalesce(lag(le) OVER w, 0) AS lower_bound, "
        "coalesce(lag(cumulative) OVER w, 0) AS below, total_count * 0.95::DOUBLE AS rank FROM h WINDOW w AS (PARTITION BY service, route ORDER BY le)) "
        "WHERE cumulative >= rank) WHERE r = 1",
        "request_outcomes", h=LATENCY,
    ),
)
def histogram_quantile(spark, sf):
    buckets = om.histogram(fx.request_outcomes(spark, sf), ["service", "route"], "duration_s", om.LATENCY_BOUNDS)
    found = om.histogram_quantile(buckets, ["service", "route"], 0.95, "p95")
    return found.withColumn("p95", F.round("p95", 9))


@query(
    "histogram_quantile_rates",
    fx.with_ctes(
        "SELECT service, route, round(CASE WHEN isinf(le) THEN lower_bound ELSE lower_bound + (le - lower_bound) * (rank - below) / (cumulative - below) END, 9) AS p95 "
        "FROM (SELECT *, row_number() OVER (PARTITION BY service, route ORDER BY le) AS r FROM (SELECT *, coalesce(lag(le) OVER w, 0) AS lower_bound, "
        "coalesce(lag(cumulative) OVER w, 0) AS below, total_count * 0.95::DOUBLE AS rank FROM (SELECT service, route, le, cumulative / 2592000::DOUBLE AS cumulative, "
        "total_count / 2592000::DOUBLE AS total_count FROM h) WINDOW w AS (PARTITION BY service, route ORDER BY le)) WHERE cumulative >= rank) WHERE r = 1",
        "request_outcomes", h=LATENCY,
    ),
)
def histogram_quantile_rates(spark, sf):
    """Buckets as events per second over a month: far below one."""
    buckets = om.histogram(fx.request_outcomes(spark, sf), ["service", "route"], "duration_s", om.LATENCY_BOUNDS)
    rates = buckets.withColumn("cumulative", F.col("cumulative") / F.lit(2592000.0))
    return om.histogram_quantile(rates, ["service", "route"], 0.95, "p95").withColumn("p95", F.round("p95", 9))


@query(
    "latency_summary",
    fx.with_ctes(
        "SELECT service, requests, successes, requests - successes AS failures, round((requests - successes) / CAST(requests AS DOUBLE), 9) AS error_rate, "
        "v[CAST(floor((requests - 1) * 0.50::DOUBLE) AS BIGINT) + 1] AS latency_p50, v[CAST(floor((requests - 1) * 0.95::DOUBLE) AS BIGINT) + 1] AS latency_p95, "
        "v[CAST(floor((requests - 1) * 0.99::DOUBLE) AS BIGINT) + 1] AS latency_p99, v[requests] AS latency_max FROM "
        "(SELECT service, count(*) AS requests, count(*) FILTER (code >= 200 AND code < 300) AS successes, list_sort(list(duration_s)) AS v FROM request_outcomes GROUP BY service)",
        "request_outcomes",
    ),
)
def latency_summary(spark, sf):
    ok = F.col("code").between(200, 299)
    found = om.latency_summary(fx.request_outcomes(spark, sf), ["service"], "duration_s", ok)
    return found.select(
        "service", "requests", "successes", "failures", F.round("error_rate", 9).alias("error_rate"),
        "latency_p50", "latency_p95", "latency_p99", "latency_max",
    )


@query(
    "latency_summary_total",
    fx.with_ctes(
        "SELECT requests, requests - successes AS failures, v[CAST(floor((requests - 1) * 0.95::DOUBLE) AS BIGINT) + 1] AS latency_p95, v[requests] AS latency_max FROM "
        "(SELECT count(*) AS requests, count(*) FILTER (code >= 200 AND code < 300) AS successes, list_sort(list(duration_s)) AS v FROM request_outcomes)",
        "request_outcomes",
    ),
)
def latency_summary_total(spark, sf):
    ok = F.col("code").between(200, 299)
    found = om.latency_summary(fx.request_outcomes(spark, sf), [], "duration_s", ok)
    return found.select("requests", "failures", "latency_p95", "latency_max")


@query(
    "throughput_rate",
    fx.with_ctes(
        f"SELECT service, {sql_stamp('throughput.window_end', 'window_end')}, round(sum(n) / 300.0::DOUBLE, 9) AS per_second FROM (SELECT service, m + to_minutes(CAST(k AS INTEGER)) AS window_end, n FROM "
        "(SELECT service, date_trunc('minute', ts) AS m, count(*) AS n FROM request_outcomes GROUP BY ALL), (SELECT unnest(generate_series(1, 5)) AS k)) throughput GROUP BY service, throughput.window_end",
        "request_outcomes",
    ),
)
def throughput_rate(spark, sf):
    found = om.trailing_rate(fx.request_outcomes(spark, sf), ["service"], "ts", 300)
    return found.select("service", stamp("window_end"), F.round("per_second", 9).alias("per_second"))


WINDOW = "strftime(to_timestamp(floor(epoch(ts) / {w}) * {w})::TIMESTAMP, '%Y-%m-%d %H:%M:%S.%g') AS window_start"


@query(
    "status_mix",
    fx.with_ctes(
        f"SELECT {WINDOW.format(w=3600)}, service, concat(code // 100, 'xx') AS status_class, count(*) AS events, round(count(*) / 3600.0::DOUBLE, 9) AS per_second "
        "FROM request_outcomes GROUP BY ALL",
        "request_outcomes",
    ),
)
def status_mix(spark, sf):
    rows = fx.request_outcomes(spark, sf).withColumn("status_class", om.code_class(F.col("code")))
    found = om.per_second(rows, ["service", "status_class"], "ts", 3600)
    return found.select(
        stamp("window_start"), "service", "status_class", "events", F.round("per_second", 9).alias("per_second")
    )


AVAILABLE = "round(count(*) FILTER (code < 500) / greatest(CAST(count(*) AS DOUBLE), 1e-9), 9) AS availability"


@query(
    "availability",
    fx.with_ctes(f"SELECT {WINDOW.format(w=3600)}, service, {AVAILABLE} FROM request_outcomes GROUP BY ALL", "request_outcomes"),
)
def availability(spark, sf):
    found = om.availability(fx.request_outcomes(spark, sf), ["service"], "ts", "code", 3600)
    return found.select(stamp("window_start"), "service", F.round("availability", 9).alias("availability"))


@query(
    "error_ratios",
    fx.with_ctes(
        "SELECT service, round(1 - count(*) FILTER (code < 400) / CAST(count(*) AS DOUBLE), 9) AS failure_ratio, "
        "round(count(*) FILTER (code >= 500) / CAST(count(*) AS DOUBLE), 9) AS server_error_ratio FROM request_outcomes GROUP BY ALL",
        "request_outcomes",
    ),
)
def error_ratios(spark, sf):
    rows = fx.request_outcomes(spark, sf)
    failures = om.failure_ratio(rows, ["service"], F.col("code") < 400)
    server = om.share_of(rows, ["service"], F.col("code") >= 500, "server_error_ratio")
    return failures.join(server, "service").select(
        "service", F.round("failure_ratio", 9).alias("failure_ratio"),
        F.round("server_error_ratio", 9).alias("server_error_ratio"),
    )


@query(
    "slo_status",
    fx.with_ctes(
        "SELECT window_start, service, CASE WHEN availability >= 0.999::DOUBLE THEN 'green' WHEN availability >= 0.99::DOUBLE THEN 'yellow' ELSE 'red' END AS status "
        f"FROM (SELECT {WINDOW.format(w=86400)}, service, count(*) FILTER (code < 500) / greatest(CAST(count(*) AS DOUBLE), 1e-9) AS availability FROM request_outcomes GROUP BY ALL)",
        "request_outcomes",
    ),
)
def slo_status(spark, sf):
    found = om.availability(fx.request_outcomes(spark, sf), ["service"], "ts", "code", 86400)
    return found.select(
        stamp("window_start"), "service", om.slo_status(F.col("availability"), "availability").alias("status")
    )


# processor outcomes: one batch per order
BATCH_RUNS = (
    "SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'invalid_batch' WHEN 1 THEN 'retryable_error' WHEN 2 THEN '  ' ELSE 'success' END AS result, "
    "o_orderdate AS ts, o_orderkey % 40 - 1 AS log_count, o_orderkey % 500 / 100.0::DOUBLE AS duration_s, "
    "o_orderkey % 2000 - 5 AS delay_s FROM orders"
)
RESULT = "coalesce(nullif(trim(result), ''), 'unknown') AS result"


def _batch_runs(spark, sf):
    key = F.col("o_orderkey")
    return fx.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(key % 9 == 0, "invalid_batch").when(key % 9 == 1, "retryable_error").when(key % 9 == 2, "  ")
        .otherwise("success").alias("result"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        (key % 40 - 1).alias("log_count"),
        ((key % 500) / 100.0).alias("duration_s"),
        (key % 2000 - 5).alias("delay_s"),
    )


@query(
    "batch_counters",
    fx.with_ctes(
        f"SELECT {RESULT}, count(*) AS batches, CAST(sum(greatest(log_count, 0)) AS BIGINT) AS logs, round(sum(duration_s), 4) AS duration_sum FROM runs GROUP BY ALL",
        runs=BATCH_RUNS,
    ),
)
def batch_counters(spark, sf):
    found = om.batch_counters(_batch_runs(spark, sf))
    return found.withColumn("duration_sum", F.round("duration_sum", 4))


@query(
    "labelled_counters",
    fx.with_ctes(
        "SELECT coalesce(nullif(trim(result), ''), 'unknown') AS reason, CASE WHEN o_orderkey % 2 = 0 THEN 'published' ELSE 'failed' END AS outcome, count(*) AS total FROM runs GROUP BY ALL",
        runs=BATCH_RUNS,
    ),
)
def labelled_counters(spark, sf):
    rows = _batch_runs(spark, sf).select(
        F.col("result").alias("reason"),
        F.when(F.col("o_orderkey") % 2 == 0, "published").otherwise("failed").alias("outcome"),
    )
    return om.labelled_counts(rows, "reason", "outcome")


@query(
    "write_histogram",
    fx.with_ctes(
        "SELECT result, CASE WHEN isinf(le) THEN -1.0::DOUBLE ELSE le END AS le, cumulative, total_count FROM h",
        runs=BATCH_RUNS,
        h=HISTOGRAM.format(group="result", source=f"(SELECT {RESULT}, duration_s AS v FROM runs)", bounds=_bounds(om.LATENCY_BOUNDS)),
    ),
)
def write_histogram(spark, sf):
    rows = _batch_runs(spark, sf).withColumn("result", om.label("result"))
    found = om.histogram(rows, ["result"], "duration_s", om.LATENCY_BOUNDS)
    return found.select("result", _rounded_le(), "cumulative", "total_count")


@query(
    "batch_result_rate",
    fx.with_ctes(
        f"SELECT {WINDOW.format(w=86400)}, {RESULT}, count(*) AS events, round(count(*) / 86400.0::DOUBLE, 12) AS per_second FROM runs GROUP BY ALL",
        runs=BATCH_RUNS,
    ),
)
def batch_result_rate(spark, sf):
    rows = _batch_runs(spark, sf).withColumn("result", om.label("result"))
    found = om.per_second(rows, ["result"], "ts", 86400)
    return found.select(stamp("window_start"), "result", "events", F.round("per_second", 12).alias("per_second"))


@query(
    "e2e_latency",
    fx.with_ctes(
        "SELECT result, CASE WHEN isinf(le) THEN -1.0::DOUBLE ELSE le END AS le, cumulative, total_count, round(total_sum, 3) AS total_sum FROM h",
        runs=BATCH_RUNS,
        h=HISTOGRAM.format(group="result", source=f"(SELECT {RESULT}, CAST(delay_s AS DOUBLE) AS v FROM runs)", bounds=_bounds(om.END_TO_END_BOUNDS)),
    ),
)
def e2e_latency(spark, sf):
    rows = _batch_runs(spark, sf).withColumn(
        "done", F.timestamp_seconds(F.unix_seconds("ts") + F.col("delay_s"))
    )
    found = om.end_to_end(rows, "ts", "done", "result")
    return found.select(
        "result", _rounded_le(), "cumulative", "total_count", F.round("total_sum", 3).alias("total_sum")
    )


@query(
    "gauge_rollup",
    "SELECT event_type, max(v) AS max_value, min(v) AS min_value, count(*) AS series FROM "
    "(SELECT event_type, user_id, arg_max(value, ts) AS v FROM events GROUP BY ALL) GROUP BY ALL",
)
def gauge_rollup(spark, sf):
    """Every user is one instance of the gauge of its event type."""
    rows = fx.table(spark, sf, "events")
    return om.gauge_rollup(rows, ["user_id"], ["event_type"], "ts", "value")


@query(
    "counter_rate",
    "SELECT event_type, strftime(to_timestamp(floor(epoch(ts) / 3600) * 3600)::TIMESTAMP, '%Y-%m-%d %H:%M:%S.%g') AS window_start, "
    "CAST(sum(CASE WHEN p IS NULL THEN 0 WHEN c < p THEN c ELSE c - p END) AS BIGINT) AS increase, "
    "round(sum(CASE WHEN p IS NULL THEN 0 WHEN c < p THEN c ELSE c - p END) / 3600.0::DOUBLE, 9) AS per_second "
    "FROM (SELECT event_type, ts, event_id % 1000 AS c, lag(event_id % 1000) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events) GROUP BY ALL",
)
def counter_rate(spark, sf):
    """The event number modulo 1000 is a counter that restarts every 1000 events."""
    rows = fx.table(spark, sf, "events").select(
        "event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 1000).alias("c")
    )
    found = om.counter_rate(rows, ["event_type"], "ts", ["event_id"], "c", 3600)
    return found.select(
        "event_type", stamp("window_start"), "increase", F.round("per_second", 9).alias("per_second")
    )
