"""Table layout, retention, and the streams end to end."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from logloom.operators import search
from logloom.plans import fixtures as fx
from logloom.sources import logs_table
from logloom.streaming import pipeline

SF = "/root/testdata/sf0.001"
NOW = "2026-07-07T12:00:00Z"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("logs"))
    logs_table.write_logs(fx.templated_logs(spark, SF).drop("event_id"), path, mode="overwrite")
    return path


def test_layout(spark, stored):
    logs = logs_table.read_logs(spark, stored)
    assert logs.count() == 1000
    assert {"event_date", "error_code"} <= set(logs.columns)
    day = spark.read.parquet(f"{stored}/event_date=2024-01-05")
    rows = [(r["tenant_id"], r["timestamp"]) for r in day.collect()]
    assert rows == sorted(rows)


def test_search_prunes_days_and_pushes_filters(spark, stored, capsys):
    logs = logs_table.read_logs(spark, stored)
    query = search.log_query(1, "2024-01-05T00:00:00Z", "2024-01-06T00:00:00Z", trace_id="t-3-2024-01-05")
    search.search_logs(logs, query).explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert "EqualTo(tenant_id,1)" in plan and "EqualTo(trace_id,t-3-2024-01-05)" in plan
    assert "TakeOrderedAndProject" in plan


def test_retention(spark, stored):
    logs = logs_table.read_logs(spark, stored)
    kept = logs_table.retained(logs, "2024-02-09T12:00:00Z")
    assert kept.agg(F.min("timestamp")).first()[0] >= dt.datetime(2024, 1, 10, 12)
    assert kept.count() == logs.filter("timestamp >= '2024-01-10 12:00:00'").count()
    days = [dt.date(2024, 1, d) for d in range(1, 31)]
    assert logs_table.expired_days(days, "2024-02-09T12:00:00Z")[-1] == dt.date(2024, 1, 9)


def test_relayout_keeps_counts(spark, stored, tmp_path):
    check = logs_table.relayout(spark, stored, str(tmp_path / "new"))
    assert [r["matches"] for r in check.collect()] == [True, True, True]


def test_completeness(spark, stored):
    logs = logs_table.read_logs(spark, stored)
    found = logs_table.completeness(logs, "2024-01-29T00:00:00Z", "2024-02-02T00:00:00Z").first()
    assert found["partial"] and found["missing_days"] == ["2024-01-31", "2024-02-01"]


# --- streams


def body(message, level="error", seconds=0, **changes):
    stamp = dt.datetime(2026, 7, 7, 11, 59) + dt.timedelta(seconds=seconds)
    document = {
        "schema_version": "logs.ingest.v1", "service": "checkout", "env": "prod", "source": "app",
        "logs": [{"timestamp": stamp.isoformat() + "Z", "level": level, "message": message, "fields": {"host": "h1"}}],
    }
    document.update(changes)
    return json.dumps(document)


def send(spark, folder, *bodies, tenant=1, received=NOW):
    rows = [(b, tenant, received) for b in bodies]
    frame = spark.createDataFrame(rows, "body string, tenant_id long, received_at string")
    frame.coalesce(1).write.mode("append").parquet(folder)
    return frame.schema


def rule_rows(spark):
    return spark.createDataFrame(
        [(1, 1, None, None, None, None, "errors", "count_threshold", "high", "error", None, None, '["host"]', 600, "2", 600, "active")],
        "id long, tenant_id long, service_id long, service_name string, environment string, owner string, name string, "
        "rule_type string, severity string, log_level string, fingerprint string, filter_json string, group_by string, "
        "window_seconds int, threshold string, cooldown_seconds int, status string",
    )


def test_streams_end_to_end(spark, tmp_path):
    inbox, tables = str(tmp_path / "in"), pipeline.Tables(str(tmp_path / "tables"))

    def run(**options):
        stream = spark.readStream.schema("body string, tenant_id long, received_at string").parquet(inbox)
        pipeline.admit_stream(stream, tables).awaitTermination()
        pipeline.process_stream(spark, tables, rules=lambda: rule_rows(spark), **options).awaitTermination()

    # the same batch twice, a bad body and another tenant
    send(spark, inbox, body("boom 1"), body("boom 1"), "{", body("quiet", "info", 1))
    send(spark, inbox, body("boom 1"), tenant=2)
    run()
    logs = pipeline.read_stored_logs(spark, tables)
    assert sorted((r["tenant_id"], r["message"]) for r in logs.collect()) == [
        (1, "boom 1"), (1, "quiet"), (2, "boom 1"),
    ]
    query = search.log_query(2, "2026-07-07T00:00:00Z", "2026-07-08T00:00:00Z")
    assert search.search_logs(logs, query).count() == 1
    rejects = spark.read.parquet(tables.rejects)
    assert [r["reason"] for r in rejects.collect()] == ["invalid_request_body"]
    assert pipeline.read_alert_events(spark, tables).count() == 0

    # a second error within the window fires the rule, a replayed batch does not count twice
    send(spark, inbox, body("boom 2", seconds=30), body("boom 1"), received="2026-07-07T12:05:00Z")
    run()
    events = pipeline.read_alert_events(spark, tables).collect()
    assert [(r["dedupe_key"], r["event_type"], r["match_count"]) for r in events] == [("host=h1", "triggered", 2)]
    assert pipeline.read_stored_logs(spark, tables).count() == 4

    # newer quiet rows move the window on: resolved
    send(spark, inbox, body("calm", "info", 3600), received="2026-07-07T13:00:00Z")
    run()
    kinds = [r["event_type"] for r in pipeline.read_alert_events(spark, tables).orderBy("created_at").collect()]
    assert kinds == ["triggered", "resolved"]
    last = pipeline.read_alert_state(spark, tables).first()
    assert last["status"] == "resolved" and last["resolved_at"] == dt.datetime(2026, 7, 7, 13)

    # a full replay under a new name stores nothing again
    everything = pipeline.raw_event_stream(spark, tables)
    pipeline.process_stream(spark, tables, suppress_repeats=False, events=everything, name="replay").awaitTermination()
    assert pipeline.read_stored_logs(spark, tables).count() == 5


def test_a_repeated_micro_batch_replaces_itself(spark, tmp_path):
    tables = pipeline.Tables(str(tmp_path / "tables"))
    events = fx.raw_events(spark, SF).drop("b", "header_request_id", "header_trace_id")
    for _ in range(2):
        pipeline.process_batch(spark, events, "process-0", tables)
    good = events.filter("request_id IN (SELECT ingest_id FROM parquet.`%s`)" % tables.ingested)
    expected = good.agg(F.sum(F.size("logs"))).first()[0]
    assert pipeline.read_stored_logs(spark, tables).count() == expected
    letters = spark.read.parquet(tables.dead_letters)
    assert letters.count() == letters.select("request_id", "reason").distinct().count() > 0
    # the same refused batches in another micro-batch give no second letter
    pipeline.process_batch(spark, events, "process-1", tables)
    assert spark.read.parquet(tables.dead_letters).count() == letters.count()


def test_dead_letter_reasons(spark):
    events = fx.raw_events(spark, SF)
    reasons = {r["reason"] for r in pipeline.classify(events).select("reason").distinct().collect()}
    assert reasons == {None, "invalid_batch", "retry_exhausted"}


def test_streaming_counts(spark, tmp_path):
    path = str(tmp_path / "rows")
    fx.logs(spark, SF).select("timestamp", "service", "level").write.parquet(path)
    stream = spark.readStream.schema("timestamp timestamp, service string, level string").parquet(path)
    counts = pipeline.bucket_counts(stream, 86400, ["level"])
    query = (
        counts.writeStream.format("memory").queryName("daily").outputMode("complete")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert spark.sql("SELECT sum(events) FROM daily").first()[0] == 1000
