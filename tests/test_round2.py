"""Cases that sample data does not reach: extreme numbers, deep arrays, lifted limits, pruned reads, windowless rules."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from logloom.functions.jsonfields import canonical_fields, value_map
from logloom.functions.timefns import as_datetime
from logloom.limits import UNBOUNDED, RequestError
from logloom.operators import graph, notify, opsmetrics, retrieval, rules, search
from logloom.operators.quantiles import exact_quantile
from logloom.plans import dsl, fixtures as fx
from logloom.session import checkpoint_dir
from logloom.sources import logs_table
from logloom.streaming import pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("depth", range(1, 9))
def test_strings_in_arrays_of_any_depth_are_trimmed(spark, depth):
    text = '{" k ":' + "[" * depth + '" x\\u00a0\\n ",1," \\"q\\" ,"' + "]" * depth + "}"
    row = spark.createDataFrame([(text,)], "t string").select(canonical_fields(value_map("t")).alias("c")).first()
    assert json.loads(row["c"]) == json.loads('{"k":' + "[" * depth + '"x",1,"\\"q\\" ,"' + "]" * depth + "}")


def test_quantiles_of_any_double(spark):
    values = [4.9e-324, 1e-323, -4.9e-324, 1e308, 0.0, 5.0, float("inf"), float("-inf")]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    found = [exact_quantile(rows, [], "v", float(p), method="lower").first()["value"] for p in (0, 14.3, 28.6, 42.9, 100)]
    assert found == [float("-inf"), -4.9e-324, 0.0, 4.9e-324, float("inf")]
    nans = spark.createDataFrame([(1.0,), (float("nan"),)], "v double")
    assert exact_quantile(nans, [], "v", 0.0).first()["value"] == 1.0


def test_close_values_do_not_meet_in_one_range(spark):
    rows = spark.range(1_700_000_000, 1_700_200_000).select(F.col("id").cast("double").alias("v"))
    assert exact_quantile(rows, [], "v", 50.0).first()["value"] == 1_700_099_999.5
    assert exact_quantile(rows, [], "v", 99.0, method="lower").first()["value"] == 1_700_197_999.0


def test_quantile_of_rate_valued_buckets(spark):
    buckets = spark.createDataFrame([(0.1, 0.2), (0.5, 0.4), (float("inf"), 0.4)], "le double, cumulative double")
    found = opsmetrics.histogram_quantile(buckets.withColumn("s", F.lit(1)), ["s"], 0.95).first()["quantile"]
    assert found == pytest.approx(0.46)


def test_windows_must_fit_the_minute(spark):
    with pytest.raises(ValueError):
        opsmetrics.trailing_rate(fx.logs(spark, SF), [], "timestamp", 90)


@pytest.mark.parametrize("text", ["2026-07-01", "20260701T000000", "2026-W27-1", "2026-07-01 00:00:00Z", "2026-07-01T00:00:00"])
def test_only_rfc3339_instants(text):
    with pytest.raises(ValueError):
        as_datetime(text)
    with pytest.raises(RequestError):
        search.check_range(text, "2026-08-01T00:00:00Z", None, "")


def test_limits_can_be_lifted(spark):
    logs = fx.logs(spark, SF).filter("tenant_id = 1")
    assert graph.truncation(logs, None, UNBOUNDED).first().asDict() == {
        "record_count": logs.count(), "truncated": False}
    assert graph.capped(logs, None, UNBOUNDED).filter("truncated").count() == 0
    assert graph.capped(logs, 500, UNBOUNDED).count() == min(500, logs.count())
    due = spark.range(700).select(
        "id", F.lit("pending").alias("status"), F.lit(dt.datetime(2026, 1, 1)).alias("available_at"),
        F.lit(None).cast("timestamp").alias("locked_at"))
    assert notify.due(due, "2026-07-01T00:00:00Z", 700).count() == 500
    assert notify.due(due, "2026-07-01T00:00:00Z", 700, limits=UNBOUNDED).count() == 700
    with pytest.raises(RequestError):
        dsl.run_query(logs, 1, "x" * 70_000)


def test_evidence_holds_all_given_logs(spark):
    logs = fx.logs(spark, "/root/testdata/sf0.01").limit(150)
    assert retrieval.evidence_document(logs).first()["log_count"] == 150


def test_a_cluster_needs_a_shared_folder(spark):
    class Session:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return {"spark.master": "spark://host:7077"}.get(key, default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())


# --- pruned reads


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pruned") / "logs")
    logs_table.write_logs(fx.templated_logs(spark, SF).drop("event_id"), path, mode="overwrite")
    return logs_table.read_logs(spark, path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ticks_and_completeness_and_paging_read_their_days_only(spark, stored, capsys):
    ready = rules.load_rules(fx.rules(spark, SF), fx.services(spark, SF))
    ticks = rules.evaluate_ticks(stored, ready, "2024-01-10T00:00:00Z", "2024-01-10T01:00:00Z", 300)
    assert "PartitionFilters: [isnotnull(event_date" in plan(ticks)
    days = logs_table.completeness(stored, "2024-01-10T00:00:00Z", "2024-01-12T00:00:00Z")
    assert "event_date" in plan(days).split("PartitionFilters: [isnotnull(")[1][:20]
    query = search.log_query(1, "2024-01-08T00:00:00Z", "2024-01-15T00:00:00Z", limit=5)
    page = search.search_logs(stored, query).collect()
    after = search.search_after(stored, query, page[-1].asDict())
    capsys.readouterr()
    after.explain("formatted")
    assert "LessThanOrEqual(timestamp" in capsys.readouterr().out
    both = search.log_query(1, "2024-01-08T00:00:00Z", "2024-01-15T00:00:00Z", limit=10)
    assert [r["ingest_id"] for r in after.collect()] == [r["ingest_id"] for r in search.search_logs(stored, both).collect()[5:]]


# --- rules without a window in the stream


def windowless(spark):
    return spark.createDataFrame(
        [(7, 1, None, None, None, None, "now", "count_threshold", "high", "error", None, None, "[]", 0, "2", 0, "active"),
         (8, 1, None, None, None, None, "ten", "count_threshold", "high", "error", None, None, "[]", 600, "2", 0, "active")],
        "id long, tenant_id long, service_id long, service_name string, environment string, owner string, name string, "
        "rule_type string, severity string, log_level string, fingerprint string, filter_json string, group_by string, "
        "window_seconds int, threshold string, cooldown_seconds int, status string")


def test_rules_without_a_window_see_the_micro_batch_only(spark, tmp_path):
    inbox, tables = str(tmp_path / "in"), pipeline.Tables(str(tmp_path / "tables"))
    schema = "body string, tenant_id long, received_at string"

    def send(minute, *messages):
        stamp = f"2026-07-07T12:{minute:02d}:00Z"
        document = {"schema_version": "logs.ingest.v1", "service": "checkout", "env": "prod", "source": "app",
                    "logs": [{"timestamp": stamp, "level": "error", "message": m, "fields": {}} for m in messages]}
        spark.createDataFrame([(json.dumps(document), 1, stamp)], schema).coalesce(1).write.mode("append").parquet(inbox)
        pipeline.admit_stream(spark.readStream.schema(schema).parquet(inbox), tables).awaitTermination()
        pipeline.process_stream(spark, tables, rules=lambda: windowless(spark)).awaitTermination()
        return {(r["rule_id"], r["event_type"], r["match_count"], r["created_at"].minute)
                for r in pipeline.read_alert_events(spark, tables).collect()}

    assert send(1, "a") == set()
    # one matching row per micro-batch: only the rule with a window adds them up
    second = send(3, "b")
    assert second == {(8, "triggered", 2, 3)}
    third = send(5, "c", "d")
    assert third - second == {(7, "triggered", 2, 5), (8, "suppressed", 4, 5)}
    fourth = send(30, "e")
    assert fourth - third == {(7, "resolved", None, 30), (8, "resolved", None, 30)}
    assert {r["status"] for r in pipeline.read_alert_state(spark, tables).collect()} == {"resolved"}

    # a scheduled evaluation without new rows changes nothing here but is stored, and repeats replace it
    for _ in range(2):
        pipeline.evaluate_scheduled(spark, tables, windowless(spark), "2026-07-07T12:30:30Z")
    assert pipeline.read_alert_events(spark, tables).count() == len(fourth)
    outbox = spark.read.parquet(tables.deliveries).collect()
    assert sorted((r["rule_id"], json.loads(r["payload_json"])["event_type"]) for r in outbox) == [
        (7, "resolved"), (7, "triggered"), (8, "resolved"), (8, "triggered")]
    log = [r["event_type"] for r in spark.read.parquet(tables.alert_log).collect()]
    assert sorted(log) == ["notification_enqueued"] * 4 + ["resolved"] * 2 + ["suppressed"] + ["triggered"] * 2


def test_scheduled_evaluation_resolves_without_new_rows(spark, tmp_path):
    tables = pipeline.Tables(str(tmp_path / "tables"))
    logs = fx.templated_logs(spark, SF).drop("event_id").filter("tenant_id = 1").withColumn(
        "processed_at", F.current_timestamp()).withColumn("_batch", F.lit("load"))
    logs_table.laid_out(logs).write.partitionBy("event_date", "_batch").parquet(tables.logs)
    at = logs.filter("level = 'error'").agg(F.max("timestamp")).first()[0] + dt.timedelta(seconds=1)
    ready = windowless(spark).filter("id = 8").withColumn("threshold", F.lit("1"))
    pipeline.evaluate_scheduled(spark, tables, ready, at.replace(tzinfo=dt.timezone.utc))
    pipeline.evaluate_scheduled(spark, tables, ready, (at + dt.timedelta(hours=1)).replace(tzinfo=dt.timezone.utc))
    kinds = [r["event_type"] for r in pipeline.read_alert_events(spark, tables).orderBy("created_at").collect()]
    assert kinds == ["triggered", "resolved"]


def test_equal_templates_win_once_each(spark):
    vectors = spark.createDataFrame(
        [(1, "t1", "disk full", "m", 2, [1.0, 0.0])] * 2 + [(1, "t2", "disk slow", "m", 2, [0.6, 0.8]), (2, "t1", "disk full", "m", 2, [1.0, 0.0])],
        "tenant_id bigint, template_id string, message_template string, model string, dims int, embedding array<float>")
    asked = spark.createDataFrame([(9, 1, [1.0, 0.0], "disk")], "question_id bigint, tenant_id bigint, vector array<float>, question string")
    found = retrieval.hybrid_search_many(vectors, asked, "m", 2, 5).collect()
    assert sorted((r["rank"], r["template_id"], r["message_template"]) for r in found) == [
        (1, "t1", "disk full"), (2, "t1", "disk full"), (3, "t2", "disk slow")]


def test_rules_stand_under_their_most_selective_equality(spark):
    names = ["fingerprint", "trace_id", "host", "service", "source", "level"]
    def rule(rule_id, scope=(None, None), **asked):
        return (rule_id, 1, *scope, *[asked.get(n, "") for n in names])
    schema = "rule_id bigint, tenant_id bigint, scope_service string, scope_environment string, " + ", ".join(f"f_{n} string" for n in names)
    table = spark.createDataFrame([
        rule(1, level="error", fingerprint="abc"), rule(2, ("pay", "prod"), level="error"), rule(3, service="pay"), rule(4), rule(5, level="error")], schema)
    kinds = {r["rule_id"]: rules.INDEX[r["index_kind"]] for r in rules.rule_index(table).collect()}
    assert kinds == {1: ("fingerprint",), 2: ("service", "environment"), 3: ("service",), 4: (), 5: ("level",)}
    logs = spark.createDataFrame(
        [(1, "pay", "prod", "error", "abc"), (1, "pay", "dev", "info", "x"), (1, "web", "prod", "info", "x"), (2, "pay", "prod", "error", "abc")],
        "tenant_id bigint, service string, environment string, level string, fingerprint string").withColumn("fields_json", F.lit("{}"))

    def met(ruled):
        rows, keyed = rules.indexed(logs, ruled)
        return sorted((r["service"], r["environment"], r["rule_id"]) for r in rows.join(
            keyed.select("index_key", "rule_id"), "index_key").collect())

    everyone = [("pay", "dev", 4), ("pay", "prod", 4), ("web", "prod", 4)]
    assert met(table) == sorted(everyone + [("pay", "prod", 1), ("pay", "prod", 2), ("pay", "prod", 3), ("pay", "dev", 3), ("pay", "prod", 5)])
    # rows that no rule can mean are gone before their fields are parsed
    rows, _ = rules.indexed(logs, table.filter("rule_id IN (1, 2)"))
    assert rows.select("tenant_id").distinct().count() == 1 and rows.count() == 2
