"""State that the streams keep across micro-batches and restarts."""

import datetime as dt

from pyspark.sql import functions as F

from logloom.operators import rules as rule_ops
from logloom.plans import fixtures as fx
from logloom.sources import logs_table
from logloom.streaming import pipeline, window_state

SF = "/root/testdata/sf0.001"


def store(logs, tables, batch):
    rows = logs.withColumn("processed_at", F.lit(dt.datetime(2026, 1, 1))).withColumn("_batch", F.lit(batch))
    (logs_table.laid_out(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("event_date", "_batch").parquet(tables.logs))


def of(df):
    return sorted((r["rule_id"], r["group_key"], r["match_count"], round(r["metric_value"], 9)) for r in df.collect())


def test_window_state_gives_the_batch_result_after_every_restart(spark, tmp_path):
    tables = pipeline.Tables(str(tmp_path / "tables"))
    logs = fx.templated_logs(spark, SF).drop("event_id").persist()
    compiled = rule_ops.load_rules(fx.rules(spark, SF), fx.services(spark, SF))
    # thresholds of the least possible value, so that every group of every rule is compared
    compiled = compiled.withColumn("threshold", F.lit(0.0)).withColumn(
        "window_seconds", F.when(F.col("rule_id") % 2 == 0, F.col("window_seconds") * 24).otherwise(F.col("window_seconds"))).persist()
    low, high = logs.agg(F.unix_micros(F.min("timestamp")), F.unix_micros(F.max("timestamp"))).first()
    at = F.unix_micros("timestamp")
    cuts = [low + (high - low) * n // 2 for n in range(3)]
    late = F.xxhash64("ingest_id") % 10 == 0
    parts = [logs.filter((at >= cuts[n]) & (at < cuts[n + 1] + n) & ~late) for n in range(2)]
    # a tenth of the rows comes last, so most of them are older than their window, and one part is written twice
    parts += [logs.filter(late), parts[1]]
    total, sizes, seen = 0, [], []
    spark.conf.set(window_state.PROVIDER, window_state.STATE_STORE)
    try:
        for number, part in enumerate(parts):
            store(part, tables, f"b{number if number < 3 else 1}")
            sizes.append(part.count())
            found = []

            def each(batch, _, found=found):
                batch.persist()
                loaded = batch.select("rule_id").distinct()
                found.append((of(window_state.window_triggers(batch, compiled)), {r[0] for r in loaded.collect()}))

            query = window_state.window_counts(window_state.logs_stream(spark, tables), compiled, 4).writeStream.foreachBatch(each).option(
                "checkpointLocation", f"{tables.checkpoints}/watch").trigger(availableNow=True).start()
            query.awaitTermination()
            seen.append(sum(p["numInputRows"] for p in query.recentProgress))
            (got, ran), = found
            everything = pipeline.read_stored_logs(spark, tables)
            want = [r for r in of(rule_ops.evaluate_newest(everything, compiled, rule_ops.newest_rows(everything), part)) if r[0] in ran]
            assert got == want, number
            total += len(want)
    finally:
        spark.conf.unset(window_state.PROVIDER)
        logs.unpersist()
    assert total > 50
    # every stored row is read once per branch (matches, newest times), whatever is stored already
    assert seen == [2 * n for n in sizes]


def test_watch_stream_steps_like_the_processing_stream(spark, tmp_path):
    from test_storage import body, rule_rows, send

    inbox, tables = str(tmp_path / "in"), pipeline.Tables(str(tmp_path / "tables"))

    def run():
        stream = spark.readStream.schema("body string, tenant_id long, received_at string").parquet(inbox)
        pipeline.admit_stream(stream, tables).awaitTermination()
        pipeline.process_stream(spark, tables).awaitTermination()
        window_state.watch_stream(spark, tables, rule_rows(spark), shards=2).awaitTermination()
        return [(r["dedupe_key"], r["event_type"], r["match_count"])
                for r in pipeline.read_alert_events(spark, tables).orderBy("created_at").collect()]

    before = spark.conf.get(window_state.PROVIDER)
    send(spark, inbox, body("boom 1"), body("boom 1"), "{", body("quiet", "info", 1), body("boom 2", seconds=30))
    assert run() == [("host=h1", "triggered", 2)]
    send(spark, inbox, body("calm", "info", 3600), received="2026-07-07T13:00:00Z")
    assert run() == [("host=h1", "triggered", 2), ("host=h1", "resolved", None)]
    assert pipeline.read_alert_state(spark, tables).first()["status"] == "resolved"
    assert spark.conf.get(window_state.PROVIDER) == before
    outbox = spark.read.parquet(tables.deliveries)
    assert outbox.count() == 2


# --- rate limit and outcomes of admission

KEYS = ("body string, received_at string, api_key_id bigint, rate_limit int, refusal string")


def bodies_of(count, seed=1):
    import json
    import random

    pick = random.Random(seed)
    rows, at = [], dt.datetime(2026, 7, 7, 11, 59, 58)
    for n in range(count):
        at += dt.timedelta(milliseconds=pick.choice([0, 20, 150]))
        document = {"schema_version": "logs.ingest.v1", "service": "checkout", "env": "prod", "source": "app",
                    "logs": [{"timestamp": "2026-07-07T11:59:00Z", "level": "error", "message": f"m{n}"}] * pick.choice([1, 2])}
        key, limit = pick.choice([(1, 3), (1, 3), (2, 5), (3, 0), (4, None)])
        refusal = pick.choice([None] * 5 + ["forbidden_scope"])
        rows.append(("{" if n % 29 == 0 else json.dumps(document), at.isoformat() + "Z", key, limit, refusal))
    return rows


def known_keys(accepted):
    return accepted.withColumn("outcome", F.coalesce("refusal", F.lit("authorized"))).withColumn("tenant_id", F.lit(1).cast("bigint"))


def test_rate_limit_and_outcomes_across_micro_batches(spark, tmp_path):
    from logloom.operators import admission

    rows = bodies_of(160)
    whole = spark.createDataFrame(rows, KEYS)
    want = pipeline.judge(whole, known_keys).persist()
    refused = {r["body"] for r in want.filter("outcome = 'rate_limited'").collect()}
    assert len(refused) > 10
    # the same through the batch operator alone
    alone = admission.rate_limit(
        whole.filter("refusal IS NULL AND body <> '{'").withColumn("received_at", F.to_timestamp("received_at")), ties=["body"])
    assert {r["body"] for r in alone.filter("NOT admitted").collect()} == refused
    counts = admission.outcome_counts(want.select(
        "outcome", F.size("logs").alias("log_count"), F.octet_length("body").alias("body_bytes"))).collect()

    inbox, tables = str(tmp_path / "in"), pipeline.Tables(str(tmp_path / "tables"))
    for part in (rows[:7], rows[7:60], rows[60:61], rows[61:]):
        spark.createDataFrame(part, KEYS).coalesce(1).write.mode("append").parquet(inbox)
        # a new query each time: the counters come from storage
        pipeline.admit_stream(spark.readStream.schema(KEYS).parquet(inbox), tables, known_keys).awaitTermination()
    rejects = spark.read.parquet(tables.rejects)
    assert {r["body"] for r in rejects.filter("reason = 'rate_limited'").collect()} == refused
    found = pipeline.read_outcomes(spark, tables).select(counts[0].__fields__).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, counts))
    admitted = spark.read.parquet(tables.raw_events)
    assert admitted.count() == want.filter("outcome = 'authorized'").count()
    # counters are read by the hour
    plan = spark.read.schema(f"{pipeline.SPENT}, hour timestamp, _batch string").parquet(tables.admit_spent)
    assert plan.filter("hour > '2026-07-08'").count() == 0 and plan.select("hour").distinct().count() == 2
