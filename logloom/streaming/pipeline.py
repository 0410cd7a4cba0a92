"""The ingest and processing streams.

Two checkpointed queries, connected by the durable `raw_events` table:

* `admit_stream`: JSON text -> decode, validate, authorise -> raw_events or rejects
* `process_stream`: raw_events -> dedupe, normalise -> logs, dead letters, alert state

Writes of a micro-batch go under `_batch=<query>-<id>` with dynamic partition
overwrite, so a repeated micro-batch replaces its own output and nothing is stored
twice. A replay is a query of its own; stop the live query while it runs, since both
move the same alert state on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom.functions.text import canon_tag
from logloom.functions.timefns import as_datetime, instant
from logloom.limits import DEFAULT, Limits
from logloom.operators import admission, normalize, notify
from logloom.operators.binding import bind
from logloom.operators.lifecycle import alert_events, reconcile
from logloom.operators.rules import compile_rules, evaluate_at, evaluate_newest, newest_rows, runnable
from logloom.operators.skew import fits, lookup_join
from logloom.schemas import DEAD_LETTER_VERSION, RAW_EVENTS
from logloom.session import cut_lineage
from logloom.sources.batches import decode_batches, message_id
from logloom.sources.logs_table import laid_out, read_logs, writer_options

# fixed values: delivery policy
DUPLICATE_WINDOW = "2 minutes"
MAX_DELIVERIES = 5
KEY_BUCKETS = 64

EVENT_LOG = ["id", "alert_instance_id", "tenant_id", "rule_id", "event_type", "payload_json", "created_at"]
STATE = "rule_id bigint, dedupe_key string, status string, first_fired_at timestamp, last_fired_at timestamp, resolved_at timestamp"


@dataclass(frozen=True)
class Tables:
    """Folders of one deployment, all on storage every executor can reach."""

    root: str

    def __getattr__(self, name: str) -> str:
        if name not in (
            "raw_events", "rejects", "logs", "dead_letters", "ingested", "alert_state", "alert_scopes", "alert_events",
            "alert_log", "deliveries", "checkpoints", "admit_spent", "admit_outcomes",
        ):
            raise AttributeError(name)
        return f"{self.root}/{name}"


# --- classification and dead letters


def classify(raw_events: DataFrame, max_deliveries: int = MAX_DELIVERIES) -> DataFrame:
    """Add `reason` and `error`: invalid_batch for a breach or an unreadable record,
    retry_exhausted where the delivery count says so, NULL for good batches."""
    attempts = F.col("attempts") if "attempts" in raw_events.columns else F.lit(0)
    spent = attempts >= max_deliveries
    checked = bind(raw_events, "error", normalize.batch_error())
    broken = F.col("error").isNotNull()
    return checked.withColumn(
        "reason", F.when(broken, "invalid_batch").when(spent, "retry_exhausted")
    ).withColumn("error", F.when(broken, F.col("error")).when(spent, "delivery attempts used up"))


def malformed_letters(bodies: DataFrame) -> DataFrame:
    """Dead letters of payloads that could not be decoded."""
    none = F.lit(None)
    return bodies.select(
        F.lit(DEAD_LETTER_VERSION).alias("schema_version"),
        F.current_timestamp().alias("failed_at"),
        F.lit("malformed_payload").alias("reason"),
        F.col("decode_error").alias("error"),
        F.lit("").alias("request_id"),
        none.cast("bigint").alias("tenant_id"),
        *[none.cast("string").alias(c) for c in ("service", "env", "source")],
        F.lit(0).cast("bigint").alias("attempts"),
        F.col("body").cast("binary").alias("raw_payload"),
        none.cast("string").alias("event"),
    )


def refused_letters(classified: DataFrame) -> DataFrame:
    """Dead letters of raw events that were read but refused."""
    bad = classified.filter(F.col("reason").isNotNull())
    attempts = F.col("attempts") if "attempts" in bad.columns else F.lit(0)
    event = F.to_json(
        F.struct(
            "schema_version", "request_id", "correlation_id", "trace_id", "fingerprint",
            "received_at", "tenant_id", "service", "env", "source", "logs",
        )
    )
    return bad.select(
        F.lit(DEAD_LETTER_VERSION).alias("schema_version"),
        F.current_timestamp().alias("failed_at"),
        "reason",
        "error",
        "request_id",
        "tenant_id",
        "service",
        "env",
        "source",
        attempts.cast("bigint").alias("attempts"),
        event.cast("binary").alias("raw_payload"),
        event.alias("event"),
    )


def distinct_letters(letters: DataFrame) -> DataFrame:
    """One letter per (request_id, reason); letters without a request id all stay."""
    named = F.col("request_id") != ""
    return letters.filter(named).dropDuplicates(["request_id", "reason"]).unionByName(
        letters.filter(~named)
    )


def new_letters(letters: DataFrame, stored: DataFrame) -> DataFrame:
    """Letters whose (request_id, reason) no earlier micro-batch stored; those without a request id all stay."""
    key = ["request_id", "reason"]
    named = stored.filter(F.col("request_id") != "").select(*key)
    hits = lookup_join(named, letters.select(*key).distinct(), key, how="left_semi").distinct()
    return letters.join(hits, key, "left_anti").select(*letters.columns)


# --- delivery semantics


def not_yet_stored(batches: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct batches whose (tenant_id, ingest_id) the sink does not hold.

    The key table grows with the sink, a micro-batch does not: its keys are broadcast to the key table
    if they are few, and only the hits come back. Beyond that bound (a replay, a bulk load) both sides are
    dealt by the whole key: each has a key once by then, so there is no hot key to spread.
    """
    key = ["tenant_id", "ingest_id"]
    once = batches.dropDuplicates(key)
    asked, held = once.select(*key), stored.select(*key)
    if fits(asked):
        held = lookup_join(held, asked, key, how="left_semi")
    return once.join(held.distinct(), key, "left_anti")


def drop_repeats(stream: DataFrame, received: str = "received") -> DataFrame:
    """Drop copies of a message that arrive within two minutes of the first."""
    return stream.withWatermark(received, DUPLICATE_WINDOW).dropDuplicatesWithinWatermark(["msg_id"])


# --- storage


def key_bucket() -> Column:
    """Part of the key table that holds a batch; a micro-batch reads only its parts."""
    return F.pmod(F.xxhash64("tenant_id", "ingest_id"), F.lit(KEY_BUCKETS)).cast("int")


def batch_key(query: str, batch_id: int) -> str:
    """Micro-batch ids restart with every new query, so the query name belongs to them."""
    return f"{query}-{batch_id:09d}"


def _write(df: DataFrame, path: str, batch: str, by: tuple[str, ...] = ()) -> None:
    (
        df.withColumn("_batch", F.lit(batch))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .options(**writer_options())
        .partitionBy(*by, "_batch")
        .parquet(path)
    )


def _read_others(spark: SparkSession, path: str, schema: str, batch: str | None = None) -> DataFrame:
    """Rows written by other micro-batches; empty if there are none yet."""
    try:
        rows = spark.read.schema(f"{schema}, _batch string").parquet(path)
        rows.schema  # noqa: B018  a remote session resolves the path here only
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, _batch string")
    return rows if batch is None else rows.filter(F.col("_batch") != batch)


def read_stored_logs(spark: SparkSession, tables: Tables) -> DataFrame:
    return read_logs(spark, tables.logs, "processed_at timestamp, _batch string")


def read_alert_events(spark: SparkSession, tables: Tables) -> DataFrame:
    schema = f"{STATE}, event_type string, match_count bigint, metric_value double, created_at timestamp"
    return _read_others(spark, tables.alert_events, schema)


def read_alert_state(spark: SparkSession, tables: Tables, batch: str | None = None) -> DataFrame:
    """The newest snapshot (one row per rule and key), leaving out that of `batch`."""
    return alert_snapshot(spark, tables, batch)[0]


def alert_snapshot(spark: SparkSession, tables: Tables, batch: str | None = None) -> tuple[DataFrame, int]:
    """The newest snapshot of the alert state and its version."""
    return _snapshot(spark, tables.alert_state, STATE, batch)


def _snapshot(spark: SparkSession, path: str, schema: str, batch: str | None = None) -> tuple[DataFrame, int]:
    """The snapshot with the highest version and that version. Versions count micro-batches that
    wrote one, so no clock decides; a repeated micro-batch gets its version again."""
    snapshots = _read_others(spark, path, f"{schema}, version bigint", batch)
    last = snapshots.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
    return snapshots.filter(F.col("version") == last).drop("_batch", "version"), last


def _store_snapshot(rows: DataFrame, path: str, batch: str, version: int) -> None:
    _write(rows.withColumn("version", F.lit(version).cast("bigint")), path, batch)


# --- admission stream


SPENT = "api_key_id bigint, second timestamp, used bigint"
OUTCOMES = "outcome string, requests bigint, accepted_batches bigint, accepted_logs bigint, accepted_bytes bigint"


def judge(
    bodies: DataFrame,
    authorise: Callable[[DataFrame], DataFrame] | None = None,
    limits: Limits = DEFAULT,
    spent: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Decoded bodies with their `outcome`: authorized, a refusal, or invalid_request; and `reason`, the complaint
    or the refusal of those that do not go on.

    Where `authorise` also adds `api_key_id` and `rate_limit`, authorised requests beyond the limit of their
    key and second are rate_limited. `spent` gives the counters of earlier micro-batches for the requests it gets.
    """
    decided = admission.validate_batches(decode_batches(bodies, limits), limits)
    accepted = admission.canonical_batches(decided.filter("reason IS NULL"))
    judged = accepted.withColumn("outcome", F.lit("authorized")) if authorise is None else authorise(accepted)
    if {"api_key_id", "rate_limit"} <= set(judged.columns):
        allowed = judged.filter("outcome = 'authorized'").withColumn("_arrived", normalize.parse_instant("received_at"))
        # the join with the counters and the ranks work on what was decided, not on the JSON again
        limited = admission.rate_limit(
            allowed, arrival="_arrived", ties=["body"], spent=None if spent is None else spent(allowed))
        judged = limited.drop("_arrived").withColumn(
            "outcome", F.when(F.col("admitted"), F.col("outcome")).otherwise("rate_limited")
        ).drop("admitted").unionByName(judged.filter("outcome <> 'authorized'"))
    judged = judged.withColumn("reason", F.when(F.col("outcome") != "authorized", F.col("outcome")))
    broken = decided.filter("reason IS NOT NULL").drop("logs").withColumn("outcome", F.lit("invalid_request"))
    return judged.unionByName(broken, allowMissingColumns=True)


def admitted_and_refused(judged: DataFrame, received_at: Column) -> tuple[DataFrame, DataFrame]:
    """(raw events, rejected bodies) of judged bodies."""
    good = F.col("outcome") == "authorized"
    refused = judged.filter(~good).select(
        "body", "reason", F.when(F.col("outcome") == "invalid_request", F.col("decode_error")).alias("decode_error"))
    return admission.to_raw_events(judged.filter(good), received_at), refused


def admit(
    bodies: DataFrame,
    received_at: Column,
    authorise: Callable[[DataFrame], DataFrame] | None = None,
    limits: Limits = DEFAULT,
) -> tuple[DataFrame, DataFrame]:
    """(raw events, rejected bodies) of a table of JSON bodies.

    `authorise` adds `outcome` and `tenant_id`, and `api_key_id` and `rate_limit` where keys have limits; without it
    the bodies carry their tenant_id and all are allowed.
    """
    return admitted_and_refused(judge(bodies, authorise, limits), received_at)


def spent_before(spark: SparkSession, tables: Tables, batch: str) -> Callable[[DataFrame], DataFrame]:
    """Reader of the counters that earlier micro-batches left for the hours of some requests; only these hours are read."""

    def read(requests: DataFrame) -> DataFrame:
        hour = F.date_trunc("hour", "_arrived")
        first, last = requests.agg(F.min(hour), F.max(hour)).first()
        stored = _read_others(spark, tables.admit_spent, f"{SPENT}, hour timestamp", batch)
        return stored.filter(F.col("hour").between(F.lit(first), F.lit(last))).select("api_key_id", "second", "used")

    return read


def read_outcomes(spark: SparkSession, tables: Tables) -> DataFrame:
    """Requests per outcome, accepted batches, logs and bytes over all micro-batches."""
    stored = _read_others(spark, tables.admit_outcomes, OUTCOMES)
    names = [part.split()[0] for part in OUTCOMES.split(", ")][1:]
    return stored.groupBy("outcome").agg(*[F.sum(n).alias(n) for n in names])


def admit_stream(
    bodies: DataFrame,
    tables: Tables,
    authorise: Callable[[DataFrame], DataFrame] | None = None,
    limits: Limits = DEFAULT,
    **trigger,
) -> StreamingQuery:
    """Start the admission query on a streaming DataFrame with `body`, `received_at`
    (text) and either `tenant_id` or the columns `authorise` needs.

    Counters of limited keys are stored per (key, second) beside each micro-batch and read back by the hour, so
    the limit holds across micro-batches and restarts: the result is that of `rate_limit` over all requests, as long as
    requests come in the order they arrived. Outcomes are counted per micro-batch.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark, key = batch.sparkSession, batch_key("admit", batch_id)
        judged = judge(batch, authorise, limits, spent_before(spark, tables, key)).persist()
        try:
            events, rejected = admitted_and_refused(judged, F.col("received_at"))
            numbered = events.withColumn("msg_id", message_id()).withColumn(
                "stored_at", F.current_timestamp()
            )
            _write(rejected, tables.rejects, key)
            _write(admission.outcome_counts(judged.select(
                "outcome", F.size("logs").alias("log_count"), F.octet_length("body").alias("body_bytes"))), tables.admit_outcomes, key)
            if {"api_key_id", "rate_limit"} <= set(judged.columns):
                arrived = judged.filter("outcome = 'authorized'").select(
                    "api_key_id", "rate_limit", normalize.parse_instant("received_at").alias("received_at"), F.lit(True).alias("admitted"))
                _write(admission.spending(arrived).withColumn("hour", F.date_trunc("hour", "second")), tables.admit_spent, key, ("hour",))
            # what readers follow comes last
            _write(numbered, tables.raw_events, key)
        finally:
            judged.unpersist()

    return (
        bodies.writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{tables.checkpoints}/admit")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


# --- processing stream


def raw_event_stream(spark: SparkSession, tables: Tables, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(f"{RAW_EVENTS}, msg_id string, stored_at timestamp, _batch string")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(tables.raw_events)


def process_batch(
    spark: SparkSession,
    events: DataFrame,
    batch: str,
    tables: Tables,
    rules: DataFrame | None = None,
) -> None:
    """Store one micro-batch: dead letters, log rows, batch keys, alert state.
    `batch` names it; the same name again replaces the first try."""
    classified = classify(events).persist()
    try:
        letters = distinct_letters(refused_letters(classified))
        earlier = _read_others(spark, tables.dead_letters, "request_id string, reason string", batch)
        _write(new_letters(letters, earlier), tables.dead_letters, batch)
        good = classified.filter("reason IS NULL").withColumn("ingest_id", F.col("request_id"))
        good = good.withColumn("key_bucket", key_bucket())
        buckets = [r[0] for r in good.select("key_bucket").distinct().collect()]  # at most KEY_BUCKETS
        stored = _read_others(spark, tables.ingested, "tenant_id bigint, ingest_id string, key_bucket int", batch)
        stored = stored.filter(F.col("key_bucket").isin(buckets))
        fresh = not_yet_stored(good, stored).drop("ingest_id").persist()
        try:
            rows = normalize.normalize_batches(fresh.drop("key_bucket")).drop("position")
            _write(
                laid_out(rows.withColumn("processed_at", F.current_timestamp())),
                tables.logs, batch, ("event_date",),
            )
            # the keys are written last: until then a repeat stores the batch again
            # under the same `_batch`, replacing the first try
            _write(
                fresh.select("tenant_id", F.col("request_id").alias("ingest_id"), "key_bucket"),
                tables.ingested, batch, ("key_bucket",),
            )
            if rules is not None:
                update_alerts(spark, fresh, rows, batch, tables, rules)
        finally:
            fresh.unpersist()
    finally:
        classified.unpersist()


SCOPES = "tenant_id bigint, service string, environment string, newest timestamp"


def update_alerts(
    spark: SparkSession, fresh: DataFrame, rows: DataFrame, batch: str, tables: Tables, rules: DataFrame
) -> None:
    """Evaluate the rules a micro-batch touches and move the alert state on by one step.

    Rules with a window see the stored logs of their window: the newest time per scope is kept as a
    small table, so only the days of the windows are read. Rules without a window see the rows of the
    micro-batch. State and scopes are snapshots with a version per micro-batch; every tenant's
    changes carry the newest reception time of its own batches.
    """
    compiled = cut_lineage(runnable(compile_rules(rules)))
    touched = fresh.select(
        F.col("tenant_id").alias("_tenant"),
        canon_tag("service").alias("_service"),
        canon_tag("env").alias("_env"),
    ).distinct()
    in_scope = (F.col("tenant_id") == F.col("_tenant")) & (
        F.col("scope_service").isNull()
        | ((F.col("scope_service") == F.col("_service")) & (F.col("scope_environment") == F.col("_env")))
    )
    observed = fresh.groupBy("tenant_id").agg(F.max(normalize.parse_instant("received_at")).alias("observed_at"))
    evaluated = compiled.join(touched, in_scope, "left_semi").join(observed.filter("observed_at IS NOT NULL"), "tenant_id")
    scopes, version = _snapshot(spark, tables.alert_scopes, SCOPES, batch)
    newest = scopes.unionByName(newest_rows(rows)).groupBy("tenant_id", "service", "environment").agg(
        F.max("newest").alias("newest"))
    newest = newest.persist()
    current, step_version = alert_snapshot(spark, tables, batch)
    triggers = evaluate_newest(read_stored_logs(spark, tables), evaluated, newest, rows)
    step = reconcile(triggers, current, evaluated).persist()
    try:
        store_step(step, compiled, rules, batch, tables, step_version + 1)
        _store_snapshot(newest, tables.alert_scopes, batch, version + 1)
    finally:
        step.unpersist()
        newest.unpersist()


def store_step(
    step: DataFrame, compiled: DataFrame, rules: DataFrame, batch: str, tables: Tables, version: int
) -> None:
    """Store one step of the alert state: changes, event log with payloads, outbox, and the state last."""
    changes = step.filter("event_type IS NOT NULL")
    facts = compiled.select(
        "rule_id", "tenant_id", "rule_name", "severity", "kind", "threshold", "window_seconds", "percentile", "value_field"
    )
    events = lookup_join(changes.withColumnRenamed("observed_at", "tick"), facts, ["rule_id"])
    for column in ("service_name", "environment", "owner"):
        if column not in rules.columns:
            rules = rules.withColumn(column, F.lit(None).cast("string"))
    deliveries = notify.enqueue(events, rules)
    log = alert_events(events).select(*EVENT_LOG).unionByName(notify.enqueued_events(deliveries).select(*EVENT_LOG))
    _write(changes.withColumnRenamed("observed_at", "created_at"), tables.alert_events, batch)
    _write(log, tables.alert_log, batch)
    _write(deliveries, tables.deliveries, batch)
    _store_snapshot(
        step.drop("event_type", "match_count", "metric_value", "observed_at"), tables.alert_state, batch, version)


def evaluate_scheduled(
    spark: SparkSession, tables: Tables, rules: DataFrame, at: datetime | str, name: str = "schedule"
) -> None:
    """One evaluation of all rules with a window at a given time, stored like that of a micro-batch.

    Alerts resolve this way when no new rows arrive. Run it from a scheduler, not beside the
    processing query; the same time again replaces the first try.
    """
    moment = as_datetime(at)
    batch = f"{name}-{moment:%Y%m%dT%H%M%S}"
    compiled = cut_lineage(runnable(compile_rules(rules)))
    windowed = compiled.filter(F.col("window_seconds") > 0).withColumn("observed_at", instant(moment))
    triggers = evaluate_at(read_stored_logs(spark, tables), windowed, moment)
    current, version = _snapshot(spark, tables.alert_state, STATE, batch)
    step = reconcile(triggers, current, windowed).persist()
    try:
        store_step(step, compiled, rules, batch, tables, version + 1)
    finally:
        step.unpersist()


def process_stream(
    spark: SparkSession,
    tables: Tables,
    rules: Callable[[], DataFrame] | None = None,
    suppress_repeats: bool = True,
    events: DataFrame | None = None,
    name: str = "process",
    **trigger,
) -> StreamingQuery:
    """Start the processing query.

    `rules` is called per micro-batch, so rule changes take effect without a
    restart. A replay passes older `events`, a new `name` and
    suppress_repeats=False: the watermark would drop old rows, and batches already
    stored are recognised by their keys.
    """
    source = events if events is not None else raw_event_stream(spark, tables)
    if suppress_repeats:
        source = drop_repeats(
            source.withColumn("received", normalize.parse_instant("received_at")), "received"
        ).drop("received")

    def store(batch: DataFrame, batch_id: int) -> None:
        key = batch_key(name, batch_id)
        process_batch(batch.sparkSession, batch, key, tables, rules() if rules else None)

    return (
        source.writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{tables.checkpoints}/{name}")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def bucket_counts(stream: DataFrame, bucket_seconds: int, groups: list[str], lateness: str = "10 minutes") -> DataFrame:
    """Tumbling counts of a stream of log rows, closed once the watermark passes."""
    return (
        stream.withWatermark("timestamp", lateness)
        .groupBy(F.window("timestamp", f"{bucket_seconds} seconds"), *groups)
        .agg(F.count("*").alias("events"))
        .select(F.col("window.start").alias("bucket"), *groups, "events")
    )
