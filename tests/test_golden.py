"""Fixed cases for normalisation, rules, lifecycle, graph and requests."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from logloom.functions import retry, templates, text, timefns, vectors
from logloom.functions.jsonfields import canonical_fields, field_number, fields_error, value_map
from logloom.limits import DEFAULT, RequestError
from logloom.operators import (
    admission,
    analytics,
    authoring,
    graph,
    lifecycle,
    normalize,
    retrieval,
    rules,
    search,
)
from logloom.plans.dsl import run_query
from logloom.schemas import RAW_EVENTS
from logloom.sources import batches


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def at(text_value):
    return dt.datetime.fromisoformat(text_value)


# --- scalar functions


@pytest.mark.parametrize(
    "message, expected",
    [
        (
            "database query 123e4567-e89b-12d3-a456-426614174000 timed out after 5000 ms from 10.0.0.8",
            "database query <uuid> timed out after <num> ms from <ip>",
        ),
        ("  a\t\tb   c  ", "a b c"),
        ("é12 x12 12.5 0xdeadbeef0123 v1.2", "é<num> x12 <num> <hex> v1.<num>"),
        ("", ""),
    ],
)
def test_template(spark, message, expected):
    assert one(spark, templates.message_template(F.lit(message))) == expected


def test_templates_share_an_id(spark):
    a, b = (
        one(spark, templates.template_id(templates.message_template(F.lit(f"took {n} ms from 10.0.0.{n}"))))
        for n in (8, 9)
    )
    assert a == b and len(a) == 32


def test_trim_takes_every_white_space(spark):
    assert one(spark, text.trim_all(F.lit(" \u0085 \t\nx y \r"))) == "x y"


@pytest.mark.parametrize(
    "value, expected",
    [
        ("2026-07-07T16:00:00-07:00", at("2026-07-07T23:00:00")),
        ("2026-07-07T16:00:00.123456789Z", at("2026-07-07T16:00:00.123456")),
        (" 2026-07-07T16:00:00Z ", at("2026-07-07T16:00:00")),
        ("2026-07-07 16:00:00", None),
        ("2026-07-07", None),
        ("2026-13-07T16:00:00Z", None),
        ("", None),
    ],
)
def test_instants(spark, value, expected):
    assert one(spark, timefns.parse_instant(F.lit(value))) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [("5", 5.0), ("1d", None), ("NaN", None), ('" 7.5 "', 7.5), ('"x"', None), ("1e400", None), ("null", None)],
)
def test_numbers_in_fields(spark, raw, expected):
    assert one(spark, field_number(F.lit('{"k":%s}' % raw), "k")) == expected


def test_canonical_fields(spark):
    raw = '{" b ":" x ","a":[" y ",[" z ",{}]],"b":1,"n":null,"t":true}'
    assert one(spark, canonical_fields(value_map(F.lit(raw)))) == '{"a":["y",["z",{}]],"b":1,"n":null,"t":true}'
    assert one(spark, canonical_fields(value_map(F.lit("{}")))) == "{}"


@pytest.mark.parametrize(
    "raw, complaint",
    [
        ('{"a":"{not an object}"}', None),
        ('{"a":{"b":1}}', 'fields["a"]: unsupported field value type object'),
        ('{"a":[1,[{"b":1}]]}', 'fields["a"]: unsupported field value type object'),
        ('{" ":1}', "fields keys must be non-empty"),
        ('{"a b":1}', 'fields key "a b" contains unsupported characters'),
    ],
)
def test_field_complaints(spark, raw, complaint):
    assert one(spark, fields_error(value_map(F.lit(raw)))) == complaint


def test_retry_delay(spark):
    def delay(attempt, top=120_000):
        return one(spark, retry.retry_delay_ms(F.lit(10), F.lit(attempt), 30_000, top))

    first, third, fifth = delay(1), delay(3), delay(5)
    assert 30_000 <= first < third <= fifth <= 120_000


@pytest.mark.parametrize(
    "owner, service, env, expected",
    [
        ("team", "a", "prod", "team"),
        (" ", "a", "prod", "a:prod"),
        (None, "a", None, "a"),
        (None, None, None, "tenant:7"),
    ],
)
def test_notification_target(spark, owner, service, env, expected):
    values = [F.lit(v).cast("string") for v in (owner, service, env)]
    assert one(spark, retry.notification_target(*values, F.lit(7))) == expected


def test_keyword_match(spark):
    def match(document, question):
        return one(spark, vectors.has_all_tokens(F.lit(document), F.lit(question)))

    assert match("Connection pool exhausted after <num> ms", "pool CONNECTION")
    assert not match("Connection pool exhausted", "pool size")
    assert not match("Connection pool exhausted", " <num> ")


# --- admission and normalisation


def batch_of(spark, document):
    df = spark.createDataFrame([(document if isinstance(document, str) else json.dumps(document),)], "body string")
    return admission.validate_batches(batches.decode_batches(df))


GOOD = {
    "schema_version": "logs.ingest.v1",
    "service": " Checkout ",
    "env": "PROD",
    "source": "app",
    "logs": [{"timestamp": "2026-07-07T16:00:00Z", "level": "ERROR", "message": " x "}],
}


def changed(**changes):
    return {**GOOD, **changes}


def with_record(**changes):
    return changed(logs=[{**GOOD["logs"][0], **changes}])


@pytest.mark.parametrize(
    "document, reason",
    [
        (GOOD, None),
        (changed(schema_version=""), "schema_version is required"),
        (changed(schema_version="logs.ingest.v2"), 'unsupported schema_version "logs.ingest.v2"'),
        (changed(service=""), "service is required"),
        (changed(env="a b"), "env contains unsupported characters"),
        (changed(source=None), "source is required"),
        (changed(logs=[]), "at least one log entry is required"),
        (changed(logs=GOOD["logs"] * 1001), "batch exceeds 1000 log entries"),
        (with_record(level="verbose"), "log[0]: level is unsupported"),
        (with_record(timestamp="yesterday"), "log[0]: timestamp must be RFC3339"),
        (with_record(message=" "), "log[0]: message is required"),
        (with_record(fields={"a": {"b": 1}}), 'log[0]: fields["a"]: unsupported field value type object'),
        (changed(extra=1), "invalid_request_body"),
        (with_record(extra=1), "invalid_request_body"),
        (changed(service=7), "invalid_request_body"),
        (with_record(fields=[1]), "invalid_request_body"),
        (json.dumps(GOOD) + " x", "invalid_request_body"),
        (json.dumps(GOOD) * 2, "invalid_request_body"),
        (json.dumps(GOOD)[:-3], "invalid_request_body"),
        ("", "invalid_request_body"),
        ("[]", "invalid_request_body"),
        (with_record(message="x" * (1 << 20)), "request_body_too_large"),
    ],
)
def test_batch_checks(spark, document, reason):
    assert batch_of(spark, document).select("reason").first()[0] == reason


def fingerprint_of(spark, document, tenant=1):
    rows = admission.canonical_batches(batch_of(spark, document)).withColumn("tenant_id", F.lit(tenant))
    return rows.select(admission.batch_fingerprint()).first()[0]


def test_fingerprint_depends_on_content_only(spark):
    same = changed(service="checkout", env=" prod", logs=[{**GOOD["logs"][0], "message": "x", "level": "err"}])
    assert fingerprint_of(spark, GOOD) == fingerprint_of(spark, same)
    assert fingerprint_of(spark, GOOD) != fingerprint_of(spark, GOOD, tenant=2)
    assert fingerprint_of(spark, GOOD) != fingerprint_of(spark, with_record(message="y"))


def raw_event(**changes):
    event = {
        "schema_version": "logs.raw.v1", "request_id": "r1", "correlation_id": "", "trace_id": "",
        "fingerprint": "r1", "received_at": "2026-07-07T23:30:00.5Z", "tenant_id": 1, "service": " Checkout ",
        "env": "PROD", "source": " App",
        "logs": [("2026-07-07T16:00:00-07:00", " WARNING ", " slow ", json.dumps(
            {"trace_id": "trace-123", "Host": "api-1", "region": "us-west-2", "attempt": 3}))],
    }
    event.update(changes)
    return event


def raw_frame(spark, *events):
    names = [part.split()[0] for part in RAW_EVENTS.split(", ")]
    return spark.createDataFrame([tuple(e[n] for n in names) for e in events], RAW_EVENTS)


def test_normalise(spark):
    row = normalize.normalize_batches(raw_frame(spark, raw_event())).first()
    assert (row["level"], row["service"], row["environment"], row["source"]) == ("warn", "checkout", "prod", "app")
    assert row["timestamp"] == at("2026-07-07T23:00:00")
    assert (row["host"], row["trace_id"], row["message"]) == ("api-1", "trace-123", "slow")
    assert row["fields_json"] == '{"attempt":3,"region":"us-west-2"}'
    assert len(row["fingerprint"]) == 32


def test_normalise_fallbacks(spark):
    event = raw_event(trace_id=" batch-trace ", logs=[("", "", "m", None)])
    row = normalize.normalize_batches(raw_frame(spark, event)).first()
    assert row["timestamp"] == at("2026-07-07T23:30:00.500")
    assert (row["trace_id"], row["level"], row["fields_json"]) == ("batch-trace", "info", "{}")


@pytest.mark.parametrize(
    "changes, error",
    [
        ({}, None),
        ({"schema_version": "logs.raw.v0"}, "invalid logs.raw event: invalid schema version"),
        ({"tenant_id": 0}, "invalid logs.raw event: tenant_id is required"),
        ({"logs": []}, "invalid logs.raw event: at least one log entry is required"),
        ({"received_at": "soon"}, "normalize logs.raw event: parse received_at"),
        ({"logs": [("ok?", "info", "m", None)]}, "normalize logs.raw event: parse log timestamp"),
        ({"logs": [("", "info", "m", "{")]}, "normalize logs.raw event: decode log fields"),
    ],
)
def test_contract(spark, changes, error):
    assert raw_frame(spark, raw_event(**changes)).select(normalize.batch_error()).first()[0] == error


# --- alert rules


T0 = dt.datetime(2026, 7, 7, 12, 0, 0)


def log_rows(spark, *rows, tenant=1):
    """(seconds after T0, service, level, message, fields, size)"""
    data = [
        (T0 + dt.timedelta(seconds=s), tenant, service, "prod", "app", "", level, "", "fp", message,
         json.dumps(fields), f"i{i}", size)
        for i, (s, service, level, message, fields, size) in enumerate(rows)
    ]
    return spark.createDataFrame(
        data,
        "timestamp timestamp, tenant_id long, service string, environment string, source string, host string, "
        "level string, trace_id string, fingerprint string, message string, fields_json string, ingest_id string, raw_size_bytes long",
    )


def rule(spark, **changes):
    base = {
        "id": 1, "tenant_id": 1, "service_id": None, "service_name": None, "environment": None, "name": "r",
        "rule_type": "count_threshold", "severity": "high", "log_level": None, "fingerprint": None,
        "filter_json": None, "group_by": None, "window_seconds": 0, "threshold": "1", "cooldown_seconds": 0,
    }
    base.update(changes)
    schema = (
        "id long, tenant_id long, service_id long, service_name string, environment string, name string, "
        "rule_type string, severity string, log_level string, fingerprint string, filter_json string, group_by string, "
        "window_seconds int, threshold string, cooldown_seconds int"
    )
    names = [part.split()[0] for part in schema.split(", ")]
    return rules.compile_rules(spark.createDataFrame([tuple(base[n] for n in names)], schema))


def fired(spark, logs, **changes):
    found = rules.evaluate_newest(logs, rules.runnable(rule(spark, **changes)))
    return sorted((r["group_key"], r["match_count"], round(r["metric_value"], 9)) for r in found.collect())


def test_count_rule_by_field(spark):
    logs = log_rows(
        spark,
        (0, "a", "error", "m", {"region": "us-west-2"}, 1),
        (1, "a", "error", "m", {"region": "us-west-2"}, 1),
        (2, "a", "error", "m", {"region": "us-east-1"}, 1),
        (3, "a", "info", "m", {"region": "us-west-2"}, 1),
    )
    found = fired(spark, logs, log_level="ERROR", group_by='["field.region"]', threshold="2")
    assert found == [("field.region=us-west-2", 2, 0.0)]


def test_rate_rule_window_includes_both_ends(spark):
    logs = log_rows(spark, *[(s, "a", "error", "m", {}, 1) for s in (-61, -60, -30, 0)])
    found = fired(spark, logs, rule_type="rate_threshold", window_seconds=60, threshold="0.03")
    assert found == [("scope=all", 3, 0.05)]


def test_percentile_rule(spark):
    values = [100, "200", 300, 400, "not-a-number", None]
    logs = log_rows(spark, *[(i, "a", "info", "m", {"ms": v}, 1) for i, v in enumerate(values)])
    found = fired(
        spark, logs, rule_type="percentile_based", window_seconds=60, threshold="380.5",
        filter_json='{"value_field":"field.ms","percentile":95}',
    )
    assert found == [("scope=all", 4, 385.0)]


def test_raw_size_percentile(spark):
    logs = log_rows(spark, *[(i, "a", "info", "m", {}, v) for i, v in enumerate((100, 200, 300))])
    found = fired(
        spark, logs, rule_type="percentile_threshold", window_seconds=60, threshold="200",
        filter_json='{"value_field":"raw_size_bytes","percentile":50}',
    )
    assert found == [("scope=all", 3, 200.0)]


def test_pattern_rules(spark):
    logs = log_rows(
        spark,
        (0, "checkout", "error", "PANIC: x", {"region": "us-WEST-2"}, 1),
        (1, "checkout", "info", "fine", {"region": "us-west-1"}, 1),
        (2, "payments", "info", "fine", {}, 1),
    )
    assert fired(spark, logs, rule_type="pattern_match", filter_json='{"pattern":" panic "}') == [("scope=all", 1, 0.0)]
    found = fired(
        spark, logs, rule_type="pattern_match", threshold="2", group_by='["service"]',
        filter_json='{"pattern":"west","target":"field.region"}',
    )
    assert found == [("service=checkout", 2, 0.0)]
    # a missing field prints as <nil>
    found = fired(spark, logs, rule_type="pattern_match", filter_json='{"pattern":"<NIL>","target":"field.region"}')
    assert found == [("scope=all", 1, 0.0)]


def test_field_equals_and_scope(spark):
    logs = log_rows(
        spark,
        (0, "checkout", "error", "Upstream timeout", {"code": 7}, 1),
        (1, "checkout", "error", "upstream TIMEOUT", {"code": "8"}, 1),
        (2, "payments", "error", "upstream timeout", {"code": 7}, 1),
    )
    found = fired(
        spark, logs, service_id=4, service_name="checkout", environment="prod",
        filter_json='{"service":"ignored","message_contains":" Timeout ","field_equals":{"code":"7"}}',
    )
    assert found == [("scope=all", 1, 0.0)]


@pytest.mark.parametrize(
    "changes, error",
    [
        ({}, None),
        ({"rule_type": "rate_threshold"}, "rate_threshold rules require positive window_seconds"),
        ({"rule_type": "ratio"}, 'unsupported rule_type "ratio"'),
        ({"rule_type": "pattern_match"}, "pattern_match rules require filter_json.pattern"),
        ({"threshold": "0"}, "parse threshold: threshold must be positive"),
        ({"threshold": "20.5"}, "parse threshold: not an integer"),
        ({"rule_type": "rate_based", "window_seconds": 9, "threshold": "NaN"},
         "parse threshold: threshold must be a finite non-negative number"),
        ({"rule_type": "percentile_based", "window_seconds": 9},
         "percentile_threshold rules require filter_json.value_field as raw_size_bytes or field.<name>"),
        ({"rule_type": "percentile_based", "window_seconds": 9,
          "filter_json": '{"value_field":"field.x","percentile":100}'},
         "percentile_threshold rules require filter_json.percentile between 0 and 100"),
        ({"filter_json": "{"}, "parse filter_json"),
    ],
)
def test_rule_checks(spark, changes, error):
    assert rule(spark, **changes).select("rule_error").first()[0] == error


def test_tenants_are_isolated(spark):
    logs = log_rows(spark, (0, "a", "error", "m", {}, 1), tenant=2)
    assert fired(spark, logs) == []


def test_scheduled_evaluation_is_half_open(spark):
    logs = log_rows(spark, *[(s, "a", "error", "m", {}, 1) for s in (-301, -300, -1, 0)])
    ready = rules.runnable(rule(spark, window_seconds=300, threshold="2"))
    found = rules.evaluate_at(logs, ready, T0).collect()
    assert [(r["group_key"], r["match_count"]) for r in found] == [("scope=all", 2)]


# --- lifecycle


def step(spark, instances, triggers, ran=((1, 600),), now=T0):
    schema = "rule_id long, dedupe_key string, status string, first_fired_at timestamp, last_fired_at timestamp, resolved_at timestamp"
    found = lifecycle.reconcile(
        spark.createDataFrame(triggers, "rule_id long, group_key string, match_count long, metric_value double"),
        spark.createDataFrame(instances, schema),
        spark.createDataFrame(list(ran), "rule_id long, cooldown_seconds long"),
        now,
    )
    return [(r["status"], r["event_type"], r["last_fired_at"], r["resolved_at"]) for r in found.collect()]


EARLIER = T0 - dt.timedelta(seconds=300)
LONG_AGO = T0 - dt.timedelta(seconds=900)


@pytest.mark.parametrize(
    "instance, is_fired, ran, expected",
    [
        (None, True, ((1, 600),), ("firing", "triggered", T0, None)),
        (("firing", LONG_AGO, None), True, ((1, 600),), ("firing", "suppressed", LONG_AGO, None)),
        (("firing", EARLIER, None), False, ((1, 600),), ("resolved", "resolved", EARLIER, T0)),
        (("firing", EARLIER, None), False, (), ("firing", None, EARLIER, None)),
        (("resolved", LONG_AGO, EARLIER), True, ((1, 600),), ("firing", "triggered", T0, None)),
        (("resolved", EARLIER, EARLIER), True, ((1, 600),), ("firing", "suppressed", T0, None)),
        (("resolved", EARLIER, EARLIER), True, ((1, 0),), ("firing", "triggered", T0, None)),
        (("resolved", EARLIER, EARLIER), False, ((1, 600),), ("resolved", None, EARLIER, EARLIER)),
    ],
)
def test_one_step(spark, instance, is_fired, ran, expected):
    instances = [] if instance is None else [(1, "k", instance[0], instance[1], instance[1], instance[2])]
    triggers = [(1, "k", 5, 0.0)] if is_fired else []
    assert step(spark, instances, triggers, ran) == [expected]


def test_fold_equals_repeated_steps(spark):
    """The window fold over many ticks against a plain loop over the table above."""
    import random

    rng = random.Random(11)
    ticks, cooldowns = 40, [0, 60, 120, 300, 600]
    history = {(r, f"k{k}"): [rng.random() < 0.5 for _ in range(ticks)] for r in range(len(cooldowns)) for k in range(6)}
    start = dt.datetime(2026, 1, 1)
    when = [start + dt.timedelta(seconds=60 * i) for i in range(ticks)]
    expected = []
    for (r, key), run in history.items():
        status, last = None, None
        for tick, on in zip(when, run, strict=True):
            if on and status != "firing":
                cooling = status == "resolved" and cooldowns[r] > 0 and (tick - last).total_seconds() < cooldowns[r]
                expected.append((r, key, tick, "suppressed" if cooling else "triggered"))
                status, last = "firing", tick
            elif on:
                expected.append((r, key, tick, "suppressed"))
            elif status == "firing":
                expected.append((r, key, tick, "resolved"))
                status = "resolved"
    triggers = spark.createDataFrame(
        [(r, k, t, 1, 0.0) for (r, k), run in history.items() for t, on in zip(when, run, strict=True) if on],
        "rule_id long, group_key string, tick timestamp, match_count long, metric_value double",
    )
    facts = spark.createDataFrame(
        [(r, c, "n", "high", "count", 1.0, 60, None, None, 1) for r, c in enumerate(cooldowns)],
        "rule_id long, cooldown_seconds long, rule_name string, severity string, kind string, threshold double, "
        "window_seconds long, percentile double, value_field string, tenant_id long",
    )
    found = lifecycle.lifecycle(triggers, facts, when[0], when[-1], 60)
    assert sorted((x["rule_id"], x["dedupe_key"], x["tick"], x["event_type"]) for x in found.collect()) == sorted(expected)


# --- service graph


def graph_frame(spark, *rows):
    data = [
        (T0 + dt.timedelta(seconds=i), service, level, trace, json.dumps(fields), "i", i)
        for i, (service, level, trace, fields) in enumerate(rows)
    ]
    return spark.createDataFrame(
        data,
        "timestamp timestamp, service string, level string, trace_id string, fields_json string, ingest_id string, event_id long",
    )


def test_graph(spark):
    rows = graph_frame(
        spark,
        ("gateway", "error", "t", {"session_id": "s", "downstream_service": "Checkout"}),
        ("checkout", "ERROR", "t", {"session-id": "s", "user_id": "u"}),
        ("payments", "info", "t2", {"SessionID": "s"}),
    )
    nodes = {r["service"]: tuple(r)[1:] for r in graph.service_nodes(rows).collect()}
    assert nodes == {"gateway": (1, 1, 1), "checkout": (1, 1, 1), "payments": (1, 0, 1)}
    edges = {(r["source"], r["target"]): tuple(r)[2:] for r in graph.service_edges(rows).collect()}
    assert edges == {("gateway", "checkout"): (1, 1, 1), ("checkout", "payments"): (1, 0, 0)}
    session = graph.flow_sessions(rows).first()
    assert (session["kind"], session["id"], session["user_id"], session["log_count"]) == ("session", "s", "u", 3)
    assert session["services"] == ["checkout", "gateway", "payments"]
    assert graph.session_page(rows).first()["trace_ids"] == ["t", "t2"]


def test_flow_fallbacks(spark):
    rows = graph_frame(
        spark,
        ("a", "info", "", {"request_id": "r"}),
        ("b", "info", "", {"Request-ID": " r "}),
        ("c", "info", "", {"userid": "u"}),
        ("d", "info", "tr", {"user_id": "u"}),
        ("e", "info", "", {}),
    )
    found = sorted((r["flow_kind"], r["flow_id"]) for r in graph.flow_rows(rows).collect() if r["flow_id"])
    assert found == [("request", "r"), ("request", "r"), ("trace", "tr"), ("user", "u")]
    assert {r["service"] for r in graph.service_nodes(rows).collect()} == set("abcde")


def test_named_only_service_is_a_node_without_logs(spark):
    rows = graph_frame(spark, ("a", "info", "t", {"peer_service": "ledger", "caller_service": "edge"}))
    nodes = {r["service"]: tuple(r)[1:] for r in graph.service_nodes(rows).collect()}
    assert nodes == {"a": (1, 0, 1), "ledger": (0, 0, 1), "edge": (0, 0, 1)}


def test_truncation(spark):
    rows = graph_frame(spark, ("a", "info", "", {}), ("b", "info", "", {}))
    assert tuple(graph.truncation(rows, 1).first()) == (1, True)
    assert tuple(graph.truncation(rows, 2).first()) == (2, False)
    assert [(r["service"], r["truncated"]) for r in graph.capped(rows, 1).collect()] == [("a", True)]


# --- retrieval: an incident with two unrelated traces


def incident(spark):
    chain = [
        ("catalog", "info", "slow query"), ("payments-db", "error", "database connection pool exhausted"),
        ("payments", "error", "timeout"), ("checkout", "error", "payment failed"), ("gateway", "fatal", "502"),
    ]
    data = []
    for trace, offset in (("X", 0), ("X-healthy", -100), ("noise", -50)):
        for i, (service, level, message) in enumerate(chain):
            if trace == "X" or "pool" not in message:
                data.append((T0 + dt.timedelta(seconds=offset + i), 1, service, level, trace, message, "{}", f"{trace}{i}"))
    frame = spark.createDataFrame(
        data, "timestamp timestamp, tenant_id long, service string, level string, trace_id string, message string, fields_json string, ingest_id string"
    )
    return frame.withColumn("message_template", templates.message_template(F.col("message"))).withColumn(
        "template_id", templates.template_id(F.col("message_template"))
    )


def test_incident_trace(spark):
    logs = incident(spark)
    catalog = retrieval.template_catalog(logs)
    near = F.col("message_template").contains("pool")
    embedder = F.when(near, F.array(F.lit(1.0), F.lit(0.1))).otherwise(F.array(F.lit(0.1), F.lit(1.0)))
    vectors_table = retrieval.embed(catalog, embedder, 2, "m")
    best = retrieval.hybrid_search(vectors_table, 1, "m", 2, [1.0, 0.0], "pool exhausted", k=1)
    assert best.first()["message_template"] == "database connection pool exhausted"
    found = retrieval.incident_trace(logs, 1, best).collect()
    assert {r["trace_id"] for r in found} == {"X"} and len(found) == 5
    assert [r["timestamp"] for r in found] == sorted(r["timestamp"] for r in found)
    document = retrieval.evidence_document(retrieval.incident_trace(logs, 1, best)).first()
    assert document["log_count"] == 5 and len(json.loads(document["evidence"])) == 5 and document["answer"] is None
    nothing = retrieval.evidence_document(retrieval.incident_trace(logs, 2, best)).first()
    assert nothing["answer"] == "No supporting incident logs were found."


# --- request checks


DAY = ("2026-07-01T00:00:00Z", "2026-07-02T00:00:00Z")


@pytest.mark.parametrize(
    "build, message",
    [
        (lambda: search.log_query(1, *DAY[::-1]), "start must be before end"),
        (lambda: search.log_query(1, "", DAY[1]), "start is required"),
        (lambda: search.log_query(1, "x", DAY[1]), "start must be a valid RFC3339 timestamp"),
        (lambda: search.log_query(1, "2026-06-01T00:00:00Z", DAY[1]), "time range cannot exceed 7 days"),
        (lambda: search.log_query(1, *DAY, service="a b"), "service contains unsupported characters"),
        (lambda: search.log_query(1, *DAY, limit=-1), "limit must be a positive integer"),
        (lambda: search.log_query(1, *DAY, offset=10_001), "offset exceeds maximum"),
        (lambda: analytics.analytics_query(1, *DAY, "sum"), "aggregation must be one of count, rate, or percentile"),
        (lambda: analytics.analytics_query(1, *DAY, "rate"), "rate aggregation requires a bucket"),
        (lambda: analytics.analytics_query(1, *DAY, "count", top_k=5), "top_k requires at least one group_by field"),
        (lambda: analytics.analytics_query(1, *DAY, "count", top_k=5, group_by="level", bucket="day"),
         "top_k does not support time bucketing"),
        (lambda: analytics.analytics_query(1, *DAY, "count", group_by="host"), "group_by contains unsupported field"),
        (lambda: analytics.analytics_query(1, *DAY, "count", group_by="service,env,level,error_code"),
         "group_by cannot contain more than 3 fields"),
        (lambda: analytics.analytics_query(1, *DAY, "percentile"), "percentile is required for percentile aggregation"),
        (lambda: analytics.analytics_query(1, *DAY, "percentile", percentile=100),
         "percentile must be a number between 0 and 100"),
        (lambda: analytics.analytics_query(1, *DAY, "percentile", percentile=5, value_field="x"),
         "value_field must be raw_size_bytes or field.<name>"),
        (lambda: analytics.analytics_query(1, "2026-07-01T00:00:00Z", "2026-07-05T00:00:00Z", "count", bucket="minute"),
         "bucketed query would produce too many time buckets"),
        (lambda: graph.graph_identifier("x" * 257, "user_id"), "user_id cannot exceed 256 characters"),
        (lambda: graph.graph_identifier("a\x01", "user_id"), "user_id contains unsupported characters"),
        (lambda: run_query(None, 1, '{"type":"x"}'), "type must be logs or analytics"),
        (lambda: run_query(None, 1, '{"type":"logs","other":1}'), "invalid query DSL"),
        (lambda: run_query(None, 1, "{"), "invalid query DSL"),
        (lambda: batches.replay(None, "sequence", 0), "replay mode sequence requires a positive sequence"),
        (lambda: batches.replay(None, "time", since="x"), "replay mode time requires an RFC3339 time"),
        (lambda: batches.replay(None, "odd"), "unsupported replay mode 'odd'"),
    ],
)
def test_request_errors(build, message):
    with pytest.raises(RequestError) as found:
        build()
    assert str(found.value) == message


def test_bounds_clamp_and_page():
    query = search.log_query(1, *DAY, limit=5000, offset=9000)
    assert query.limit == 1000
    assert search.next_offset(1000, query) == 10_000
    assert search.next_offset(999, query) is None
    assert DEFAULT.top_k_max == analytics.analytics_query(1, *DAY, "count", top_k=500, group_by="env").top_k


def test_rule_authoring(spark):
    names = ["rule_id", "tenant_id", "seq", "action", *authoring.FIELDS]
    schema = ", ".join(
        f"{n} {'long' if n in ('rule_id', 'tenant_id', 'seq') else 'int' if n.endswith('seconds') else 'string'}"
        for n in names
    )
    new = {"service": "a", "environment": "prod", "name": " n ", "rule_type": "count_threshold", "severity": "high",
           "window_seconds": 60, "threshold": "1", "cooldown_seconds": 0}
    changes = [
        {"rule_id": 1, "seq": 1, "action": "create", **new},
        {"rule_id": 1, "seq": 2, "action": "patch", "threshold": " 7 ", "status": "Disabled"},
        {"rule_id": 1, "seq": 3, "action": "patch", "window_seconds": -1, "name": "refused"},
        {"rule_id": 2, "seq": 4, "action": "create", **new},
        {"rule_id": 2, "seq": 5, "action": "delete"},
        {"rule_id": 3, "seq": 6, "action": "create", **{**new, "service": "a b"}},
        {"rule_id": 4, "seq": 7, "action": "patch", "name": "no such rule"},
        {"rule_id": 5, "seq": 8, "action": "create", **new},
        {"rule_id": 5, "seq": 9, "action": "patch", "cooldown_seconds": 0},
    ]
    frame = spark.createDataFrame([tuple({"tenant_id": 1, **c}.get(n) for n in names) for c in changes], schema)
    found = {r["rule_id"]: r for r in authoring.current_rules(frame).collect()}
    assert set(found) == {1, 5}
    assert (found[1]["threshold"], found[1]["status"], found[1]["name"]) == ("7", "disabled", "n")
    assert found[1]["cooldown_seconds"] == 600 and found[5]["cooldown_seconds"] == 0
    assert found[1]["window_seconds"] == 60
