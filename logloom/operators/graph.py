"""Service dependency graph and correlated flows, derived from log rows.

A flow is the set of rows sharing a session, request, trace or user id. Flows
may be as large as a third of the table, so per-flow work is either a partial
aggregate or a time-sliced window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.jsonfields import field_text, loose_keys, loose_lookup, text_map
from logloom.functions.text import canon_tag, is_error
from logloom.limits import DEFAULT, Limits, RequestError
from logloom.operators.binding import bind
from logloom.operators.search import check_range, in_scope, oldest_first, positive, safe_filter
from logloom.operators.skew import with_previous

# fixed values: field spellings
SESSION_KEYS = ["session_id", "sessionid", "session-id"]
REQUEST_KEYS = ["request_id", "requestid", "request-id", "correlation_id"]
USER_KEYS = ["user_id", "userid", "user-id"]
UPSTREAM_KEYS = ["upstream_service", "upstream.service", "caller_service"]
DOWNSTREAM_KEYS = ["downstream_service", "downstream.service", "peer_service", "target_service"]

FLOW = ["flow_kind", "flow_id"]


def graph_identifier(value: str | None, name: str, limits: Limits = DEFAULT) -> str:
    value = (value or "").strip()
    if len(value.encode()) > limits.identifier_chars:
        raise RequestError(f"{name} cannot exceed {limits.identifier_chars} characters")
    if any(ord(c) < 0x20 or ord(c) == 0x7F for c in value):
        raise RequestError(f"{name} contains unsupported characters")
    return value


def graph_rows(
    logs: DataFrame,
    tenant_id: int,
    start,
    end,
    trace_id: str = "",
    session_id: str = "",
    user_id: str = "",
    limits: Limits = DEFAULT,
) -> DataFrame:
    """Rows the graph is built from; no row cap, Spark does not need one."""
    first, last = check_range(start, end, limits.graph_window, "24 hours")
    trace_id = safe_filter(trace_id, "trace_id")
    rows = in_scope(logs, tenant_id, first, last)
    if trace_id:
        rows = rows.filter(F.col("trace_id") == trace_id)
    for name, value in (("session_id", session_id), ("user_id", user_id)):
        wanted = graph_identifier(value, name, limits)
        if wanted:
            rows = rows.filter(field_text("fields_json", name) == wanted)
    ties = [c for c in ("event_id", "fingerprint") if c in logs.columns]
    return rows.select("timestamp", "service", "level", "trace_id", "fields_json", "ingest_id", *ties)


def capped(rows: DataFrame, limit=None, limits: Limits = DEFAULT) -> DataFrame:
    """The oldest `limit` rows, each with a `truncated` flag saying whether more exist.

    The windows run over at most limit + 1 rows.
    """
    top = positive(limit, limits.graph_rows, limits.graph_rows_max, "limit")
    if top is None:
        return rows.withColumn("truncated", F.lit(False))
    probe = rows.orderBy(*oldest_first(rows)).limit(top + 1).withColumn("_one", F.lit(1))
    whole = Window.partitionBy("_one")
    return (
        probe.withColumn("_rank", F.row_number().over(whole.orderBy(*oldest_first(rows))))
        .withColumn("truncated", F.count("*").over(whole) > top)
        .filter(F.col("_rank") <= top)
        .drop("_one", "_rank")
    )


def truncation(rows: DataFrame, limit=None, limits: Limits = DEFAULT) -> DataFrame:
    """record_count and truncated for a capped read."""
    top = positive(limit, limits.graph_rows, limits.graph_rows_max, "limit")
    if top is None:
        return rows.agg(F.count("*").alias("record_count"), F.lit(False).alias("truncated"))
    probe = rows.select("timestamp").limit(top + 1)
    return probe.agg(
        F.least(F.count("*"), F.lit(top)).alias("record_count"),
        (F.count("*") > top).alias("truncated"),
    )


def flow_identity(fields: Column, loose: Column, trace_id: Column) -> tuple[Column, Column]:
    """(kind, id): session, else request, else trace, else user, else NULL."""
    candidates = [
        ("session", loose_lookup(fields, loose, SESSION_KEYS)),
        ("request", loose_lookup(fields, loose, REQUEST_KEYS)),
        ("trace", F.coalesce(trace_id, F.lit(""))),
        ("user", loose_lookup(fields, loose, USER_KEYS)),
    ]
    kinds = F.coalesce(*[F.when(value != "", F.lit(kind)) for kind, value in candidates])
    ids = F.coalesce(*[F.nullif(value, F.lit("")) for _, value in candidates])
    return kinds, ids


def flow_rows(rows: DataFrame) -> DataFrame:
    """Rows with non-blank service, plus flow identity, error flag and named neighbours."""
    named = rows.withColumn("service", canon_tag("service")).filter(F.col("service") != "")
    parsed = bind(named, "_fields", text_map("fields_json"))
    parsed = bind(parsed, "_loose", loose_keys(F.col("_fields"), "_-."))
    fields, loose = F.col("_fields"), F.col("_loose")
    kind, ident = flow_identity(fields, loose, F.col("trace_id"))
    found = F.struct(
        kind.alias("kind"),
        ident.alias("id"),
        loose_lookup(fields, loose, USER_KEYS).alias("user"),
        canon_tag(loose_lookup(fields, loose, UPSTREAM_KEYS)).alias("up"),
        canon_tag(loose_lookup(fields, loose, DOWNSTREAM_KEYS)).alias("down"),
    )
    ties = [c for c in ("ingest_id", "event_id", "fingerprint") if c in rows.columns]
    return bind(parsed, "_found", found).select(
        "timestamp",
        "service",
        "trace_id",
        is_error("level").alias("is_error"),
        F.col("_found.kind").alias("flow_kind"),
        F.col("_found.id").alias("flow_id"),
        F.col("_found.user").alias("user_id"),
        F.col("_found.up").alias("upstream"),
        F.col("_found.down").alias("downstream"),
        *ties,
    )


def _ties(flows: DataFrame) -> list[str]:
    return [c for c in ("ingest_id", "event_id", "fingerprint") if c in flows.columns]


def flow_edges(flows: DataFrame) -> DataFrame:
    """One row per (flow, source, target) with error and propagation flags.

    Named and inferred edges come out of one pass over the rows.
    """
    members = flows.filter(F.col("flow_id").isNotNull())
    slim = members.select(
        *FLOW, "timestamp", "service", "is_error", "upstream", "downstream", *_ties(members)
    )
    steps = with_previous(slim, FLOW, "timestamp", _ties(members), ["service", "is_error"])

    def edge(source: str, target: str, propagated: Column) -> Column:
        ends = [F.col(source).alias("source"), F.col(target).alias("target")]
        return F.struct(*ends, propagated.alias("propagated"))

    passed_on = F.coalesce(F.col("prev_is_error") & F.col("is_error"), F.lit(False))
    edges = F.array(
        edge("upstream", "service", F.lit(False)),
        edge("service", "downstream", F.lit(False)),
        edge("prev_service", "service", passed_on),
    )
    real = F.filter(
        edges,
        lambda e: (e["source"] != "") & (e["target"] != "") & (e["source"] != e["target"]),
    )
    return (
        steps.select(*FLOW, F.col("is_error").alias("error"), F.explode(real).alias("_e"))
        .groupBy(*FLOW, F.col("_e.source").alias("source"), F.col("_e.target").alias("target"))
        .agg(F.bool_or("error").alias("error"), F.bool_or("_e.propagated").alias("propagated"))
    )


def service_edges(rows: DataFrame) -> DataFrame:
    return (
        flow_edges(flow_rows(rows))
        .groupBy("source", "target")
        .agg(
            F.count("*").alias("flow_count"),
            F.count_if("error").alias("error_flow_count"),
            F.count_if("propagated").alias("propagated_error_count"),
        )
        .orderBy("source", "target")
    )


def flow_parts(flows: DataFrame) -> DataFrame:
    """Rows reduced to (flow, trace, service, neighbours): the one pass that nodes and
    sessions are derived from. A large flow is spread over its traces and services."""
    order = F.struct("timestamp", *_ties(flows), "user_id")
    return flows.groupBy(*FLOW, "trace_id", "service", "upstream", "downstream").agg(
        F.count("*").alias("logs"),
        F.count_if("is_error").alias("errors"),
        F.min("timestamp").alias("first_at"),
        F.max("timestamp").alias("last_at"),
        F.min(F.when(F.col("user_id") != "", order)).alias("first_user"),
    )


def flow_services(parts: DataFrame) -> DataFrame:
    """Distinct (flow, service), with services only named as neighbours."""
    members = parts.filter(F.col("flow_id").isNotNull())
    names = F.array("service", "upstream", "downstream")
    return (
        members.select(*FLOW, F.explode(F.array_distinct(names)).alias("service"))
        .filter(F.col("service") != "")
        .distinct()
    )


def service_nodes(rows: DataFrame) -> DataFrame:
    """log_count and error_count per service, and the flows it was seen in."""
    parts = flow_parts(flow_rows(rows))
    seen = parts.groupBy("service").agg(
        F.sum("logs").alias("log_count"), F.sum("errors").alias("error_count")
    )
    in_flows = flow_services(parts).groupBy("service").agg(F.count("*").alias("flow_count"))
    return (
        seen.join(in_flows, "service", "full")
        .select(
            "service",
            F.coalesce("log_count", F.lit(0)).alias("log_count"),
            F.coalesce("error_count", F.lit(0)).alias("error_count"),
            F.coalesce("flow_count", F.lit(0)).alias("flow_count"),
        )
        .orderBy("service")
    )


def flow_sessions(rows: DataFrame) -> DataFrame:
    """One row per flow. Traces are counted here and listed by `flow_traces`,
    because a flow may hold any number of them; services are few by nature."""
    parts = flow_parts(flow_rows(rows)).filter(F.col("flow_id").isNotNull())
    base = parts.groupBy(*FLOW).agg(
        F.min("first_at").alias("started_at"),
        F.max("last_at").alias("ended_at"),
        F.sum("logs").alias("log_count"),
        F.sum("errors").alias("error_count"),
        F.min("first_user").alias("_user"),
    )
    services = flow_services(parts).groupBy(*FLOW).agg(
        F.array_sort(F.collect_set("service")).alias("services")
    )
    traces = parts.filter("trace_id <> ''").select(*FLOW, "trace_id").distinct()
    counted = traces.groupBy(*FLOW).agg(F.count("*").alias("trace_count"))
    return (
        base.join(services, FLOW, "left")
        .join(counted, FLOW, "left")
        .select(
            F.col("flow_id").alias("id"),
            F.col("flow_kind").alias("kind"),
            F.coalesce(F.col("_user.user_id"), F.lit("")).alias("user_id"),
            F.coalesce("trace_count", F.lit(0)).alias("trace_count"),
            "services",
            "started_at",
            "ended_at",
            "log_count",
            "error_count",
        )
    )


def flow_traces(rows: DataFrame) -> DataFrame:
    """Distinct non-blank (flow, trace_id), one row each."""
    members = flow_rows(rows).filter(F.col("flow_id").isNotNull() & (F.col("trace_id") != ""))
    return members.select(*FLOW, "trace_id").distinct()


def session_page(rows: DataFrame, limit: int = 100) -> DataFrame:
    """The newest flows with their trace ids as a sorted list, like a response page."""
    page = flow_sessions(rows).orderBy(F.desc("started_at"), "id", "kind").limit(limit)
    wanted = page.select(F.col("kind").alias("flow_kind"), F.col("id").alias("flow_id"))
    lists = (
        flow_traces(rows)
        .join(F.broadcast(wanted), FLOW, "left_semi")  # at most `limit` rows
        .groupBy(*FLOW)
        .agg(F.array_sort(F.collect_set("trace_id")).alias("trace_ids"))
        .select(F.col("flow_kind").alias("kind"), F.col("flow_id").alias("id"), "trace_ids")
    )
    empty = F.array().cast("array<string>")
    return (
        page.join(lists, ["kind", "id"], "left")
        .withColumn("trace_ids", F.coalesce("trace_ids", empty))
        .orderBy(F.desc("started_at"), "id", "kind")
    )
