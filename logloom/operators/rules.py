"""Alert rules: load, check, match against logs, evaluate over event-time windows.

All rules are evaluated in one plan. Logs meet the rule table in a lookup join on
the tenant, matches are reduced to counts per (rule, group, value) before any
further step, and no step orders or collects a group's raw rows.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.jsonfields import NUMERIC, numeric_text, text_map
from logloom.functions.text import contains_ignore_case, trim_all
from logloom.functions.timefns import as_datetime, instant, plus_seconds
from logloom.operators.binding import bind
from logloom.operators.quantiles import quantile_of_counts
from logloom.operators.search import in_scope, newest_first
from logloom.operators.skew import lookup_join
from logloom.session import cut_lineage

FILTER_SCHEMA = (
    "service string, environment string, level string, fingerprint string, source string, "
    "host string, trace_id string, message_contains string, pattern string, target string, "
    "field_equals map<string,string>, value_field string, percentile double"
)
# fixed values: rule types
KINDS = {
    "count_threshold": "count",
    "pattern_match": "pattern",
    "rate_threshold": "rate",
    "rate_based": "rate",
    "percentile_threshold": "percentile",
    "percentile_based": "percentile",
}
MISSING = "<nil>"
FEW_TENANTS = 200  # so many tenants are named in a filter, more are left to the join


def active_rules(rules: DataFrame, services: DataFrame) -> DataFrame:
    """Active rules with the name, environment and owner of their service."""
    named = services.select(
        F.col("id").alias("service_id"),
        F.col("name").alias("service_name"),
        "environment",
        "owner",
    )
    return rules.filter(F.col("status") == "active").join(named, "service_id", "left")


def rules_for_scope(rules: DataFrame, services: DataFrame, tenant_id: int, service: str, env: str) -> DataFrame:
    """Active rules that apply to one tenant, service and environment."""
    loaded = active_rules(rules, services).filter(F.col("tenant_id") == tenant_id)
    named = (F.col("service_name") == service) & (F.col("environment") == env)
    return loaded.filter(F.col("service_id").isNull() | named).orderBy("id")


def _given(*values: Column) -> Column:
    """First value that is not blank, else ''."""
    return F.coalesce(*[F.when(trim_all(v) != "", v) for v in values], F.lit(""))


def compile_rules(rules: DataFrame) -> DataFrame:
    """Typed rules: explicit scope columns override the filter document, and
    `rule_error` says why a rule cannot run (NULL if it can)."""
    for name in ("fingerprint", "log_level", "filter_json", "group_by", "environment", "service_name"):
        if name not in rules.columns:
            rules = rules.withColumn(name, F.lit(None).cast("string"))
    has_filter = F.coalesce(F.col("filter_json"), F.lit("")) != ""
    has_groups = F.coalesce(F.col("group_by"), F.lit("")) != ""
    threshold = trim_all(F.col("threshold").cast("string"))
    parsed = (
        rules.withColumn("_f", F.from_json("filter_json", FILTER_SCHEMA))
        .withColumn("_groups", F.from_json("group_by", "array<string>"))
        .withColumn("_type", F.lower(trim_all("rule_type")))
        .withColumn("_whole", F.when(threshold.rlike(r"\A[+-]?\d+\z"), threshold.try_cast("bigint")))
        .withColumn("_number", F.when(threshold.rlike(NUMERIC), threshold.try_cast("double")))
    )
    f = F.col("_f")
    kind = F.coalesce(*[F.when(F.col("_type") == name, kind) for name, kind in KINDS.items()])
    value_field = trim_all(F.coalesce(f["value_field"], F.lit("")))
    pattern = trim_all(F.coalesce(f["pattern"], F.lit("")))
    counted = kind.isin("count", "pattern")
    bad_json = has_filter & F.try_parse_json("filter_json").isNull()
    bad_groups = has_groups & F.col("_groups").isNull() & (trim_all("group_by") != "null")
    # fixed values: texts of rule complaints, which callers match on
    error = F.coalesce(
        F.when(bad_json, "parse filter_json"),
        F.when(bad_groups, "parse group_by"),
        F.when(kind.isNull(), F.concat(F.lit('unsupported rule_type "'), F.col("rule_type"), F.lit('"'))),
        F.when(counted & F.col("_whole").isNull(), "parse threshold: not an integer"),
        F.when(counted & (F.col("_whole") <= 0), "parse threshold: threshold must be positive"),
        F.when(
            ~counted & (F.col("_number").isNull() | (F.col("_number") < 0) | (F.col("_number") == float("inf"))),
            "parse threshold: threshold must be a finite non-negative number",
        ),
        F.when(
            ~counted & (F.col("window_seconds") <= 0),
            F.concat(kind, F.lit("_threshold rules require positive window_seconds")),
        ),
        F.when((kind == "pattern") & (pattern == ""), "pattern_match rules require filter_json.pattern"),
        F.when(
            (kind == "percentile")
            & (value_field != "raw_size_bytes")
            & ~value_field.startswith("field."),
            "percentile_threshold rules require filter_json.value_field as raw_size_bytes or field.<name>",
        ),
        F.when(
            (kind == "percentile")
            & ~((F.coalesce(f["percentile"], F.lit(0.0)) > 0) & (F.coalesce(f["percentile"], F.lit(0.0)) < 100)),
            "percentile_threshold rules require filter_json.percentile between 0 and 100",
        ),
    )
    scoped = F.col("service_id").isNotNull()
    none = F.array().cast("array<string>")
    return parsed.select(
        F.col("id").alias("rule_id"),
        "tenant_id",
        F.col("name").alias("rule_name"),
        "rule_type",
        "severity",
        kind.alias("kind"),
        F.when(scoped, F.coalesce("service_name", F.lit(""))).alias("scope_service"),
        F.when(scoped, F.coalesce("environment", F.lit(""))).alias("scope_environment"),
        trim_all(_given(F.col("service_name"), f["service"])).alias("f_service"),
        trim_all(_given(F.col("environment"), f["environment"])).alias("f_environment"),
        F.lower(trim_all(_given(F.col("log_level"), f["level"]))).alias("f_level"),
        trim_all(_given(F.col("fingerprint"), f["fingerprint"])).alias("f_fingerprint"),
        F.lower(trim_all(_given(f["source"]))).alias("f_source"),
        trim_all(_given(f["host"])).alias("f_host"),
        trim_all(_given(f["trace_id"])).alias("f_trace_id"),
        trim_all(_given(f["message_contains"])).alias("f_message_contains"),
        pattern.alias("f_pattern"),
        trim_all(F.coalesce(f["target"], F.lit(""))).alias("f_target"),
        F.coalesce(f["field_equals"], F.create_map().cast("map<string,string>")).alias("f_field_equals"),
        F.when(kind == "percentile", value_field).alias("value_field"),
        F.when(kind == "percentile", f["percentile"]).alias("percentile"),
        F.coalesce("_groups", none).alias("group_fields"),
        F.col("window_seconds").cast("bigint").alias("window_seconds"),
        F.coalesce("_number", F.col("_whole").cast("double")).alias("threshold"),
        F.col("cooldown_seconds").cast("bigint").alias("cooldown_seconds"),
        error.alias("rule_error"),
    )


def runnable(compiled: DataFrame) -> DataFrame:
    return compiled.filter(F.col("rule_error").isNull()).drop("rule_error")


def load_rules(rules: DataFrame, services: DataFrame) -> DataFrame:
    """Active rules that can run, compiled and stored once, so that the plans that
    use them (several times each) start from a small table."""
    return cut_lineage(runnable(compile_rules(active_rules(rules, services))))


def target_value(target: Column, row: str, fields: Column) -> Column:
    """Value of a log row by target name; a missing field prints as `<nil>`."""
    name = trim_all(target)
    value = F.when(name.isin("", "message"), F.col(f"{row}message"))
    for column in ("service", "environment", "source", "host", "level", "trace_id", "fingerprint"):
        value = value.when(name == column, F.col(f"{row}{column}"))
    return value.when(
        name.startswith("field."), field_or_missing(fields, F.substring(name, F.lit(7), F.length(name)))
    ).otherwise(F.lit(""))


def field_or_missing(fields: Column, key: Column) -> Column:
    return F.coalesce(trim_all(F.try_element_at(fields, key)), F.lit(MISSING))


def group_key(group_fields: Column, row: str, fields: Column) -> Column:
    """`f1=v1|f2=v2` in rule order, `scope=all` without group fields."""
    parts = F.transform(
        group_fields, lambda g: F.concat(g, F.lit("="), target_value(g, row, fields))
    )
    return F.when(F.size(group_fields) == 0, "scope=all").otherwise(F.array_join(parts, "|"))


def scope_condition() -> Column:
    """A rule applies to every service of its tenant, or to its own service."""
    return F.col("r.scope_service").isNull() | (
        (F.col("l.service") == F.col("r.scope_service"))
        & (F.col("l.environment") == F.col("r.scope_environment"))
    )


def filter_condition() -> Column:
    """All filter predicates of a rule against a log row (aliases l and r)."""
    test = F.lit(True)
    for name in ("service", "environment", "level", "fingerprint", "source", "host", "trace_id"):
        wanted = F.col(f"r.f_{name}")
        test = test & ((wanted == "") | (F.col(f"l.{name}") == wanted))
    needle = F.col("r.f_message_contains")
    test = test & ((needle == "") | contains_ignore_case(F.col("l.message"), needle))
    wanted = F.map_entries(F.col("r.f_field_equals"))
    same = F.forall(
        wanted,
        lambda e: field_or_missing(F.col("l.fields"), e["key"]) == trim_all(e["value"]),
    )
    test = test & same
    target = target_value(F.col("r.f_target"), "l.", F.col("l.fields"))
    pattern = (F.col("r.kind") != "pattern") | contains_ignore_case(target, F.col("r.f_pattern"))
    return test & pattern


LOG_SIDE = [
    "timestamp", "tenant_id", "service", "environment", "source", "host", "level",
    "trace_id", "fingerprint", "message", "raw_size_bytes",
]


def rule_rows(logs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The log columns rules can look at, with fields parsed once."""
    present = [c if c in logs.columns else F.lit("").alias(c) for c in LOG_SIDE]
    extra = [c for c in logs.columns if c in ("event_date", "ingest_id", *(carry or []))]
    return logs.select(*present, *extra, text_map("fields_json").alias("fields"))


def _index_key(number: int, *parts: Column) -> Column:
    """Key of an index entry: tenant and the values a rule asks for, told apart by the entry's kind."""
    tenant = F.col("tenant_id").cast("bigint")
    return F.xxhash64(F.lit(number), tenant, *[F.coalesce(p, F.lit("")) for p in parts])


# columns of an index entry, the most selective first; the last one holds rules of a whole tenant
INDEX = [("fingerprint",), ("trace_id",), ("host",), ("service", "environment"), ("service",), ("source",), ("level",), ()]
FEW_KEYS = 1_000


def rule_index(rules: DataFrame) -> DataFrame:
    """Rules with `index_kind` and `index_key`: each rule stands under its most selective equality alone, so a row meets
    it at most once, and only if it has the value."""
    wanted = {
        name: F.nullif(F.col(f"f_{name}"), F.lit("")) for name in ("fingerprint", "trace_id", "host", "service", "source", "level")
    }
    asked = {
        (name,): (wanted[name].isNotNull(), (wanted[name],)) for name in wanted
    } | {
        # a rule of one service has its scope; services are told from the filter's by both values
        ("service", "environment"): (F.col("scope_service").isNotNull(), (F.col("scope_service"), F.col("scope_environment"))),
        (): (F.lit(True), ()),
    }
    kinds = F.coalesce(*[F.when(asked[columns][0], F.lit(n)) for n, columns in enumerate(INDEX)])
    keys = F.coalesce(*[F.when(F.col("index_kind") == n, _index_key(n, *asked[columns][1])) for n, columns in enumerate(INDEX)])
    return rules.withColumn("index_kind", kinds).withColumn("index_key", keys)


def indexed(logs: DataFrame, rules: DataFrame, carry: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Log rows once per index key that a rule may stand under, and the rules with their key.

    Rows get keys of the kinds in use only (the driver fetches at most one number per kind). With few rules, rows
    without any rule's key are left out before their fields are parsed; with many, the join does that.
    """
    keyed = rule_index(rules)
    entries = keyed.select("index_kind", "index_key").distinct().limit(FEW_KEYS + 1).collect()
    if len(entries) > FEW_KEYS:
        kinds, keys = sorted(r[0] for r in keyed.select("index_kind").distinct().collect()), None
    else:
        kinds, keys = sorted({r[0] for r in entries}), [r[1] for r in entries]
    own = [_index_key(n, *[F.col(c) for c in INDEX[n]]) for n in kinds]
    if keys is not None:
        own = [F.when(k.isin(keys), k) for k in own]
    found = F.array_compact(F.array(*own)) if own else F.array().cast("array<bigint>")
    present = logs
    for c in LOG_SIDE:
        if c not in logs.columns:
            present = present.withColumn(c, F.lit(""))
    met = bind(present, "index_keys", found).filter(F.size("index_keys") > 0)
    rows = rule_rows(met, [*(carry or []), "index_keys"])
    return rows.withColumn("index_key", F.explode("index_keys")).drop("index_keys"), keyed.drop("index_kind")


def match_rules(
    logs: DataFrame, rules: DataFrame, window: Column | None = None, sized_by: DataFrame | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """(rule, row) matches: rule columns, timestamp, group_key and numeric value, and the columns of `carry`.

    `window` is an extra condition over the aliases l and r. Rows a percentile
    rule cannot read a number from are left out.
    """
    condition = scope_condition() & filter_condition()
    if window is not None:
        condition = window & condition
    rows, keyed = indexed(logs, rules, carry)
    joined = lookup_join(rows, keyed.withColumnRenamed("tenant_id", "rule_tenant"), ["index_key"],
                         (F.col("l.tenant_id") == F.col("r.rule_tenant")) & condition, sized_by=sized_by)
    fields = F.col("fields")
    number = F.when(F.col("value_field") == "raw_size_bytes", F.col("raw_size_bytes").cast("double")).otherwise(
        numeric_text(
            F.try_element_at(
                fields, F.substring(F.col("value_field"), F.lit(7), F.length("value_field"))
            )
        )
    )
    value = F.when(F.col("kind") == "percentile", number)
    matched = joined.select(
        "rule_id",
        "timestamp",
        "kind",
        "percentile",
        "window_seconds",
        group_key(F.col("group_fields"), "", fields).alias("group_key"),
        value.alias("value"),
        *(carry or []),
    )
    return matched.filter((F.col("kind") != "percentile") | F.col("value").isNotNull())


def measured(counts: DataFrame, keys: list[str], rules: DataFrame) -> DataFrame:
    """match_count and metric_value per key from (keys, kind, percentile, value, n)."""
    plain = (
        counts.filter(F.col("kind") != "percentile")
        .groupBy("rule_id", *keys)
        .agg(F.sum("n").alias("match_count"))
        .withColumn("quantile", F.lit(None).cast("double"))
    )
    ranked = quantile_of_counts(
        counts.filter(F.col("kind") == "percentile").select("rule_id", *keys, "percentile", "value", "n"),
        ["rule_id", *keys, "percentile"],
        F.col("percentile"),
        "quantile",
        total="match_count",
    ).select("rule_id", *keys, "match_count", "quantile")
    facts = rules.select(
        "rule_id", "tenant_id", "rule_name", "rule_type", "severity", "kind", "threshold",
        "window_seconds", "percentile", "value_field", "cooldown_seconds",
    )
    found = lookup_join(plain.unionByName(ranked), facts, ["rule_id"], sized_by=rules)
    rate = F.col("match_count") / F.col("window_seconds")
    metric = (
        F.when(F.col("kind") == "rate", rate)
        .when(F.col("kind") == "percentile", F.col("quantile"))
        .otherwise(F.lit(0.0))
    )
    return found.withColumn("metric_value", metric).drop("quantile")


def triggered(found: DataFrame) -> DataFrame:
    reached = F.when(
        F.col("kind").isin("count", "pattern"), F.col("match_count") >= F.col("threshold")
    ).otherwise(F.col("metric_value") >= F.col("threshold"))
    return found.filter(reached)


def _counted(matches: DataFrame, extra: list[str]) -> DataFrame:
    """Matches per rule, group and value, stored once: measuring reads them several times, the logs are read once."""
    return cut_lineage(matches.groupBy("rule_id", "group_key", *extra, "kind", "percentile", "value").agg(
        F.count("*").alias("n")
    ))


def alert_records(
    logs: DataFrame,
    tenant_id: int,
    start,
    end,
    service: str = "",
    environment: str = "",
    level: str = "",
    fingerprint: str = "",
    limit: int | None = None,
) -> DataFrame:
    """Rows one rule's explicit scope selects, newest first; a cap is optional."""
    rows = in_scope(logs, tenant_id, start, end)
    wanted = {
        "service": service.strip(),
        "environment": environment.strip(),
        "level": level.strip().lower(),
        "fingerprint": fingerprint.strip(),
    }
    for name, value in wanted.items():
        if value:
            rows = rows.filter(F.col(name) == value)
    if limit is None:
        return rows
    return rows.orderBy(*newest_first(rows)).limit(limit)


def newest_rows(logs: DataFrame) -> DataFrame:
    """Newest time per (tenant_id, service, environment)."""
    return logs.groupBy("tenant_id", "service", "environment").agg(F.max("timestamp").alias("newest"))


def rule_anchors(newest: DataFrame, rules: DataFrame) -> DataFrame:
    """Newest row each rule was loaded for, matched or not: (rule_id, anchor)."""
    scopes = rules.select("rule_id", "tenant_id", "scope_service", "scope_environment")
    return (
        lookup_join(newest, scopes, ["tenant_id"], scope_condition(), sized_by=rules)
        .groupBy("rule_id")
        .agg(F.max("newest").alias("anchor"))
    )


def evaluate_newest(
    logs: DataFrame, rules: DataFrame, newest: DataFrame | None = None, batch: DataFrame | None = None
) -> DataFrame:
    """Triggers over the window that ends at the newest row of each rule, both
    ends included.

    `newest` has the newest time per scope, by default that of `logs`. A rule without a
    positive window sees the rows of `batch`, by default all of `logs`; with a batch only the days
    of the windows are read from `logs`.
    """
    scopes = newest_rows(logs) if newest is None else newest
    anchored = rules.join(rule_anchors(scopes, rules), "rule_id").withColumn(
        "since",
        F.when(F.col("window_seconds") > 0, plus_seconds("anchor", -F.col("window_seconds"))),
    )
    if batch is None:
        inside = F.col("r.since").isNull() | (F.col("l.timestamp") >= F.col("r.since"))
        if "event_date" in logs.columns:
            anchored = cut_lineage(anchored)
            if anchored.filter("since IS NULL").isEmpty():
                logs = _recent_days(logs, anchored)
        matches = match_rules(logs, anchored, inside, sized_by=rules)
    else:
        anchored = cut_lineage(anchored)
        windowed = anchored.filter("since IS NOT NULL")
        recent = _recent_days(logs, windowed) if "event_date" in logs.columns else logs
        matches = match_rules(recent, windowed, F.col("l.timestamp") >= F.col("r.since"), sized_by=rules).unionByName(
            match_rules(batch, anchored.filter("since IS NULL"), sized_by=rules))
    return triggered(measured(_counted(matches, []), ["group_key"], rules))


def _recent_days(logs: DataFrame, anchored: DataFrame) -> DataFrame:
    """Only the days and tenants of the windows (scalars and the rules' tenants are fetched).

    Without a window there is nothing to read.
    """
    tenants = anchored.groupBy("tenant_id").agg(F.min("since").alias("since")).collect()
    starts = [t["since"] for t in tenants if t["since"] is not None]
    if not starts:
        return logs.filter(F.lit(False))
    recent = logs.filter(F.col("event_date") >= F.lit(min(starts).date()))
    if len(tenants) <= FEW_TENANTS:
        recent = recent.filter(F.col("tenant_id").isin([t["tenant_id"] for t in tenants]))
    return recent


def evaluate_at(logs: DataFrame, rules: DataFrame, at: datetime | str) -> DataFrame:
    """Triggers of all windowed rules over [at - window, at)."""
    windowed = rules.filter(F.col("window_seconds") > 0).withColumn(
        "since", plus_seconds(instant(at), -F.col("window_seconds"))
    )
    inside = (F.col("l.timestamp") >= F.col("r.since")) & (F.col("l.timestamp") < instant(at))
    if "event_date" in logs.columns:
        logs = _recent_days(logs, windowed)
    matches = match_rules(logs, windowed, inside, sized_by=rules)
    return triggered(measured(_counted(matches, []), ["group_key"], rules))


def evaluate_ticks(
    logs: DataFrame, rules: DataFrame, first: datetime | str, last: datetime | str, step_seconds: int
) -> DataFrame:
    """Triggers at every tick first, first + step, .. last, each over
    [tick - window, tick).

    A row counts for a contiguous run of ticks. Rows are reduced to counts per
    run before runs are spread to single ticks.
    """
    windowed = rules.filter(F.col("window_seconds") > 0)
    longest = windowed.agg(F.max("window_seconds")).first()[0] or 0
    oldest, latest = as_datetime(first) - timedelta(seconds=longest), as_datetime(last)
    logs = logs.filter((F.col("timestamp") >= F.lit(oldest)) & (F.col("timestamp") < F.lit(latest)))
    if "event_date" in logs.columns:
        logs = logs.filter(F.col("event_date").between(F.lit(oldest.date()), F.lit(latest.date())))
    matches = match_rules(logs, windowed, sized_by=rules)
    origin, end = F.unix_micros(instant(first)), F.unix_micros(instant(last))
    step = F.lit(step_seconds * 1_000_000)
    since = F.unix_micros("timestamp") - origin
    run_end = since + F.col("window_seconds") * 1_000_000
    runs = (
        matches.withColumn("k1", F.greatest(F.floor(since / step) + 1, F.lit(0)))
        .withColumn("k2", F.least(F.floor(run_end / step), F.floor((end - origin) / step)))
        .filter(F.col("k1") <= F.col("k2"))
    )
    ticks = (
        _counted(runs, ["k1", "k2"])
        .withColumn("k", F.explode(F.sequence("k1", "k2")))
        .groupBy("rule_id", "group_key", "k", "kind", "percentile", "value")
        .agg(F.sum("n").alias("n"))
        .withColumn("tick", F.timestamp_micros(origin + F.col("k") * step))
    )
    return triggered(measured(ticks, ["group_key", "tick"], rules))
