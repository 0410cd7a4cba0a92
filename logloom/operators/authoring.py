"""Alert rule authoring: checks, listing, and the fold of a change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import is_safe_key, trim_all
from logloom.limits import DEFAULT, Limits
from logloom.operators.search import positive, safe_filter

# fixed values
DEFAULT_COOLDOWN = 600
DEFAULT_STATUS = "active"
FIELDS = [
    "service", "environment", "log_level", "fingerprint", "name", "rule_type", "severity",
    "filter_json", "group_by", "window_seconds", "threshold", "cooldown_seconds", "status",
]
# fixed values: required columns, and below the texts of complaints, which callers match on
REQUIRED = ["service", "environment", "name", "rule_type", "severity"]
SAFE = ["service", "environment", "log_level", "fingerprint"]


def _text(name: str) -> Column:
    return F.coalesce(trim_all(F.col(name)), F.lit(""))


def _shared_checks() -> list[Column]:
    checks = [
        F.when((_text(n) != "") & ~is_safe_key(_text(n)), f"{n} contains unsupported characters")
        for n in SAFE
    ]
    checks.append(
        F.when(~F.lower(_text("status")).isin("", "active", "disabled"), "status must be active or disabled")
    )
    for name in ("filter_json", "group_by"):
        given = F.coalesce(F.col(name), F.lit("")) != ""
        checks.append(F.when(given & F.try_parse_json(name).isNull(), f"{name} must be valid json"))
    return checks


def mutation_error() -> Column:
    """First complaint about a new rule, NULL if it is fine."""
    checks = [F.when(_text(n) == "", f"{n} is required") for n in REQUIRED]
    checks += [
        F.when(F.coalesce("window_seconds", F.lit(0)) <= 0, "window_seconds must be positive"),
        F.when(F.coalesce("cooldown_seconds", F.lit(0)) < 0, "cooldown_seconds must be non-negative"),
        F.when(_text("threshold") == "", "threshold is required"),
    ]
    return F.coalesce(*checks, *_shared_checks())


def patch_error() -> Column:
    """First complaint about a change to a rule (NULL fields are left alone)."""
    checks = [F.when(F.col(n).isNotNull() & (_text(n) == ""), f"{n} cannot be empty") for n in REQUIRED]
    checks += [
        F.when(F.col("window_seconds") <= 0, "window_seconds must be positive"),
        F.when(F.col("cooldown_seconds") < 0, "cooldown_seconds must be non-negative"),
        F.when(F.col("threshold").isNotNull() & (_text("threshold") == ""), "threshold cannot be empty"),
    ]
    return F.coalesce(*checks, *_shared_checks())


def change_error() -> Column:
    """Complaint about a row of the change log, by its `action`."""
    return F.when(F.col("action") == "create", mutation_error()).when(
        F.col("action") == "patch", patch_error()
    )


def current_rules(changes: DataFrame) -> DataFrame:
    """Rules after all accepted changes, deleted ones left out.

    changes: rule_id, tenant_id, seq, action (create, patch, delete) and the rule
    fields, NULL where a patch leaves a field alone. A field's value is the newest
    one given; changes after a delete are ignored. All steps are aggregates.
    """
    accepted = changes.filter(change_error().isNull())
    deletions = accepted.filter(F.col("action") == "delete").select("rule_id").distinct()
    live = accepted.filter(F.col("action") != "delete")
    folded = live.groupBy("rule_id").agg(
        F.min_by("tenant_id", "seq").alias("tenant_id"),
        *[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("seq"))).alias(n) for n in FIELDS],
        F.count_if(F.col("action") == "create").alias("_created"),
        F.max_by("action", F.when(F.col("cooldown_seconds").isNotNull(), F.col("seq"))).alias("_cooled_by"),
    )
    kept = folded.filter(F.col("_created") > 0).join(deletions, "rule_id", "left_anti")
    # a zero cooldown on create means the default; a patch may set a real zero
    cooldown = F.when(
        F.col("cooldown_seconds").isNull()
        | ((F.col("cooldown_seconds") == 0) & (F.col("_cooled_by") == "create")),
        F.lit(DEFAULT_COOLDOWN),
    ).otherwise(F.col("cooldown_seconds"))
    status = F.coalesce(F.nullif(F.lower(_text("status")), F.lit("")), F.lit(DEFAULT_STATUS))
    return kept.select(
        "rule_id",
        "tenant_id",
        *[_text(n).alias(n) for n in ("service", "environment", "name", "rule_type", "severity")],
        F.lower(_text("log_level")).alias("log_level"),
        _text("fingerprint").alias("fingerprint"),
        F.coalesce(F.nullif("filter_json", F.lit("")), F.lit("{}")).alias("filter_json"),
        F.coalesce(F.nullif("group_by", F.lit("")), F.lit("[]")).alias("group_by"),
        "window_seconds",
        _text("threshold").alias("threshold"),
        cooldown.alias("cooldown_seconds"),
        status.alias("status"),
    )


def services_of(rules: DataFrame) -> DataFrame:
    """Distinct (tenant, service, environment) a set of rules refers to."""
    return rules.select("tenant_id", F.col("service").alias("name"), "environment").distinct()


def list_rules(
    rules: DataFrame,
    services: DataFrame,
    tenant_id: int,
    service: str = "",
    environment: str = "",
    status: str = "",
    rule_id: int | None = None,
    limit=None,
    limits: Limits = DEFAULT,
) -> DataFrame:
    """Rules of a tenant that are not deleted, by id. Empty arguments do not filter."""
    named = services.select(
        F.col("id").alias("service_id"), F.col("name").alias("service"), "environment"
    )
    found = rules.filter((F.col("tenant_id") == tenant_id) & (F.col("status") != "deleted"))
    found = found.join(named, "service_id", "left")
    for column, value in (
        ("service", safe_filter(service, "service")),
        ("environment", safe_filter(environment, "environment")),
        ("status", status.strip().lower()),
    ):
        if value:
            found = found.filter(F.col(column) == value)
    if rule_id is not None:
        found = found.filter(F.col("id") == rule_id)
    empty = F.lit("")
    shown = found.select(
        "id", "tenant_id",
        *[F.coalesce(c, empty).alias(c) for c in ("service", "environment", "log_level", "fingerprint")],
        "name", "rule_type", "severity", "window_seconds", "threshold", "cooldown_seconds", "status",
    )
    return shown.orderBy("id").limit(positive(limit, limits.log_page, limits.rule_page_max, "limit"))
