"""The stored log table: layout, writing, retention, relayout and completeness."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.jsonfields import field_text
from logloom.functions.timefns import as_datetime, instant, plus_seconds
from logloom.operators.integrity import reconcile_counts
from logloom.schemas import LOG_COLUMNS, LOGS

RETENTION_DAYS = 30
# columns the first schema version did not have
LATER_COLUMNS = ["message_template", "template_id"]
# fixed values: columns with Bloom filters for point lookups
BLOOM_COLUMNS = ["ingest_id", "trace_id", "error_code"]


def laid_out(logs: DataFrame) -> DataFrame:
    """Rows ready to be written: day column, extracted error_code, and files that
    hold one day and few tenants, sorted by tenant, time and service.

    The rebalance hint lets Spark split a day or tenant that is too large for one
    task and merge small ones, by bytes, so file sizes follow the volume.
    """
    rows = logs.withColumn("event_date", F.to_date("timestamp"))
    if "error_code" not in rows.columns:
        rows = rows.withColumn("error_code", field_text("fields_json", "error_code"))
    return rows.hint("rebalance", "event_date", "tenant_id").sortWithinPartitions(
        "event_date", "tenant_id", "timestamp", "service"
    )


def writer_options() -> dict[str, str]:
    options = {"compression": "zstd"}
    for name in BLOOM_COLUMNS:
        options[f"parquet.bloom.filter.enabled#{name}"] = "true"
    options["parquet.bloom.filter.max.bytes"] = str(1 << 20)
    return options


def write_logs(logs: DataFrame, path: str, mode: str = "append", partitions: tuple[str, ...] = ()) -> None:
    """Write rows in the table layout; extra partition columns come after the day."""
    writer = laid_out(logs).write.mode(mode).options(**writer_options())
    writer.partitionBy("event_date", *partitions).parquet(path)


def read_logs(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """The table with the columns of all schema versions, later ones defaulting to ''.

    The schema is given, so no file footer is read for planning; files written
    before a column existed yield NULL for it. `extra` names further columns.
    """
    schema = f"{LOGS}, error_code string, event_date date" + (f", {extra}" if extra else "")
    return with_log_columns(spark.read.schema(schema).parquet(path))


def with_log_columns(logs: DataFrame) -> DataFrame:
    """Additive schema change: columns of later schema versions default to ''.

    Only those are wrapped; a filter on a wrapped column cannot reach the file scan.
    """
    for name in LOG_COLUMNS:
        if name not in logs.columns:
            logs = logs.withColumn(name, F.lit(""))
        elif name in LATER_COLUMNS:
            logs = logs.withColumn(name, F.coalesce(F.col(name), F.lit("")))
    return logs


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows together; columns only one side has default to ''."""
    both = old.unionByName(new, allowMissingColumns=True)
    return with_log_columns(both)


def retained(logs: DataFrame, as_of: datetime | str, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows not older than `days`; whole days are pruned where the table has them."""
    if "event_date" in logs.columns:
        oldest = (as_datetime(as_of) - timedelta(days=days)).date()
        logs = logs.filter(F.col("event_date") >= F.lit(oldest))
    return logs.filter(plus_seconds("timestamp", days * 86400) >= instant(as_of))


def expired_days(days: list[date], as_of: datetime | str, keep: int = RETENTION_DAYS) -> list[date]:
    """Day partitions that hold no row to keep and may be dropped whole."""
    oldest = (as_datetime(as_of) - timedelta(days=keep)).date()
    return [d for d in days if d < oldest]


def relayout(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Copy a table into the layout. Returns the per-tenant count check; the caller
    drops the old table only when every row of it matches."""
    old = spark.read.parquet(source)
    write_logs(old.drop("event_date"), target, mode="overwrite")
    return reconcile_counts(old, spark.read.parquet(target))


def completeness(logs: DataFrame, start: datetime | str, end: datetime | str) -> DataFrame:
    """partial flag and the list of days in [start, end) without any data."""
    last = F.timestamp_micros(F.unix_micros(instant(end)) - 1)
    # one literal row: the expected days, bounded by the requested range
    expected = logs.sparkSession.range(1).select(
        F.explode(
            F.sequence(F.to_date(instant(start)), F.to_date(last), F.expr("interval 1 day"))
        ).alias("event_date")
    )
    # only the days of the range are read
    if "event_date" in logs.columns:
        day = F.col("event_date")
        stop = as_datetime(end) - timedelta(microseconds=1)
        logs = logs.filter(day.between(F.lit(as_datetime(start).date()), F.lit(stop.date())))
    else:
        day = F.to_date("timestamp")
        logs = logs.filter((F.col("timestamp") >= instant(start)) & (F.col("timestamp") < instant(end)))
    present = logs.select(day.alias("event_date")).distinct()
    missing = expected.join(present, "event_date", "left_anti")
    days = F.array_sort(F.collect_list(F.date_format("event_date", "yyyy-MM-dd")))
    return missing.agg(days.alias("missing_days")).withColumn(
        "partial", F.size("missing_days") > 0
    )
