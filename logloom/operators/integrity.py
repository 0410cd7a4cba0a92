"""Key, reference and count checks of the control and log tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(check, key, problem): keys that occur more than once."""
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > 1)
        .select(
            F.lit(name).alias("check_name"),
            F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"),
            F.col("n").alias("row_count"),
        )
    )


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str, name: str) -> DataFrame:
    """Children whose parent does not exist; a NULL reference is allowed."""
    known = parent.select(F.col(key).alias(column))
    return (
        child.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("n"))
        .join(known, column, "left_anti")
        .select(
            F.lit(name).alias("check_name"),
            F.col(column).cast("string").alias("key"),
            F.col("n").alias("row_count"),
        )
    )


def report(checks: list[DataFrame]) -> DataFrame:
    result = checks[0]
    for check in checks[1:]:
        result = result.unionByName(check)
    return result


def tenant_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("tenant_id").agg(F.count("*").alias("row_count"))


def reconcile_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows per tenant before and after a copy, and whether they agree."""
    before = tenant_counts(old).withColumnRenamed("row_count", "old_rows")
    after = tenant_counts(new).withColumnRenamed("row_count", "new_rows")
    zero = F.lit(0)
    return before.join(after, "tenant_id", "full").select(
        "tenant_id",
        F.coalesce("old_rows", zero).alias("old_rows"),
        F.coalesce("new_rows", zero).alias("new_rows"),
        (F.coalesce("old_rows", zero) == F.coalesce("new_rows", zero)).alias("matches"),
    )
