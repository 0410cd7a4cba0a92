"""Exact quantiles per group without bringing a group's values into one task.

Values are reduced to (group, value, count), then to counts per coarse value
range. Ranks are located among the coarse ranges first, and only the one or two
ranges that hold the wanted ranks are cut into slices; only the slices with the
ranks are ordered value by value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SLICES = 4096
TINY = 1e-300


def coarse_key(value: Column) -> Column:
    """Non-decreasing integer code of a double: about 900 codes per decade.

    The smallest numbers share one code per sign, infinities have the outer codes, NaN the last one.
    """
    size = F.abs(value)
    exponent = F.floor(F.log10(size))
    code = (exponent + 400) * 1000 + F.floor(size / F.pow(F.lit(10.0), exponent) * 100)
    code = F.when(size < TINY, F.lit(1)).when(size == float("inf"), F.lit(10**9)).otherwise(code)
    return (
        F.when(F.isnan(value), F.lit(2 * 10**9))
        .when(value == 0, F.lit(0))
        .when(value > 0, code)
        .when(value < 0, -code)
        .cast("bigint")
    )


def slice_key(value: Column, low: Column, high: Column) -> Column:
    """Non-decreasing number of the equal slice of [low, high] that a value lies in."""
    part = (value - low) / (high - low) * SLICES
    return F.when((high > low) & (high - low < float("inf")), F.floor(part)).otherwise(F.lit(0)).cast("bigint")


def value_counts(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(group, value, n). NULL values keep their group alive with weight 0."""
    return df.groupBy(*groups, F.col(value).cast("double").alias("value")).agg(
        F.count(value).alias("n")
    )


def _with_same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    test = F.lit(True)
    for key in keys:
        test = test & F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    extra = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return left.alias("l").join(right.alias("r"), test).select("l.*", *extra)


def quantile_of_counts(
    counts: DataFrame,
    groups: list[str],
    percent: Column | float,
    output: str,
    method: str = "linear",
    total: str | None = None,
) -> DataFrame:
    """Quantile per group from (groups, value, n).

    `percent` (0..100) is a number or an expression over the group columns.
    `linear` interpolates at p/100 * (n - 1); `lower` takes the value at its
    floor. Groups without numeric values yield NULL. `total` names an optional
    output column with the number of values.
    """
    percent = F.lit(float(percent)) if isinstance(percent, (int, float)) else percent
    keys = [*groups, "_range"]
    ranged = counts.withColumn("_range", coarse_key(F.col("value")))
    ranges = ranged.groupBy(*keys).agg(
        F.sum("n").alias("m"), F.min("value").alias("_min"), F.max("value").alias("_max"))
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    upto = whole.orderBy(F.col("_range").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    position = F.greatest(percent / 100 * (F.col("_all") - 1), F.lit(0.0))
    located = (
        ranges.withColumn("_upto", F.sum("m").over(upto))
        .withColumn("_all", F.sum("m").over(whole))
        .withColumn("_lo", F.floor(position))
        .withColumn("_frac", position - F.col("_lo"))
        .withColumn("_hi", F.least(F.col("_lo") + 1, F.greatest(F.col("_all") - 1, F.lit(0))))
        .withColumn("_base", F.col("_upto") - F.col("m"))
    )
    if method == "lower":
        located = located.withColumn("_hi", F.col("_lo"))
    holds = (F.col("_all") == 0) | (
        (F.col("_lo") < F.col("_upto")) & (F.col("_hi") >= F.col("_base")) & (F.col("m") > 0)
    )
    wanted = located.filter(holds).select(*keys, "_base", "_all", "_lo", "_hi", "_frac", "_min", "_max")
    # a range may hold very many close values (ids, epochs): cut it once more and keep the slices with the ranks
    inner = [*keys, "_slice"]
    held = _with_same(ranged, wanted, keys).withColumn("_slice", slice_key(F.col("value"), F.col("_min"), F.col("_max")))
    slices = held.groupBy(*inner, "_base", "_all", "_lo", "_hi").agg(F.sum("n").alias("m"))
    along = Window.partitionBy(*keys).orderBy(F.col("_slice").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    near = (
        slices.withColumn("_upto", F.col("_base") + F.sum("m").over(along))
        .withColumn("_start_at", F.col("_upto") - F.col("m"))
        .filter((F.col("_all") == 0) | ((F.col("_lo") < F.col("_upto")) & (F.col("_hi") >= F.col("_start_at")) & (F.col("m") > 0)))
        .select(*inner, "_start_at")
    )
    inside = Window.partitionBy(*inner).orderBy("value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    fine = (
        _with_same(held, near, inner)
        .withColumn("_end", F.col("_start_at") + F.sum("n").over(inside))
        .withColumn("_start", F.col("_end") - F.col("n"))
    )

    def at(rank: str) -> Column:
        hit = (F.col(rank) >= F.col("_start")) & (F.col(rank) < F.col("_end"))
        return F.max(F.when(hit, F.col("value")))

    low, high = at("_lo"), at("_hi")
    # equal ends need no step between them, which infinities could not give
    between = F.when((low == high) | (F.max("_frac") == 0), low).otherwise(low + F.max("_frac") * (high - low))
    columns = [between if method == "linear" else low]
    columns = [columns[0].alias(output)]
    if total:
        columns.append(F.max("_all").alias(total))
    return fine.groupBy(*groups).agg(*columns)


def exact_quantile(
    df: DataFrame,
    groups: list[str],
    value: str,
    percent: Column | float,
    output: str = "value",
    method: str = "linear",
    total: str | None = None,
) -> DataFrame:
    return quantile_of_counts(
        value_counts(df, groups, value), groups, percent, output, method, total
    )
