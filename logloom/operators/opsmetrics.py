"""Operations metrics: histograms, quantiles, rates, ratios, gauges, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.timefns import bucket_start, plus_seconds
from logloom.operators.quantiles import quantile_of_counts, value_counts
from logloom.operators.skew import with_previous

# fixed values: histogram bounds in seconds
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10]
END_TO_END_BOUNDS = [0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 60, 300, 900]
# fixed values: colour steps (warning, best or worst) per objective
SLO_STEPS = {
    "availability": (0.99, 0.999, "higher"),
    "http_latency": (0.5, 1.0, "lower"),
    "end_to_end_latency": (5.0, 30.0, "lower"),
    "processor_error_ratio": (0.01, 0.05, "lower"),
    "dead_letter_ratio": (0.001, 0.01, "lower"),
}
SUMMARY_PERCENTS = (50, 95, 99)
FLOOR = 1e-9
INF = float("inf")


def label(value: Column | str) -> Column:
    """Metric label: blank becomes `unknown`."""
    col = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.nullif(F.trim(col), F.lit("")), F.lit("unknown"))


def histogram(df: DataFrame, groups: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative buckets: one row per (group, bound) plus +Inf, with sum and count.
    Negative values are left out. One partial aggregate, no sort."""
    rows = df.filter(F.col(value) >= 0)
    sums = [F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    wide = rows.groupBy(*groups).agg(
        *sums, F.count("*").alias("total_count"), F.sum(value).alias("total_sum")
    )
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("cumulative"))
             for i, b in enumerate(bounds)]
    pairs.append(F.struct(F.lit(INF).alias("le"), F.col("total_count").alias("cumulative")))
    return wide.select(
        *groups, "total_count", "total_sum", F.explode(F.array(*pairs)).alias("_p")
    ).select(*groups, F.col("_p.le").alias("le"), F.col("_p.cumulative").alias("cumulative"),
             "total_count", "total_sum")


def histogram_quantile(buckets: DataFrame, groups: list[str], q: float, output: str = "quantile") -> DataFrame:
    """Quantile from cumulative buckets by linear interpolation inside the bucket
    that holds the rank; beyond the last finite bound that bound is returned.
    Windows hold one series' buckets, a dozen rows."""
    series = Window.partitionBy(*groups).orderBy("le")
    whole = Window.partitionBy(*groups)
    ranked = (
        buckets.withColumn("_lower", F.coalesce(F.lag("le").over(series), F.lit(0.0)))
        .withColumn("_below", F.coalesce(F.lag("cumulative").over(series), F.lit(0)))
        .withColumn("_rank", F.max("cumulative").over(whole) * q)
        .filter((F.col("cumulative") >= F.col("_rank")) & (F.col("_rank") > 0))
        .withColumn("_first", F.row_number().over(series))
        .filter(F.col("_first") == 1)
    )
    inside = F.col("cumulative") - F.col("_below")
    # rates are buckets too, so the width may be far below one; only an empty bucket has no inside
    part = F.when(inside > 0, (F.col("_rank") - F.col("_below")) / inside).otherwise(F.lit(1.0))
    value = F.when(F.col("le") == INF, F.col("_lower")).otherwise(
        F.col("_lower") + (F.col("le") - F.col("_lower")) * part
    )
    return ranked.select(*groups, value.alias(output))


def latency_summary(df: DataFrame, groups: list[str], value: str, ok: Column) -> DataFrame:
    """Requests, successes, failures, error rate and lower nearest-rank p50, p95,
    p99, max. An empty input has error rate 1."""
    counts = df.groupBy(*groups).agg(
        F.count("*").alias("requests"),
        F.count_if(ok).alias("successes"),
        F.max(value).alias("latency_max"),
    )
    percents = F.array(*[F.lit(float(p)) for p in SUMMARY_PERCENTS])
    parts = value_counts(df, groups, value).withColumn("_p", F.explode(percents))
    ranked = quantile_of_counts(parts, [*groups, "_p"], F.col("_p"), "_q", method="lower")
    wide = ranked.groupBy(*groups).agg(
        *[F.max(F.when(F.col("_p") == p, F.col("_q"))).alias(f"latency_p{p}") for p in SUMMARY_PERCENTS]
    )
    # both parts hold one row per group: put them side by side with one aggregate
    both = counts.unionByName(wide, allowMissingColumns=True)
    names = [c for c in both.columns if c not in groups]
    failures = F.col("requests") - F.col("successes")
    rate = F.when(F.col("requests") > 0, failures / F.col("requests")).otherwise(F.lit(1.0))
    return (
        both.groupBy(*groups)
        .agg(*[F.max(c).alias(c) for c in names])
        .withColumn("failures", failures)
        .withColumn("error_rate", rate)
    )


def trailing_rate(df: DataFrame, groups: list[str], time: str, window_seconds: int = 300,
                  weight: Column | None = None, output: str = "per_second") -> DataFrame:
    """Events per second over the trailing window, at every minute the window covers.

    Events are reduced to one row per (group, minute) before minutes are spread
    over the windows that contain them. A window ends at `window_end` and excludes it.
    It must be a whole number of minutes.
    """
    if window_seconds <= 0 or window_seconds % 60:
        raise ValueError("the window must be a positive whole number of minutes")
    amount = F.count("*") if weight is None else F.sum(weight)
    minutes = df.groupBy(*groups, bucket_start(time, "minute").alias("_minute")).agg(amount.alias("_n"))
    steps = window_seconds // 60
    spread = minutes.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    return (
        spread.withColumn("window_end", plus_seconds("_minute", F.col("_k") * 60))
        .groupBy(*groups, "window_end")
        .agg((F.sum("_n") / window_seconds).alias(output))
    )


def code_class(code: Column) -> Column:
    return F.concat(F.floor(code / 100).cast("string"), F.lit("xx"))


def per_second(df: DataFrame, groups: list[str], time: str, window_seconds: int = 300) -> DataFrame:
    """Events per second in fixed windows, per group."""
    start = F.timestamp_seconds(F.floor(F.unix_seconds(time) / window_seconds) * window_seconds)
    return df.groupBy(start.alias("window_start"), *groups).agg(
        F.count("*").alias("events"), (F.count("*") / window_seconds).alias("per_second")
    )


def ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole.cast("double"), F.lit(FLOOR))


def availability(requests: DataFrame, groups: list[str], time: str, code: str, window_seconds: int) -> DataFrame:
    """Share of requests that did not fail on the server side, per fixed window."""
    start = F.timestamp_seconds(F.floor(F.unix_seconds(time) / window_seconds) * window_seconds)
    good = F.count_if(F.col(code) < 500)
    return requests.groupBy(start.alias("window_start"), *groups).agg(
        ratio(good, F.count("*")).alias("availability")
    )


def failure_ratio(df: DataFrame, groups: list[str], ok: Column, output: str = "failure_ratio") -> DataFrame:
    return df.groupBy(*groups).agg((F.lit(1.0) - ratio(F.count_if(ok), F.count("*"))).alias(output))


def share_of(df: DataFrame, groups: list[str], test: Column, output: str) -> DataFrame:
    return df.groupBy(*groups).agg(ratio(F.count_if(test), F.count("*")).alias(output))


def slo_status(value: Column, objective: str) -> Column:
    """green / yellow / red by the steps of the objective."""
    warn, edge, better = SLO_STEPS[objective]
    if better == "higher":
        return F.when(value >= edge, "green").when(value >= warn, "yellow").otherwise("red")
    return F.when(value >= edge, "red").when(value >= warn, "yellow").otherwise("green")


def gauge_rollup(samples: DataFrame, series: list[str], groups: list[str], time: str, value: str) -> DataFrame:
    """Largest and smallest of the latest sample of each series, per group."""
    latest = samples.groupBy(*groups, *series).agg(F.max_by(value, time).alias("_v"))
    return latest.groupBy(*groups).agg(
        F.max("_v").alias("max_value"), F.min("_v").alias("min_value"), F.count("*").alias("series")
    )


def counter_rate(samples: DataFrame, series: list[str], time: str, ties: list[str], value: str,
                 window_seconds: int) -> DataFrame:
    """Per-second increase of counters in fixed windows. A drop is a restart: the
    new value counts as increase from zero."""
    steps = with_previous(samples, series, time, ties, [value])
    before, now = F.col(f"prev_{value}"), F.col(value)
    increase = F.when(before.isNull(), F.lit(0)).when(now < before, now).otherwise(now - before)
    start = F.timestamp_seconds(F.floor(F.unix_seconds(time) / window_seconds) * window_seconds)
    return steps.groupBy(*series, start.alias("window_start")).agg(
        F.sum(increase).alias("increase"), (F.sum(increase) / window_seconds).alias("per_second")
    )


def batch_counters(batches: DataFrame) -> DataFrame:
    """Batches, logs and processing seconds by result."""
    return batches.groupBy(label("result").alias("result")).agg(
        F.count("*").alias("batches"),
        F.sum(F.greatest("log_count", F.lit(0))).alias("logs"),
        F.sum("duration_s").alias("duration_sum"),
    )


def labelled_counts(df: DataFrame, *labels: str) -> DataFrame:
    """Counter per label combination, e.g. dead letters by reason and outcome."""
    return df.groupBy(*[label(name).alias(name) for name in labels]).agg(F.count("*").alias("total"))


def end_to_end(logs: DataFrame, received: str, completed: str, result: str) -> DataFrame:
    """Histogram of the time from reception to completion; negative spans are skipped."""
    span = (F.unix_micros(completed) - F.unix_micros(received)) / 1_000_000
    rows = logs.withColumn("latency_s", span).withColumn("result", label(result))
    return histogram(rows, ["result"], "latency_s", END_TO_END_BOUNDS)
