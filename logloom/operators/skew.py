"""Joins, previous-row and carry-forward operators that survive hot keys.

A single key (tenant, flow, series, alert) may own a third of all rows, so none
of these puts all rows of a key into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.session import cut_lineage

LOOKUP_ROWS = 50_000
LOOKUP_BYTES = 32 << 20
SALTS = 64
SLICE_SECONDS = 3600
SLICE_ROWS = 1_000_000
FINER = 60

_ATOMIC = (T.StringType, T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType, T.BooleanType)


def row_salt(df: DataFrame, buckets: int) -> Column:
    """Bucket number from row content, so a recomputed row lands in the same place."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, _ATOMIC)]
    return F.pmod(F.xxhash64(*[F.col(f"`{n}`") for n in names]), F.lit(buckets)).cast("int")


def fits(df: DataFrame, max_rows: int = LOOKUP_ROWS) -> bool:
    """Whether a table has at most `max_rows` rows and LOOKUP_BYTES of JSON text, so that it may be broadcast.

    Reads at most `max_rows` + 1 rows, once per table object.
    """
    known = df.__dict__.setdefault("_row_bounds", {})
    if max_rows not in known:
        size = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
        row = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
        known[max_rows] = row["n"] <= max_rows and row["bytes"] <= LOOKUP_BYTES
    return known[max_rows]


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    condition: Column | None = None,
    how: str = "inner",
    max_rows: int = LOOKUP_ROWS,
    salts: int = SALTS,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Join a large table to a control table on `on` plus an optional condition.

    The control table is broadcast only after its rows and bytes have been checked.
    Beyond the bound each key is spread over `salts` sub-keys, with the control
    rows repeated once per sub-key, so a hot key is still split. Only inner,
    left, left_semi and left_anti joins are meaningful this way.
    `condition` may name columns of both sides through the aliases `l` and `r`.
    `sized_by` is a cheaper table known to have at least as many rows as `small`.
    """
    left = big.alias("l")
    if fits(small if sized_by is None else sized_by, max_rows):
        right, keys = F.broadcast(small).alias("r"), on
    else:
        left = big.withColumn("_salt", row_salt(big, salts)).alias("l")
        spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
        right, keys = small.withColumn("_salt", spread).alias("r"), [*on, "_salt"]
    test = None
    for key in keys:
        same = F.col(f"l.{key}") == F.col(f"r.{key}")
        test = same if test is None else test & same
    if condition is not None:
        test = test & condition
    joined = left.join(right, test, how)
    kept = [F.col(f"l.{c}") for c in big.columns]
    if how not in ("left_semi", "left_anti"):
        kept += [F.col(f"r.{c}") for c in small.columns if c not in on]
    return joined.select(*kept)


def time_slices(
    df: DataFrame, keys: list[str], time: str, slice_seconds: int = SLICE_SECONDS, max_rows: int = SLICE_ROWS
) -> DataFrame:
    """Add `_slice`: the start (epoch microseconds) of a time interval that holds at most `max_rows` rows of a key.

    Intervals are `slice_seconds` long; those that hold more are cut in 60, again and again, down to a microsecond.
    Intervals of a key never overlap, so their starts order them. Rows are counted by a hash of the key: two keys
    with one hash merely share their cuts. Rows of one key and one microsecond stay together; so do rows without a time.
    Counts are combined before the shuffle, and each level counts only the rows of the crowded intervals above it.
    """
    at = F.unix_micros(time)
    width = slice_seconds * 1_000_000
    sliced = df.withColumn("_key", F.xxhash64(*keys)).withColumn("_slice", at - F.pmod(at, F.lit(width)))
    slim = sliced.select("_key", "_slice", at.alias("_at"))
    while width > 1:
        counts = slim.filter(F.col("_at").isNotNull()).groupBy("_key", "_slice").count()
        crowded = cut_lineage(counts.filter(F.col("count") > max_rows).select("_key", "_slice"))
        if crowded.isEmpty():
            break
        width = max(1, width // FINER)

        def finer(instant: Column, step: int = width) -> Column:
            return instant - F.pmod(instant - F.col("_slice"), F.lit(step))

        slim = lookup_join(slim, crowded, ["_key", "_slice"], how="left_semi").withColumn("_slice", finer(F.col("_at")))
        marked = lookup_join(sliced, crowded.withColumn("_crowded", F.lit(True)), ["_key", "_slice"], how="left")
        sliced = marked.withColumn("_slice", F.when(F.col("_crowded"), finer(at)).otherwise(F.col("_slice"))).drop("_crowded")
    return sliced.drop("_key")


def with_previous(
    df: DataFrame,
    keys: list[str],
    time: str,
    ties: list[str],
    carry: list[str],
    slice_seconds: int = SLICE_SECONDS,
    max_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add `prev_<c>`: the value on the preceding row of the same key.

    Rows are windowed per (key, time slice of at most about `max_rows` rows). Only the first and last row of each
    slice take part in a second window over the whole key, which supplies the
    previous row across slice borders. (time, ties) must be a total order.
    """
    order = [time, *ties]
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    marked = (
        time_slices(df, keys, time, slice_seconds, max_rows)
        .withColumn("_prev", F.lag(F.struct(*carry)).over(inside))
        .withColumn("_last", F.lead(F.lit(1)).over(inside).isNull())
    )
    across = Window.partitionBy(*keys).orderBy(*order)
    borders = (
        marked.filter(F.col("_prev").isNull() | F.col("_last"))
        .withColumn("_head", F.col("_prev").isNull())
        .withColumn("_prev", F.lag(F.struct(*carry)).over(across))
        .filter("_head")
        .drop("_head")
    )
    both = marked.filter(F.col("_prev").isNotNull()).unionByName(borders)
    previous = [F.col("_prev")[c].alias(f"prev_{c}") for c in carry]
    return both.select(*[F.col(c) for c in df.columns], *previous)


def carry_forward(
    df: DataFrame,
    keys: list[str],
    time: str,
    ties: list[str],
    value: str,
    output: str,
    slice_seconds: int = SLICE_SECONDS,
    max_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add `output`: the last non-NULL `value` at or before each row of its key."""
    order = [time, *ties]
    running = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    sliced = time_slices(df, keys, time, slice_seconds, max_rows)
    inside = sliced.withColumn("_run", F.last(value, ignorenulls=True).over(running))
    closing = sliced.filter(F.col(value).isNotNull()).groupBy(*keys, "_slice").agg(
        F.max_by(F.col(value), F.struct(*order)).alias("_close")
    )
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    slices = inside.select(*keys, "_slice").distinct()
    openings = (
        slices.join(closing, [*keys, "_slice"], "left")
        .withColumn("_open", F.last("_close", ignorenulls=True).over(earlier))
        .select(*keys, "_slice", "_open")
    )
    return (
        inside.join(openings, [*keys, "_slice"], "left")
        .withColumn(output, F.coalesce("_run", "_open"))
        .drop("_slice", "_run", "_open")
    )


def admit_first(
    df: DataFrame, keys: list[str], order: list[str], limit: str, output: str, salts: int = SALTS
) -> DataFrame:
    """Add boolean `output`: row is among the first `limit` of its key.

    Each key is first cut down inside content-based sub-keys; only rows that can
    still make it are ranked over the whole key.
    """
    salted = df.withColumn("_salt", row_salt(df, salts))
    local = Window.partitionBy(*keys, "_salt").orderBy(*order)
    ranked = salted.withColumn("_rank", F.row_number().over(local))
    beyond = F.col("_rank") > F.col(limit)
    final = Window.partitionBy(*keys).orderBy(*order)
    survivors = ranked.filter(~beyond).withColumn(
        output, F.row_number().over(final) <= F.col(limit)
    )
    rejected = ranked.filter(beyond).withColumn(output, F.lit(False))
    return survivors.unionByName(rejected).drop("_salt", "_rank")
