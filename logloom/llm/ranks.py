"""Places of rows in an order, without one task per group.

A window over a whole group would put a source with a third of all rows into one task. Here rows are
dealt by ranges of (group, order), so every range is a slice of one or a few groups; rows are numbered
inside (group, range) and the sizes of the ranges before are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.session import cut_lineage


def placed(df: DataFrame, group: list[str], order: list[Column], place: str = "place", width: str = "width") -> DataFrame:
    """`df` with each row's place in its group (from 0, by `order`) and the group's number of rows.

    Rows equal in group and order are told apart by where they were read, so copies of one row are cut
    into ranges as well; their places are interchangeable. The dealt rows are stored, since their
    ranges come from a sample and must not change between counting and numbering. Columns whose names
    start with two underscores are reserved.
    """
    if clash := [c for c in df.columns if c.startswith("__")]:
        raise ValueError(f"reserved column names: {clash}")
    key = F.struct(*group)
    keyed = df.select("*", key.alias("__group"), *[c.alias(f"__by{n}") for n, c in enumerate(order)])
    by = [f"__by{n}" for n in range(len(order))]
    # a nondeterministic column cannot be a sort expression itself
    keyed = keyed.withColumn("__read", F.monotonically_increasing_id())
    dealt = cut_lineage(
        keyed.repartitionByRange(F.col("__group"), *[F.col(b) for b in by], F.col("__read"))
        .withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy("__group", "__range").agg(F.count("*").alias("__rows"))
    whole = Window.partitionBy("__group")
    before = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__group", "__range", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"),
        F.sum("__rows").over(whole).alias(width))
    inside = Window.partitionBy("__group", "__range").orderBy(*by, "__read")
    numbered = dealt.withColumn("__nth", F.row_number().over(inside))
    return numbered.join(offsets, ["__group", "__range"]).select(
        *df.columns, (F.col("__before") + F.col("__nth") - 1).cast("bigint").alias(place), F.col(width).cast("bigint"))
