"""Computing an expensive column exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that the optimizer will not copy into later filters and projections.

    A filter on a plain computed column is pushed below it with the expression
    copied in, once per use; for JSON parsing that multiplies the work. A generator
    of one row stays where it is.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(value)).alias(name))
