"""Running totals and ranks over an order, without one task that sees a whole group.

Rows fall into BUCKETS slices of the order. Slices are totalled first (partial sums before the shuffle);
the totals, at most BUCKETS rows a group, give each slice its offset, and only the rows of one slice are
ever sorted together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def with_running_sum(df: DataFrame, group: list[str], slice_: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds out: the sum of value over the rows before this one, in order of slice_ (0 .. BUCKETS-1) and then order."""
    before = Window.partitionBy(*group).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, slice_).agg(F.sum(value).alias("_t")).withColumn("_off", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    inside = Window.partitionBy(*group, slice_).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(totals, [*group, slice_])
        .withColumn(out, (F.col("_off") + F.col("_in")).cast("bigint"))
        .drop("_off", "_in")
    )
