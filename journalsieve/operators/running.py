"""Running totals over a whole table without bringing it into one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from journalsieve.workspace import settle

#: One range of rows for so many of the square root of their number.
PER_ROOT = 16


def with_total_before(rows: DataFrame, order: list[str], amount: str, count: int) -> DataFrame:
    """Adds ``before``: the sum of ``amount`` over all rows that come earlier in ``order``.

    The rows, ``count`` of them, are dealt into ranges of the order.  Ranges and their lengths both grow
    with the square root of the count; only the totals of the ranges meet in one task.  The ranges are
    written, so that a task run again finds the same ones.
    """
    ranged = settle(rows.repartitionByRange(math.isqrt(count) // PER_ROOT + 1, *order)
                    .withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.sum(amount).alias("_total"))
    totals = totals.select("_range", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_earlier"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.withColumn("before", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
            .join(totals, "_range").withColumn("before", F.col("before") + F.col("_earlier"))
            .drop("_range", "_earlier"))
