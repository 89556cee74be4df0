"""Group-wise row selection that stays balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def rows_in_small_groups(rows: DataFrame, keys: list[str], max_size: int,
                         tie: str = "row_id") -> DataFrame:
    """Rows of the groups with at most ``max_size`` rows, plus their ``group_rows``.

    Only ``max_size + 1`` rows of a group are needed to know that it is too large.  Filtering on the
    row number lets the engine apply that limit before the shuffle as well, so a group holding a
    third of all rows sends a handful of rows per map task.  Groups within the limit arrive
    complete; the result is exact.
    """
    members = Window.partitionBy(*keys)
    return (
        rows.withColumn("_place", F.row_number().over(members.orderBy(tie)))
        .filter(F.col("_place") <= max_size + 1)
        .withColumn("group_rows", F.count(F.lit(1)).over(members))
        .filter(F.col("group_rows") <= max_size)
        .drop("_place")
    )


def distinct_over(column, members) -> F.Column:
    """Distinct non-null values inside an already bounded group."""
    return F.size(F.collect_set(column).over(members))
