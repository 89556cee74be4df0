"""The ways a test can flag rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Predicate:
    """Flags rows by a condition on the row itself."""

    hit: Column


@dataclass(frozen=True)
class Lookup:
    """Flags rows by a condition on the row and a table joined on ``keys``.

    The table is a written one or derived from one, so the planner knows its size and picks the
    join: broadcast when it is small, else a shuffle join with skew splitting.
    """

    table: DataFrame
    keys: list[str]
    hit: Column


@dataclass(frozen=True)
class RowIds:
    """Flags the rows listed in a table with the single column ``row_id`` (each id once)."""

    rows: DataFrame


Part = Predicate | Lookup | RowIds


def counted_amounts() -> Column:
    """Rows that enter amount statistics: a real amount, not a reversal."""
    return (F.col("_abs") > 0) & ~F.col("_is_storno")
