"""Column fill rates and which tests they allow."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from journalsieve.functions.text import strip
from journalsieve.plans.registry import TESTS, FlagTest, needs_of
from journalsieve.schema import CANONICAL_COLUMNS

SPARSE_BELOW = 50.0


def column_profile(journal: DataFrame, columns: list[str] = CANONICAL_COLUMNS) -> DataFrame:
    """(column_name, fill_pct, status): one pass over the journal, one row per column."""
    have = [c for c in columns if c in journal.columns]
    filled = [F.avg(F.when(F.coalesce(strip(c), F.lit("")) != "", 1.0).otherwise(0.0)).alias(c)
              for c in have]
    absent = [F.lit(None).cast("double").alias(c) for c in columns if c not in have]
    shares = journal.agg(F.count(F.lit(1)).alias("total"), *filled, *absent)
    pct = F.round(F.coalesce("share", F.lit(0.0)) * 100, 1)
    missing = F.col("column_name").isin([c for c in columns if c not in have])
    return (
        shares.unpivot(["total"], columns, "column_name", "share")
        .select("column_name", pct.alias("fill_pct"),
                F.when(missing, "missing").when(pct == 0, "empty")
                .when(pct < SPARSE_BELOW, "sparse").otherwise("ok").alias("status"))
    )


def profiled_columns(tests: Sequence[FlagTest] = TESTS) -> list[str]:
    """The canonical columns, and those that only tests of one's own read."""
    own = [c for required, optional in needs_of(tests).values() for c in (*required, *optional)]
    return list(dict.fromkeys([*CANONICAL_COLUMNS, *own]))


def _needs(profile: DataFrame, tests: Sequence[FlagTest]) -> DataFrame:
    rows = [
        (test, place, column, needed)
        for test, (required, optional) in needs_of(tests).items()
        for place, (column, needed) in enumerate(
            [(c, True) for c in required] + [(c, False) for c in optional])
    ]
    return profile.sparkSession.createDataFrame(
        rows, "test string, place int, column_name string, needed boolean")


def _listed(condition: Column, shown: Column) -> Column:
    items = F.array_sort(F.collect_list(F.when(condition, F.struct("place", shown.alias("s")))))
    return F.array_join(F.transform(items, lambda i: i["s"]), ", ")


def test_readiness(profile: DataFrame, tests: Sequence[FlagTest] = TESTS) -> DataFrame:
    """(test, status, reason): blocked without a required column, degraded when one is sparse or an
    optional one is empty."""
    needed, pct, name = F.col("needed"), F.col("fill_pct"), F.col("column_name")
    grouped = _needs(profile, tests).join(profile, "column_name").groupBy("test").agg(
        _listed(needed & (pct == 0), name).alias("blocked"),
        _listed(needed & (pct > 0) & (pct < SPARSE_BELOW),
                F.concat(name, F.format_string(" (%.0f%%)", pct))).alias("sparse"),
        _listed(~needed & (pct == 0), name).alias("optional"))
    return grouped.select(
        "test",
        F.when(F.col("blocked") != "", "blocked")
        .when((F.col("sparse") != "") | (F.col("optional") != ""), "degraded")
        .otherwise("ok").alias("status"),
        F.when(F.col("blocked") != "", F.concat("blocked", F.lit(" leer")))
        .when(F.col("sparse") != "", F.concat("sparse", F.lit(" dünn besetzt")))
        .when(F.col("optional") != "", F.concat("optional", F.lit(" leer → eingeschränkt")))
        .otherwise("").alias("reason"))


def validation_warnings(profile: DataFrame) -> DataFrame:
    """(column_name, fill_pct, warning) for debit/credit marks and counter accounts."""
    name, pct = F.col("column_name"), F.col("fill_pct")
    warning = (
        F.when((name == "soll_haben") & (pct == 0), "marker missing, booked sign is used")
        .when((name == "soll_haben") & (pct < SPARSE_BELOW), "marker sparse, signs partly inexact")
        .when((name == "konto_haben") & (pct < SPARSE_BELOW),
              "counter account sparse, filled from two-row vouchers")
    )
    return profile.select("column_name", "fill_pct", warning.alias("warning")).filter(
        "warning is not null")


def column_null_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, null_pct, warn): warn above one half."""
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    pct = F.round(F.coalesce("share", F.lit(0.0)) * 100, 1)
    return shares.unpivot([], columns, "column_name", "share").select(
        "column_name", pct.alias("null_pct"), (F.col("share") > 0.5).alias("warn"))
