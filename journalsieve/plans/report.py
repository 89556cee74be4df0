"""From scored rows to the export and the run figures."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from journalsieve.config import AnalysisConfig
from journalsieve.plans.registry import TESTS, FlagTest
from journalsieve.schema import EXPORT_COLUMNS


def suspicious(config: AnalysisConfig, tests: Sequence[FlagTest] = TESTS) -> Column:
    """Score at the threshold, or any critical flag."""
    critical = reduce(lambda a, b: a | b, [F.col(t.column) for t in tests if t.critical], F.lit(False))
    return (F.col("_score") >= config.output_threshold) | critical


def flag_string(tests: Sequence[FlagTest] = TESTS) -> Column:
    """Names of the raised flags, joined in registry order."""
    return F.concat_ws("|", *[F.when(F.col(t.column), t.name) for t in tests])


def suspicious_rows(scored: DataFrame, config: AnalysisConfig, tests: Sequence[FlagTest] = TESTS) -> DataFrame:
    """Suspicious rows, highest score first; a row limit only when the configuration sets one."""
    rows = scored.filter(suspicious(config, tests)).orderBy(F.desc("_score"), "row_id")
    return rows.limit(config.max_output_rows) if config.max_output_rows else rows


def export_projection(rows: DataFrame, tests: Sequence[FlagTest] = TESTS) -> DataFrame:
    """The published columns; the score rounds half to even."""
    date = F.coalesce(F.date_format("_datum", "yyyy-MM-dd"), F.col("datum"))
    shown = {"datum": date, "betrag": F.col("_betrag")}
    return rows.select(
        "row_id", *[shown.get(c, F.col(c)).alias(c) for c in EXPORT_COLUMNS],
        F.bround("_score", 2).alias("anomaly_score"), flag_string(tests).alias("anomaly_flags"))


def flag_counts(scored: DataFrame, tests: Sequence[FlagTest] = TESTS) -> DataFrame:
    """(flag, n) for every test, from one pass."""
    names = [t.name for t in tests]
    return scored.agg(*[
        F.count_if(F.col(t.column)).alias(t.name) for t in tests
    ]).unpivot([], names, "flag", "n")


def run_statistics(scored: DataFrame, config: AnalysisConfig, tests: Sequence[FlagTest] = TESTS) -> DataFrame:
    """Totals of a run in one pass; an empty journal gives zeros."""
    total, found = F.col("total_input"), F.col("total_suspicious")
    pct = F.when(total > 0, found / total * 100).otherwise(0.0)
    limit = config.max_output_rows
    output = F.least(found, F.lit(limit)) if limit else found
    return scored.agg(
        F.count(F.lit(1)).alias("total_input"),
        F.count_if(suspicious(config, tests)).alias("total_suspicious"),
        F.coalesce(F.round(F.avg("_score"), 2), F.lit(0.0)).alias("avg_score"),
        F.coalesce(F.max("_score"), F.lit(0.0)).alias("max_score"),
    ).select(
        "total_input", "total_suspicious", output.alias("total_output"),
        F.format_string("%.1f%%", pct).alias("filter_ratio"),
        F.round(pct, 2).alias("suspicious_pct"), "avg_score", "max_score",
        F.lit(float(sum(t.weight for t in tests))).alias("max_possible_score"))
