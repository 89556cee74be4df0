"""Reviewer labels, precision per flag, and learned weights."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from journalsieve.plans.registry import TESTS, FlagTest
from journalsieve.schema import (
    LABELS_FOR_STATS, LABELS_FOR_TRAINING, LABELS_PER_FLAG, REVIEW_LABELS, WEIGHT_BOUNDS,
)

# mandant comes last: it is the partition column of the stored table
LABEL_SCHEMA = (
    "analysis_timestamp string, row_index long, belegnummer string, anomaly_score double, "
    "anomaly_flags string, label string, pruefer string, kommentar string, labeled_at string, "
    "mandant string"
)


class TooFewLabels(Exception):
    """Raised when statistics or training are asked for before enough labels exist."""


def labelled_rows(reviewed: DataFrame, reviewer: str, analysed_at: str,
                  labelled_at: str | None = None) -> DataFrame:
    """Label records of the reviewed rows whose rating is a known label.

    ``reviewed`` has the exported columns plus ``bewertung`` and ``mandant``.
    """
    if not reviewer.strip():
        raise ValueError("a reviewer is needed to save labels")
    rating = F.lower(F.btrim("bewertung"))
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    return reviewed.withColumn("label", rating).filter(F.col("label").isin(REVIEW_LABELS)).select(
        F.lit(analysed_at).alias("analysis_timestamp"), F.col("row_id").alias("row_index"),
        "belegnummer", "anomaly_score", "anomaly_flags", "label",
        F.lit(reviewer.strip()).alias("pruefer"), F.lit("").alias("kommentar"),
        (F.lit(labelled_at) if labelled_at else now).alias("labeled_at"), "mandant")


def label_counts(labels: DataFrame) -> DataFrame:
    """Labels per client and overall, and what they open."""
    n = F.count(F.lit(1))
    return labels.rollup("mandant").agg(
        n.alias("n_labels"), (n >= LABELS_FOR_STATS).alias("stats_open"),
        (n >= LABELS_FOR_TRAINING).alias("training_open"),
    ).withColumn("mandant", F.coalesce("mandant", F.lit("ALL")))


def _require(labels: DataFrame, at_least: int, what: str) -> None:
    n = labels.limit(at_least).count()
    if n < at_least:
        raise TooFewLabels(f"{what} needs {at_least} labels, found {n}")


def _per_flag(labels: DataFrame) -> DataFrame:
    named = labels.select(F.explode(F.split("anomaly_flags", r"\|")).alias("flag"), "label")
    return named.withColumn("flag", F.btrim("flag")).filter("flag != ''")


def _tallies() -> list[Column]:
    return [F.count_if(F.col("label") == label).alias(label) for label in REVIEW_LABELS]


def feedback_stats(labels: DataFrame) -> DataFrame:
    """tp, fp, unsure, precision and false-positive rate per flag, plus the total row."""
    _require(labels, LABELS_FOR_STATS, "statistics")
    judged = F.col("tp") + F.col("fp")

    def rate(part: str) -> Column:
        return F.round(F.when(judged > 0, F.col(part) / judged).otherwise(0.0), 6)

    return (
        _per_flag(labels).rollup("flag").agg(*_tallies())
        .select(F.coalesce("flag", F.lit("GESAMT")).alias("flag"), *REVIEW_LABELS,
                rate("tp").alias("precision"), rate("fp").alias("fp_rate"))
    )


def reweight(labels: DataFrame, tests: Sequence[FlagTest] = TESTS) -> DataFrame:
    """(flag, weight): default weight times one half plus precision, for flags judged often
    enough; rounded to two decimals and clamped."""
    _require(labels, LABELS_FOR_TRAINING, "training")
    low, high = WEIGHT_BOUNDS
    defaults = F.create_map(*[F.lit(x) for t in tests for x in (t.name, float(t.weight))])
    judged = F.col("tp") + F.col("fp")
    learned = F.bround(F.col("default") * (0.5 + F.col("tp") / judged), 2)
    return (
        _per_flag(labels).groupBy("flag").agg(*_tallies())
        .withColumn("default", F.try_element_at(defaults, F.col("flag")))
        .filter(F.col("default").isNotNull() & (judged >= LABELS_PER_FLAG))
        .select("flag", F.greatest(F.lit(low), F.least(F.lit(high), learned)).alias("weight"))
    )


def learned_weights(labels: DataFrame, tests: Sequence[FlagTest] = TESTS) -> dict[str, float]:
    """The same as a mapping for the configuration: at most one entry per test."""
    return {r.flag: r.weight for r in reweight(labels, tests).collect()}
