"""Amount statistics per account class and overall."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from journalsieve.operators.quantiles import exact_quantiles

TOTAL = "ALL"


class Moments(NamedTuple):
    n: int
    mean: float
    std: float


def moments_table(amounts: DataFrame) -> DataFrame:
    """One row per class plus the total; the rollup is combined before the shuffle."""
    return (
        amounts.rollup("_kontoklasse")
        .agg(F.count("_abs").alias("n"), F.avg("_abs").alias("mean"),
             F.coalesce(F.stddev_samp("_abs"), F.lit(0.0)).alias("std"))
        .filter("n > 0")
        .withColumn("_kontoklasse", F.coalesce("_kontoklasse", F.lit(TOTAL)))
    )


def quartiles_table(amounts: DataFrame, total: bool = True) -> DataFrame:
    """Exact quartiles (``q0``, ``q1``) per class and, if wanted, of the total."""
    if total:
        amounts = amounts.select("_abs", F.explode(F.array("_kontoklasse", F.lit(TOTAL))).alias("_kontoklasse"))
    return exact_quantiles(amounts, "_abs", [0.25, 0.75], ["_kontoklasse"])


def class_moments(amounts: DataFrame) -> dict[str, Moments]:
    """The table above as numbers: four classes and a total, whatever the journal's size.

    As literals they reach the scan as pushed filters.
    """
    return {r["_kontoklasse"]: Moments(r["n"], r["mean"], r["std"])
            for r in moments_table(amounts).collect()}


def class_quartiles(amounts: DataFrame) -> dict[str, tuple[int, float, float]]:
    return {r["_kontoklasse"]: (r["n"], r["q0"], r["q1"])
            for r in quartiles_table(amounts, total=False).collect()}


def global_stats(amounts: DataFrame, iqr_factor: float) -> DataFrame:
    """n, mean, deviation, interquartile range and fence over all counted amounts."""
    whole = amounts.select("_abs", F.lit(TOTAL).alias("_kontoklasse"))
    spread = exact_quantiles(whole, "_abs", [0.25, 0.75], ["_kontoklasse"]).select("_kontoklasse", "q0", "q1")
    iqr = F.col("q1") - F.col("q0")
    return (
        moments_table(amounts).filter(F.col("_kontoklasse") == TOTAL).join(spread, "_kontoklasse")
        .select(F.col("n").alias("n_vals"), F.col("mean").alias("b_mean"),
                F.col("std").alias("b_std"), iqr.alias("b_iqr"),
                (F.col("q1") + F.lit(iqr_factor) * iqr).alias("b_fence"))
    )
