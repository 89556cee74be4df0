"""Amount outliers against the account class and against the own account."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from journalsieve.functions.accounts import is_pnl
from journalsieve.operators.context import Context
from journalsieve.operators.parts import Lookup, Part, Predicate, counted_amounts
from journalsieve.operators.series import account_moments
from journalsieve.schema import PNL_CLASSES


def _any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def betrag_zscore(ctx: Context) -> list[Part]:
    limit = ctx.config.zscore_threshold
    far = []
    for kind in PNL_CLASSES:
        m = ctx.moments.get(kind)
        if m and m.n >= 2 and m.std > 0:
            far.append((F.col("_kontoklasse") == kind)
                       & ((F.col("_abs") - F.lit(m.mean)) / F.lit(m.std) > limit))
    return [Predicate(counted_amounts() & _any_of(far))]


def betrag_iqr(ctx: Context) -> list[Part]:
    c = ctx.config
    beyond = []
    for kind in PNL_CLASSES:
        n, low, high = ctx.quartiles.get(kind, (0, 0.0, 0.0))
        if n >= 4 and high > low:
            fence = high + c.iqr_factor * (high - low)
            beyond.append((F.col("_kontoklasse") == kind) & (F.col("_abs") > fence)
                          & (F.col("_abs") > c.iqr_min_betrag))
    return [Predicate(counted_amounts() & _any_of(beyond))]


def account_limits(months: DataFrame, sigma: float, min_rows: int) -> DataFrame:
    """Upper and lower amount limit of every profit-and-loss account with enough postings."""
    spread = F.lit(sigma) * F.col("konto_std")
    return (
        account_moments(months)
        .filter(is_pnl(F.col("_kontoklasse")) & (F.col("konto_soll") != "")
                & (F.col("konto_count") >= min_rows))
        .select("konto_soll", "konto_count",
                (F.col("konto_mean") + spread).alias("upper_limit"),
                F.greatest(F.col("konto_mean") - spread, F.lit(0.0)).alias("lower_limit"))
    )


def konto_betrag_anomalie(ctx: Context) -> list[Part]:
    c = ctx.config
    limits = account_limits(ctx.account_months, c.konto_betrag_sigma, c.konto_min_buchungen)
    outside = (F.col("_abs") > F.col("upper_limit")) | (F.col("_abs") < F.col("lower_limit"))
    hit = counted_amounts() & is_pnl(F.col("_kontoklasse")) & outside
    return [Lookup(limits.drop("konto_count"), ["konto_soll"], hit)]
