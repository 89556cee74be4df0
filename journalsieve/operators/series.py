"""Account-by-month table and the time series tests."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window, functions as F

from journalsieve.functions.accounts import is_pnl
from journalsieve.operators.parts import Lookup, Part, counted_amounts

if TYPE_CHECKING:
    from journalsieve.operators.context import Context

MIN_ROWS = 10
MIN_MONTHS = 3
MIN_SPAN = 6


def account_months(journal: DataFrame) -> DataFrame:
    """Per account and month: counts, sums and squared deviations.

    Undated postings form a month of their own.  Account limits, both series tests and the run
    history are derived from this table, so the journal is grouped by account once; the sums are
    combined before the shuffle, whatever share of the rows one account holds.
    """
    real = F.col("_abs") > 0
    counted = F.when(real & ~F.col("_is_storno"), F.col("_abs"))
    return (
        journal.groupBy("konto_soll", "_kontoklasse", "_ym")
        .agg(
            F.count(counted).alias("n_counted"),
            F.sum(counted).alias("counted_sum"),
            (F.var_pop(counted) * F.count(counted)).alias("squares"),
            F.count_if(~F.col("_is_storno") & (F.col("konto_soll") != "")).alias("n_booked"),
            F.count_if(real).alias("n_real"),
            F.sum(F.when(real, F.col("_abs"))).alias("real_sum"),
        )
    )


def account_moments(months: DataFrame) -> DataFrame:
    """Count, mean and sample deviation of the counted amounts per account, merged from the months:
    squares inside the months plus squares of the months around the account's mean."""
    per_account = Window.partitionBy("konto_soll")
    n, total = F.col("n_counted"), F.col("counted_sum")
    mean = F.sum(total).over(per_account) / F.sum(n).over(per_account)
    around = F.col("squares") + n * F.pow(total / n - F.col("mean"), 2)
    count = F.sum(n)
    return (
        months.filter(n > 0).withColumn("mean", mean).withColumn("around", around)
        .groupBy("konto_soll", "_kontoklasse")
        .agg(count.alias("konto_count"), F.first("mean").alias("konto_mean"),
             F.when(count > 1, F.sqrt(F.sum("around") / (count - 1))).otherwise(0.0)
             .alias("konto_std"))
    )


def _facts(table: DataFrame, **figures: Column) -> Column:
    """Journal-wide figures as one scalar subquery over the monthly table."""
    one_row = table.agg(*[column.alias(name) for name, column in figures.items()])
    return one_row.select(F.struct(*figures)).scalar()


def monthly_outliers(months: DataFrame, zscore: float, min_months: int) -> DataFrame:
    """Months of a profit-and-loss account whose sum is far from the account's usual month."""
    per_account = Window.partitionBy("konto_soll")
    pnl = months.filter(is_pnl(F.col("_kontoklasse")) & F.col("_ym").isNotNull()
                        & (F.col("n_counted") > 0))
    enough = _facts(pnl, rows=F.sum("n_counted"))["rows"] >= MIN_ROWS
    std = F.col("std")
    return (
        pnl.withColumns({
            "mean": F.avg("counted_sum").over(per_account),
            "std": F.coalesce(F.stddev_samp("counted_sum").over(per_account), F.lit(0.0)),
            "n_months": F.count(F.lit(1)).over(per_account),
        })
        .filter((F.col("n_months") >= min_months) & (std > 0) & enough)
        .filter(F.abs(F.col("counted_sum") - F.col("mean")) / std > zscore)
        .select("konto_soll", "_ym")
    )


def months_beside_gaps(months: DataFrame, min_share: float) -> DataFrame:
    """Booked months of a regularly used account that touch a month without booking.

    Gaps count over the span of the whole journal, so the first or last own month of an account
    qualifies when the journal reaches further.
    """
    booked = months.filter("n_booked > 0 and _ym is not null").select("konto_soll", "_ym", "n_booked")
    facts = _facts(booked, rows=F.sum("n_booked"), used=F.count_distinct("_ym"),
                   first=F.min("_ym"), last=F.max("_ym"))
    first, last = facts["first"], facts["last"]
    span = last - first + 1
    enough = ((facts["rows"] >= MIN_ROWS) & (facts["used"] >= MIN_MONTHS) & (span >= MIN_SPAN))
    active_from = F.greatest(F.lit(MIN_MONTHS), F.floor(span * F.lit(min_share)))
    per_account = Window.partitionBy("konto_soll")
    by_month = per_account.orderBy("_ym")
    ym = F.col("_ym")
    gap_before = (ym > first) & ~F.coalesce(F.col("previous") == ym - 1, F.lit(False))
    gap_after = (ym < last) & ~F.coalesce(F.col("following") == ym + 1, F.lit(False))
    return (
        booked.withColumns({
            "n_months": F.count(F.lit(1)).over(per_account),
            "previous": F.lag("_ym").over(by_month),
            "following": F.lead("_ym").over(by_month),
        })
        .filter(enough & (F.col("n_months") >= active_from) & (gap_before | gap_after))
        .select("konto_soll", "_ym")
    )


def outlier_months(ctx: Context) -> DataFrame:
    c = ctx.config
    return monthly_outliers(ctx.account_months, c.monats_entwicklung_zscore,
                            c.monats_entwicklung_min_monate)


def monats_entwicklung(ctx: Context) -> list[Part]:
    spikes = outlier_months(ctx).withColumn("spike_month", F.lit(True))
    hit = F.col("spike_month") & counted_amounts() & is_pnl(F.col("_kontoklasse"))
    return [Lookup(spikes, ["konto_soll", "_ym"], hit)]


def fehlende_monatsbuchung(ctx: Context) -> list[Part]:
    gaps = months_beside_gaps(ctx.account_months, ctx.config.fehlende_buchung_min_quote)
    hit = F.col("gap_month") & ~F.col("_is_storno") & (F.col("konto_soll") != "")
    return [Lookup(gaps.withColumn("gap_month", F.lit(True)), ["konto_soll", "_ym"], hit)]
