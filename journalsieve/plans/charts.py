"""Data behind the charts; drawing is left to the front end."""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from journalsieve.functions.accounts import is_pnl
from journalsieve.functions.amounts import NUMBER
from journalsieve.functions.dates import month_label
from journalsieve.operators.quantiles import draw_of_rank
from journalsieve.plans.registry import TESTS, FlagTest

CHART_ROWS = 500_000
BINS = 50
# fixed values: weekday names in chart order, bin edges and labels
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
RISK_BINS = [(0, "Unauffällig"), (2, "Niedrig"), (4, "Mittel"), (math.inf, "Hoch")]
AMOUNT_BINS = [(100, "<100€"), (1000, "100-1k€"), (10000, "1k-10k€"), (100000, "10k-100k€"),
               (math.inf, ">100k€")]


def _binned(value: Column, above: float, bins: list[tuple[float, str]]) -> Column:
    """Label of the right-closed bin; NULL at or below ``above``."""
    label = F.when(value <= above, None)
    for edge, name in bins:
        label = label.when(value <= F.lit(float(edge)), name)
    return label


def weekday_name(day: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.weekday(day) + 1)


def derive_dims(scored: DataFrame, tests: Sequence[FlagTest] = TESTS) -> DataFrame:
    """Calendar, risk and amount classes for free chart building."""
    day = F.col("_datum")
    raised = sum((F.col(t.column).cast("int") for t in tests[1:]), F.col(tests[0].column).cast("int"))
    return scored.withColumns({
        "Wochentag": weekday_name(day),
        "Monat": month_label(F.col("_ym")),
        "Quartal": F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string")),
        "Kalenderwoche": F.weekofyear(day),
        "Risiko-Kategorie": _binned(F.col("_score"), -0.01, RISK_BINS),
        "Betrags-Klasse": _binned(F.col("_abs"), 0.0, AMOUNT_BINS),
        "Anzahl_Flags": raised,
    })


def downsample(scored: DataFrame, max_rows: int = CHART_ROWS, seed: int = 42) -> DataFrame:
    """All rows with a score, filled up at random to ``max_rows``.

    The fill takes the rows with the smallest hash.  Counts of the hash's leading digits, then of the
    next ones inside the one cell that is taken in part, find the exact cut; the rows are only filtered.
    """
    counts = scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_score") > 0).alias("hot"))
    n, hot = counts.head()
    if n <= max_rows:
        return scored
    wanted, rest = max(0, max_rows - hot), n - hot
    flagged, quiet = scored.filter("_score > 0"), scored.filter("_score <= 0")
    if wanted == 0 or rest <= wanted:
        # the published rule keeps the whole rest when nothing may be filled up
        return scored
    draw = F.md5(F.concat(F.lit(f"{seed}-"), F.col("row_id").cast("string")))
    return flagged.union(quiet.filter(draw < draw_of_rank(quiet.select(draw.alias("draw")), wanted)))


def score_histogram(scored: DataFrame) -> DataFrame:
    """Row counts of fifty equal score bins, with the mean score for the marker line."""
    span = scored.agg(F.min("_score").alias("low"), F.max("_score").alias("high"),
                      F.round(F.avg("_score"), 2).alias("mean"))
    low, high = span.select("low").scalar(), span.select("high").scalar()
    width = (high - low) / BINS
    place = F.when(width > 0, F.least(F.floor((F.col("_score") - low) / width), F.lit(BINS - 1))) \
        .otherwise(F.lit(0))
    return (
        scored.groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        .select("bin", F.round(low + F.col("bin") * width, 6).alias("lower"), "n",
                span.select("mean").scalar().alias("mean_score"))
    )


def flag_frequency(counts: DataFrame) -> DataFrame:
    return counts.filter("n > 0").orderBy("n", "flag")


def monthly_pnl(journal: DataFrame) -> DataFrame:
    """Signed amounts per month and account class."""
    return (
        journal.filter("_ym is not null").groupBy("_ym", "_kontoklasse")
        .agg(F.round(F.sum("_betrag_signed"), 2).alias("summe"))
        .select(month_label(F.col("_ym")).alias("monat"),
                F.col("_kontoklasse").alias("kontoklasse"), "summe")
    )


def income_expense_monthly(journal: DataFrame) -> DataFrame:
    return monthly_pnl(journal.filter(is_pnl(F.col("_kontoklasse"))))


def volume_heatmap(journal: DataFrame) -> DataFrame:
    """Postings per weekday and month, Monday first."""
    return (
        journal.filter("_ym is not null")
        .groupBy(F.weekday("_datum").alias("day"), "_ym").agg(F.count(F.lit(1)).alias("n"))
        .orderBy("day", "_ym")
        .select(F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]),
                             F.col("day") + 1).alias("wochentag"),
                month_label(F.col("_ym")).alias("monat"), "n")
    )


def top_accounts(scored: DataFrame, n: int = 10) -> DataFrame:
    """Accounts by mean score of their flagged rows."""
    return (
        scored.filter("_score > 0").groupBy("konto_soll")
        .agg(F.avg("_score").alias("mean"), F.count(F.lit(1)).alias("n_flagged"))
        .orderBy(F.desc("mean"), "konto_soll").limit(n)
        .select("konto_soll", F.round("mean", 6).alias("avg_score"), "n_flagged")
    )


def amount_vs_score(scored: DataFrame, tests: Sequence[FlagTest] = TESTS) -> DataFrame:
    """Amount, score and the first raised flag in registry order of every flagged row."""
    first = F.coalesce(*[F.when(F.col(t.column), t.name) for t in tests])
    return scored.filter("_score > 0").select("row_id", "_abs", "_score", first.alias("top_flag"))


def vendor_treemap(scored: DataFrame, n: int = 30) -> DataFrame:
    """Vendors with two or more postings by amount."""
    return (
        scored.filter("kreditor != ''").groupBy("kreditor")
        .agg(F.round(F.sum("_abs"), 2).alias("summe"), F.round(F.avg("_score"), 6).alias("avg_score"),
             F.count(F.lit(1)).alias("n"))
        .filter("n >= 2").orderBy(F.desc("summe"), "kreditor").limit(n)
    )


def account_timeline(scored: DataFrame, account: str | None = None) -> DataFrame:
    """Dated postings of one account; by default the account with the highest mean score."""
    if account is None:
        chosen = top_accounts(scored, 1).select("konto_soll").scalar()
    else:
        chosen = F.lit(account)
    return (
        scored.filter((F.col("konto_soll") == chosen) & F.col("_datum").isNotNull())
        .orderBy("_datum", "row_id")
        .select("row_id", "konto_soll", F.date_format("_datum", "yyyy-MM-dd").alias("datum"),
                "_betrag", (F.col("_score") > 0).alias("anomalie"))
    )


def debit_credit_balance(journal: DataFrame, n: int = 15) -> DataFrame:
    """Signed sums of debit and credit rows per account, by difference."""
    mark = F.col("_seite")

    def total(s: str) -> Column:
        return F.coalesce(F.sum(F.when(mark == s, F.col("_betrag_signed"))), F.lit(0.0))

    return (
        journal.filter(mark.isNotNull()).groupBy("konto_soll")
        .agg(F.round(total("S"), 2).alias("soll"), F.round(total("H"), 2).alias("haben"))
        .withColumn("diff", F.round(F.abs(F.col("soll") - F.col("haben")), 2))
        .orderBy(F.desc("diff"), "konto_soll").limit(n)
    )


def landscape_3d(scored: DataFrame) -> DataFrame:
    """Amount, account number and days since the first posting."""
    first = scored.agg(F.min("_datum")).scalar()
    # the cast alone accepts type suffixes and names of special numbers
    number = F.when(F.trim("konto_soll").rlike(NUMBER), F.col("konto_soll").try_cast("double"))
    return (
        scored.filter(F.col("_datum").isNotNull() & number.isNotNull())
        .select("row_id", "_abs", number.alias("konto_num"),
                F.datediff(F.col("_datum"), first).alias("tage"), "_score")
    )
