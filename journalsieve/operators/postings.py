"""Tests on the posting itself: reversals, empty texts, period mismatches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from journalsieve.functions.accounts import is_pnl
from journalsieve.operators.context import Context
from journalsieve.operators.parts import Part, Predicate
from journalsieve.schema import GENERIC_TEXTS

_MAX_MONTHS_APART = 2


def sigma_limit(ctx: Context, sigma: float) -> Column:
    """Overall mean plus ``sigma`` deviations; out of reach when all amounts are equal."""
    m = ctx.overall
    return F.lit(m.mean + sigma * m.std if m.std > 0 else math.inf)


def storno(ctx: Context) -> list[Part]:
    text = F.lower("buchungstext")
    unreferenced = F.col("_is_storno") & ~F.col("_has_reference")
    large_credit_note = (
        text.contains("gutschrift") & ~text.contains("storn")
        & (F.col("_abs") > sigma_limit(ctx, 1.0))
    )
    return [Predicate(unreferenced | large_credit_note)]


def leerer_buchungstext(ctx: Context) -> list[Part]:
    text = F.col("buchungstext")
    empty = F.lower(text).isin(GENERIC_TEXTS) | (F.char_length(text) <= 2)
    return [Predicate(empty & is_pnl(F.col("_kontoklasse")))]


def comparison_month(journal: DataFrame) -> Column:
    """Month the posting is compared with: entry date if any row has one beside the document
    date, otherwise the posting period on the same condition, otherwise nothing."""
    entered, period = F.col("_ym_erfasst"), F.col("_ym_periode")
    dated = F.col("_ym").isNotNull()
    present = journal.agg(
        F.bool_or(dated & entered.isNotNull()).alias("entered"),
        F.bool_or(dated & period.isNotNull()).alias("period"),
    ).select(F.struct("entered", "period")).scalar()
    return F.when(present["entered"], entered).when(present["period"], period)


def rechnungsdatum_periode(ctx: Context) -> list[Part]:
    apart = F.abs(comparison_month(ctx.journal) - F.col("_ym"))
    return [Predicate((apart > _MAX_MONTHS_APART) & ~F.col("_is_storno"))]


def buchungstext_periode(ctx: Context) -> list[Part]:
    return [Predicate((F.col("_ym_text") != F.col("_ym")) & ~F.col("_is_storno"))]
