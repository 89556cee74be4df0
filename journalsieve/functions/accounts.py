"""Account classes and the sign of a posting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from journalsieve.functions.text import strip
from journalsieve.schema import (
    CLASS_BALANCE, CLASS_COSTING, CLASS_EXPENSE, CLASS_INCOME, COSTING_FROM, CREDIT_MARKS,
    DEBIT_MARKS, EXPENSE_RANGE, INCOME_RANGE, PNL_CLASSES,
)


def account_number(c: Column) -> Column:
    """Digits of the account field as a number; NULL without digits."""
    return F.regexp_replace(c, r"\D", "").try_cast("double")


def account_class(number: Column) -> Column:
    """Class of an account number; accounts without digits count as balance accounts."""
    return (
        F.when(number.between(*INCOME_RANGE), CLASS_INCOME)
        .when(number.between(*EXPENSE_RANGE), CLASS_EXPENSE)
        .when(number >= COSTING_FROM, CLASS_COSTING)
        .otherwise(CLASS_BALANCE)
    )


def is_pnl(kind: Column) -> Column:
    return kind.isin(PNL_CLASSES)


def side(c: Column) -> Column:
    """``S`` for debit, ``H`` for credit, NULL when the marker is missing or unknown."""
    mark = F.upper(strip(c))
    return F.when(mark.isin(DEBIT_MARKS), "S").when(mark.isin(CREDIT_MARKS), "H")


def signed_amount(amount: Column, kind: Column, booked_side: Column) -> Column:
    """Income grows on credit, expense on debit; other classes keep the booked sign."""
    own = F.when(kind == CLASS_INCOME, "H").when(kind == CLASS_EXPENSE, "S")
    return F.when(own == booked_side, F.abs(amount)).when(own != booked_side, -F.abs(amount)) \
        .otherwise(amount)
