"""From canonical text columns to the typed journal every test reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from journalsieve.functions.accounts import account_class, account_number, side, signed_amount
from journalsieve.functions.amounts import parse_amounts
from journalsieve.functions.dates import month_index, parse_dates
from journalsieve.functions.text import strip
from journalsieve.operators.groups import rows_in_small_groups
from journalsieve.schema import BLANK_WORDS, CANONICAL_COLUMNS, NO_REVERSAL_REFERENCE

# fixed values: patterns of reversal, correction and period texts
_REVERSAL_TEXT = r"storno|stornierung|r[uü]ckbuchung|gutschrift.*storn"
_CORRECTION_TEXT = r"\bkorrektur\b"
_TEXT_PERIOD = r"\b\d{1,2}[/.]\d{4}\b"


def with_canonical_columns(raw: DataFrame) -> DataFrame:
    """All canonical columns, missing values as empty strings, and a row id.

    Without a source key the row id is drawn once here; the caller writes the prepared table before
    reading it twice, so both readers see the same ids.
    """
    have = set(raw.columns)
    extra = [F.col(f"`{c}`") for c in raw.columns if c not in CANONICAL_COLUMNS]
    if "row_id" not in have:
        extra.insert(0, F.monotonically_increasing_id().alias("row_id"))
    filled = [
        (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")).alias(c)
        for c in CANONICAL_COLUMNS
    ]
    return raw.select(*extra, *filled)


def has_reversal_reference(reference: Column) -> Column:
    cleaned = F.rtrim(strip(reference), F.lit(";"))
    return ~F.lower(cleaned).isin(NO_REVERSAL_REFERENCE)


def is_reversal_text(text: Column, amount: Column) -> Column:
    """Text that names a reversal, or a correction of a negative amount."""
    return F.lower(text).rlike(_REVERSAL_TEXT) | (
        (amount < 0) & F.lower(text).rlike(_CORRECTION_TEXT))


def named_month(period: Column) -> Column:
    """Month index of ``m/yyyy`` or ``mm.yyyy``; NULL without a period or beyond December.

    Without a period the cast gets NULL: a failing cast of a text raises inside, in every row.
    """
    month = F.nullif(F.substring_index(F.translate(period, ".", "/"), "/", 1), F.lit("")).try_cast("int")
    return F.when((period != "") & month.between(1, 12),
                  F.right(period, F.lit(4)).try_cast("int") * 12 + month - 1)


def has_system_voucher() -> Column:
    return ~F.lower(strip("dvbelegnummer")).isin(BLANK_WORDS)


def with_voucher_id(journal: DataFrame) -> DataFrame:
    """The system voucher number if any row of the journal has one, else the document number.

    The search for such a row ends at the first one.  With the answer known, the id is a plain
    column, so filters and pruning reach the scan through it.
    """
    any_present = not journal.filter(has_system_voucher()).isEmpty()
    chosen = "dvbelegnummer" if any_present else "belegnummer"
    return journal.withColumn("_beleg_id", strip(chosen))


def with_typed_columns(journal: DataFrame) -> DataFrame:
    """Amount, date, class, reversal and sign columns: projections only, one pass."""
    amount, text = F.col("_betrag"), F.col("buchungstext")
    typed = parse_amounts(journal, {"_betrag": "betrag"})
    typed = parse_dates(typed, {"_datum": "datum", "_erfasst": "erfassungsdatum",
                                "_periode": "buchungsperiode"})
    return (
        typed
        .withColumns({
            "_betrag": F.coalesce(amount, F.lit(0.0)),
            "_kontonummer": account_number(F.col("konto_soll")),
            **{c: strip(c) for c in
               ("konto_soll", "konto_haben", "kreditor", "belegnummer", "buchungstext")},
            "_ym": month_index(F.col("_datum")),
            "_ym_erfasst": month_index(F.col("_erfasst")),
            "_ym_periode": month_index(F.col("_periode")),
        })
        .withColumns({
            "_abs": F.abs(amount),
            "_kontoklasse": account_class(F.col("_kontonummer")),
            "_has_reference": has_reversal_reference(F.col("generalumgekehrt")),
            "_seite": side(F.col("soll_haben")),
            "_period_text": F.regexp_extract("buchungstext", _TEXT_PERIOD, 0),
            "_kreditor_canonical": F.col("kreditor"),
        })
        .withColumns({
            "_is_storno": F.col("_has_reference") | is_reversal_text(text, amount),
            "_betrag_signed": signed_amount(amount, F.col("_kontoklasse"), F.col("_seite")),
            "_ym_text": named_month(F.col("_period_text")),
        })
        .drop("_erfasst", "_periode", "_period_text")
    )


def counterpart_accounts(journal: DataFrame) -> DataFrame:
    """``row_id`` and the counter account read off the other row of a two-row voucher."""
    pairs = rows_in_small_groups(
        journal.select("row_id", "_beleg_id", "_abs", "konto_soll", "konto_haben"),
        ["_beleg_id"], 2).filter(F.col("group_rows") == 2)
    order = Window.partitionBy("_beleg_id").orderBy("row_id")

    def partner(c: str) -> Column:
        return F.coalesce(F.lag(c).over(order), F.lead(c).over(order))

    paired = pairs.withColumns({"other_abs": partner("_abs"), "other_konto": partner("konto_soll")})
    same_amount = (
        (F.col("_abs") > 0) & (F.col("other_abs") > 0)
        & (F.abs(F.col("_abs") - F.col("other_abs")) <= 0.01)
    )
    fillable = F.lower("konto_haben").isin(BLANK_WORDS) & ~F.lower("other_konto").isin(BLANK_WORDS)
    return paired.filter(same_amount & fillable).select(
        "row_id", F.col("other_konto").alias("inferred_konto"))


def with_counterparts(journal: DataFrame, inferred: DataFrame) -> DataFrame:
    """Fill empty counter accounts; joined on the unique row id, so no key can run hot."""
    return (
        journal.join(inferred, "row_id", "left")
        .withColumn("_konto_haben_inferred", F.col("inferred_konto").isNotNull())
        .withColumn("konto_haben", F.coalesce("inferred_konto", "konto_haben"))
        .drop("inferred_konto")
    )


def canonical_vendors(journal: DataFrame, names: DataFrame) -> DataFrame:
    """Replace vendor names by the canonical ones of ``names`` (kreditor, canonical)."""
    return (
        journal.drop("_kreditor_canonical").join(names, "kreditor", "left")
        .withColumn("_kreditor_canonical", F.coalesce("canonical", "kreditor"))
        .drop("canonical")
    )


def prepare(raw: DataFrame) -> DataFrame:
    """The typed journal without counter accounts.  ``raw`` carries canonical names (see
    ``map_columns``)."""
    return with_voucher_id(with_typed_columns(with_canonical_columns(raw)))
