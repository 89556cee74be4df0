"""Canonical journal schema and the word lists the flags depend on."""

from __future__ import annotations

# --- fixed values: canonical column -> accepted header spellings, in matching order ---
COLUMN_ALIASES: dict[str, list[str]] = {
    "datum": ["datum", "date", "buchungsdatum", "belegdatum"],
    "betrag": ["betrag", "amount", "summe", "wert", "fibubetrag"],
    "konto_soll": ["konto_soll", "kontosoll", "soll", "sollkonto", "debit", "kontonummer"],
    "konto_haben": ["konto_haben", "kontohaben", "haben", "habenkonto", "credit"],
    "buchungstext": ["buchungstext", "text", "beschreibung", "verwendungszweck"],
    "belegnummer": ["belegnummer", "beleg", "belegnr", "beleg_nr", "voucher"],
    "kostenstelle": ["kostenstelle", "kst", "cost_center"],
    "kreditor": ["kreditor", "lieferant", "vendor", "supplier", "creditor", "bezeichnung"],
    "soll_haben": ["soll_haben", "sollhaben", "s_h", "sh", "soll/haben", "l"],
    "klasse": ["klasse", "class"],
    "belegart": ["belegart", "beleg_art"],
    "buchungsperiode": ["buchungsperiode", "periode", "period"],
    "erfassungsdatum": ["erfassungsdatum", "erfassungam", "erfassung_am", "created_at"],
    "kostentraeger": ["kostentraeger"],
    "projekt": ["projekt", "project"],
    "steuerschluessel": ["steuerschluessel"],
    "detailbetrag": ["detailbetrag", "detail_betrag"],
    "generalumgekehrt": ["generalumgekehrt", "storno_kz", "umkehr"],
    "dvbelegnummer": ["dvbelegnummer", "dv_belegnummer", "dv_beleg_nr"],
    "dvbuchungsnummer": ["dvbuchungsnummer", "dv_buchungsnummer"],
    "interne_belegnummer": ["interne_belegnummer", "internebelegnummer", "intern_beleg"],
    "mandant": ["mandant", "firma", "mandanten_nr"],
}

CANONICAL_COLUMNS: list[str] = list(COLUMN_ALIASES)

# --- fixed values: strings read as missing when a journal file is loaded ---
# the four journal literals, and the CSV reader's default list of missing-value spellings
NULL_LITERALS: list[str] = ["NULL", "null", "None", "none"]
CSV_NULL_LITERALS: list[str] = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- fixed values: reversal references that mean "no reversal" ---
NO_REVERSAL_REFERENCE: list[str] = [
    "", "0", "0.0", "0.00", "nan", "null", "none", "na", "n/a", "false", "nein", "no",
]

# --- fixed values: posting texts that say nothing ---
GENERIC_TEXTS: list[str] = [
    "diverse", "verschiedenes", "sonstiges", "test", "xxx", "---", "...", "k.a.",
    "keine angabe", "n/a", "na", "tbd", "todo",
]

# --- fixed values: spellings of an empty account or voucher field ---
BLANK_WORDS: list[str] = ["", "nan", "null", "none"]

# --- fixed values: account classes and their number ranges ---
CLASS_BALANCE = "Bestand"
CLASS_INCOME = "Ertrag"
CLASS_EXPENSE = "Aufwand"
CLASS_COSTING = "Kostenrechnung"
INCOME_RANGE = (40000, 59999)
EXPENSE_RANGE = (60000, 79999)
COSTING_FROM = 80000
PNL_CLASSES = [CLASS_INCOME, CLASS_EXPENSE]

# --- fixed values: debit and credit markers ---
DEBIT_MARKS = ["S", "SOLL"]
CREDIT_MARKS = ["H", "HABEN"]

# --- fixed values: columns of the suspicious-bookings export, in order ---
EXPORT_COLUMNS = [
    "datum", "konto_soll", "konto_haben", "betrag", "buchungstext", "belegnummer",
    "kostenstelle", "kreditor", "soll_haben",
]

# --- fixed values: which journal columns each test needs (required, optional) ---
TEST_COLUMNS: dict[str, tuple[list[str], list[str]]] = {
    "BETRAG_ZSCORE": (["betrag"], ["konto_soll"]),
    "BETRAG_IQR": (["betrag"], ["konto_soll"]),
    "KONTO_BETRAG_ANOMALIE": (["betrag"], ["konto_soll"]),
    "NEAR_DUPLICATE": (["kreditor", "betrag"],
                       ["buchungstext", "konto_soll", "datum", "soll_haben"]),
    "DOPPELTE_BELEGNUMMER": (["belegnummer"], []),
    "BELEG_KREDITOR_DUPLIKAT": (["belegnummer", "kreditor", "betrag"], []),
    "STORNO": (["betrag"], ["buchungstext", "generalumgekehrt"]),
    "NEUER_KREDITOR_HOCH": (["kreditor", "betrag", "datum"], []),
    "LEERER_BUCHUNGSTEXT": (["buchungstext"], []),
    "RECHNUNGSDATUM_PERIODE": (["datum"], ["erfassungsdatum", "buchungsperiode"]),
    "BUCHUNGSTEXT_PERIODE": (["buchungstext", "datum"], []),
    "MONATS_ENTWICKLUNG": (["betrag", "datum"], []),
    "FEHLENDE_MONATSBUCHUNG": (["datum"], ["konto_soll"]),
    "ISOLATION_ANOMALIE": (["betrag"], ["datum", "konto_soll"]),
    "TEXT_KONTO_MATCH": (["buchungstext", "konto_soll"], []),
}

# --- fixed values: reviewer labels and label counts that open statistics and training ---
REVIEW_LABELS = ["tp", "fp", "unsure"]
LABELS_FOR_STATS = 200
LABELS_FOR_TRAINING = 500
LABELS_PER_FLAG = 10
WEIGHT_BOUNDS = (0.1, 5.0)
