"""The registered tests, in the order in which their names appear in the flag string."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Iterable

from journalsieve.operators import (
    amounts, duplicates, isolation, postings, series, text_match, vendors,
)
from journalsieve.operators.context import Context
from journalsieve.operators.parts import Part
from journalsieve.schema import TEST_COLUMNS


@dataclass(frozen=True)
class FlagTest:
    """A plug-in test: name, score weight, whether it alone makes a row suspicious, and the rule.

    ``required`` and ``optional`` are the journal columns it reads; the registered tests have theirs in
    ``TEST_COLUMNS``.  A run takes any sequence of tests, ``[*TESTS, own]`` for one's own beside the
    registered ones: flags, score, export, figures and readiness follow that sequence.
    """

    name: str
    weight: float
    critical: bool
    rule: Callable[[Context], list[Part]]
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()

    @property
    def column(self) -> str:
        return f"flag_{self.name}"


# fixed values: names, weights and the critical mark
TESTS: tuple[FlagTest, ...] = (
    FlagTest("BETRAG_ZSCORE", 2.0, True, amounts.betrag_zscore),
    FlagTest("BETRAG_IQR", 1.5, False, amounts.betrag_iqr),
    FlagTest("KONTO_BETRAG_ANOMALIE", 2.0, True, amounts.konto_betrag_anomalie),
    FlagTest("NEAR_DUPLICATE", 2.0, True, duplicates.near_duplicate),
    FlagTest("DOPPELTE_BELEGNUMMER", 2.0, True, duplicates.doppelte_belegnummer),
    FlagTest("BELEG_KREDITOR_DUPLIKAT", 2.5, True, duplicates.beleg_kreditor_duplikat),
    FlagTest("STORNO", 1.5, False, postings.storno),
    FlagTest("LEERER_BUCHUNGSTEXT", 1.0, False, postings.leerer_buchungstext),
    FlagTest("RECHNUNGSDATUM_PERIODE", 1.5, False, postings.rechnungsdatum_periode),
    FlagTest("BUCHUNGSTEXT_PERIODE", 1.0, False, postings.buchungstext_periode),
    FlagTest("NEUER_KREDITOR_HOCH", 2.5, True, vendors.neuer_kreditor_hoch),
    FlagTest("MONATS_ENTWICKLUNG", 1.5, False, series.monats_entwicklung),
    FlagTest("FEHLENDE_MONATSBUCHUNG", 1.0, False, series.fehlende_monatsbuchung),
    FlagTest("ISOLATION_ANOMALIE", 1.5, False, isolation.isolation_anomalie),
    FlagTest("TEXT_KONTO_MATCH", 2.0, False, text_match.text_konto_match),
)


def checked(tests: Iterable[FlagTest]) -> tuple[FlagTest, ...]:
    """The tests of a run; names tell their columns apart, so they must differ in more than case."""
    tests = tuple(tests)
    names = [t.name.lower() for t in tests]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if not tests or repeated:
        raise ValueError(f"tests of one name: {', '.join(repeated)}" if repeated else "a run needs at least one test")
    if any("|" in t.name for t in tests):
        raise ValueError("a test name cannot hold the sign that joins the names in the export")
    return tests


def needs_of(tests: Iterable[FlagTest]) -> dict[str, tuple[list[str], list[str]]]:
    """Test name -> (required, optional) columns, in the order of the tests."""
    return {t.name: TEST_COLUMNS.get(t.name, (list(t.required), list(t.optional))) for t in tests}


BY_NAME = {t.name: t for t in TESTS}
FLAG_NAMES = [t.name for t in TESTS]
WEIGHTS = {t.name: t.weight for t in TESTS}
MAX_SCORE = sum(WEIGHTS.values())
