from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from journalsieve.operators.context import Context  # noqa: E402
from journalsieve.operators.prepare import prepare  # noqa: E402
from journalsieve.plans import flags  # noqa: E402
from journalsieve.config import AnalysisConfig  # noqa: E402
from journalsieve.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4",
        "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false",
        # the frames are tiny: compiling each plan would take most of the time
        "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


DEFAULTS = {"datum": "2024-01-15", "betrag": "100,00", "konto_soll": "62000", "konto_haben": "",
            "buchungstext": "Wartung Maschine", "belegnummer": "", "kreditor": ""}


@pytest.fixture
def raw(spark):
    """A raw journal from per-row differences to the defaults; row ids count from 0."""
    def make(rows: list[dict]):
        names = sorted({*DEFAULTS, *(n for row in rows for n in row)})
        data = [(i, *[str({**DEFAULTS, **row}.get(n, "")) for n in names])
                for i, row in enumerate(rows)]
        return spark.createDataFrame(
            data, "row_id long, " + ", ".join(f"{n} string" for n in names))
    return make


@pytest.fixture
def flagged(raw):
    """Sorted ids of the rows one test flags."""
    def run(name: str, rows: list[dict], labels=None, vectors=None, **config):
        context = Context(prepare(raw(rows)), AnalysisConfig(**config), vectors, labels)
        return sorted(r.row_id for r in flags.run_single_test(context, name).collect())
    return run
