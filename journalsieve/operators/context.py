"""What the tests of one run share: the prepared journal, limits and small statistics."""

from __future__ import annotations

import threading
from typing import Any, Callable

from pyspark.sql import DataFrame

from journalsieve.config import AnalysisConfig
from journalsieve.operators.parts import counted_amounts
from journalsieve.operators.series import account_months
from journalsieve.operators.stats import Moments, class_moments, class_quartiles
from journalsieve.workspace import settle


class Context:
    """``vectors`` are optional vectors of the posting texts: terms (text, gram, weight), or dense unit
    vectors (text, vector) of texts and labels.  ``labels`` are optional account labels (konto_soll,
    gt_bezeichnung).

    The tests of a run are set up concurrently; what they share is computed by whoever asks first.
    """

    def __init__(self, journal: DataFrame, config: AnalysisConfig | None = None,
                 vectors: DataFrame | None = None, labels: DataFrame | None = None):
        self.journal, self.config = journal, config or AnalysisConfig()
        self.vectors, self.labels = vectors, labels
        self._shared: dict[str, Any] = {}
        self._guard = threading.Lock()
        self._locks: dict[str, threading.Lock] = {}

    def _once(self, name: str, compute: Callable[[], Any]) -> Any:
        with self._guard:
            lock = self._locks.setdefault(name, threading.Lock())
        with lock:
            if name not in self._shared:
                self._shared[name] = compute()
            return self._shared[name]

    @property
    def moments(self) -> dict[str, Moments]:
        """Count, mean and deviation per account class: at most five aggregated rows."""
        return self._once("moments", lambda: class_moments(self.journal.filter(counted_amounts())))

    @property
    def overall(self) -> Moments:
        return self.moments.get("ALL", Moments(0, 0.0, 0.0))

    @property
    def quartiles(self) -> dict[str, tuple[int, float, float]]:
        return self._once(
            "quartiles", lambda: class_quartiles(self.journal.filter(counted_amounts())))

    @property
    def account_months(self) -> DataFrame:
        """One row per account and month, written once; both time series tests read it."""
        return self._once(
            "account_months", lambda: settle(account_months(self.journal), "account_months"))
