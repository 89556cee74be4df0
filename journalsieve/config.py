"""Thresholds of one analysis run."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Mapping

# field -> (lowest, highest) accepted value; None means open
_BOUNDS: dict[str, tuple[float | None, float | None]] = {
    "zscore_threshold": (0.5, None),
    "iqr_factor": (0.5, None),
    "iqr_min_betrag": (0.0, None),
    "near_duplicate_days": (1, None),
    "near_duplicate_max_group_size": (2, None),
    "near_duplicate_regular_months": (2, None),
    "doppelte_beleg_min_count": (2, None),
    "doppelte_beleg_regular_months": (2, None),
    "beleg_kreditor_days": (1, None),
    "beleg_kreditor_max_group_size": (2, None),
    "beleg_kreditor_regular_pct": (0.05, 0.80),
    "new_kreditor_max_bookings": (1, None),
    "new_kreditor_amount_sigma": (0.0, None),
    "konto_betrag_sigma": (1.0, None),
    "konto_min_buchungen": (2, None),
    "monats_entwicklung_zscore": (1.0, None),
    "monats_entwicklung_min_monate": (2, None),
    "fehlende_buchung_min_quote": (0.1, 1.0),
    "output_threshold": (0.0, None),
    "max_output_rows": (0, None),
    "near_duplicate_text_similarity": (0.0, 1.0),
    "kreditor_clustering_eps": (0.01, 1.0),
    "isolation_contamination": (0.001, 0.5),
    "isolation_trees": (1, 1000),
    "isolation_sample": (2, 4096),
    "text_konto_threshold": (0.0, 1.0),
    "text_konto_min_bookings": (1, None),
    "text_konto_konto_min": (0, None),
    "text_konto_konto_max": (0, None),
}


@dataclass(frozen=True)
class AnalysisConfig:
    """All tunable limits; the defaults are the published ones."""

    # amounts
    zscore_threshold: float = 2.5
    iqr_factor: float = 3.0
    iqr_min_betrag: float = 10000.0
    # duplicates
    near_duplicate_days: int = 3
    near_duplicate_max_group_size: int = 10
    near_duplicate_regular_months: int = 6
    doppelte_beleg_min_count: int = 10
    doppelte_beleg_regular_months: int = 6
    doppelte_beleg_prefix_ignore: str = ""
    beleg_kreditor_days: int = 1
    beleg_kreditor_max_group_size: int = 20
    beleg_kreditor_regular_pct: float = 0.15
    # new vendors
    new_kreditor_max_bookings: int = 2
    new_kreditor_amount_sigma: float = 1.5
    # accounts
    konto_betrag_sigma: float = 3.0
    konto_min_buchungen: int = 5
    # time series
    monats_entwicklung_zscore: float = 3.0
    monats_entwicklung_min_monate: int = 3
    fehlende_buchung_min_quote: float = 0.5
    # output
    output_threshold: float = 2.0
    max_output_rows: int = 0
    # text vectors, clustering, isolation
    near_duplicate_text_similarity: float = 0.85
    kreditor_clustering_enabled: bool = True
    kreditor_clustering_eps: float = 0.20
    isolation_enabled: bool = False
    isolation_contamination: float = 0.02
    isolation_trees: int = 100
    isolation_sample: int = 256
    text_konto_threshold: float = 0.3
    text_konto_min_bookings: int = 5
    text_konto_konto_min: int = 40000
    text_konto_konto_max: int = 80000
    # learned weights
    custom_weights: Mapping[str, float] | None = None

    def __post_init__(self) -> None:
        for f in fields(self):
            low, high = _BOUNDS.get(f.name, (None, None))
            value = getattr(self, f.name)
            if low is not None and value < low:
                raise ValueError(f"{f.name}={value} is below {low}")
            if high is not None and value > high:
                raise ValueError(f"{f.name}={value} is above {high}")

    @property
    def ignored_prefixes(self) -> list[str]:
        parts = (p.strip().upper() for p in self.doppelte_beleg_prefix_ignore.split(","))
        return [p for p in parts if p]
