"""Spark-native anomaly analytics for double-entry booking journals."""

from journalsieve.config import AnalysisConfig
from journalsieve.plans.analysis import Analysis
from journalsieve.sources.journal_csv import read_journal_csv

__all__ = ["Analysis", "AnalysisConfig", "read_journal_csv"]
