"""One analysis run over a journal."""

from __future__ import annotations

from functools import cached_property
from typing import Iterable

from pyspark.sql import DataFrame, functions as F

from journalsieve.config import AnalysisConfig
from journalsieve.operators.context import Context
from journalsieve.operators.prepare import (
    canonical_vendors, counterpart_accounts, with_canonical_columns, with_counterparts,
    with_typed_columns, with_voucher_id,
)
from journalsieve.operators.similarity_join import unit_vectors
from journalsieve.operators.text_vectors import text_vectors
from journalsieve.operators.vendor_clusters import vendor_clusters
from journalsieve.plans import flags, report, validation
from journalsieve.plans.registry import TESTS, FlagTest, checked
from journalsieve.workspace import settle


class Analysis:
    """Prepare, flag, score and export a journal with canonical column names.

    The prepared journal and the scored journal are each written once; everything else is a lazy
    DataFrame over them.  ``text_similarity`` turns on the text vectors: vendor names are clustered
    and near duplicates compared by similarity of their texts.  ``vectors`` (text, vector) are dense
    vectors of texts, labels and vendor names from any model; they turn text mode on and take the
    place of the trigrams in every comparison.  ``tests`` are the tests of the run, one's own among them.  ``labels`` (konto_soll,
    gt_bezeichnung) enables the comparison of texts with account labels.
    """

    def __init__(self, raw: DataFrame, config: AnalysisConfig | None = None,
                 labels: DataFrame | None = None, text_similarity: bool = False,
                 vectors: DataFrame | None = None, tests: Iterable[FlagTest] = TESTS):
        self.tests = checked(tests)
        self.config = config or AnalysisConfig()
        self.raw, self.labels, self.given = raw, labels, vectors
        self.text_similarity = text_similarity or vectors is not None

    @classmethod
    def of_prepared(cls, journal: DataFrame, config: AnalysisConfig | None = None,
                    **options) -> Analysis:
        """A run over an already prepared and written journal."""
        run = cls(journal, config, **options)
        run.__dict__["journal"] = journal
        return run

    @cached_property
    def dense(self) -> DataFrame | None:
        """The given vectors at unit length, written once."""
        return None if self.given is None else settle(unit_vectors(self.given), "dense_texts")

    @cached_property
    def journal(self) -> DataFrame:
        """The typed journal: the raw text is read and parsed once."""
        typed = with_typed_columns(with_canonical_columns(self.raw))
        journal = with_voucher_id(settle(typed, "journal"))
        if self.text_similarity and self.config.kreditor_clustering_enabled:
            names = journal.filter("kreditor != ''").groupBy("kreditor").agg(
                F.min("row_id").alias("first_row"))
            merged = settle(vendor_clusters(
                names, self.config.kreditor_clustering_eps, self.dense), "vendors")
            journal = settle(canonical_vendors(journal, merged), "journal")
        return journal

    @cached_property
    def prepared(self) -> DataFrame:
        """The typed journal with counter accounts filled in, as a lazy plan."""
        return with_counterparts(self.journal, counterpart_accounts(self.journal))

    @cached_property
    def context(self) -> Context:
        vectors = self.dense
        if self.text_similarity and vectors is None:
            vectors = settle(
                text_vectors(self.journal, "buchungstext").select("text", "gram", "weight"),
                "posting_vectors")
        return Context(self.journal, self.config, vectors, self.labels)

    def flagged(self, enabled: Iterable[str] | None = None) -> DataFrame:
        return flags.with_flags(self.context, enabled, self.tests)

    def score(self, enabled: Iterable[str] | None = None) -> DataFrame:
        """Flags, score and counter accounts as a lazy plan.

        The counter accounts are joined here and not while preparing: both joins on the row id share
        one shuffle of the journal.
        """
        scored = flags.with_score(self.flagged(enabled), self.config.custom_weights, self.tests)
        return with_counterparts(scored, counterpart_accounts(self.journal))

    @cached_property
    def scored(self) -> DataFrame:
        """Flags and score, written once."""
        return settle(self.score(), "scored")

    def scored_once(self) -> DataFrame:
        """Flags and score for a single reader: the written table if there is one, else a lazy plan, of
        which only the columns that are read get shuffled."""
        return self.scored if "scored" in self.__dict__ else self.score()

    def single_test(self, name: str) -> DataFrame:
        return flags.run_single_test(self.context, name, self.tests)

    def suspicious_rows(self) -> DataFrame:
        return report.suspicious_rows(self.scored, self.config, self.tests)

    def export(self) -> DataFrame:
        return report.export_projection(self.suspicious_rows(), self.tests)

    def flag_counts(self) -> DataFrame:
        return report.flag_counts(self.scored, self.tests)

    def statistics(self) -> DataFrame:
        return report.run_statistics(self.scored, self.config, self.tests)

    def readiness(self) -> DataFrame:
        """Which tests the columns of the journal allow; a column the journal lacks counts as missing."""
        profile = validation.column_profile(self.raw, validation.profiled_columns(self.tests))
        return validation.test_readiness(profile, self.tests)
