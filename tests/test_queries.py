"""Queries against their SQL counterparts at the smallest scale factor."""

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from journalsieve.oracles import ORACLES
from journalsieve.plans.analysis import Analysis
from journalsieve.queries import QUERIES, journal_of
from tools.check import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"
# the tests, and one query of every other kind; tools/check.py runs all of them
CHECKED = [
    "read_journal_csv", "prepared_parquet", "counterpart_account", "flags_parquet", "export_csv",
    "retain_last_n", "compare_runs", "test_readiness", "feedback_stats", "reweight",
    "text_konto_match", "threshold_sweep", "vendor_clusters", "canonical_vendor_join",
    "full_analysis_text", "intake_suspicious", "cosine_pairs", "downsample",
    "derive_dims", "debit_credit_balance", "global_stats", "save_run", "save_run_months", "merge_flags",
]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sql, name):
    frame = queries()[name](spark, FOLDER)
    got = pd.DataFrame([tuple(r) for r in frame.collect()], columns=frame.columns)
    want = sql.execute(oracle_sql()[name]).df()
    want = want.astype(object).where(want.notna(), None)
    pd.testing.assert_frame_equal(canonical(got), canonical(want))


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == {"isolation_anomalie"}
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns[0] == "row_id"


def test_lookups_of_equal_keys_meet_the_journal_once(spark):
    run = Analysis.of_prepared(journal_of(spark, FOLDER))
    plan = run.flagged()._jdf.queryExecution().optimizedPlan().toString()
    # account limits, account months and row ids
    assert plan.count("Join LeftOuter") == 3
