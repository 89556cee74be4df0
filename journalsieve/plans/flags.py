"""Running tests: one test to row ids, all tests to flag columns and a score."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Iterable, Sequence

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, functions as F

from journalsieve.operators.context import Context
from journalsieve.operators.parts import Lookup, Part, Predicate, RowIds
from journalsieve.plans.registry import TESTS, FlagTest
from journalsieve.schema import EXPORT_COLUMNS
from journalsieve.workspace import settle

SETUP_JOBS = 4
_KEPT = {"row_id", "mandant", *EXPORT_COLUMNS}


def _rows_of(ctx: Context, part: Part) -> DataFrame:
    if isinstance(part, RowIds):
        return part.rows
    rows = ctx.journal
    if isinstance(part, Lookup):
        rows = rows.join(part.table, part.keys)
    return rows.filter(part.hit).select("row_id")


def _named(tests: Sequence[FlagTest], name: str) -> FlagTest:
    return next(t for t in tests if t.name == name)


def run_single_test(ctx: Context, name: str, tests: Sequence[FlagTest] = TESTS) -> DataFrame:
    """The ids of the rows one test flags."""
    found = [_rows_of(ctx, part) for part in _named(tests, name).rule(ctx)]
    if not found:
        return ctx.journal.select("row_id").filter(F.lit(False))
    ids = reduce(DataFrame.union, found)
    return ids.distinct() if len(found) > 1 else ids


def _or(hits: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in hits], F.lit(False))


def with_flags(ctx: Context, enabled: Iterable[str] | None = None, tests: Sequence[FlagTest] = TESTS) -> DataFrame:
    """One boolean column per test beside the exported and typed columns of the journal; disabled
    tests are false throughout.  Source columns no later step reads are not carried along.

    Row conditions become a projection.  Lookup tables of the same keys are joined with each other
    first, so the journal meets them once, and written: by its real size a small one is broadcast
    before the journal is shuffled for it.  The tests that deliver
    row ids are united, folded to one row per id and joined once on the unique id: a single shuffle
    of the journal, on a key that cannot run hot.
    """
    wanted = {t.name for t in tests} if enabled is None else set(enabled)
    df, listed = ctx.journal, []
    hits: dict[str, list[Column]] = {t.name: [] for t in tests}
    tables: dict[tuple[str, ...], DataFrame] = {}
    active = [t for t in tests if t.name in wanted]
    # the small jobs behind the tests are independent of each other
    with ThreadPoolExecutor(SETUP_JOBS) as pool:
        in_session = inheritable_thread_target(ctx.journal.sparkSession)
        parts = list(pool.map(in_session(lambda t: t.rule(ctx)), active))
    for test, found in zip(active, parts):
        for part in found:
            if isinstance(part, RowIds):
                mark = f"_listed_{len(listed)}"
                listed.append((mark, part.rows))
                hits[test.name].append(F.col(mark))
            else:
                if isinstance(part, Lookup):
                    keys = tuple(part.keys)
                    tables[keys] = tables[keys].join(part.table, part.keys, "full") \
                        if keys in tables else part.table
                hits[test.name].append(part.hit)
    with ThreadPoolExecutor(SETUP_JOBS) as pool:
        in_session = inheritable_thread_target(ctx.journal.sparkSession)
        written = list(pool.map(in_session(lambda keys: settle(tables[keys], "lookup")), tables))
    for keys, table in zip(tables, written):
        df = df.join(table, list(keys), "left")
    if listed:
        tagged = reduce(DataFrame.union, [
            rows.select("row_id", F.lit(mark).alias("mark")) for mark, rows in listed])
        folded = tagged.groupBy("row_id").agg(*[
            F.bool_or(F.col("mark") == mark).alias(mark) for mark, _ in listed])
        df = df.join(folded, "row_id", "left")
    kept = [c for c in ctx.journal.columns if c in _KEPT or c.startswith("_")]
    return df.select(*kept, *[_or(hits[t.name]).alias(t.column) for t in tests])


def merge_flags(journal: DataFrame, found: dict[str, DataFrame], tests: Sequence[FlagTest] = TESTS) -> DataFrame:
    """Flag columns from separately run tests: ``found`` maps a test name to its row ids."""
    tagged = reduce(DataFrame.union, [
        ids.select("row_id", F.lit(name).alias("test")) for name, ids in found.items()])
    folded = tagged.groupBy("row_id").agg(*[
        F.bool_or(F.col("test") == name).alias(_named(tests, name).column) for name in found])
    joined = journal.join(folded, "row_id", "left")
    return joined.select(*[F.col(c) for c in journal.columns], *[
        (F.coalesce(t.column, F.lit(False)) if t.name in found else F.lit(False)).alias(t.column)
        for t in tests])


def flag_weight(test: FlagTest, custom) -> float:
    return float(custom.get(test.name, test.weight)) if custom else test.weight


def with_score(flagged: DataFrame, custom_weights=None, tests: Sequence[FlagTest] = TESTS) -> DataFrame:
    """``_score``: the weights of the raised flags added up."""
    terms = [F.when(F.col(t.column), F.lit(flag_weight(t, custom_weights))).otherwise(F.lit(0.0))
             for t in tests]
    return flagged.withColumn("_score", reduce(lambda a, b: a + b, terms))
