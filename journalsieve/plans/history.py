"""Run history: what a run leaves behind and how two runs differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from journalsieve.functions.dates import month_label


def monthly_account_sums(months: DataFrame) -> DataFrame:
    """Amounts per account and month, two decimals, from the account-by-month table."""
    return months.filter("_ym is not null and n_real > 0").select(
        "konto_soll", month_label(F.col("_ym")).alias("monat"),
        F.round("real_sum", 2).alias("summe"))


def detect_mandant(journal: DataFrame, file_name: str | None = None) -> DataFrame:
    """The most frequent non-empty client id (smallest on ties), else the first two to six digits
    of the file name, else ``unknown``."""
    from_name = F.regexp_extract(F.lit(file_name or ""), r"(\d{2,6})", 1)
    fallback = F.when(from_name != "", from_name).otherwise("unknown")
    id_ = F.btrim("mandant")
    counts = journal.select(id_.alias("mandant")).filter("mandant != ''").groupBy("mandant").count()
    best = counts.agg(F.min_by("mandant", F.struct(-F.col("count"), "mandant")).alias("m"))
    return best.select(F.coalesce("m", fallback).alias("mandant"))


def run_record(mandant: DataFrame, file: str, run_date: str, statistics: DataFrame,
               flags: DataFrame) -> DataFrame:
    """One row: totals and the flag counts as a map."""
    counts = flags.agg(F.map_from_entries(F.collect_list(F.struct("flag", "n")))).scalar()
    return statistics.select(
        mandant.select("mandant").scalar().alias("mandant"), F.lit(run_date).alias("run_date"),
        F.lit(file).alias("file"), F.col("total_input").alias("total_rows"),
        F.col("total_suspicious").alias("suspicious"), "suspicious_pct",
        counts.alias("flag_counts"))


def monthly_records(mandant: DataFrame, file: str, run_date: str, months: DataFrame) -> DataFrame:
    """The monthly sums per account stored beside the run's record, one row each."""
    return months.select(
        mandant.select("mandant").scalar().alias("mandant"), F.lit(run_date).alias("run_date"),
        F.lit(file).alias("file"), "konto_soll", "monat", "summe")


def _newest_two(runs: DataFrame) -> DataFrame:
    """The two newest runs of every client, ``place`` 1 and 2; runs of one second go by file name."""
    newest_first = Window.partitionBy("mandant").orderBy(F.desc("run_date"), F.desc("file"))
    return runs.withColumn("place", F.row_number().over(newest_first)).filter("place <= 2")


def previous_run(runs: DataFrame) -> DataFrame:
    """Per client the run before the newest one; a client with a single run has none."""
    return _newest_two(runs).filter("place = 2").drop("place")


def compare_runs(runs: DataFrame, months: DataFrame) -> DataFrame:
    """(mandant, kind, name, current, previous, delta) of every client's newest two stored runs.

    ``runs`` holds the run records, ``months`` their monthly records.  Rows name the tests whose
    counts changed, the suspicious share, and accounts only one of the runs booked on.  A client's
    first run has nothing to compare with.
    """
    pair = _newest_two(runs).withColumn(
        "n_runs", F.count(F.lit(1)).over(Window.partitionBy("mandant"))).filter("n_runs = 2")
    newest = F.col("place") == 1

    def sides(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
        value = value.cast("double")
        return rows.groupBy("mandant", *keys).agg(
            F.sum(F.when(newest, value).otherwise(0.0)).alias("current"),
            F.sum(F.when(newest, 0.0).otherwise(value)).alias("previous"))

    counts = pair.select("mandant", "place", F.explode("flag_counts").alias("name", "n"))
    flags = sides(counts, ["name"], F.col("n")).filter("current != previous").select(
        "mandant", F.lit("flag").alias("kind"), "name", "current", "previous",
        (F.col("current") - F.col("previous")).alias("delta"))
    share = sides(pair, [], F.col("suspicious_pct")).select(
        "mandant", F.lit("share").alias("kind"), F.lit("suspicious_pct").alias("name"), "current",
        "previous", F.round(F.col("current") - F.col("previous"), 2).alias("delta"))
    booked = (
        months.join(pair.select("mandant", "run_date", "file", "place"), ["mandant", "run_date", "file"])
        .groupBy("mandant", "konto_soll")
        .agg(F.bool_or(newest).alias("now"), F.bool_or(~newest).alias("then"))
    )
    accounts = booked.filter(F.col("now") != F.col("then")).select(
        "mandant", F.when(F.col("now"), "new account").otherwise("removed account").alias("kind"),
        F.col("konto_soll").alias("name"),
        *[F.lit(None).cast("double").alias(c) for c in ("current", "previous", "delta")])
    return flags.unionByName(share).unionByName(accounts)
