"""Arriving journal files, analysed as they come."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import Sequence

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from journalsieve.config import AnalysisConfig
from journalsieve.functions.text import clean_nulls
from journalsieve.operators.prepare import with_canonical_columns, with_typed_columns, with_voucher_id
from journalsieve.plans import history
from journalsieve.plans.analysis import Analysis
from journalsieve.plans.registry import TESTS, FlagTest
from journalsieve.schema import CSV_NULL_LITERALS, NULL_LITERALS
from journalsieve.sources.journal_csv import resolve_headers
from journalsieve.workspace import new_folder, settle

RESULT_SCHEMA = (
    "upload string, total_input long, total_suspicious long, total_output long, "
    "filter_ratio string, suspicious_pct double, avg_score double, max_score double, "
    "max_possible_score double, batch long"
)

#: What is stored of every upload, each part in its own folder.
PARTS = ("totals", "suspicious", "flags", "history", "months")
#: Uploads analysed side by side: while one plans or ends a stage, the others keep the cores busy.
AT_ONCE = 3
#: What intake adds to the columns of the files.
ARRIVAL = ("upload", "arrived_at")


def typed_batch(batch: DataFrame) -> DataFrame:
    """The typed journal of a whole batch; its rows keep their upload and arrival."""
    headers = [c for c in batch.columns if c not in ARRIVAL]
    renamed = [F.col(f"`{c}`").alias(name) for c, name in zip(headers, resolve_headers(headers))]
    return with_typed_columns(with_canonical_columns(batch.select(*renamed, *ARRIVAL)))


def _parts_of(run: Analysis, upload: str, arrived: str) -> dict[str, DataFrame]:
    mandant = settle(history.detect_mandant(run.journal, upload), "mandant")
    totals = settle(run.statistics(), "totals")
    months = history.monthly_account_sums(run.context.account_months)
    return {
        "totals": totals,
        "suspicious": run.export(),
        "flags": run.scored.select("row_id", *[t.column for t in run.tests], "_score"),
        "history": history.run_record(mandant, upload, arrived, totals, run.flag_counts()),
        "months": history.monthly_records(mandant, upload, arrived, months),
    }


def _analyse_batch(results: str, config: AnalysisConfig, tests: Sequence[FlagTest]):
    def analyse(batch: DataFrame, batch_id: int) -> None:
        """Each upload of the batch is one journal: its statistics cover its own rows only.

        The batch is parsed on its way from the files and written once by upload, so every analysis reads
        its own typed rows alone.  The driver holds the names of the batch's uploads and analyses
        ``AT_ONCE`` of them side by side.  A repeated batch replaces its own result folders, so a restart
        leaves no duplicates.
        """
        spark, folder, typed = batch.sparkSession, new_folder(batch.sparkSession, "intake"), typed_batch(batch)
        typed.write.partitionBy("upload").parquet(folder)
        rows = spark.read.schema(typed.schema).parquet(folder)
        uploads = rows.groupBy("upload").agg(
            F.date_format(F.max("arrived_at"), "yyyy-MM-dd'T'HH:mm:ss").alias("arrived")).orderBy("upload")

        def analyse_upload(place: int, upload: str, arrived: str) -> None:
            own = rows.filter(F.col("upload") == upload).drop(*ARRIVAL)
            run = Analysis.of_prepared(with_voucher_id(own), config, tests=tests)
            for part, figures in _parts_of(run, upload, arrived).items():
                figures.withColumns({"upload": F.lit(upload), "batch": F.lit(batch_id).cast("long")}) \
                    .write.mode("overwrite").parquet(f"{results}/{part}/batch={batch_id}/upload={place}")

        with ThreadPoolExecutor(AT_ONCE) as pool:
            one = inheritable_thread_target(spark)(lambda upload: analyse_upload(*upload))
            for _ in pool.map(one, [(i, *upload) for i, upload in enumerate(uploads.collect())]):
                pass  # raises what an analysis raised
    return analyse


def intake_stream(spark: SparkSession, inbox: str, results: str, state: str, columns: list[str],
                  separator: str = ";", config: AnalysisConfig | None = None,
                  tests: Sequence[FlagTest] = TESTS):
    """Analyse every upload folder ``<inbox>/<upload>/*.csv`` that has arrived, then stop.

    The whole-file statistics of the tests need all rows of an upload, so the unit of work is the
    micro-batch, not the row.  Returns the finished query.
    """
    schema = ", ".join(f"`{c}` STRING" for c in columns)
    literals = sorted({*NULL_LITERALS, *CSV_NULL_LITERALS})
    arriving = clean_nulls(
        spark.readStream.schema(schema).option("sep", separator).option("header", True)
        .option("quote", '"').option("escape", '"').csv(f"{inbox}/*/")
        .select("*", F.element_at(F.split("_metadata.file_path", "/"), -2).alias("upload"),
                F.col("_metadata.file_modification_time").alias("arrived_at")),
        literals)
    query = (
        arriving.writeStream.trigger(availableNow=True).option("checkpointLocation", state)
        .foreachBatch(_analyse_batch(results, config or AnalysisConfig(), tests)).start()
    )
    query.awaitTermination()
    return query


def intake_results(spark: SparkSession, results: str, part: str = "totals") -> DataFrame:
    """One of ``PARTS`` over all uploads; ``upload`` and ``batch`` say where a row came from."""
    read = spark.read.schema(RESULT_SCHEMA) if part == "totals" else spark.read
    return read.parquet(f"{results}/{part}/*/*")
