"""Stored runs and reviewer labels: append-only tables partitioned by client."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

KEEP_RUNS = 20


def append(rows: DataFrame, folder: str, kind: str = "parquet") -> None:
    rows.write.mode("append").partitionBy("mandant").format(kind).save(folder)


def load(spark: SparkSession, folder: str, schema, kind: str = "parquet") -> DataFrame:
    """The table; a filter on ``mandant`` reads only that client's folder."""
    return spark.read.schema(schema).format(kind).load(folder)


def list_runs(runs: DataFrame, mandant: str) -> DataFrame:
    """Stored runs of one client, newest first."""
    return runs.filter(F.col("mandant") == mandant).orderBy(F.desc("run_date"), "file")


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run of every client."""
    newest = F.max_by(F.struct(*[c for c in runs.columns if c != "mandant"]),
                      F.struct("run_date", "file")).alias("run")
    return runs.groupBy("mandant").agg(newest).select("mandant", "run.*")


def retain_last_n(runs: DataFrame, n: int = KEEP_RUNS) -> DataFrame:
    """Rows of the ``n`` newest run dates of every client.  The limit also applies before the
    shuffle, so a client with many runs sends only its newest ones."""
    newest_first = Window.partitionBy("mandant").orderBy(F.desc("run_date"))
    return (
        runs.withColumn("place", F.dense_rank().over(newest_first))
        .filter(F.col("place") <= n).drop("place")
    )


def current_version(spark: SparkSession, store: str) -> int | None:
    """The newest published version of a versioned store, or None before the first."""
    try:
        return spark.read.schema("version int").parquet(f"{store}/published").agg(F.max("version")).head()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def load_current(spark: SparkSession, store: str, schema) -> DataFrame:
    """The rows of the newest published version; a DataFrame keeps to the version it was made from."""
    version = current_version(spark, store)
    if version is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{store}/version={version}")


def _publish(rows: DataFrame, store: str, version: int) -> None:
    """Writes a version and then, as one small file, the mark that makes it the newest."""
    rows.write.mode("overwrite").partitionBy("mandant").parquet(f"{store}/version={version}")
    mark = rows.sparkSession.range(1).select(F.lit(version).alias("version")).coalesce(1)
    mark.write.mode("append").parquet(f"{store}/published")


def add_runs(rows: DataFrame, store: str, schema, keep: int = KEEP_RUNS) -> int:
    """Publishes the next version: the stored runs and ``rows``, of each client the ``keep`` newest run dates.

    Rows beyond are removed: the version before the last one is emptied, so its files go.  Readers see one
    whole version at any time, those of the version just replaced included.  A version that was written but
    never published is written over.  One writer at a time.
    """
    spark = rows.sparkSession
    newest = current_version(spark, store)
    version = 0 if newest is None else newest + 1
    together = load_current(spark, store, schema).unionByName(rows)
    _publish(retain_last_n(together, keep), store, version)
    if version >= 2:
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{store}/version={version - 2}")
    return version


def export_csv(rows: DataFrame, folder: str) -> None:
    """Semicolon-separated with header; one file per partition, in the order of the rows."""
    rows.write.option("sep", ";").option("header", True).csv(folder)
