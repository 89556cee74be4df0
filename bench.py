"""Headline timings: one JSON line.

Each query is built and fully evaluated once into a sink that stores nothing, on
``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``, after one warm-up run on the smallest scale factor.
``full_analysis`` goes from the raw text export to the sorted suspicious rows; the queries after it
start from the prepared or scored journal of the same session, as the tests of one run do.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from journalsieve.queries import QUERIES, journal_of, scored_of  # noqa: E402
from journalsieve.session import build_session  # noqa: E402

HEADLINE = [
    "full_analysis", "prepared_parquet", "score",
    "betrag_zscore", "betrag_iqr", "konto_betrag_anomalie", "near_duplicate",
    "doppelte_belegnummer", "beleg_kreditor_duplikat", "storno", "leerer_buchungstext",
    "rechnungsdatum_periode", "buchungstext_periode", "neuer_kreditor_hoch", "monats_entwicklung",
    "fehlende_monatsbuchung", "isolation_anomalie", "text_konto_match",
    "global_stats", "flag_counts", "export_projection", "column_profile", "monthly_account_sums",
    "vendor_clusters", "text_vectors", "cosine_pairs", "monthly_pnl", "vendor_treemap", "downsample",
]


def evaluate(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        evaluate(spark, "full_analysis", small)
    timings = {}
    for name in HEADLINE:
        if name == "score":
            journal_of(spark, folder)  # the tests read the stored journal
        if name == "flag_counts":
            scored_of(spark, folder)  # the report queries read the stored scores
        timings[name] = evaluate(spark, name, folder)
    rows = spark.read.parquet(f"{folder}/orders.parquet").count()
    print(json.dumps({
        "metric": "full journal analysis, raw export to suspicious rows",
        "value": timings["full_analysis"], "unit": "sec", "queries": timings,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "journal_rows": rows,
        "rows_per_sec": round(rows / timings["full_analysis"])}))
    spark.stop()


if __name__ == "__main__":
    main()
