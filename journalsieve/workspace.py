"""Written intermediate tables.

Tables that several plans read (the prepared journal, small lookup tables) are written once to the
folder the cluster names in ``spark.checkpoint.dir`` and read back.  That cuts the lineage, survives
the loss of executors, and gives the planner the real size of every lookup table: it broadcasts the
small ones and joins the large ones through a shuffle, so no plan carries a broadcast hint whose
side could outgrow memory.
"""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Fall-back folders of local sessions; they go when the interpreter ends.
_local_roots: dict[str, tempfile.TemporaryDirectory] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared scratch folder; only a local session may fall back to a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.TemporaryDirectory(prefix="journalsieve-", ignore_cleanup_errors=True)
    return _local_roots[app].name


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path under the scratch folder; nothing is ever overwritten."""
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/journalsieve/{app}/{label}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back."""
    spark = df.sparkSession
    folder = new_folder(spark, label)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


#: Rows of a scan that one task parses at most, and characters of text that one task splits.
ROWS_PER_TASK, CHARS_PER_TASK = 100_000, 1 << 20


def spread(scan: DataFrame, text: str | None = None) -> DataFrame:
    """A file scan of fewer splits than its rows need is dealt out once.

    At least one part per core, and one for every ``ROWS_PER_TASK`` rows, or ``CHARS_PER_TASK`` characters
    of ``text``: what follows costs much more per row than reading, and a file of few bytes or few row
    groups would put millions of rows into one task.
    """
    parts = math.ceil(scan.count() / ROWS_PER_TASK)
    if text:
        chars = scan.agg(F.coalesce(F.sum(F.char_length(text)), F.lit(0))).head()[0]
        parts = max(parts, math.ceil(chars / CHARS_PER_TASK))
    parts = max(parts, scan.sparkSession.sparkContext.defaultParallelism)
    return scan.repartition(parts) if scan.rdd.getNumPartitions() < parts else scan
