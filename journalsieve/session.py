"""Session settings the plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What the long projections of the journal need in any session.  HotSpot never compiles a method of more
#: than 8000 bytes, so a whole stage in one such method is interpreted for every row; with this limit
#: Spark cuts the stage up.  Results do not depend on it.
PLAN_SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000"}

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # a hot account, vendor or voucher is split by the engine in the shuffle joins
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the plans are built from many columns; recording the call site of each doubles that time
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    **PLAN_SETTINGS,
}


def build_session(app: str, master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; ``master`` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def with_plan_settings(spark: SparkSession) -> SparkSession:
    """Gives a session made elsewhere the settings of the plans; what it has set itself stays."""
    for key, value in PLAN_SETTINGS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark
