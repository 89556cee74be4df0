"""Sharding by fixed virtual slots, in DataFrame functions alone.

Records are hashed into a fixed number of slots, far more than there are shards.  Only the slots have a
place: a versioned map says which shard holds which slot.  The bytes of each slot are added up, and a new
version of the map is made from the last one: every shard keeps its largest slots up to a share of the
mean, and the other slots go, largest first, to the shard with the fewest bytes.  A version is one small
file that never changes.  What moves are slots; no record is ever hashed anew.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Virtual slots; the tables of slots and the map have as many rows, whatever the input holds.
SLOTS = 4096
#: Share of the mean up to which a shard keeps its slots when the map is edited.
KEEP = 0.95

MAP_SCHEMA = "slot int, shard int, bytes long, rows long"


def slot_of(*key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 52 bits of the MD5 of its parts, null parts counting as empty."""
    text = F.concat_ws(":", *[F.coalesce(k.cast("string"), F.lit("")) for k in key])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") % slots).cast("int")


def slot_loads(rows: DataFrame, size: str = "size", slots: int = SLOTS) -> DataFrame:
    """(slot, bytes, rows) of all slots, empty ones included; ``rows`` has ``virtual_slot`` and the size."""
    counted = rows.groupBy(F.col("virtual_slot").alias("slot")).agg(
        F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    return every.join(counted, "slot", "left").select(
        "slot", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"),
        F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


def _dealt(pool: DataFrame, start: DataFrame) -> DataFrame:
    """(slot, shard): the slots of ``pool``, largest first, each to the shard that has the fewest bytes by then.

    ``start`` has (shard, bytes).  A fold over one array of at most as many slots as the map has.
    """
    listed = pool.select(F.struct((-F.col("bytes")).alias("less"), "slot").alias("todo")).unionByName(
        start.select(F.struct("bytes", "shard").alias("load")), allowMissingColumns=True)
    one_row = listed.agg(F.array_sort(F.collect_list("todo")).alias("todo"), F.collect_list("load").alias("loads"))

    def place(state: Column, slot: Column) -> Column:
        least = F.array_min(state["loads"])
        return F.struct(
            F.transform(state["loads"], lambda s: F.struct(
                F.when(s["shard"] == least["shard"], s["bytes"] - slot["less"]).otherwise(s["bytes"]).alias("bytes"),
                s["shard"].alias("shard"))).alias("loads"),
            F.concat(state["shards"], F.array(least["shard"])).alias("shards"))

    begin = F.struct(F.col("loads"), F.array().cast("array<int>").alias("shards"))
    placed = one_row.select("todo", F.aggregate("todo", begin, place)["shards"].alias("shards"))
    pairs = F.zip_with("todo", "shards", lambda t, s: F.struct(t["slot"].alias("slot"), s.alias("shard")))
    return placed.select(F.inline(pairs))


def next_map(loads: DataFrame, shards: int, last: DataFrame | None = None, keep: float = KEEP) -> DataFrame:
    """The map for ``shards`` shards from the measured ``loads`` (slot, bytes, rows) and the last map.

    Without a last map all slots are dealt.  With one, each of its shards that is still wanted keeps its
    largest slots, in order, while they add up to at most ``keep`` of the mean; the rest is dealt.  If there
    are more shards than before, the old ones keep up to the whole mean and only the new ones receive, so
    nothing moves between old shards.  Ties go to the smaller slot and the smaller shard.
    """
    every = loads.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    if last is None:
        return loads.join(_dealt(loads, every.withColumn("bytes", F.lit(0).cast("long"))), "slot").select(
            "slot", "shard", "bytes", "rows")
    known = last.agg(F.max("shard")).head()[0] + 1
    mean = loads.agg(F.sum("bytes")).head()[0] / shards
    limit, first = (mean, known) if shards > known else (keep * mean, 0)
    largest_first = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot")
    kept = (loads.join(last.select("slot", "shard"), "slot").filter(F.col("shard") < shards)
            .withColumn("filled", F.sum("bytes").over(largest_first)).filter(F.col("filled") <= limit)
            .select("slot", "shard", "bytes", "rows"))
    start = (every.filter(F.col("shard") >= first)
             .join(kept.groupBy("shard").agg(F.sum("bytes").alias("bytes")), "shard", "left")
             .select("shard", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes")))
    moved = loads.join(kept.select("slot"), "slot", "left_anti")
    return kept.unionByName(moved.join(_dealt(moved, start), "slot").select("slot", "shard", "bytes", "rows"))


def store_map(slot_map: DataFrame, folder: str, version: int) -> None:
    """Writes one version, a single small file; a version that exists is never written again."""
    slot_map.coalesce(1).write.mode("error").parquet(f"{folder}/version={version}")


def read_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """(slot, shard, bytes, rows) of a version."""
    return spark.read.schema(MAP_SCHEMA).parquet(f"{folder}/version={version}")


def newest_version(spark: SparkSession, folder: str) -> int | None:
    """The largest stored version, or None without any."""
    try:
        versions = spark.read.schema(f"{MAP_SCHEMA}, version int").parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return versions.agg(F.max("version")).head()[0]


def edit_map(folder: str, loads: DataFrame, shards: int, keep: float = KEEP) -> int:
    """Stores the version after the newest one of ``folder``, from the measured loads; returns its number."""
    spark = loads.sparkSession
    newest = newest_version(spark, folder)
    last = None if newest is None else read_map(spark, folder, newest)
    version = 0 if newest is None else newest + 1
    store_map(next_map(loads, shards, last, keep), folder, version)
    return version


def with_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(id, size, text_crc32, virtual_slot) of every row: UTF-8 bytes of the text plus 1, and its CRC-32.

    The slot follows from the id, the size and the CRC-32.  Rows alike in all three are counted map-side
    and numbered, and the number counts in the slot: neither rows without an id nor repeats of one row meet
    in a slot.  Null text has no bytes; its CRC-32 is that of the empty text.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"))
    alike = rows.groupBy("id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    numbered = alike.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return numbered.select("id", "size", "text_crc32", "copy",
                           slot_of(F.col("id"), F.col("size"), F.col("text_crc32"), F.col("copy"), slots=slots)
                           .alias("virtual_slot"))


def place_records(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``rows`` (see ``with_slots``) with ``shard`` and ``place``, gapless from 0 within each shard.

    The slots of a shard stand one after another; rows are numbered within their slot, so no task sees
    more than a slot's rows.
    """
    before = Window.partitionBy("shard").orderBy("slot")
    offsets = slot_map.select(F.col("slot").alias("virtual_slot"), "shard",
                              (F.sum("rows").over(before) - F.col("rows")).alias("offset"))
    inside = Window.partitionBy("virtual_slot").orderBy("id", "size", "text_crc32", "copy")
    numbered = rows.withColumn("inside", F.row_number().over(inside).cast("long"))
    return numbered.join(offsets, "virtual_slot").withColumn(
        "place", F.col("offset") + F.col("inside") - 1).drop("offset", "inside", "copy")
