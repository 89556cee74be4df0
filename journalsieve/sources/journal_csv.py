"""Reading a journal export: separator, header names, missing values."""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from journalsieve.functions.text import clean_nulls
from journalsieve.operators.running import with_total_before
from journalsieve.schema import COLUMN_ALIASES, CSV_NULL_LITERALS, NULL_LITERALS
from journalsieve.workspace import settle

SEPARATORS = ["|", ";", ",", "\t"]
_TRAILING_SEMICOLONS = r";+\s*$"
_BYTE_ORDER_MARK = "^\ufeff"
_UMLAUTS = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"})


def normalise_header(name: str) -> str:
    """Lower case, umlauts spelled out, everything else but letters and digits as ``_``."""
    plain = name.lower().strip().translate(_UMLAUTS)
    return re.sub(r"[^a-z0-9]+", "_", plain).strip("_")


def resolve_headers(headers: list[str]) -> list[str]:
    """Canonical name per column; columns nobody claims keep their own name.

    A canonical column takes the first alias that equals a header.  Failing that, it takes the first
    still free header containing one of its aliases.  An equal match may take a header back.
    """
    position = {normalise_header(h): i for i, h in enumerate(headers)}
    claimed: dict[int, str] = {}
    for canonical, aliases in COLUMN_ALIASES.items():
        equal = next((position[a] for a in aliases if a in position), None)
        if equal is None:
            equal = next((i for a in aliases for name, i in position.items()
                          if a in name and i not in claimed), None)
        if equal is not None:
            claimed[equal] = canonical
    names: list[str] = []
    taken = {c.lower() for c in claimed.values()}
    for i, header in enumerate(headers):
        name = claimed.get(i, header)
        if i not in claimed:
            while name.lower() in taken:
                name += "_source"
            taken.add(name.lower())
        names.append(name)
    return names


def map_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*resolve_headers(df.columns))


def sniff(header: str) -> tuple[str, list[str]]:
    """Separator and column names of a header line: the first separator giving three columns."""
    for separator in SEPARATORS:
        line = re.sub(_TRAILING_SEMICOLONS, "", header) if separator == "|" else header
        names = next(csv.reader([line], delimiter=separator), [])
        if len(names) >= 3:
            return separator, names
    raise ValueError("no journal file: fewer than three columns with any known separator")


_QUOTES = {"quote": '"', "escape": '"'}
#: Blocks of the input (of 128 MB, as a rule) whose first numbers are broadcast, four longs each.
BROADCAST_BLOCKS = 1 << 20


def _place() -> Column:
    """Where a row stands in the input: its file, and the block of it that one task reads."""
    return F.struct(*[F.col(f"_metadata.{source}").alias(name) for name, source in (
        ("file", "file_path"), ("start", "file_block_start"), ("length", "file_block_length"))]).alias("_place")


def _first_line(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    return re.sub(_BYTE_ORDER_MARK, "", rows[0].value) if rows else ""


def _parsed(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The file's rows as text, with their place in the input, and the names of the columns."""
    first = _first_line(spark, path)
    separator, names = sniff(first)
    unique = [n if names.index(n) == i else f"{n}.{i}" for i, n in enumerate(names)]
    unique = [n.replace("`", "") for n in unique]
    schema = ", ".join(f"`{n}` STRING" for n in unique)
    if separator == "|":
        # this export ends its lines with stray semicolons, which belong to no column
        lines = spark.read.text(path).select(F.regexp_replace(
            F.regexp_replace("value", _BYTE_ORDER_MARK, ""), _TRAILING_SEMICOLONS, "")
            .alias("value"), _place())
        header = re.sub(_TRAILING_SEMICOLONS, "", first)
        parsed = lines.filter((F.col("value") != header) & (F.trim("value") != "")).select(
            F.from_csv("value", schema, {"sep": separator, **_QUOTES}).alias("row"), "_place").select("row.*", "_place")
    else:
        parsed = (spark.read.schema(schema)
                  .option("sep", separator).option("header", True).option("enforceSchema", True)
                  .options(**_QUOTES).csv(path).select("*", _place()))
    return parsed, unique


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """The file with its own column names, all strings, missing values as NULL."""
    parsed, names = _parsed(spark, path)
    return clean_nulls(parsed.select(*[f"`{n}`" for n in names]), sorted({*NULL_LITERALS, *CSV_NULL_LITERALS}))


def with_row_numbers(parsed: DataFrame) -> DataFrame:
    """``_place`` becomes ``row_id``: numbers from 0 without gaps, by file path and place in the file.

    A first pass counts the rows of every block of the scan, and the counts of the blocks before, by path
    and start, give each block its first number.  The second pass reads the same blocks; should the scan
    be split otherwise by then, it fails instead of numbering wrongly.  One row a block is joined: it is
    broadcast up to ``BROADCAST_BLOCKS`` of them, and left to the planner beyond.
    """
    at = F.monotonically_increasing_id()
    key = [F.col("_place.start").alias("_start"), F.col("_place.length").alias("_length"),
           F.xxhash64("_place.file").alias("_file"), F.spark_partition_id().alias("_part")]
    keys = ["_start", "_length", "_file", "_part"]
    blocks = settle(
        parsed.select(*key, F.col("_place.file").alias("file"), at.alias("at"))
        .groupBy(*keys, "file").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("_first")), "blocks")
    found = blocks.agg(F.count(F.lit(1)).alias("all"), F.count_distinct(F.struct(*keys)).alias("told_apart")).head()
    if found["all"] != found["told_apart"]:
        raise RuntimeError("two files of the input share a hash of their paths")
    numbered = settle(with_total_before(blocks, ["file", "_start"], "rows", found["all"])
                      .select(*keys, (F.col("before") - F.col("_first")).alias("_shift")), "block_numbers")
    if found["all"] <= BROADCAST_BLOCKS:
        numbered = F.broadcast(numbered)
    others = [c for c in parsed.columns if c != "_place"]
    placed = parsed.select(*[f"`{c}`" for c in others], *key, at.alias("_at")).join(numbered, keys, "left")
    number = F.when(F.col("_shift").isNull(), F.raise_error(F.lit("the input is split otherwise than when it was counted"))
                    .cast("long")).otherwise(F.col("_at") + F.col("_shift"))
    return placed.select(number.alias("row_id"), *[f"`{c}`" for c in others])


def read_journal_csv(spark: SparkSession, path: str) -> DataFrame:
    """A journal export under canonical column names.

    Without a column ``row_id`` of its own, rows are numbered from 0 in the order of the files' paths and
    of their lines.
    """
    parsed, names = _parsed(spark, path)
    given = "row_id" in (n.lower() for n in names)
    rows = parsed.select(*[f"`{n}`" for n in names]) if given else with_row_numbers(parsed)
    cleaned = clean_nulls(rows, sorted({*NULL_LITERALS, *CSV_NULL_LITERALS}))
    return map_columns(cleaned)
