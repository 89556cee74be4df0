"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_columns(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that extra columns never clash."""
    return df.select(*[F.col(source).alias(name) for name, source in columns.items()])


def in_portions(texts: list[str], size: int = 1 << 20) -> Iterator[range]:
    """Index ranges of about ``size`` characters, so that a batch of long texts is not held split."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= size:
            yield range(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield range(start, len(texts))


def text_portions(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of stretches of about ``size`` bytes, null as empty; only one is held as objects."""
    start, held = 0, 0
    for i, length in enumerate(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).tolist(), 1):
        held += length
        if held >= size or i == len(column):
            yield start, [t or "" for t in column.slice(start, i - start).to_pylist()]
            start, held = i, 0


def fold(df: DataFrame, doc_id: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds
