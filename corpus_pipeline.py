"""A training corpus from ``documents``: five stages, each written as Parquet and read again.

Every stage works on all rows its predecessor kept.  The stages rest on the operators of
``journalsieve.llm``; their docstrings say how they treat nulls, repeated rows and empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from journalsieve.llm import bpe, language, mixing, pii, simhash
from journalsieve.workspace import settle

VOCABULARY = "word_bpe_49k.json"
#: Words a worker remembers and characters it encodes at a time: less than the operator's own, as the workers
#: still hold what earlier stages left.
KEPT_WORDS, PORTION = 150_000, 1 << 20


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns the languages from the labelled documents and drops what lies far from all of them."""
    model = language.fit(docs)
    return language.identify(docs, model).filter(~F.col("rejected")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that the fingerprints link, the document with the smallest id stays, once.

    Rows are told apart by id and text (null counts as empty): of exact repeats the first by source, lang and
    n_chars stays.  Rows without an id come after all others; a group of such rows alone keeps the least hash.
    """
    mark = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), mark.alias("mark"))
    found = simhash.near_duplicates(docs.select(key.alias("key"), "text"), id_col="key")
    name = lambda id_, mark_: F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("")), mark_)
    kept = found.filter(F.col("key") == F.col("component_id")).select(
        name(F.col("key.id"), F.col("key.mark")).alias("name")).distinct()
    row = "row" + "_" * max(map(len, docs.columns))  # a name that none of the columns has
    whole = docs.select(name(F.col("doc_id"), mark).alias("name"), F.struct(*docs.columns).alias(row)).join(
        kept, "name", "left_semi")
    first = F.row_number().over(Window.partitionBy("name").orderBy(*[f"{row}.{c}" for c in ("source", "lang", "n_chars")]))
    return whole.withColumn("place", first).filter("place = 1").select(f"{row}.*")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the name of their kind."""
    return pii.redact(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to the square root of their size; a document comes as often as it is drawn."""
    return mixing.mix_sources(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and a digest of what they decode to."""
    return bpe.encode_decode(docs, public_tokenizers.path(VOCABULARY), keep=("lang", "source", "n_chars"),
                             outputs=("n_tokens", "ids", "decoded_sha256"), kept=KEPT_WORDS, portion=PORTION)


STAGES = [
    ("language", keep_known_languages),
    ("near_copies", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("mixing", mix_to_weights),
    ("tokens", encode),
]

#: Fingerprints, clustering and the tokenizer are beyond SQL; the tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
