"""The operators of this package over their whole tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from journalsieve.llm import (
    bpe, hard_negatives, html_cut, language, mixing, neighbours, period_runs, pii, pitman_yor, simhash, sketch, slots,
    warc_zip,
)
from journalsieve.llm.common import fold, table
from journalsieve.workspace import new_folder, settle

VOCABULARY = "word_bpe_49k.json"


def op1_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY),
                             outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op2_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sketch.edited_fingerprints(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                        sketch.as_text("sketch").alias("fingerprint"),
                        sketch.as_text("edited_sketch").alias("edited_fingerprint"),
                        "near_edited", "near_next", "contained_edited", "contained_next")


def op3_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    # the kind is bound outside: a second parameter of the function would be the place in the array
    of_kind = lambda k: F.filter("base", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(pii.spans_text("base"), 256).alias("base_sha256"),
                        pii.spans_text("found").alias("spans"))


def op4_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pitman_yor.score_texts(docs, fold(docs, "doc_id", 7) == 2)


def op6_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(docs, "doc_id", 5) == 0
    model = language.fit(docs, ~held_out)
    return language.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op7_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op9_min_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_cut.extract_pages(table(spark, sf_dir, "pages"))


def op10_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_zip.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_threshold_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        "embedding")
    return hard_negatives.mine(rows, F.col("id") % 50 == 0)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of one document in ten the words from some place on repeat a short stretch of its own."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("words"))
    placed = chosen.withColumn("n", F.size("words")).withColumn(
        "a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    rest = F.col("n") - F.col("a")
    placed = placed.withColumn("p", (1 + F.floor(rest / (3 + F.col("g") % 8))).cast("int"))
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op12_basic_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = period_runs.find_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    found = found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.col2")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.col3")).alias("period"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.withColumn("exponent_milli", F.floor(1000 * F.col("length") / F.col("period")))


def op13_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settle(slots.with_slots(table(spark, sf_dir, "documents")), "slot-rows")
    loads = settle(slots.slot_loads(rows), "slot-loads")
    folder = new_folder(spark, "slot-map")
    now, grown = slots.edit_map(folder, loads, 8), slots.edit_map(folder, loads, 9)
    after = slots.read_map(spark, folder, grown).select(F.col("slot").alias("virtual_slot"),
                                                        F.col("shard").alias("next_version_shard"))
    placed = slots.place_records(rows, slots.read_map(spark, folder, now)).join(after, "virtual_slot")
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
                         F.lit(now).alias("map_version"), "next_version_shard")


QUERIES = {f.__name__: f for f in (op1_bpe_trie, op2_scaled_sketch, op3_bootstrapped_pii, op4_poisson_mix,
                                   op5_pitman_yor, op6_centroids, op7_simhash_gray, op8_block_join, op9_min_cut,
                                   op10_warc_zip, op11_threshold_join, op12_basic_factors, op13_virtual_slots)}
