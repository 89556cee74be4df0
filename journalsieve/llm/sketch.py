"""Document fingerprints by a threshold-scaled sketch, in DataFrame functions alone.

A sketch keeps every hash of a five-word shingle that lies below a fixed fraction of the hash range.
Two sketches with the same cut can be united, and the share of one set that lies in the other can be
estimated however unequal the documents are.  A document with few hashes below the fraction keeps its
``least`` smallest ones; its cut then lies just above them (beyond all hashes, if that is all it has),
and two sketches are compared below the smaller of their cuts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from journalsieve.workspace import settle

WORDS, FRACTION, LEAST = 5, 1 / 16, 8
#: One range of ids for so many of the square root of their number.
PER_ROOT = 16
_SPACE = r"[\x20\x09-\x0D]+"
_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1


def with_sketch(df: DataFrame, text: str, name: str, words: int = WORDS, fraction: float = FRACTION,
                least: int = LEAST) -> DataFrame:
    """Adds ``name``: struct(cut, hashes) of the lower-cased text, hashes sorted.

    A null or wordless text has no hashes; a text of fewer words than a shingle is one shingle.  The
    steps are separate projections, so that each runs once per row.
    """
    cut = int(_LOWEST + fraction * (1 << 64))
    w, h, s, low = (f"__{name}_{x}" for x in "whsl")
    return (
        df.withColumn(w, F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), _SPACE),
                                  lambda x: x != ""))
        .withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
        .withColumn(s, F.when(F.size(h) >= words, F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(h) - (words - 1), F.lit(1))),
            lambda i: F.xxhash64(*[F.try_element_at(F.col(h), i + k) for k in range(words)])))
            .when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>")))
        .withColumn(low, F.array_distinct(F.filter(s, lambda x: x < cut)))
        .withColumn(low, F.when(F.size(low) >= least, F.array_sort(low)).otherwise(
            F.slice(F.array_sort(F.array_distinct(F.col(s))), 1, least)))
        .withColumn(name, F.struct(
            F.when(F.size(low) < least, F.lit(_HIGHEST))
            .otherwise(F.greatest(F.lit(cut), F.element_at(low, -1) + 1)).alias("cut"),
            F.col(low).alias("hashes")))
        .drop(w, h, s, low))


def _below(sketch: Column, cut: Column) -> Column:
    return F.filter(sketch["hashes"], lambda x: x < cut)


def with_likeness(df: DataFrame, a: str, b: str, jaccard: str, containment: str) -> DataFrame:
    """Estimated Jaccard likeness and containment of the smaller set; two empty documents are alike."""
    x, y, both = f"__{jaccard}_x", f"__{jaccard}_y", f"__{jaccard}_both"
    cut = F.least(F.col(a)["cut"], F.col(b)["cut"])
    df = (df.withColumn(x, _below(F.col(a), cut)).withColumn(y, _below(F.col(b), cut))
          .withColumn(both, F.size(F.array_intersect(x, y))))
    smaller, union = F.least(F.size(x), F.size(y)), F.size(x) + F.size(y) - F.col(both)
    return (df.withColumn(jaccard, F.when(union == 0, 1.0).otherwise(F.col(both) / union))
            .withColumn(containment, F.when(union == 0, 1.0).when(smaller == 0, 0.0)
                        .otherwise(F.col(both) / smaller))
            .drop(x, y, both))


def as_text(sketch: str) -> Column:
    """The cut and the hashes in hexadecimal; equal documents give equal strings."""
    digits = lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")
    return F.concat(digits(F.col(sketch)["cut"]), F.lit(":"),
                    F.array_join(F.transform(F.col(sketch)["hashes"], digits), ""))


def _next_larger(rows: DataFrame, count: int) -> DataFrame:
    """Adds ``after``, the next larger id and its size, to distinct (id, size).

    The ids are dealt into ranges of about equal length, however they are spread; the smallest of each
    range answers for the range before.  The number of ranges and their length both grow with the square
    root of the count.  The ranges are written, so that a task run again finds the same ones.
    """
    here = F.struct("id", "size")
    ranged = settle(rows.repartitionByRange(max(1, math.isqrt(count) // PER_ROOT), "id")
                    .withColumn("range", F.spark_partition_id()), "id-ranges")
    heads = ranged.groupBy("range").agg(F.min(here).alias("head"))
    heads = heads.select("range", F.lead("head").over(Window.orderBy("range")).alias("head"))
    inside = F.lead(here).over(Window.partitionBy("range").orderBy("id"))
    return (ranged.withColumn("after", inside).join(heads, "range")
            .select("id", "size", F.coalesce("after", "head").alias("after")))


def neighbours(docs: DataFrame) -> DataFrame:
    """(id, before, half): the document that has ``id`` as its next one, descending, and half its size.

    ``docs`` has (id, size); an id that repeats counts once, with its largest size.  Only ids move.  Any
    longs will do as ids: no arithmetic is done on them.
    """
    ids = docs.filter("id is not null").groupBy("id").agg(F.max("size").alias("size"))
    facts = ids.agg(F.count("id").alias("count"), F.min(F.struct("id", "size")).alias("first")).head()
    if not facts["count"]:
        return ids.select("id", F.col("id").alias("before"), F.col("size").alias("half"))
    linked = _next_larger(ids, facts["count"])
    first = F.struct(*[F.lit(facts["first"][c]).cast("long").alias(c) for c in ("id", "size")])
    after = F.coalesce("after", first)  # the smallest comes last; its next one is the largest
    return linked.select("id", after["id"].alias("before"),
                         F.floor(after["size"] / 2).cast("int").alias("half"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        words: int = WORDS, fraction: float = FRACTION) -> DataFrame:
    """Fingerprints of every document, of its edited text, and how alike neighbours are.

    The edited text is the document with its last floor(n/2) code points replaced by as many first ones
    of the next document in descending id order (all, if it has fewer; after the smallest id follows the
    largest).  Returns id, text, n_chars, edited, sketch, edited_sketch, near_edited, near_next,
    contained_edited, contained_next.

    Null text counts as empty.  Rows that share an id share their next document, and are the smallest
    of their texts where they are the next one themselves.  A null id has no next document (its edited
    text is its first part).  Extra columns are left out; an empty table gives an empty table.

    The text is shuffled once by id (both uses share that exchange), and only the part that a neighbour
    needs is sent on.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    links = neighbours(rows.select("id", F.char_length("text").cast("long").alias("size")))
    unnamed, rows = rows.filter("id is null"), rows.filter("id is not null")
    sent = with_sketch(rows.join(links, "id"), "text", "sketch", words, fraction)
    sent = (sent.select("before", F.struct(F.substring("text", F.lit(1), F.col("half")).alias("text"),
                                           "sketch").alias("next"))
            .groupBy("before").agg(F.min("next").alias("next")))
    size = F.char_length("text")
    joined = rows.join(sent, rows["id"] == sent["before"], "left").select("id", "text", "next")
    joined = joined.unionByName(unnamed, allowMissingColumns=True)
    joined = (joined.withColumn("n_chars", size.cast("long")).withColumn("half", F.floor(size / 2).cast("int"))
              .withColumn("edited", F.concat(
                  F.substring("text", F.lit(1), size - F.col("half")),
                  F.coalesce(F.substring(F.col("next.text"), F.lit(1), F.col("half")), F.lit("")))))
    joined = with_sketch(joined, "text", "sketch", words, fraction)
    joined = with_sketch(joined, "edited", "edited_sketch", words, fraction)
    nothing = F.struct(F.lit(_HIGHEST).alias("cut"), F.array().cast("array<bigint>").alias("hashes"))
    joined = joined.withColumn("next_sketch", F.coalesce("next.sketch", nothing))
    joined = with_likeness(joined, "sketch", "edited_sketch", "near_edited", "contained_edited")
    joined = with_likeness(joined, "sketch", "next_sketch", "near_next", "contained_next")
    return joined.select(F.col("id").alias(id_col), "text", "n_chars", "edited", "sketch", "edited_sketch",
                         "near_edited", "near_next", "contained_edited", "contained_next")
