"""Unit-length text vectors over character trigrams, as rows of a term table.

A vector is the set of rows (text, gram, weight) of one text.  Keeping it relational lets joins and
pre-aggregated sums do the vector work, on whole texts, without any Python per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from journalsieve.workspace import settle

GRAM = 3


def gram_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, gram, tf) of every non-empty text, lower case, with a blank on each end.

    ``key`` is unique.  The text is split into characters once, so the work per text is linear.
    """
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    grams = F.transform(
        F.sequence(F.lit(0), F.size("chars") - GRAM),
        lambda i: F.concat(*[F.get("chars", i + step) for step in range(GRAM)]))
    return (
        texts.filter(F.col(text) != "")
        .select(F.col(key).alias("text"), F.split(padded, "").alias("chars"))
        .select("text", F.explode(grams).alias("gram"))
        .groupBy("text", "gram").agg(F.count(F.lit(1)).alias("tf"))
    )


def text_vectors(texts: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """(text, gram, weight, df): weight is tf * ln(1 + texts / df), scaled to unit length.

    The vectors belong to the distinct texts themselves, or to ``key`` where texts are long; the
    column ``text`` of the result holds the text or the key.

    The document frequencies are written before they are joined: a vocabulary small enough is
    broadcast, a large one goes through a skew-split shuffle join.
    """
    if key is None:
        texts, key = texts.select(text).distinct(), text
    counts = settle(gram_counts(texts, key, text), "gram_counts")
    n_texts = counts.agg(F.count_distinct("text")).scalar()
    frequency = settle(counts.groupBy("gram").agg(F.count(F.lit(1)).alias("df")), "gram_df")
    raw = F.col("tf") * F.log(1 + n_texts / F.col("df"))
    one_text = Window.partitionBy("text")
    return (
        counts.join(frequency, "gram").withColumn("raw", raw)
        .withColumn("norm", F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(one_text)))
        .select("text", "gram", (F.col("raw") / F.col("norm")).alias("weight"), "df")
    )


def is_dense(vectors: DataFrame) -> bool:
    """Whether vectors are given as (text, vector) and not as terms (text, gram, weight)."""
    return "vector" in vectors.columns


def pair_cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, cosine) of the distinct text pairs (a, b); pairs without a common gram get 0.

    Dense unit vectors (text, vector) are joined to both sides; a pair of which one text has no vector,
    or whose vectors differ in length, has a null cosine.
    """
    wanted = pairs.select("a", "b").distinct()
    if is_dense(vectors):
        left = vectors.select(F.col("text").alias("a"), F.col("vector").alias("va"))
        right = vectors.select(F.col("text").alias("b"), F.col("vector").alias("vb"))
        alike = F.size("va") == F.size("vb")
        return wanted.join(left, "a", "left").join(right, "b", "left").select(
            "a", "b", F.when(alike, dot(F.col("va"), F.col("vb"))).alias("cosine"))
    left = vectors.select(F.col("text").alias("a"), "gram", F.col("weight").alias("wa"))
    right = vectors.select(F.col("text").alias("b"), "gram", F.col("weight").alias("wb"))
    return (
        wanted.join(left, "a", "left").join(right, ["b", "gram"], "left")
        .groupBy("a", "b")
        .agg(F.coalesce(F.sum(F.col("wa") * F.col("wb")), F.lit(0.0)).alias("cosine"))
    )


def dot(a: F.Column, b: F.Column) -> F.Column:
    """Dot product of two dense array vectors."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine_pairs(pairs: DataFrame, vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Cosine of paired unit vectors: ``pairs`` holds (id_a, id_b), ``vectors`` (key, vector)."""
    a = vectors.select(F.col(key).alias("id_a"), F.col(vector).alias("va"))
    b = vectors.select(F.col(key).alias("id_b"), F.col(vector).alias("vb"))
    return pairs.join(a, "id_a").join(b, "id_b").select(
        "id_a", "id_b", dot(F.col("va"), F.col("vb")).alias("cosine"))
