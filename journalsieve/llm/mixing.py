"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

Each source has a target repetition rate: its share of the mixture over its share of the documents.  A
document's number of copies inverts the Poisson distribution of that mean at a uniform draw seeded by
the hash of its id, so it depends on nothing but the id, the rate and the seed: any task can be repeated
and no group is gathered.  The copies are then ordered by a hash of (seed, id, copy).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from journalsieve.workspace import settle


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5,
                 size: float = 1.0, source_col: str = "source") -> DataFrame:
    """(source, n, rate, cdf): documents, target copies per document, and the distribution of the copies.

    ``weights`` gives each source's share (others get none); without them the share is in proportion to
    the number of documents to the ``power``.  ``size`` is the length of the mixture as a multiple of
    the table.  ``cdf`` reaches as far as double precision tells values from 1.
    """
    spark = docs.sparkSession
    counted = settle(docs.groupBy(F.col(source_col).alias("source"))
                     .agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    if weights is None:
        weighed = counted.withColumn("weight", F.pow("n", F.lit(power)))
    else:
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items()] or [(None, 0.0)],
                                      "given string, weight double")
        weighed = counted.join(given, F.col("source").eqNullSafe(F.col("given")), "left").select(
            "source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    total = weighed.agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).head()
    if not total.weight:
        rate = F.lit(0.0)
    else:
        rate = F.col("weight") / F.lit(total.weight) * F.lit(float(total.n * size)) / F.col("n")
    rated = weighed.withColumn("rate", rate).withColumn(
        "reach", F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 40).cast("int"))
    step = lambda s, j: F.struct(
        (s["log"] + F.log("rate") - F.log(j.cast("double"))).alias("log"),
        F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1)
                                   + F.exp(s["log"] + F.log("rate") - F.log(j.cast("double"))))).alias("cdf"))
    start = F.struct((-F.col("rate")).alias("log"), F.array(F.exp(-F.col("rate"))).alias("cdf"))
    cdf = F.when(F.col("rate") > 0, F.aggregate(F.sequence(F.lit(1), F.col("reach")), start, step)["cdf"])
    return rated.select("source", "n", "rate", F.coalesce(cdf, F.array(F.lit(1.0))).alias("cdf"))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5,
                size: float = 1.0, seed: int = 0, id_col: str = "doc_id",
                source_col: str = "source") -> DataFrame:
    """Every document as often as its Poisson draw says, in a global hash order.

    Returns the columns of ``docs`` with ``copy`` (from 1), ``copies``, ``rate`` and ``place`` (the hash
    the rows are ordered by), replacing columns of those names.  A null source is a source of its own;
    a null id draws as the empty text; rows that share an id share their draw and stay repeated; an
    empty table stays empty.

    The rates are one row per source: Spark broadcasts that table if it proves small and otherwise
    splits the hot source in the shuffle join.  The text is shuffled once, for the global order.
    """
    own = ["copy", "copies", "rate", "place"]
    docs = docs.drop(*own)
    columns = docs.columns
    rates = source_rates(docs, weights, power, size, source_col).select(
        F.col("source").alias("__source"), F.col("rate").alias("__rate"), F.col("cdf").alias("__cdf"))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:draw:"), key)), 1, 13), 16, 10).cast("double")
    joined = docs.join(rates, docs[source_col].eqNullSafe(F.col("__source"))).withColumn(
        "copies", F.size(F.filter("__cdf", lambda c: c <= draw / 16.0 ** 13)))
    place = F.md5(F.concat(F.lit(f"{seed}:place:"), key, F.lit(":"), F.col("copy").cast("string")))
    return (joined.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select(*columns, "copy", "copies", F.col("__rate").alias("rate"), place.alias("place"))
            .orderBy("place", id_col))
