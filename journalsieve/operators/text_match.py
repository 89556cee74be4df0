"""Posting text against the label of its account."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from journalsieve.functions.text import strip
from journalsieve.operators.context import Context
from journalsieve.operators.parts import Part, RowIds
from journalsieve.operators.quantiles import exact_quantiles
from journalsieve.operators.text_vectors import is_dense, pair_cosines, text_vectors
from journalsieve.workspace import settle

SOURCE_LABEL = "bezeichnung"
SWEEP_STEPS = 18
EXAMPLES = 3
PERCENTILES = [10, 20, 30, 40, 50, 60, 70, 80, 90]


def with_labels(journal: DataFrame, labels: DataFrame | None, fallback: str | None = None) -> DataFrame:
    """The account label from ``labels`` (konto_soll, gt_bezeichnung), else the source label."""
    if labels is None:
        return journal.withColumn("gt_bezeichnung", F.col(fallback))
    known = labels.select(strip("konto_soll").alias("konto_soll"), "gt_bezeichnung")
    label = F.col("gt_bezeichnung")
    if fallback:
        label = F.coalesce(label, F.when(strip(fallback) != "", F.col(fallback)))
    return journal.join(known, "konto_soll", "left").withColumn("gt_bezeichnung", label)


def source_label(ctx: Context) -> str | None:
    """The journal's own label column, if it has one."""
    return next((n for n in ctx.journal.columns if n.lower() == SOURCE_LABEL), None)


def eligible_rows(ctx: Context) -> DataFrame:
    """Rows with text and label on an account of the checked range."""
    c = ctx.config
    fallback = source_label(ctx)
    number = F.col("_kontonummer")
    return (
        with_labels(ctx.journal, ctx.labels, fallback)
        .withColumn("label", strip("gt_bezeichnung"))
        .filter((F.col("buchungstext") != "") & (F.col("label") != ""))
        .filter((number >= c.text_konto_konto_min) & (number < c.text_konto_konto_max))
        .select("row_id", "konto_soll", "buchungstext", "label")
    )


def text_label_counts(ctx: Context) -> DataFrame:
    """One row per account, text and label with its cosine and row count, written once.

    Everything after this works on distinct combinations; equal texts are compared once.
    """
    combos = settle(
        eligible_rows(ctx).groupBy("konto_soll", F.col("buchungstext").alias("a"),
                                   F.col("label").alias("b"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row")), "text_label")
    if ctx.vectors is not None and is_dense(ctx.vectors):
        vectors = ctx.vectors
    else:
        texts = combos.select(F.col("a").alias("text")).union(combos.select("b"))
        vectors = settle(text_vectors(texts).select("text", "gram", "weight"), "text_vectors")
    return settle(combos.join(pair_cosines(combos, vectors), ["a", "b"]), "text_label_cosine")


def rows_with_cosine(ctx: Context, combos: DataFrame) -> DataFrame:
    """Every eligible row with the cosine of its combination."""
    return (
        eligible_rows(ctx).withColumnsRenamed({"buchungstext": "a", "label": "b"})
        .join(combos.select("konto_soll", "a", "b", "cosine"), ["konto_soll", "a", "b"])
    )


def text_konto_match(ctx: Context) -> list[Part]:
    """Rows whose text is unlike the label, on accounts with enough eligible rows.

    The label may come from the row itself, so the rows are looked up by all three columns.
    """
    # without a table of labels only a column of exactly that name counts
    if ctx.labels is None and SOURCE_LABEL not in ctx.journal.columns:
        return []
    c = ctx.config
    combos = text_label_counts(ctx)
    booked = combos.groupBy("konto_soll").agg(F.sum("n").alias("bookings")).filter(
        F.col("bookings") >= c.text_konto_min_bookings)
    unlike = settle(
        combos.filter(F.col("cosine") < c.text_konto_threshold)
        .join(booked, "konto_soll", "left_semi"), "unlike_labels")
    return [RowIds(rows_with_cosine(ctx, unlike).select("row_id"))]


def threshold_sweep(rows: DataFrame, combos: DataFrame) -> DataFrame:
    """Rows below each threshold 0.05 .. 0.90, their share, and the worst rows as examples.

    Each combination is counted at the first step it falls under, so one aggregation yields at most
    eighteen counts.  The lowest rows overall serve every threshold that lies above them.
    """
    guess = F.greatest(F.floor(F.col("cosine") / 0.05), F.lit(1))
    # the division may land on either side of a step, so compare with the steps themselves
    first_step = (
        F.when(F.col("cosine") < F.round(guess * 0.05, 2), guess)
        .when(F.col("cosine") < F.round((guess + 1) * 0.05, 2), guess + 1)
        .otherwise(guess + 2)
    )
    per_step = combos.withColumn("step", first_step).filter(F.col("step") <= SWEEP_STEPS) \
        .groupBy("step").agg(F.sum("n").alias("n"))
    counts = per_step.agg(F.collect_list(F.struct("step", "n"))).scalar()
    total = combos.agg(F.sum("n")).scalar()
    sample = F.struct("cosine", "row_id", "konto_soll", F.col("b").alias("label"),
                      F.col("a").alias("text"))
    worst = rows.orderBy("cosine", "row_id").limit(EXAMPLES) \
        .agg(F.sort_array(F.collect_list(sample))).scalar()
    steps = combos.sparkSession.range(1, SWEEP_STEPS + 1).select(
        F.round(F.col("id") * 0.05, 2).alias("threshold"), F.col("id").alias("at"),
        counts.alias("counts"), worst.alias("worst"), total.alias("total"))
    below = F.aggregate(
        F.filter("counts", lambda c: c["step"] <= F.col("at")), F.lit(0).cast("long"),
        lambda seen, c: seen + c["n"])
    shown = F.transform(
        F.filter("worst", lambda w: w["cosine"] < F.col("threshold")),
        lambda w: F.concat_ws(" ", w["konto_soll"], w["label"], w["text"]))
    return steps.withColumn("n_anomalies", below).select(
        "threshold", "n_anomalies",
        F.round(F.col("n_anomalies") / F.col("total") * 100, 1).alias("pct"),
        F.array_join(shown, "; ").alias("examples"))


def similarity_percentiles(combos: DataFrame) -> DataFrame:
    """P10 .. P90 of the similarities with the number of rows below, and the overall figures."""
    one_run = combos.withColumn("run", F.lit(0))
    spread = settle(exact_quantiles(one_run, "cosine", [p / 100 for p in PERCENTILES], ["run"],
                                    weight="n"), "similarity_quantiles")
    named = spread.select(F.explode(F.array(*[
        F.struct(F.lit(f"p{p}").alias("measure"), F.col(f"q{i}").alias("value"))
        for i, p in enumerate(PERCENTILES)])).alias("m")).select("m.*")
    cut = spread.head()
    below = combos.agg(*[
        F.sum(F.when(F.col("cosine") < F.lit(cut[f"q{i}"]), F.col("n")).otherwise(0)).alias(f"p{p}")
        for i, p in enumerate(PERCENTILES)
    ]).unpivot([], [f"p{p}" for p in PERCENTILES], "measure", "n_below")
    n, x = F.col("n"), F.col("cosine")
    mean = F.sum(n * x) / F.sum(n)
    overall = combos.agg(
        mean.alias("mean"),
        F.sqrt(F.greatest(F.sum(n * x * x) / F.sum(n) - mean * mean, F.lit(0.0))).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"),
    ).unpivot([], ["mean", "std", "min", "max"], "measure", "value")
    return named.join(below, "measure").unionByName(
        overall.withColumn("n_below", F.lit(None).cast("long")))
