"""Isolation forest over a few row features (off by default).

The trees grow in parallel on samples of a fixed size (``isolation_trees`` and ``isolation_sample``,
100 and 256 rows); the forest, a few hundred kilobytes whatever the journal's size, is broadcast and
scores all rows in Arrow batches.  The cut
is the exact quantile of the scores.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from journalsieve.operators.context import Context
from journalsieve.operators.parts import Part, RowIds, counted_amounts
from journalsieve.operators.quantiles import draw_of_rank, exact_quantiles
from journalsieve.operators.text_vectors import is_dense
from journalsieve.workspace import settle

# the helpers travel with their tasks, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED, MIN_ROWS, TEXT_DIMS = 42, 50, 10
_TREE = "tree int, feature array<int>, cut array<double>, child array<int>, depth array<double>"


def features(ctx: Context) -> tuple[DataFrame, list[str]]:
    """Scaled log amount, day of month and weekday on circles, optional text dimensions."""
    rows = ctx.journal.filter(counted_amounts())
    size = F.log1p("_abs")
    scale = rows.agg(F.avg(size).alias("mean"), F.stddev_pop(size).alias("std")).head()
    day = F.coalesce(F.dayofmonth("_datum"), F.lit(0)) * (2 * math.pi / 31)
    weekday = F.coalesce(F.weekday("_datum"), F.lit(0)) * (2 * math.pi / 7)
    scaled = (size - F.lit(scale["mean"])) / F.lit(scale["std"]) if scale["std"] else size
    columns = {"size": scaled, "day_sin": F.sin(day), "day_cos": F.cos(day),
               "week_sin": F.sin(weekday), "week_cos": F.cos(weekday)}
    names = list(columns)
    table = rows.select("row_id", "buchungstext", *[c.alias(n) for n, c in columns.items()])
    if ctx.vectors is not None:
        dims = [f"text_{i}" for i in range(TEXT_DIMS)]
        if is_dense(ctx.vectors):
            folded = ctx.vectors.select(F.col("text").alias("buchungstext"), *[
                F.coalesce(F.get("vector", F.lit(i)), F.lit(0.0)).alias(d) for i, d in enumerate(dims)])
        else:
            slot = F.pmod(F.xxhash64("gram"), F.lit(TEXT_DIMS))
            folded = ctx.vectors.groupBy(F.col("text").alias("buchungstext")).agg(*[
                F.sum(F.when(slot == i, F.col("weight")).otherwise(0.0)).alias(d)
                for i, d in enumerate(dims)])
        table = table.join(folded, "buchungstext", "left").fillna(0.0, dims)
        names += dims
    return table.drop("buchungstext"), names


def _expected_depth(n: float) -> float:
    """Average path length of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(names: list[str]):
    def grow(sample: pd.DataFrame) -> pd.DataFrame:
        tree = int(sample["tree"].iloc[0])
        draw = np.random.default_rng([SEED, tree])
        points = sample.sort_values("row_id")[names].to_numpy()
        limit = math.ceil(math.log2(max(len(points), 2)))
        feature, cut, child, depth = [-1], [0.0], [0], [0.0]
        waiting = [(0, points, 0)]
        while waiting:
            node, held, level = waiting.pop()
            spread = np.ptp(held, axis=0) if len(held) > 1 else np.zeros(len(names))
            if level >= limit or not spread.any():
                depth[node] = level + _expected_depth(len(held))
                continue
            f = int(draw.choice(np.flatnonzero(spread)))
            low, high = held[:, f].min(), held[:, f].max()
            feature[node], cut[node], child[node] = f, float(draw.uniform(low, high)), len(cut)
            for _ in range(2):
                feature.append(-1), cut.append(0.0), child.append(0), depth.append(0.0)
            left = held[:, f] <= cut[node]
            waiting.append((child[node], held[left], level + 1))
            waiting.append((child[node] + 1, held[~left], level + 1))
        return pd.DataFrame({"tree": [tree], "feature": [feature], "cut": [cut],
                             "child": [child], "depth": [depth]})
    return grow


def forest(table: DataFrame, names: list[str], n_rows: int, trees: int, sample: int) -> list:
    """The trees as flat arrays.

    The rows with the smallest hashes, as many as all trees together take, are put in one random
    order.  Each tree takes the next ``sample`` places, going round where the table holds fewer.
    """
    wanted, each = min(n_rows, trees * sample), min(n_rows, sample)
    drawn = table.withColumn("draw", F.md5(F.concat(F.lit(f"{SEED}-"), F.col("row_id").cast("string"))))
    if wanted < n_rows:
        drawn = drawn.filter(F.col("draw") < draw_of_rank(drawn.select("draw"), wanted))
    place = F.row_number().over(Window.orderBy("draw", "row_id")) - 1  # trees * sample rows at most
    samples = (
        drawn.withColumn("place", place)
        .withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        .filter(F.pmod(F.col("place") - F.col("tree") * each, F.lit(wanted)) < each)
    )
    return samples.groupBy("tree").applyInPandas(_grow(names), _TREE).collect()


def scores(ctx: Context) -> DataFrame | None:
    """(row_id, score); higher is more isolated.  None when the journal is too small."""
    config = ctx.config
    table, names = features(ctx)
    table = settle(table, "isolation_features")
    n_rows = table.count()
    if n_rows < MIN_ROWS:
        return None
    trees = [tuple(np.asarray(part) for part in (t.feature, t.cut, t.child, t.depth))
             for t in forest(table, names, n_rows, config.isolation_trees, config.isolation_sample)]
    shared = ctx.journal.sparkSession.sparkContext.broadcast(trees)
    norm = _expected_depth(min(config.isolation_sample, n_rows))

    @F.pandas_udf("double")
    def score(frame: pd.DataFrame) -> pd.Series:
        points = frame.to_numpy(dtype=float)
        rows = np.arange(len(points))
        total = np.zeros(len(points))
        for feature, cut, child, depth in shared.value:
            node = np.zeros(len(points), dtype=int)
            while (feature[node] >= 0).any():
                inner = feature[node] >= 0
                at = node[inner]
                right = points[rows[inner], feature[at]] > cut[at]
                node[inner] = child[at] + right
            total += depth[node]
        return pd.Series(np.power(2.0, -total / (len(shared.value) * norm)))

    return settle(table.select("row_id", score(F.struct(*names)).alias("score")), "isolation")


def isolation_anomalie(ctx: Context) -> list[Part]:
    if not ctx.config.isolation_enabled:
        return []
    scored = scores(ctx)
    if scored is None:
        return []
    cut = exact_quantiles(scored.withColumn("run", F.lit(0)), "score",
                          [1.0 - ctx.config.isolation_contamination], ["run"])
    return [RowIds(scored.filter(F.col("score") > cut.select("q0").scalar()).select("row_id"))]
