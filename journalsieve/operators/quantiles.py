"""Exact interpolated quantiles without collecting a group.

The built-in exact percentile keeps every distinct value of a group in one task.  Here a value gets
a position code that grows with it (octave, then leading mantissa bits).  Counting coarse cells
finds the cell that holds each wanted rank; only that cell is counted again in fine cells, and only
the fine cell by value.  Every step is a count combined before its shuffle: no window sees raw rows, and
no values are shuffled but those of the cells that hold a wanted rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_FINE = 1 << 24
_COARSE = 1 << 12
_OCTAVE_SHIFT = 1100


def _position(v: Column) -> Column:
    """A long that never decreases when ``v`` grows."""
    size = F.abs(v)
    octave = F.floor(F.log2(size))
    mantissa = size / F.pow(F.lit(2.0), octave) - 1.0
    code = (octave + _OCTAVE_SHIFT) * _FINE + F.floor(mantissa * _FINE)
    return (F.when(v == 0, F.lit(0)).when(v > 0, code).otherwise(-code)).cast("long")


def _counted(values: DataFrame, here: list[str], cell: str) -> DataFrame:
    """Per ``here`` and ``cell`` the values held and those up to its end."""
    return values.groupBy(*here, cell).agg(F.sum("weight").alias("held")).withColumn(
        "upto", F.sum("held").over(Window.partitionBy(*here).orderBy(cell)))


def _known(found: DataFrame) -> DataFrame:
    """The wanted ranks so far as a local table: two rows per group and quantile."""
    return found.sparkSession.createDataFrame(found.collect(), found.schema)


def _narrow(values: DataFrame, wanted: DataFrame, by: list[str], inside: list[str],
            cell: str) -> DataFrame:
    """For each wanted rank, the ``cell`` that holds it and the number of values before it."""
    here = [*by, *inside]
    cells = _counted(values.join(F.broadcast(wanted.select(*here).distinct()), here, "left_semi"), here, cell)
    hit = (F.col("rank") >= F.col("before") + F.col("upto") - F.col("held")) & (
        F.col("rank") < F.col("before") + F.col("upto"))
    return (
        cells.join(F.broadcast(wanted), here).filter(hit)
        .select(*by, "rank", "n", *inside, cell,
                (F.col("before") + F.col("upto") - F.col("held")).alias("before"))
    )


def exact_quantiles(rows: DataFrame, value: str, probs: list[float], by: list[str],
                    weight: str | None = None) -> DataFrame:
    """One row per group: ``n`` and ``q0``, ``q1``, ... with linear interpolation.

    ``by`` must have few groups (account classes, one run): the wanted ranks pass through the driver.
    ``weight`` names a column with repetition counts.  ``rows`` are read three times, the two columns
    alone, in the same way at every size; write them first where they are dear to compute.
    """
    values = rows.filter(F.col(value).isNotNull()).select(
        *by, F.col(value).alias("v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("weight"))
    values = values.withColumn("fine", _position(F.col("v"))) \
        .withColumn("coarse", F.floor(F.col("fine") / _COARSE))

    def spot(p: float) -> Column:
        return (F.col("n") - 1) * F.lit(float(p))

    ranks = F.array_distinct(F.flatten(F.array(*[
        F.array(F.floor(spot(p)), F.ceil(spot(p))) for p in probs])))
    before = F.col("upto") - F.col("held")
    first = _counted(values, by, "coarse").withColumn("n", F.sum("held").over(Window.partitionBy(*by)))
    found = _known(first.select(
        *by, F.explode(F.filter(ranks, lambda r: (r >= before) & (r < F.col("upto")))).alias("rank"), "n",
        "coarse", before.alias("before")))
    found = _known(_narrow(values, found, by, ["coarse"], "fine"))
    found = _narrow(values, found, by, ["coarse", "fine"], "v")

    def at(rank: Column) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col("v")))

    ends = [
        end for i, p in enumerate(probs)
        for end in (at(F.floor(spot(p))).alias(f"low{i}"), at(F.ceil(spot(p))).alias(f"high{i}"))
    ]
    bounds = found.groupBy(*by, "n").agg(*ends)
    return bounds.select(*by, "n", *[
        (F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}"))
         * (spot(p) - F.floor(spot(p)))).alias(f"q{i}")
        for i, p in enumerate(probs)
    ])


def draw_of_rank(draws: DataFrame, rank: int, digits: int = 3) -> str:
    """The text below which ``rank`` of the distinct hexadecimal draws lie; each step counts 16^3 cells."""
    bound = ""
    while rank or not bound:
        cells = draws.filter(F.col("draw").startswith(bound)).groupBy(
            F.substring("draw", len(bound) + 1, digits).alias("cell")).count().collect()
        for cell in sorted(cells):
            if cell["count"] > rank:
                bound += cell["cell"]
                break
            rank -= cell["count"]
        else:
            return bound + "g"  # every draw of the cell
        if len(bound) >= 32:
            break
    return bound
