"""Nearest neighbours by a block matrix join with int8 tiles.

Queries and candidates are dealt into blocks by a hash of their id; every query block meets every
candidate block in a task of its own.  There, vectors are scaled to int8 and multiplied block by block;
the products of the integers are exact, and the length of what rounding left out bounds the error of
each product.  Only pairs whose upper bound reaches the k-th best lower bound of their query are
computed again in double precision, a heap per query keeps the best k, and the tiles' heaps are merged.
No neighbour can be lost: recall is 1 by construction.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from journalsieve.llm.common import own_columns

#: Rows of a query block and of a candidate block, and of the tiles multiplied at once.
QUERY_BLOCK, BLOCK, TILE = 2048, 8192, 256
#: Dimensions whose int8 products add up exactly in single precision.
EXACT = 1024
#: Largest component of a vector that has bounds, and the inverse of the smallest.
SAFE = 1e140


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


class Quantised:
    """A block in int8 with the norms that bound its error.

    Vectors whose largest component lies beyond ``SAFE`` have no bounds: their products or norms could
    leave the range of doubles, so every pair of theirs is computed again.
    """

    def __init__(self, vectors: np.ndarray):
        largest = np.abs(vectors).max(1)
        self.unbounded = (largest > SAFE) | (largest < 1 / SAFE)
        vectors = np.where(self.unbounded[:, None], 0.0, vectors)
        self.scale = np.where(self.unbounded, 1.0, largest) / 127
        # held in single precision, where sums of products of these integers are exact
        self.codes = np.rint(vectors / self.scale[:, None]).astype(np.int8).astype(np.float32)
        rounded = self.codes * self.scale[:, None]
        self.norm = lengths(vectors)
        self.rounded_norm = lengths(rounded)
        self.error = lengths(vectors - rounded)

    def bounds(self, rows: slice, other: "Quantised") -> tuple[np.ndarray, np.ndarray]:
        """Approximate products of ``rows`` with ``other``, and how far the true ones may lie off."""
        product = sum(self.codes[rows, k:k + EXACT] @ other.codes[:, k:k + EXACT].T.astype(np.float32)
                      for k in range(0, self.codes.shape[1], EXACT)).astype(np.float64)
        product *= self.scale[rows, None]
        product *= other.scale
        off = self.norm[rows, None] * other.error
        off += self.error[rows, None] * other.rounded_norm
        off += 1e-12 * self.norm[rows, None] * other.norm
        off += 1e-290  # products of components may vanish
        off[self.unbounded[rows]] = np.inf
        off[:, other.unbounded] = np.inf
        return product, off


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Euclidean norms; the vectors are scaled first, so that no square overflows or vanishes."""
    largest = np.abs(vectors).max(1)
    largest[largest == 0] = 1.0
    return np.linalg.norm(vectors / largest[:, None], axis=1) * largest


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows, in double precision, summed in the order of the dimensions."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore"):
        for k in range(a.shape[1]):
            total += a[:, k] * b[:, k]
    return total


def _first(entry: tuple[bool, float, int]) -> tuple[bool, float, int]:
    """Order of (is a number, negated product, id); products that are no number come first, by id."""
    return entry if entry[0] else (False, 0.0, entry[2])


def nearest_in_blocks(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray,
                      k: int) -> list[tuple[int, int, float]]:
    """The k best (query, id, product) of each query in one block, ties to the smaller id."""
    found: list[tuple[int, int, float]] = []
    coarse, blocks = Quantised(queries), Quantised(vectors)
    for start in range(0, len(queries), TILE):
        rows = slice(start, start + TILE)
        product, off = coarse.bounds(rows, blocks)
        own = query_ids[rows, None] == ids
        product[own] = -np.inf
        off[own] = 0
        place = max(0, len(ids) - k)
        least = np.partition(product - off, place, axis=1)[:, place]
        at, candidate = np.nonzero((product + off >= least[:, None]) & ~own)
        exact = exact_products(queries[rows][at], vectors[candidate])
        ends = np.searchsorted(at, np.arange(len(product) + 1))
        for row, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
            scores = exact[a:b]
            best = heapq.nsmallest(k, zip((~np.isnan(scores)).tolist(), (-scores).tolist(),
                                          ids[candidate[a:b]].tolist()), key=_first)
            found.extend((int(query_ids[start + row]), i, -s) for _, s, i in best)
    return found


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id",
            vector_col: str = "embedding", query_block: int = QUERY_BLOCK, block: int = BLOCK) -> DataFrame:
    """The ``k`` rows of largest inner product for every query row, all other rows being candidates.

    ``is_query`` is a condition on the id column.  Returns query_id, rank, id, score.  Vectors that are
    null, zero, or hold null or non-finite components take no part, nor do null ids; vectors meet only
    vectors of as many dimensions.  Of rows that share an id the smallest vector counts.  Ties go to the
    smaller id; with fewer than k candidates all are returned.  Products beyond the range of doubles are
    infinite, and no number where both infinities meet; those come first, as in Spark's order.  Extra
    columns are left out; an empty table gives an empty result.
    """
    rows = own_columns(vectors, id=id_col, vector=vector_col).select(
        F.col("id").cast("long"), F.col("vector").cast("array<double>"))
    rows = (rows.filter(F.col("id").isNotNull() & usable(F.col("vector")))
            .groupBy("id").agg(F.min("vector").alias("vector"))
            .withColumn("dims", F.size("vector")).withColumn("is_query", F.coalesce(
                F.expr("true") & is_query, F.lit(False))))
    counts = vectors.select(F.col(id_col).cast("long").alias("id")).agg(
        F.count("id").alias("all"), F.count(F.when(is_query, 1)).alias("queries")).head()
    n_blocks, n_query_blocks = -(-counts["all"] // block) or 1, -(-counts["queries"] // query_block) or 1
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("id", "vector", "dims", place(n_blocks).alias("block"),
                             every(n_query_blocks).alias("query_block"))
    queries = rows.filter("is_query").select("id", "vector", "dims", place(n_query_blocks).alias("query_block"),
                                             every(n_blocks).alias("block"))
    keys = ["dims", "query_block", "block"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            arrays = []
            for side in (left, right):
                values = side["vector"].combine_chunks()
                arrays += [side["id"].to_numpy(), values.flatten().to_numpy().reshape(side.num_rows, -1)]
            found = nearest_in_blocks(*arrays, k)
        names = [("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())]
        return pa.table([pa.array([f[i] for f in found], t) for i, (_, t) in enumerate(names)],
                        schema=pa.schema(names))

    tiles = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(
        meet, "query_id bigint, id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return tiles.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
