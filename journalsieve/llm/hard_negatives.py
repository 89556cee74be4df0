"""Hard negatives by threshold joins in the manner of L2AP.

Two joins of anchors with all rows, dealt into blocks: first the best rows of an anchor's own label, its
positives; each positive's score then opens a window of scores, and the second join fills the windows with
the best rows of other labels.  A pair counts for a window only, so a threshold per anchor decides what a
block has to look at: it starts high and is lowered until every window of the anchor is full or lies above it.

Within a block the anchors are an inverted index, one list of (anchor, value) per dimension.  Dimensions are
taken in one order, those with the largest values first, and an anchor is not listed in the last dimensions
once the norm of what is left of it, times the largest norm of a row, is below its threshold: rows that meet
it nowhere else cannot reach the threshold.  The lists add up partial scores some dimensions at a time.
After each step the norms of what remains of both vectors bound the score, and pairs below the threshold
fall away.  The pairs left get their omitted dimensions; scores are whole numbers, so they are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from journalsieve.llm.common import own_columns
from journalsieve.workspace import settle

POSITIVES, NEGATIVES, SCALE = 5, 3, 256
#: A negative scores between these hundredths of its positive.
LOW, HIGH = 50, 95
#: Bytes of a block of vectors; anchors of a tile and rows it meets at once; dimensions per step.
BLOCK_BYTES, TILE, STRIPE, STEP = 4 << 20, 64, 8192, 16
#: The thresholds, as shares of the highest score that can count for an anchor, down to its lowest window.
SHARES = (0.9, 0.7, 0.5, 0.0)
#: Squared norms stay below this, so that every score fits a long.
NORM = float(1 << 62)
#: Whole numbers up to here add up exactly in double precision.
EXACT = float(1 << 53)


def whole_vectors(rows: DataFrame, scale: int = SCALE, id_col: str = "vec_id", label_col: str = "label",
                  vector_col: str = "embedding") -> DataFrame:
    """(id, label, vector, dims): components floor(scale * x) of the rows that take part, once per id."""
    rows = own_columns(rows, id=id_col, label=label_col, vector=vector_col).select(
        F.col("id").cast("long"), "label", F.col("vector").cast("array<double>"))
    small = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < 2.0 ** 31)
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall("vector", small))
    rows = rows.withColumn("vector", F.transform("vector", lambda x: F.floor(x * scale)))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = rows.filter(norm < NORM).withColumn("vector", F.col("vector").cast("array<int>"))
    one = rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row"))
    return one.select("id", "row.label", "row.vector", F.size("row.vector").alias("dims"))


class Rows:
    """Vectors in the order of the dimensions, with the norms of what follows every ``step``-th one."""

    def __init__(self, vectors: np.ndarray, order: np.ndarray, step: int):
        self.values = np.ascontiguousarray(vectors[:, order])
        self.ends = np.arange(0, vectors.shape[1] + step, step).clip(max=vectors.shape[1])
        squares = np.zeros((len(vectors), vectors.shape[1] + 1))
        np.square(self.values[:, ::-1], out=squares[:, 1:], dtype=np.float64)
        # a little more than the norm, so that no rounding loses a pair
        self.rest = np.sqrt(np.cumsum(squares, 1))[:, vectors.shape[1] - self.ends] * (1 + 1e-9)


def _reaching(anchors: Rows, rows: Rows, threshold: np.ndarray,
              meets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs allowed by ``meets`` that score at least the anchor's threshold."""
    dims, kind = anchors.values.shape[1], anchors.values.dtype
    off = 0 if kind == np.float64 else 1 << 12  # beyond double precision the bounds are rounded
    # an anchor is listed in its first dimensions, up to where the rest of it cannot reach the threshold
    reach = anchors.rest * rows.rest[:, 0].max() + off
    listed = (reach >= threshold[:, None]).sum(1).clip(max=dims)
    alive = meets & (reach[:, 0] >= threshold)[:, None]
    partial = np.zeros(meets.shape, kind)
    at = 0
    while at < dims and alive.sum() * 16 >= alive.size:
        some = np.flatnonzero((listed > at) & alive.any(1))
        if not len(some):
            break
        here = slice(at, min(at + STEP, dims))
        partial[some] += anchors.values[some, here] @ rows.values[:, here].T
        at = here.stop
        bound = partial[some] + anchors.rest[some, at, None] * rows.rest[:, -(-at // STEP)] + off
        alive[some] &= bound >= threshold[some, None]
    a, r = np.nonzero(alive)
    score = partial[a, r]
    # the pairs left get the dimensions in which their anchor is not listed, or that few pairs reached
    done = np.minimum(at, -(-listed // STEP) * STEP)[a]
    for start in range(0, dims, STEP):
        left, here = np.flatnonzero(done <= start), slice(start, start + STEP)
        for part in range(0, len(left), 1 << 18):
            p = left[part:part + (1 << 18)]
            score[p] += np.einsum("ij,ij->i", anchors.values[a[p], here], rows.values[r[p], here])
    score = score.astype(np.int64)
    reached = score >= threshold[a]
    return a[reached], r[reached], score[reached]


class Windows:
    """What a tile of anchors has found: for each of its windows the best pairs so far."""

    def __init__(self, windows: list[list[tuple[int, int]]], count: int):
        width = max(map(len, windows))
        # a window of no score at all fills up the shorter lists
        padded = [w + [(1, 0)] * (width - len(w)) for w in windows]
        self.low, self.high = (np.array([[x[i] for x in w] for w in padded], np.int64) for i in (0, 1))
        self.real = self.low <= self.high
        self.count, self.anchor, self.id, self.score = count, *(np.empty(0, np.int64) for _ in range(3))

    def add(self, anchor: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.anchor, self.id, self.score = (np.concatenate(x) for x in (
            (self.anchor, anchor), (self.id, ids), (self.score, score)))
        kept = np.zeros(len(self.anchor), bool)
        #: the least score that can still matter: of a full window its last one, else the window's lowest
        self.least = self.low.copy()
        for w in range(self.low.shape[1]):
            inside = np.flatnonzero((self.score >= self.low[self.anchor, w]) & (self.score <= self.high[self.anchor, w]))
            order = inside[np.lexsort((self.id[inside], -self.score[inside], self.anchor[inside]))]
            place = np.arange(len(order)) - np.searchsorted(self.anchor[order], self.anchor[order])
            kept[order[place < self.count]] = True
            last = order[place == self.count - 1]
            self.least[self.anchor[last], w] = self.score[last]
        self.anchor, self.id, self.score = self.anchor[kept], self.id[kept], self.score[kept]

    def floor(self) -> np.ndarray:
        """Per anchor the least score that can still matter to any of its windows."""
        return np.where(self.real, self.least, np.iinfo(np.int64).max).min(1)


def search_block(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, windows: list[list[tuple[int, int]]],
                 row_ids: np.ndarray, row_labels: np.ndarray, rows: np.ndarray, count: int,
                 same_label: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor id, row id, score): for each window (low, high) of each anchor its ``count`` best rows.

    Rows have the anchor's label or, without ``same_label``, another one; an anchor is not its own row.
    """
    length = np.linalg.norm(vectors.astype(np.float64), axis=1)
    longest = np.linalg.norm(rows.astype(np.float64), axis=1).max()
    kind = np.float64 if length.max() * longest < EXACT else np.int64
    weight = np.square(vectors, dtype=np.float64).sum(0) * np.square(rows, dtype=np.float64).sum(0)
    order = np.argsort(-weight, kind="stable")
    stripes = [Rows(rows[s:s + STRIPE].astype(kind), order, STEP) for s in range(0, len(rows), STRIPE)]
    some = np.array([i for i, w in enumerate(windows) if w], np.int64)
    for first in range(0, len(some), TILE):
        tile = some[first:first + TILE]
        index = Rows(vectors[tile].astype(kind), order, 1)
        found = Windows([windows[i] for i in tile], count)
        found.add(*(np.empty(0, np.int64) for _ in range(3)))
        top = np.minimum(found.high.max(1), length[tile] * longest)
        for s, stripe in enumerate(stripes):
            here = slice(s * STRIPE, (s + 1) * STRIPE)
            meets = (labels[tile, None] == row_labels[here]) == same_label
            meets &= ids[tile, None] != row_ids[here]
            before = np.full(len(tile), np.iinfo(np.int64).max)
            for share in SHARES:
                threshold = np.maximum(found.floor(), np.ceil(top * share).astype(np.int64))
                a, r, score = _reaching(index, stripe, threshold, meets)
                fresh = score < before[a]
                found.add(a[fresh], row_ids[here][r[fresh]], score[fresh])
                # an anchor that needs nothing below its threshold is done with this stripe
                meets &= (found.floor() < threshold)[:, None]
                before = threshold
                if not meets.any():
                    break
        yield ids[tile][found.anchor], found.id, found.score


def _matrix(table: pa.Table) -> np.ndarray:
    values = table["vector"].combine_chunks().flatten().to_numpy()
    return values.reshape(table.num_rows, len(values) // table.num_rows)


def _search(count: int, same_label: bool, windows):
    """Searches the rows of a block for the anchors of a block; ``windows`` reads an anchor's windows off its row."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [(np.empty(0, np.int64),) * 3]
        if left.num_rows and right.num_rows:
            sides = [(t["id"].to_numpy(), _matrix(t)) for t in (left, right)]
            names = np.array(left["label"].to_pylist() + right["label"].to_pylist(), object)
            labels = np.unique(names, return_inverse=True)[1]
            parts += search_block(sides[0][0], labels[:left.num_rows], sides[0][1], windows(left), sides[1][0],
                                  labels[left.num_rows:], sides[1][1], count, same_label)
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["anchor_id", "id", "score"])

    return run


def _meet(anchors: DataFrame, rows: DataFrame, group: list[str], block_bytes: int, search) -> DataFrame:
    """(anchor_id, id, score) of ``search`` over every block of anchors with every block of rows of its group.

    A group's numbers of blocks follow from its counts; blocks are dealt by a hash of the id, so a group that
    holds much of the table is many blocks.
    """
    full = F.lit(4) * F.greatest(F.col("dims"), F.lit(1)) / F.lit(block_bytes)
    blocks = lambda df, name: df.groupBy(*group).agg(
        F.ceil(F.count(F.lit(1)) * F.max(full)).cast("int").alias(name))
    sizes = settle(blocks(rows, "blocks").join(blocks(anchors, "anchor_blocks"), group), "negatives-blocks")
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = anchors.join(sizes, group).select(
        *[F.col(c).alias(c) for c in anchors.columns], place("anchor_blocks").alias("anchor_block"), every("blocks").alias("block"))
    right = rows.join(sizes, group).select(
        *[F.col(c).alias(c) for c in rows.columns], place("blocks").alias("block"), every("anchor_blocks").alias("anchor_block"))
    keys = [*group, "anchor_block", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        search, "anchor_id bigint, id bigint, score bigint")


def positives_of(anchors: DataFrame, rows: DataFrame, count: int = POSITIVES,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positives): of each anchor the ``count`` best rows of its label, (rank, id, score).

    Rows that score below zero are left out: no row lies between two shares of a negative score.
    """
    search = _search(count, True, lambda t: [[(0, 1 << 62)]] * t.num_rows)
    found = _meet(anchors, rows, ["dims", "label"], block_bytes, search)
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= count)
    return best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
         high: int = HIGH, scale: int = SCALE, id_col: str = "vec_id", label_col: str = "label",
         vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on the column ``id``.  Scores are inner products of the whole numbers
    floor(scale * x); higher ones come first, ties go to the smaller id.  Every anchor's ``positives`` best
    other rows of its label each get the ``negatives`` best rows of other labels that score between ``low``
    and ``high`` hundredths of theirs (all, if there are fewer).

    Rows with a null id, label or vector, or with null or non-finite components take no part, nor do vectors
    whose scores no long could hold (components of 2^31 or a norm of 2^31 after scaling).  Of rows that share
    an id the one with the smallest label and vector counts.  Vectors meet vectors of as many dimensions
    only.  Extra columns are left out; an empty table gives an empty result.
    """
    whole = settle(whole_vectors(rows, scale, id_col, label_col, vector_col), "negatives-rows")
    anchors = whole.filter(is_anchor)
    own = settle(positives_of(anchors, whole, positives, block_bytes), "negatives-positives")
    scores = own.select(F.col("anchor_id").alias("id"), F.col("positives.score").alias("scores"))

    def windows(table: pa.Table) -> list[list[tuple[int, int]]]:
        spans = [[(-(-low * p // 100), high * p // 100) for p in given] for given in table["scores"].to_pylist()]
        return [sorted({(a, b) for a, b in found if a <= b}) for found in spans]

    found = _meet(anchors.join(scores, "id"), whole, ["dims"], block_bytes, _search(negatives, False, windows))
    of_positive = own.select("anchor_id", F.inline("positives")).select(
        "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    hundredths = lambda c, n: F.col(c).cast("decimal(20,0)") * n
    pairs = found.join(of_positive, "anchor_id").filter(
        (hundredths("positive_score", low) <= hundredths("score", 100))
        & (hundredths("score", 100) <= hundredths("positive_score", high)))
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
