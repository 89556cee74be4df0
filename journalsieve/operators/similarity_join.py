"""Exact joins of unit vectors whose cosine reaches a threshold, down to what components need.

Term vectors: the grams of a vector are ordered from rare to common.  Two vectors of cosine t or more share
a rarest common gram, and in both of them what follows it, with it, is at least t long; so only the grams
up to there are posted.  The names posted under one gram are a group.  A small group is checked in one task,
after the bound (product of the grams known to be common, plus the product of the norms of what remains)
has taken out the members that cannot have a partner.  A group too large for that is dealt again by the
*second* rarest common gram, and so on: what the grams known so far and what follows the next one hold
together must again be t long.  Groups therefore end up small, and the pairs checked grow with the postings.

Only the components of the pairs are wanted.  So every member of a large group is first compared with its
heaviest member, which links nearly equal names in one pass, and groups within one component are let go.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from journalsieve.operators.components import connected_components
from journalsieve.workspace import settle

# the helpers travel with their tasks, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Members of the largest group checked at once, rows of a block, and how often a group is dealt again.
GROUP, BLOCK, DEPTH = 256, 256, 4
#: Bytes and rows of the largest block of dense vectors, rows of the smallest, and rows multiplied at once.
_DENSE_BYTES, _DENSE_ROWS, _DENSE_LEAST, _STRIP = 1 << 23, 1 << 14, 256, 1024
_SLACK = 1e-9
_EDGE = "a string, b string"


def pack(vectors: DataFrame) -> DataFrame:
    """(text, grams, weights, tails) of (text, gram, weight, df), from rare to common.

    ``tails`` are the squared norms from each gram on.
    """
    common_first = Window.partitionBy("text").orderBy(F.desc("df"), F.desc("gram"))
    tail = F.sum(F.col("weight") * F.col("weight")).over(
        common_first.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    terms = F.array_sort(F.collect_list(F.struct("df", "gram", "weight", "tail")))
    return vectors.withColumn("tail", tail).groupBy("text").agg(terms.alias("terms")).select(
        "text", F.col("terms.gram").alias("grams"), F.col("terms.weight").alias("weights"),
        F.col("terms.tail").alias("tails"))


def _postings(packed: DataFrame, least: float) -> DataFrame:
    """(path, text, root, at, heads): every text under its leading grams; ``heads`` are the weights on the path.

    Grams are of one length, so a path is its grams one after another.
    """
    at = F.explode(F.filter(F.sequence(F.lit(0), F.size("tails") - 1), lambda k: F.get("tails", k) >= least))
    return packed.withColumn("at", at).select(
        F.get("grams", "at").alias("path"), "text", F.col("text").alias("root"), "at",
        F.array(F.get("weights", "at")).alias("heads"))


def _mass(heads: Column) -> Column:
    return F.aggregate(heads, F.lit(0.0), lambda s, x: s + x * x)


def _dealt_again(members: DataFrame, packed: DataFrame, least: float) -> DataFrame:
    """The members under each further gram that may be their next common one."""
    nexts = F.when(F.col("at") + 1 < F.size("tails"), F.filter(
        F.sequence(F.col("at") + 1, F.size("tails") - 1),
        lambda k: _mass(F.col("heads")) + F.get("tails", k) >= least))
    return members.join(packed, "text").withColumn("next", F.explode(nexts)).select(
        F.concat("path", F.get("grams", "next")).alias("path"), "text", "root", F.col("next").alias("at"),
        F.concat("heads", F.array(F.get("weights", "next"))).alias("heads"))


def _least_reachable(close: np.ndarray) -> np.ndarray:
    """Index of the least row each row is connected to."""
    label = np.arange(len(close))
    while len(label):
        spread = np.where(close, label[None, :], len(close)).min(axis=1)
        spread = np.minimum(spread, label)
        if (spread == label).all():
            break
        label = spread
    return label


def _forest(names: np.ndarray, close: np.ndarray) -> pa.Table:
    """One edge per name that is connected to a lesser one."""
    label = _least_reachable(close)
    linked = np.flatnonzero(label != np.arange(len(names)))
    return pa.table({"a": pa.array(names[label[linked]], pa.string()), "b": pa.array(names[linked], pa.string())})


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy()


def _check(cosine: float):
    def check(cell: pa.Table) -> pa.Table:
        # a name may stand in a cell of two blocks more than once
        order = np.argsort(np.array(cell["text"].to_pylist(), object), kind="stable")
        names = np.array(cell["text"].to_pylist(), object)[order]
        cell = cell.take(pa.array(order[np.r_[True, names[1:] != names[:-1]]]))
        heads, _ = _numbers(cell["heads"])
        heads = heads.reshape(cell.num_rows, -1)
        rest = np.sqrt(np.maximum(cell["rest"].to_numpy(), 0))
        roots = np.unique(np.array(cell["root"].to_pylist(), object), return_inverse=True)[1]
        may = (heads @ heads.T + np.outer(rest, rest) >= cosine - _SLACK) & (roots[:, None] != roots)
        cell = cell.filter(pa.array(may.any(1)))
        names = np.array(cell["text"].to_pylist(), object)
        if not len(names):
            return _forest(names, np.zeros((0, 0), bool))
        grams = cell["grams"].combine_chunks()
        codes = grams.flatten().dictionary_encode()
        weights, sizes = _numbers(cell["weights"])
        matrix = np.zeros((len(names), len(codes.dictionary)))
        matrix[np.repeat(np.arange(len(names)), sizes), codes.indices.to_numpy()] = weights
        return _forest(names, matrix @ matrix.T >= cosine - _SLACK)
    return check


def _cells(members: DataFrame) -> DataFrame:
    """Each member once per pair of blocks of its group; at most two blocks of names per cell."""
    sizes = settle(members.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")),
                   "similarity_blocks")
    block = F.pmod(F.xxhash64("text"), F.col("blocks")).cast("int")
    dealt = members.join(sizes, "path").withColumn("block", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"lower": F.least("block", "other"), "upper": F.greatest("block", "other")})


def _checked(groups: DataFrame, keys: list[str], packed: DataFrame, cosine: float) -> DataFrame:
    rows = groups.join(packed, "text").withColumn("rest", F.coalesce(F.get("tails", F.col("at") + 1), F.lit(0.0)))
    return rows.select(*keys, "text", "root", "heads", "rest", "grams", "weights").groupBy(*keys).applyInArrow(
        _check(cosine), _EDGE)


def _with_heaviest(members: DataFrame, hot: DataFrame, packed: DataFrame, cosine: float) -> DataFrame:
    """Edges from the heaviest member of each large group to the members close to it."""
    rep = packed.select(F.col("text").alias("a"), F.map_from_arrays("grams", "weights").alias("terms"))
    led = settle(hot.join(rep, "a").select("path", "a", "terms"), "similarity_leaders")
    rows = members.join(led, "path").filter("text != a").join(packed, "text")
    products = F.zip_with("grams", "weights", lambda g, w: w * F.coalesce(F.try_element_at("terms", g), F.lit(0.0)))
    cosine_ = F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
    return rows.filter(cosine_ >= cosine - _SLACK).select("a", F.col("text").alias("b"))


def close_edges(vectors: DataFrame, cosine: float, group: int = GROUP, depth: int = DEPTH,
                report: list | None = None) -> DataFrame:
    """(a, b): edges whose components are those of all pairs of texts with at least that cosine.

    ``vectors`` are unit vectors (text, gram, weight, df).  A group still too large after ``depth`` further
    grams, and the members of a large group that its grams alone may join, are compared in blocks.
    ``report`` collects, level by level, (postings, pairs in small groups, postings in large groups).
    """
    least = cosine * cosine - _SLACK
    packed = settle(pack(vectors), "similarity_vectors")
    members, found = _postings(packed, least), None
    for level in range(depth + 1):
        members = settle(members, "similarity_members")
        heaviest = F.max_by("text", F.struct(_mass(F.col("heads")), "text")).alias("a")
        sizes = settle(members.groupBy("path").agg(
            F.count(F.lit(1)).alias("n"), heaviest, F.min("root").alias("least"), F.max("root").alias("most"))
            .filter("least != most").drop("least", "most"), "similarity_groups")
        small, hot = sizes.filter(F.col("n") <= group), sizes.filter(F.col("n") > group)
        if report is not None:
            pairs = F.col("n") * (F.col("n") - 1) / 2
            report.append(tuple(sizes.agg(F.sum("n"), F.sum(F.when(F.col("n") <= group, pairs)),
                                          F.sum(F.when(F.col("n") > group, F.col("n")))).head()))
        edges = _checked(members.join(small.select("path"), "path"), ["path"], packed, cosine)
        if hot.isEmpty():
            found = edges if found is None else found.union(edges)
            break
        large = members.join(hot.select("path"), "path")
        edges = edges.union(_with_heaviest(large, hot, packed, cosine))
        if level or not depth:
            # of two names that share one gram only, both are close to the heaviest under it; with more
            # grams known, names that need no further one meet here
            closed = large if level == depth else large.filter(_mass(F.col("heads")) >= least)
            edges = edges.union(_checked(_cells(closed), ["path", "lower", "upper"], packed, cosine))
        edges = settle(edges, "similarity_edges")
        found = edges if found is None else found.union(edges)
        if level < depth:
            known = settle(connected_components(found), "similarity_known")
            large = large.drop("root").join(known, large["text"] == known["node"], "left").select(
                "path", "text", F.coalesce("component", "text").alias("root"), "at", "heads")
            large = settle(large, "similarity_large")
            split = large.groupBy("path").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter(
                "least != most").select("path")
            members = _dealt_again(large.join(split, "path"), packed, least)
    return settle(found.distinct(), "similarity_found")


def unit_vectors(vectors: DataFrame, text: str = "text", vector: str = "vector") -> DataFrame:
    """(text, vector): given dense vectors at unit length, one per text (the least of several).

    Texts without a vector, and vectors that are zero or hold null or non-finite components, have none.
    """
    rows = vectors.select(F.col(text).alias("text"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # the largest component goes first, so that no square overflows
    scaled = F.transform("vector", lambda x: x / F.array_max(F.transform("vector", F.abs)))
    one = rows.filter(F.col("text").isNotNull() & finite & F.exists("vector", lambda x: x != 0)).groupBy("text").agg(
        F.min("vector").alias("vector")).withColumn("vector", scaled)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    return one.withColumn("norm", norm).select(
        "text", F.transform("vector", lambda x: x / F.col("norm")).alias("vector"))


def _lower(close: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
    """Lowers the labels of rows and columns to the least each is connected to."""
    top = np.iinfo(rows.dtype).max
    while True:
        low = np.minimum(rows, np.where(close, columns, top).min(axis=1))
        across = np.minimum(columns, np.where(close, low[:, None], top).min(axis=0))
        if (low == rows).all() and (across == columns).all():
            return
        rows[:], columns[:] = low, across


def _strip_edges(matrix: np.ndarray, here: np.ndarray, there: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(lesser row, row) edges that join what is close between two strips of rows, one per row at most."""
    close = matrix[here] @ matrix[there].T >= cosine - _SLACK
    rows, columns = here.copy(), there.copy()
    touched, met = np.flatnonzero(close.any(1)), np.flatnonzero(close.any(0))
    if not len(touched):
        return here[:0], here[:0]
    part, left, right = close[np.ix_(touched, met)], rows[touched], columns[met]
    _lower(part, left, right)
    labels, ends = np.r_[left, right], np.r_[here[touched], there[met]]
    linked = labels != ends
    return labels[linked], ends[linked]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Lowers ``label`` to the least row connected by the edges and by the labels so far."""
    while True:
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label[:] = label[label]
        if (label[a] == label[b]).all():
            return


def _dense_cells(vectors: DataFrame, block: int | None = None) -> DataFrame:
    """Each vector once per block of its length (``block`` rows, or ``_DENSE_BYTES``); two blocks a cell."""
    rows = settle(vectors.withColumn("dims", F.size("vector")), "dense_vectors")
    fit = F.lit(block) if block else F.greatest(F.lit(_DENSE_LEAST), F.least(
        F.lit(_DENSE_ROWS), F.floor(F.lit(_DENSE_BYTES) / (8 * F.col("dims")))))
    sizes = settle(rows.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).select(
        "dims", F.ceil(F.col("n") / fit).cast("int").alias("blocks")), "dense_blocks")
    own = F.pmod(F.xxhash64("text"), F.col("blocks")).cast("int")
    dealt = rows.join(sizes, "dims").withColumn("block", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("dims", F.least("block", "other").alias("lower"), F.greatest("block", "other").alias("upper"),
                        "block", "text", "vector")


def dense_edges(vectors: DataFrame, cosine: float, block: int | None = None, strip: int = _STRIP) -> DataFrame:
    """The same edges over dense unit vectors (text, vector), by a block matrix join.

    Dense vectors share all dimensions, so no posting tells them apart: every block meets every block, half
    of them for symmetry, in a task each, and a cell returns one edge per connected name.  Each vector is
    sent once per block, so blocks are large; a task multiplies them ``strip`` rows at a time and holds the
    products of two strips alone.  Vectors of other lengths never meet.
    """
    def check(cell: pa.Table) -> pa.Table:
        names = np.array(cell["text"].to_pylist(), object)
        blocks = cell["block"].to_numpy()
        # the rows of the lower block first, each in the order of names
        order = np.lexsort((np.argsort(np.argsort(names, kind="stable")), blocks))
        names, blocks = names[order], blocks[order]
        matrix = _numbers(cell["vector"])[0].reshape(len(names), -1)[order]
        at = np.arange(len(names))
        cut = int((blocks == blocks[0]).sum()) if len(names) else 0
        # a block meets itself in its own cell only
        alone = cell["lower"][0] == cell["upper"][0]
        left = [at[:cut][i:i + strip] for i in range(0, cut, strip)]
        right = [at[cut:][i:i + strip] for i in range(0, len(at) - cut, strip)]
        pairs = [(x, y) for i, x in enumerate(left) for y in left[i:]] if alone else [(x, y) for x in left for y in right]
        label = at.copy()
        for here, there in pairs:
            a, b = _strip_edges(matrix, here, there, cosine)
            if len(a):
                _joined(label, a, b)
        linked = np.flatnonzero(label != at)
        return pa.table({"a": pa.array(names[label[linked]], pa.string()), "b": pa.array(names[linked], pa.string())})

    return _dense_cells(vectors, block).groupBy("dims", "lower", "upper").applyInArrow(check, _EDGE)
