"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints within ``d`` differing bits agree in at least one of ``d + 1`` parts of their bits, so each
distinct fingerprint is dealt to one group per part.  A group too large for one task is dealt again by
the parts of its remaining bits, until it is small: a group that shares all but r bits has at most 2^r
distinct members, so this ends.  Nothing is capped and no pair is missed.

Within the groups of a task the fingerprints are sorted by Gray rank, where neighbours differ in few
bits.  Runs of neighbours form nodes, runs of nodes form upper nodes, and each node keeps the bits that
all below share and no upper node holds.  A search walks down with the differences counted so far and
leaves out every node that exceeds the limit.  Of the links found, a group returns a spanning forest.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from journalsieve.llm.common import own_columns
from journalsieve.operators.components import connected_components
from journalsieve.workspace import settle

WORDS, SEED, DISTANCE = 3, 42, 2
#: Members of the largest group that one task searches, children of a node, pairs held at once.
GROUP, FANOUT, HELD = 1024, 8, 1 << 21


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """A bit is set where more than half of the shingle hashes have it; no words give zero."""
    found = (text or "").encode().lower().split()  # bytes: lower-cases A-Z, splits at \x20 \x09-\x0D
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*[found[k:] for k in range(words)]))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], "<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words: int = WORDS) -> DataFrame:
    """(id, fp): the fingerprint of every whole text as a signed long; null text counts as empty."""
    source = own_columns(docs, id=id_col, text=text_col)
    source = source.withColumn("text", F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))],
                                             names=["id", "fp"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, fp bigint")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the binary reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """The hierarchical index of several groups of fingerprints, built and searched together."""

    def __init__(self, codes: np.ndarray, groups: np.ndarray):
        order = np.lexsort((gray_rank(codes), groups))
        self.order, self.codes, groups = order, codes[order], groups[order]
        levels, low, high, of = [], self.codes, self.codes, groups
        while True:
            shared = ~(low ^ high)
            levels.append((low & shared, shared))
            first = np.r_[True, of[1:] != of[:-1]]
            starts = np.flatnonzero(first)
            sizes = np.diff(np.r_[starts, len(of)])
            if (sizes == 1).all():
                break
            place = np.arange(len(of)) - np.repeat(starts, sizes)
            node_starts = np.flatnonzero(place % FANOUT == 0)
            self_children = (node_starts, np.diff(np.r_[node_starts, len(of)]))
            levels[-1] += self_children
            low, high = (np.bitwise_and.reduceat(low, node_starts), np.bitwise_or.reduceat(high, node_starts))
            of = of[node_starts]
        self.levels = levels  # from the fingerprints up to one node a group
        self.root_of = np.searchsorted(of, groups)

    def links(self, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the given arrays of all pairs of one group within ``distance``, each pair once."""
        query = np.arange(len(self.codes))
        node = self.root_of
        bits, held = self.levels[-1][0], self.levels[-1][1]
        apart = np.bitwise_count((self.codes ^ bits[node]) & held[node]).astype(np.int16)
        for below in range(len(self.levels) - 2, -1, -1):
            near = apart <= distance
            query, node, apart = query[near], node[near], apart[near]
            starts, counts = self.levels[below][2:]
            each = counts[node]
            offset = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            child = np.repeat(starts[node], each) + offset
            taken = held[np.repeat(node, each)]
            query, apart = np.repeat(query, each), np.repeat(apart, each)
            bits, held = self.levels[below][:2]
            apart = apart + np.bitwise_count(
                (self.codes[query] ^ bits[child]) & (held[child] & ~taken)).astype(np.int16)
            node = child
        near = (apart <= distance) & (query < node)
        return self.order[query[near]], self.order[node[near]]


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place linked to each of n places."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        if (low == label[a]).all() and (low == label[b]).all():
            break
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
    return label


def group_links(groups: list[np.ndarray], distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links within each group, a portion of groups at a time."""
    portion, held = [], 0
    for k, group in enumerate(groups):
        portion.append(group)
        held += len(group) ** 2
        if held >= HELD or k + 1 == len(groups):
            codes = np.concatenate(portion).view(np.uint64)
            index = GrayIndex(codes, np.repeat(np.arange(len(portion)), [len(g) for g in portion]))
            label = spanning_forest(len(codes), *index.links(distance))
            moved = np.flatnonzero(label != np.arange(len(codes)))
            yield codes[label[moved]].view(np.int64), codes[moved].view(np.int64)
            portion, held = [], 0


def _parts(free: int, count: int) -> list[int]:
    """Masks that deal the free bits into ``count`` even parts."""
    bits = [1 << k for k in range(64) if free >> k & 1]
    return [functools.reduce(int.__or__, bits[k * len(bits) // count:(k + 1) * len(bits) // count], 0)
            for k in range(count)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_pairs(codes: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """(a, b): edges over the distinct ``fp`` whose components are those of all links within ``distance``."""
    full = (1 << 64) - 1
    masks, found = [0], None
    members = codes.select("fp", F.lit(0).cast("long").alias("mask"))
    while True:
        finer = {m: [m | p for p in dict.fromkeys(_parts(full & ~m, distance + 1)) if p] for m in masks}
        deal = F.create_map(*[x for m, parts in finer.items() for x in (
            F.lit(_signed(m)), F.array(*[F.lit(_signed(p)) for p in parts]).cast("array<bigint>"))])
        dealt = (members.select("fp", F.explode(deal[F.col("mask")]).alias("mask"))
                 .withColumn("part", F.col("fp").bitwiseAND(F.col("mask"))))
        dealt = settle(dealt, "simhash-groups")
        sizes = dealt.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        hot = settle(sizes.filter(F.col("n") > group), "simhash-hot")
        small = dealt.join(sizes.filter(F.col("n") <= group).drop("n"), ["mask", "part"])
        small = small.groupBy("mask", "part").agg(F.collect_list("fp").alias("codes")).select("codes")

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                groups = [np.asarray(g.values, np.int64) for g in batch.column(0)]
                for a, b in group_links(groups, distance):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        links = settle(small.mapInArrow(search, "a bigint, b bigint"), "simhash-links")
        found = links if found is None else found.union(links)
        if hot.isEmpty():
            return found.distinct()
        # exact copies of one code are one member, so only distinct codes are dealt again
        members = dealt.join(hot.drop("n"), ["mask", "part"], "left_semi").select("fp", "mask")
        masks = list(dict.fromkeys(p for parts in finer.values() for p in parts))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    distance: int = DISTANCE, words: int = WORDS) -> DataFrame:
    """(id, fp, component): every row with its fingerprint and the least id it is linked to.

    Links join fingerprints at ``distance`` or fewer differing bits; components follow chains of links.
    Null or wordless texts have fingerprint zero and are linked like others.  Rows with a null id get a
    component but never name it; it is null where no member has an id.  Repeated rows stay; extra
    columns are left out; an empty table gives an empty table.

    Exact copies meet in a pre-aggregated distinct, pairs are sought among distinct fingerprints only,
    and the rows take their component from a table with one row per distinct fingerprint.
    """
    found = settle(fingerprints(docs, id_col, text_col, words), "simhash")
    codes = settle(found.groupBy("fp").agg(F.min("id").alias("least")), "simhash-codes")
    edges = near_pairs(codes.select("fp"), distance)
    components = connected_components(edges)
    of_code = codes.join(components, codes["fp"] == components["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root"))
    of_code = settle(of_code, "simhash-roots")
    roots = of_code.groupBy("root").agg(F.min("least").alias("component"))
    named = settle(of_code.join(roots, "root").select(F.col("fp").alias("code"), "component"), "simhash-named")
    return found.join(named, found["fp"] == named["code"]).select(
        F.col("id").alias(id_col), "fp", F.col("component").alias("component_id"))
