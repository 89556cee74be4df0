"""Periodic runs of words by a dictionary of basic factors.

A basic factor is a stretch of 2^k words.  The dictionary names equal basic factors equally, level by level:
a factor of 2^(k+1) words is the pair of the names of its halves.  Names are only kept for factors that
occur more than once, so a level costs no more than the repeats left, and the last one has none.

With m = 2^k, occurrences of one factor at most m/2 apart lie exactly its period apart (Fine and Wilf), so
they form arithmetic progressions of one difference d, and progressions lie more than m/2 apart.  A run of
smallest period q, m <= q < 2m, holds a factor that starts q apart in two different progressions, at most
three steps from each other.  The differences between two progressions are themselves an arithmetic
progression of step d: those from m to 2m - 1 are the proposed periods.  Each proposal is extended to both
sides through the dictionary, from the longest factors down; of extensions over the same words the smallest
period is the run's own.  No run is missed and nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from journalsieve.llm.common import text_portions

#: Words of the shortest run.
LEAST = 12

RUN = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
_TYPES = {"n_words": "bigint", "runs": "array<struct<start:bigint,length:bigint,period:bigint>>",
          "collapsed": "string"}


def _repeated(keys: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the keys that occur more than once (-1 elsewhere), and their places by name and place."""
    order = np.argsort(keys, kind="stable")
    keys, places = keys[order], places[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    counts = np.diff(np.r_[first, len(keys)])
    many = np.repeat(counts > 1, counts)
    places = places[many]
    label = np.repeat(np.arange((counts > 1).sum(), dtype=np.int32), counts[counts > 1])
    names = np.full(size, -1, np.int32)
    names[places] = label
    return names, places, label


def _proposals(places: np.ndarray, label: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period), m <= period < 2m, from the progressions of one level."""
    gap = np.diff(places)
    linked = (label[1:] == label[:-1]) & (2 * gap <= m)
    first = np.flatnonzero(np.r_[True, ~linked])
    last = np.r_[first[1:], len(places)] - 1
    name, start, end, count = label[first], places[first], places[last], last - first + 1
    step = np.where(count > 1, places[np.minimum(first + 1, len(places) - 1)] - start, 0)
    found = []
    for ahead in (1, 2, 3):
        a, b = np.arange(max(0, len(first) - ahead)), np.arange(ahead, max(ahead, len(first)))
        least = start[b] - end[a]
        near = (name[a] == name[b]) & (least < 2 * m)
        a, b, least = a[near], b[near], least[near]
        d = np.maximum(np.maximum(step[a], step[b]), 1)  # a single place has no difference and no second term
        low = np.maximum(-((least - m) // d), 0)
        high = np.minimum((2 * m - 1 - least) // d, count[a] + count[b] - 2)
        terms = np.maximum(high - low + 1, 0)
        which = np.repeat(np.arange(len(a)), terms)
        j = np.arange(len(which)) - np.repeat(np.cumsum(terms) - terms, terms) + low[which]
        period = least[which] + j * d[which]
        found.append((end[a][which] - np.minimum(j, count[a][which] - 1) * d[which], period))
    place, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    # places less than a factor apart with one period lie in one stretch
    fresh = np.r_[True, (period[1:] != period[:-1]) | (place[1:] - place[:-1] > m)][:len(place)]
    return place[fresh], period[fresh]


def _extension(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """Equal words from ``a`` and ``b`` on, or before them.  No factor repeats above the last level."""
    total, size = np.zeros(len(a), np.int64), len(levels[0])
    for k in range(len(levels) - 1, -1, -1):
        m, names = 1 << k, levels[k]
        x, y = (a - total - m, b - total - m) if back else (a + total, b + total)
        inside = (x >= 0) & (y < size)
        name = names[np.where(inside, x, 0)]
        total += m * (inside & (name >= 0) & (name == names[np.where(inside, y, 0)]))
    return total


def runs_of(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of every run in a sequence of word numbers, by start, then period.

    Several sequences may stand one after another if no two share a number: no run crosses them.
    """
    size = len(words)
    names, places, label = _repeated(words, np.arange(size), size)
    levels, proposed = [], []
    while len(places):
        m = 1 << len(levels)
        levels.append(names)
        proposed.append(_proposals(places, label, m))
        pairs = np.sort(places[places + m < size])
        pairs = pairs[names[pairs + m] >= 0]
        keys = names[pairs].astype(np.int64) * (int(label[-1]) + 1) + names[pairs + m]
        names, places, label = _repeated(keys, pairs, size)
    if not proposed:
        return np.empty((0, 3), np.int64)
    place, period = (np.concatenate(x) for x in zip(*proposed))
    start = place - _extension(levels, place, place + period, back=True)
    length = place + period + _extension(levels, place, place + period, back=False) - start
    kept = length >= np.maximum(least, 2 * period)
    found = np.stack([start[kept], length[kept], period[kept]], 1)
    # of equal stretches the smallest period; two stretches with one start differ in length and period
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    same = (found[1:, :2] == found[:-1, :2]).all(1)
    found = found[np.r_[True, ~same][:len(found)]]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _portion(texts: list[str], least: int, collapsed: bool) -> tuple[np.ndarray, pa.Array, list[str] | None]:
    """Word counts, runs and, if wanted, collapsed texts of one portion."""
    split = [t.encode().split() for t in texts]  # bytes: splits at \x20 \x09-\x0D
    counts = np.array([len(s) for s in split], np.int64)
    starts = np.cumsum(counts) - counts
    words = [w for s in split for w in s]
    codes = pa.array(words, pa.binary()).dictionary_encode()
    owner = np.repeat(np.arange(len(texts)), counts)
    found = runs_of(owner * (len(codes.dictionary) + 1) + codes.indices.to_numpy(), least)
    doc = owner[found[:, 0]] if len(found) else np.empty(0, np.int64)
    ends = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
    values = [found[:, 0] - starts[doc], found[:, 1], found[:, 2]]
    runs = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
        [pa.array(v) for v in values], fields=list(RUN)))
    if not collapsed:
        return counts, runs, None
    depth = np.zeros(len(words) + 1, np.int64)  # runs over each word, without their first period
    np.add.at(depth, found[:, 0] + found[:, 2], 1)
    np.add.at(depth, found[:, 0] + found[:, 1], -1)
    kept = np.cumsum(depth)[:-1] == 0
    return counts, runs, [b" ".join(compress(s, kept[a:a + len(s)])).decode() for a, s in zip(starts, split)]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
              keep: tuple[str, ...] = (), outputs: tuple[str, ...] = ("n_words", "runs", "collapsed")) -> DataFrame:
    """Every row of ``docs`` with its periodic runs.

    Words are what lies between \\x20 and \\x09-\\x0D.  A run is a stretch of words with smallest period q
    (words q apart are equal) of at least ``least`` and 2q words that no neighbour extends.  ``runs`` holds
    (start, length, period) in words, by start, then period.  ``collapsed`` is the text without the words
    that some run contains after its first q words, joined by blanks.

    A null or wordless text has no runs and an empty ``collapsed``.  Repeated rows and null ids stay; columns
    beside ``id_col`` and ``keep`` are left out; an empty table gives an empty table.  Texts are taken
    whole, a portion of about a million characters at a time: a map without a shuffle.
    """
    unknown = set(outputs) - set(_TYPES)
    if unknown:
        raise ValueError(f"unknown outputs: {sorted(unknown)}")
    kept = [id_col, *keep]
    text = "text" + "_" * max(map(len, kept))  # a name that none of the kept columns has
    source = docs.select(*[F.col(c) for c in kept],
                         F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]],
                        *[f"{o} {_TYPES[o]}" for o in outputs]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_portions(batch.column(len(kept))):
                counts, runs, short = _portion(texts, least, "collapsed" in outputs)
                made = {"n_words": lambda: pa.array(counts), "runs": lambda: runs,
                        "collapsed": lambda: pa.array(short, pa.string())}
                own = batch.slice(start, len(texts)).columns[:-1]
                yield pa.RecordBatch.from_arrays([*own, *[made[o]() for o in outputs]], names=[*kept, *outputs])

    return source.mapInArrow(run, schema)
