"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text becomes the hashed counts of its letters' byte n-grams, weighted by log frequency and inverse
document frequency and brought to unit length.  Each language has several centroids, clustered by cosine
from a bounded sample of labelled documents.  The language of the centroid with the largest cosine wins;
a text that lies much farther from its centroid than any sample text of the language is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from journalsieve.llm.common import own_columns
from journalsieve.workspace import settle

#: Expected labelled documents drawn per language (the fit's only sample), and centroids per language.
SAMPLE, CLUSTERS = 1500, 4
#: Buckets of the n-gram hash, lengths of the n-grams, and the part of the cosine of a language's farthest
#: sample text that a text must reach to be kept: short texts lie far from every centroid.
BUCKETS, LENGTHS, LEAST_PART = 1 << 13, (1, 2, 3), 0.5
UNDEFINED = "und"

_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(rb"[\x00-\x60\x7b-\x7f]+")  # ASCII but a-z, after lower-casing


def has_letter(text: str | None) -> bool:
    return bool(text) and (any(map(str.isalpha, text)) if not _LETTER.search(text) else True)


def ngram_counts(text: str) -> np.ndarray:
    """Hashed counts of the byte n-grams within words; beyond ASCII every byte counts as a letter."""
    data = np.frombuffer(_OTHER.sub(b" ", b" " + text.lower().encode() + b" "), np.uint8)
    counts = np.zeros(BUCKETS)
    code = np.zeros(len(data), np.uint32)
    letters = data != 32
    for length in range(1, max(LENGTHS) + 1):
        code = code[:len(data) - length + 1] << np.uint32(8) | data[length - 1:]
        if length == 1:
            kept = code[letters]
        else:  # a space may open or close an n-gram, not lie inside it
            kept = code[letters[length - 2:len(data) - 1]] if length == 2 else code[letters[1:len(data) - 1]]
        if length in LENGTHS:
            place = ((kept + np.uint32(length * 0x1000193)) * np.uint32(2654435761)) >> np.uint32(19)
            counts += np.bincount(place, minlength=BUCKETS)
    return counts


@dataclass(frozen=True)
class LanguageModel:
    """Centroids of unit length, the language of each, how far each language reaches, and the idf."""

    languages: list[str]
    language_of: np.ndarray
    centroids: np.ndarray
    reach: np.ndarray
    idf: np.ndarray

    def vector(self, text: str) -> np.ndarray:
        return unit(np.log1p(ngram_counts(text)) * self.idf)

    def nearest(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine from 0 to 1, rejected); no letters: undefined, 0, rejected."""
        if not self.languages or not has_letter(text):
            return UNDEFINED, 0.0, True
        cosines = self.centroids @ self.vector(text)
        best = int(np.argmax(cosines))
        language = int(self.language_of[best])
        return (self.languages[language], float(min(1.0, max(0.0, cosines[best]))),
                bool(1 - cosines[best] > self.reach[language]))


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=-1, keepdims=True), 1e-12)


def cluster(vectors: np.ndarray, count: int, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from spread-out starts: (centroids, cosine of each vector to its own)."""
    chosen = [int(np.argmax(vectors @ unit(vectors.sum(0))))]
    while len(chosen) < min(count, len(vectors)):
        chosen.append(int(np.argmin((vectors @ vectors[chosen].T).max(1))))
    centroids = vectors[chosen]
    for _ in range(rounds):
        owner = np.argmax(vectors @ centroids.T, 1)
        moved = np.array([unit(vectors[owner == c].sum(0)) if (owner == c).any() else centroids[c]
                          for c in range(len(centroids))])
        if np.allclose(moved, centroids):
            break
        centroids = moved
    return centroids, (vectors @ centroids.T).max(1)


def fit(docs: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", sample: int = SAMPLE, clusters: int = CLUSTERS) -> LanguageModel:
    """Learn from documents with a label (and ``usable``), about ``sample`` of each language.

    The sample is a hash range of the ids with their texts, as wide as the language's number of documents
    allows; rows alike in both count once, so null or equal ids do not swell it.  Texts are read whole.
    What reaches the driver are the idf and the centroids, both of fixed length.
    """
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if usable is not None:
        labelled = labelled.filter(usable)
    labelled = own_columns(labelled, id=id_col, text=text_col, lang=lang_col)
    # written, so that the planner knows how few rows these are and leaves the texts where they lie
    sizes = settle(labelled.groupBy("lang").count().withColumn(
        "width", F.least(F.lit(1.0), F.lit(float(sample)) / F.col("count"))), "language-sizes")
    draw = F.xxhash64(F.lit(7), F.col("id"), F.col("text"))
    picked = labelled.withColumn("draw", draw).join(sizes.select("lang", "width"), "lang").filter(
        F.pmod("draw", F.lit(1 << 40)) / float(1 << 40) < F.col("width"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, draws, buckets, weights = [], [], [], []
            seen = set()
            for lang, draw, text in zip(*[column.to_pylist() for column in batch.columns]):
                if (lang, draw) not in seen and has_letter(text):
                    seen.add((lang, draw))
                    tf = ngram_counts(text)
                    used = np.flatnonzero(tf)
                    langs.append(lang)
                    draws.append(draw)
                    buckets.append(used.astype(np.int32))
                    weights.append(np.log1p(tf[used]).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(draws, pa.int64()),
                 pa.array(buckets, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float32()))],
                names=["lang", "draw", "buckets", "weights"])

    counted = picked.select("lang", "draw", "text").mapInArrow(
        count, "lang string, draw long, buckets array<int>, weights array<float>")
    counted = settle(counted.dropDuplicates(["lang", "draw"]).drop("draw"), "language-sample")
    total = counted.count()
    frequency = np.zeros(BUCKETS)
    for row in counted.select(F.explode("buckets").alias("b")).groupBy("b").count().collect():
        frequency[row["b"]] = row["count"]
    idf = np.log((1 + total) / (1 + frequency)) + 1

    def centroids(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        vectors = np.zeros((len(rows), BUCKETS), np.float32)
        for i, (b, w) in enumerate(zip(rows["buckets"], rows["weights"])):
            vectors[i, b] = w
        vectors = unit(vectors * idf.astype(np.float32))
        found, own = cluster(vectors, clusters)
        return pd.DataFrame({"lang": key[0], "reach": float(1 - own.min()), "centroid": list(found)})

    rows = counted.groupBy("lang").applyInPandas(centroids, "lang string, reach double, centroid array<float>")
    rows = sorted(rows.collect(), key=lambda r: r["lang"])
    languages = sorted({r["lang"] for r in rows})
    reach = {r["lang"]: r["reach"] for r in rows}
    return LanguageModel(
        languages, np.array([languages.index(r["lang"]) for r in rows], int),
        np.array([r["centroid"] for r in rows], float).reshape(-1, BUCKETS),
        np.array([1 - LEAST_PART * (1 - reach[lang]) for lang in languages]), idf)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score (cosine, 0 to 1) and rejected to every row, from the whole text alone.

    ``rejected`` marks texts without letters (null and empty ones too, ``lang_pred`` "und") and texts
    beyond the reach of their nearest language.  Other columns pass through, but for former columns of
    the three names; repeated rows stay; an empty table stays empty.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # fixed length per language, bounded by the sample

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [known.nearest(t.as_py()) for t in batch.column(batch.schema.get_field_index(text_col))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())],
                names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return docs.mapInArrow(predict, ", ".join([*fields, "lang_pred string, score double, rejected boolean"]))
