"""Canonical vendor names: names whose vectors are close are one vendor.

Density clustering with a minimum of two members is the same as the connected components of the
graph of all pairs within the distance; ``similarity_join`` finds edges with these components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from journalsieve.operators.components import connected_components
from journalsieve.operators.similarity_join import GROUP, close_edges, dense_edges
from journalsieve.operators.text_vectors import is_dense, text_vectors
from journalsieve.workspace import settle


def vendor_clusters(names: DataFrame, eps: float, vectors: DataFrame | None = None,
                    group: int = GROUP) -> DataFrame:
    """(kreditor, canonical) from ``names`` (kreditor, first_row): shortest name of the cluster,
    the earliest one on ties; a name without neighbours stays itself.

    Names are compared by trigrams, or by given dense unit vectors (text, vector); a name without a
    vector has no neighbours.
    """
    names = settle(names.groupBy("kreditor").agg(F.min("first_row").alias("first_row")),
                   "vendor_names")
    if vectors is not None and is_dense(vectors):
        own = names.join(vectors, F.col("kreditor") == F.col("text")).select("text", "vector")
        edges = dense_edges(own, 1.0 - eps)
    else:
        edges = close_edges(text_vectors(names, "kreditor"), 1.0 - eps, group)
    members = connected_components(edges).withColumnRenamed("node", "kreditor")
    located = names.join(members, "kreditor", "left").withColumn(
        "component", F.coalesce("component", "kreditor"))
    best = located.groupBy("component").agg(F.min_by(
        "kreditor", F.struct(F.char_length("kreditor"), "first_row")).alias("canonical"))
    return located.join(best, "component").select("kreditor", "canonical")
