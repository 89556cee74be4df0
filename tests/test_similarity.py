"""The similarity joins against all pairs."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from journalsieve.operators import similarity_join as sj
from journalsieve.operators.components import connected_components
from journalsieve.operators.text_vectors import pair_cosines, text_vectors
from journalsieve.operators.vendor_clusters import vendor_clusters
from journalsieve.plans.analysis import Analysis
from journalsieve.plans import flags


def _groups(pairs, nodes):
    label = {n: n for n in nodes}
    for a, b in pairs:
        old, new = label[a], label[b]
        label = {n: new if x == old else x for n, x in label.items()}
    groups = {}
    for n, x in label.items():
        groups.setdefault(x, set()).add(n)
    return {frozenset(g) for g in groups.values()}


def _terms(spark, vectors):
    """(text, gram, weight, df) of dictionaries of weights, scaled to unit length."""
    df = {}
    for terms in vectors.values():
        for gram in terms:
            df[gram] = df.get(gram, 0) + 1
    rows = []
    for text, terms in vectors.items():
        norm = sum(w * w for w in terms.values()) ** 0.5
        rows += [(text, gram, w / norm, df[gram]) for gram, w in terms.items()]
    return spark.createDataFrame(rows, "text string, gram string, weight double, df long")


@pytest.mark.parametrize("group, depth, cosine", [(2, 0, 0.6), (3, 2, 0.5), (4, 4, 0.7), (500, 4, 0.6)])
def test_term_join_against_all_pairs(spark, monkeypatch, group, depth, cosine):
    monkeypatch.setattr(sj, "BLOCK", 4)
    draw = random.Random(group)
    vectors = {}
    for i in range(70):  # few grams, so that groups are large and paths several grams long
        grams = draw.sample(["aaa", "bbb", "ccc", "ddd", "eee", "fff", "ggg", "hhh"], draw.randint(1, 5))
        vectors[f"n{i:02}"] = {g: draw.choice([0.2, 1.0, 2.0, 4.0]) for g in grams}
    terms = _terms(spark, vectors)
    unit = {}
    for r in terms.collect():
        unit.setdefault(r.text, {})[r.gram] = r.weight
    wanted = [(a, b) for a, b in itertools.combinations(unit, 2)
              if sum(w * unit[b].get(g, 0) for g, w in unit[a].items()) >= cosine - 1e-9]
    found = [tuple(r) for r in sj.close_edges(terms, cosine, group, depth).collect()]
    assert _groups(found, unit) == _groups(wanted, unit)
    assert any(len(g) > 2 for g in _groups(wanted, unit))


def test_names_under_one_gram_stay_near_linear(spark):
    """All names share grams; the pairs checked per name do not grow with their number."""
    per_name = []
    for n in (1000, 4000):
        names = spark.range(n).select(F.concat(F.lit("Kreditor "), F.lpad((F.col("id") * 7919).cast("string"), 9, "0"))
                                      .alias("kreditor"))
        report = []
        sj.close_edges(text_vectors(names, "kreditor"), 0.8, group=64, report=report)
        per_name.append(sum(pairs or 0 for _, pairs, _ in report) / n)
    assert per_name[1] < 2 * per_name[0] + 64


def test_nearly_equal_names_are_linked_in_one_pass(spark):
    """A large group of close names is one component after its first level and is not dealt again."""
    vectors = {f"n{i}": {**{3 * c: 1.0 for c in "abcdefghij"}, f"{i:03}": 0.5} for i in range(600)}
    report = []
    edges = sj.close_edges(_terms(spark, vectors), 0.8, group=32, report=report)
    assert connected_components(edges).select("component").distinct().count() == 1
    assert len(report) == 2 and not report[1][0]


def test_unit_vectors_and_dense_join(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(6, 8))
    rows = [(f"t{i:02}", [float(x) for x in centres[i % 6] * 10.0 ** draw.integers(-160, 160) + 0 * draw.normal(size=8)])
            for i in range(12)]
    rows += [(f"u{i:02}", [float(x) for x in centres[i % 6] + 0.4 * draw.normal(size=8)]) for i in range(40)]
    rows += [("zero", [0.0] * 8), ("nan", [float("nan")] * 8), ("none", None), (None, [1.0] * 8), ("short", [1.0, 2.0]),
             ("hole", [1.0, None] + [0.0] * 6), ("t00", [9.0] * 8)]
    unit = sj.unit_vectors(spark.createDataFrame(rows, "text string, vector array<double>"))
    held = {r.text: np.array(r.vector) for r in unit.collect()}
    assert set(held) == {t for t, _ in rows if t and t[0] in "tu"} | {"short"}
    assert all(abs(np.linalg.norm(v) - 1) < 1e-12 for v in held.values())
    wanted = [(a, b) for a, b in itertools.combinations(sorted(held), 2)
              if len(held[a]) == len(held[b]) and held[a] @ held[b] >= 0.8 - 1e-9]
    for block in (5, 1024):
        found = [tuple(r) for r in sj.dense_edges(unit, 0.8, block).collect()]
        assert _groups(found, held) == _groups(wanted, held)
    pairs = spark.createDataFrame([("t01", "t07"), ("t01", "none"), ("t01", "short")], "a string, b string")
    cosine = {r.b: r.cosine for r in pair_cosines(pairs, unit).collect()}
    assert cosine["t07"] == pytest.approx(1.0) and cosine["none"] is None and cosine["short"] is None


def test_given_vectors_drive_text_mode(spark, raw):
    """Vectors, not spellings, decide on vendors, near duplicates and labels."""
    vectors = spark.createDataFrame(
        [("Bahn AG", [1.0, 0.0]), ("Deutsche Bahn", [0.99, 0.1]), ("Post", [0.0, 1.0]), ("Fahrkarte", [1.0, 0.1]),
         ("Ticket", [0.9, 0.0]), ("Porto", [0.0, 2.0]), ("Reisekosten", [1.0, 0.0])], "text string, vector array<double>")
    rows = [{"kreditor": "Deutsche Bahn", "buchungstext": "Fahrkarte", "datum": "2024-01-10", "belegnummer": "1"},
            {"kreditor": "Bahn AG", "buchungstext": "Ticket", "datum": "2024-01-11", "belegnummer": "2"},
            {"kreditor": "Bahn AG", "buchungstext": "Fahrkarte", "datum": "2024-01-12", "belegnummer": "3"},
            {"kreditor": "Post", "buchungstext": "Porto", "datum": "2024-01-12", "belegnummer": "4"},
            {"kreditor": "Post", "buchungstext": "Ticket", "datum": "2024-01-13", "belegnummer": "5"},
            {"kreditor": "Post", "buchungstext": "unbekannt", "datum": "2024-01-14", "belegnummer": "6"}]
    labels = spark.createDataFrame([("62000", "Reisekosten")], "konto_soll string, gt_bezeichnung string")
    run = Analysis(raw(rows), labels=labels, vectors=vectors)
    merged = {r.kreditor: r._kreditor_canonical for r in run.journal.select("kreditor", "_kreditor_canonical").collect()}
    assert merged == {"Deutsche Bahn": "Bahn AG", "Bahn AG": "Bahn AG", "Post": "Post"}
    near = {r.row_id for r in flags.run_single_test(run.context, "NEAR_DUPLICATE").collect()}
    assert near == {0, 1, 2}  # two spellings of one vendor, alike texts; those of 3 to 5 are not alike
    unlike = {r.row_id for r in flags.run_single_test(run.context, "TEXT_KONTO_MATCH").collect()}
    assert unlike == {3}  # no vector for the last text, so nothing is known of it
    assert run.export().count() >= 1


def test_dense_strips_equal_all_pairs_and_blocks_are_large(spark):
    rng = np.random.default_rng(6)
    points = rng.normal(size=(120, 4))
    held = {f"v{i:03}": p / np.linalg.norm(p) for i, p in enumerate(points)}
    frame = spark.createDataFrame([(n, v.tolist()) for n, v in held.items()], "text string, vector array<double>")
    for cosine in (0.9, 0.985, -1.0):
        wanted = [(a, b) for a, b in itertools.combinations(sorted(held), 2) if held[a] @ held[b] >= cosine - 1e-9]
        for block, strip in ((None, 1024), (None, 7), (37, 5), (200, 50)):
            found = [tuple(r) for r in sj.dense_edges(frame, cosine, block, strip).collect()]
            assert _groups(found, held) == _groups(wanted, held)
    many = spark.range(5000).select(F.col("id").cast("string").alias("text"),
                                    F.array_repeat(F.lit(0.125), 64).alias("vector"))
    assert sj._dense_cells(many).count() == 5000  # one block: every vector is sent once
