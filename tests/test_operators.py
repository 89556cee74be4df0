"""Building blocks against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from journalsieve.operators import vendor_clusters as vc
from journalsieve.operators.components import connected_components
from journalsieve.operators.groups import rows_in_small_groups
from journalsieve.operators.quantiles import exact_quantiles
from journalsieve.operators.series import account_moments, account_months
from journalsieve.operators.text_vectors import cosine_pairs, pair_cosines, text_vectors


def test_small_groups_with_a_hot_key(spark):
    draw = random.Random(1)
    keys = ["hot"] * 400 + [f"k{draw.randrange(150)}" for _ in range(600)]
    rows = spark.createDataFrame(list(enumerate(keys)), "row_id long, k string").repartition(7)
    got = {r.row_id: r.group_rows for r in rows_in_small_groups(rows, ["k"], 4).collect()}
    sizes = {k: keys.count(k) for k in set(keys)}
    assert got == {i: sizes[k] for i, k in enumerate(keys) if sizes[k] <= 4}


def test_group_limit_runs_before_the_shuffle(spark):
    rows = spark.range(100).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("k"))
    plan = rows_in_small_groups(rows, ["k"], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange")
    assert "Partial" in plan[plan.index("Exchange"):]


def test_exact_quantiles(spark):
    draw = np.random.default_rng(5)
    groups = {
        "cents": np.round(draw.lognormal(5, 3, 700), 2), "same": np.full(40, 7.25),
        "signed": draw.normal(0, 1e-3, 501), "single": np.array([3.5]),
        "powers": np.array([2.0 ** k for k in range(-20, 40)] + [0.0, 0.0]),
    }
    data = [(g, float(v)) for g, values in groups.items() for v in values]
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.98, 1.0]
    out = exact_quantiles(spark.createDataFrame(data, "g string, x double"), "x", probs, ["g"])
    got = {r.g: [r[f"q{i}"] for i in range(len(probs))] for r in out.collect()}
    for g, values in groups.items():
        np.testing.assert_allclose(got[g], np.quantile(values, probs), rtol=1e-12, atol=1e-15)


def test_weighted_quantiles(spark):
    data = [("a", 1.0, 3), ("a", 2.0, 5), ("a", 10.0, 1)]
    out = exact_quantiles(spark.createDataFrame(data, "g string, x double, n long"), "x",
                          [0.25, 0.5, 0.9], ["g"], weight="n").head()
    expected = np.quantile([1.0] * 3 + [2.0] * 5 + [10.0], [0.25, 0.5, 0.9])
    assert out.n == 9
    np.testing.assert_allclose([out.q0, out.q1, out.q2], expected)


def test_components(spark):
    draw = random.Random(3)
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    star = [("s000", f"s{i:03d}") for i in range(1, 40)]
    loose = [(f"r{draw.randrange(80):02d}", f"r{draw.randrange(80):02d}") for _ in range(60)]
    edges = chain + star + [e for e in loose if e[0] != e[1]]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    got = {r.node: r.component for r in
           connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: find(n) for e in edges for n in e}


def _names():
    draw = random.Random(11)
    stems = ["Mueller Maschinenbau", "Schmidt Logistik", "Nordwind Energie", "Kaffee Klatsch",
             "Hansen Hafen", "Stadtwerke Emden"]
    names = {f"{s}{t}" for s in stems for t in ("", " GmbH", " GmbH & Co KG", " AG", " gmbh", "s")}
    names |= {"".join(draw.choice("abcdefg ") for _ in range(12)).strip() for _ in range(40)}
    return sorted(n for n in names if n)


@pytest.mark.parametrize("group", [3, 256])
def test_vendor_clusters_against_all_pairs(spark, group):
    names, eps = _names(), 0.35
    rows = spark.createDataFrame([(n, i) for i, n in enumerate(names)],
                                 "kreditor string, first_row long")
    got = {r.kreditor: r.canonical for r in vc.vendor_clusters(rows, eps, group=group).collect()}
    weights = {}
    for r in text_vectors(rows, "kreditor").collect():
        weights.setdefault(r.text, {})[r.gram] = r.weight
    group = {n: {n} for n in names}
    for a, b in itertools.combinations(names, 2):
        if sum(w * weights[b].get(g, 0.0) for g, w in weights[a].items()) >= 1 - eps - 1e-9:
            merged = group[a] | group[b]
            for n in merged:
                group[n] = merged
    assert got == {n: min(group[n], key=lambda m: (len(m), names.index(m))) for n in names}
    assert any(k != v for k, v in got.items())


def test_text_vectors_have_unit_length(spark):
    texts = spark.createDataFrame([("Miete Halle",), ("Miete",), ("",), ("Ü€😀x",)], "text string")
    vectors = text_vectors(texts)
    norms = vectors.groupBy("text").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert {r.text for r in norms} == {"Miete Halle", "Miete", "Ü€😀x"}
    assert all(abs(r.n - 1) < 1e-12 for r in norms)
    pairs = spark.createDataFrame([("Miete", "Miete"), ("Miete", "Ü€😀x"), ("Miete", "Miete Halle")],
                                  "a string, b string")
    cosine = {r.b: r.cosine for r in pair_cosines(pairs, vectors).collect()}
    assert abs(cosine["Miete"] - 1) < 1e-12 and cosine["Ü€😀x"] == 0.0
    assert 0.2 < cosine["Miete Halle"] < 1


def test_dense_cosine(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8])], "id long, v array<float>")
    pairs = spark.createDataFrame([(1, 2), (2, 2)], "id_a long, id_b long")
    got = {r.id_a: r.cosine for r in cosine_pairs(pairs, vectors, "id", "v").collect()}
    assert got == pytest.approx({1: 0.6, 2: 1.0}, abs=1e-6)


def test_account_moments_from_months(raw):
    from journalsieve.operators.prepare import prepare
    draw = np.random.default_rng(2)
    amounts = np.round(draw.lognormal(8, 2, 200), 2)
    rows = [{"betrag": f"{a:.2f}", "konto_soll": str(60000 + i % 3),
             "datum": f"2024-{1 + i % 12:02d}-10" if i % 11 else ""} for i, a in enumerate(amounts)]
    got = {r.konto_soll: r for r in account_moments(account_months(prepare(raw(rows)))).collect()}
    for k in range(3):
        own = amounts[k::3]
        r = got[str(60000 + k)]
        assert r.konto_count == len(own)
        assert r.konto_mean == pytest.approx(own.mean(), rel=1e-12)
        assert r.konto_std == pytest.approx(own.std(ddof=1), rel=1e-9)
