"""Hard negatives against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from journalsieve.llm import hard_negatives as hn, queries


def brute_force(rows, anchors, positives=5, negatives=3):
    """rows: (id, label, whole components) of those that take part."""
    found = []
    product = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, label, v in rows:
        if not anchors(a):
            continue
        scored = sorted((-product(v, w), i, other == label) for i, other, w in rows if i != a and len(w) == len(v))
        for p_score, p, _ in [s for s in scored if s[2]][:positives]:
            fits = [(s, i) for s, i, same in scored if not same and 50 * -p_score <= 100 * -s <= 95 * -p_score]
            found += [(a, p, k, i, -p_score, -s) for k, (s, i) in enumerate(fits[:negatives], 1)]
    return sorted(found)


def _rows(kind, n, seed):
    draw = np.random.default_rng(seed)
    if kind == "clustered":
        centres = draw.normal(size=(4, 12))
        values = centres[draw.integers(0, 4, n)] + 0.3 * draw.normal(size=(n, 12))
    elif kind == "ties":
        values = draw.integers(-1, 2, (n, 4)).astype(float)
    elif kind == "large":  # scores beyond double precision
        values = draw.normal(size=(n, 5)) * 5e5
    else:
        values = draw.normal(size=(n, 40)) * (draw.random(40) < 0.3) + 0.01
    labels = draw.integers(0, 3, n)
    return [(int(i), int(label), [float(x) for x in v]) for i, (label, v) in enumerate(zip(labels, values))]


@pytest.mark.parametrize("kind", ["clustered", "ties", "large", "sparse"])
def test_mine_against_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(hn, "TILE", 3)
    monkeypatch.setattr(hn, "STRIPE", 16)
    rows = _rows(kind, 150, 3)
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = hn.mine(table, F.col("id") % 5 == 0, block_bytes=40 * 4 * len(rows[0][2]))
    whole = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows]
    wanted = brute_force(whole, lambda a: a % 5 == 0)
    assert sorted(map(tuple, got.collect())) == wanted and len(wanted) > 30
    if kind == "large":
        assert max(r[4] for r in wanted) > 2 ** 53


def test_query_and_rows_that_take_no_part(spark, tmp_path):
    draw = np.random.default_rng(8)
    rows = [(i, int(draw.integers(0, 10)), [float(x) for x in draw.normal(size=6)]) for i in range(-50, 260)]
    nan, inf = float("nan"), float("inf")
    odd = [(None, 1, [1.0] * 6), (300, None, [1.0] * 6), (350, 1, None), (400, 2, [nan] + [1.0] * 5), (450, 2, [inf] * 6),
           (500, 2, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (550, 3, [1e300] * 6), (600, 3, [1.0, 2.0]), (650, 4, []),
           (700, 5, [0.0] * 6), (701, 5, [0.0] * 6), (702, 6, [0.0] * 6)]
    table = spark.createDataFrame(rows + odd + [(50, 9, [99.0] * 6)], "vec_id long, label int, embedding array<double>")
    table.selectExpr("*", "1 as id", "'x' as dims", "2 as blocks").write.parquet(f"{tmp_path}/embeddings.parquet")
    label = lambda i, k: (k + 1) % 10 if i % 7 == 0 else k
    held = {}
    for i, k, v in rows + [r for r in odd if r[0] in (600, 650, 700, 701, 702)] + [(50, 9, [99.0] * 6)]:
        row = (i, label(i, k), [math.floor(256 * x) for x in v])
        held[i] = min(held.get(i, row), row)  # of rows that share an id the smallest counts
    wanted = brute_force(sorted(held.values()), lambda a: a % 50 == 0)
    got = queries.op11_threshold_join(spark, str(tmp_path))
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                                        "negative_score").collect())) == wanted
    assert any(w[0] == 700 and w[4:] == (0, 0) for w in wanted)  # zero lies between two shares of zero
    empty = hn.mine(table.limit(0), F.col("id") % 50 == 0)
    assert empty.collect() == [] and len(empty.columns) == 6
