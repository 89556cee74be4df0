"""Runs of words against a brute-force search, and the query's digests against plain Python."""

import hashlib
import random
import zlib

import numpy as np

from journalsieve.llm import queries
from journalsieve.llm.period_runs import find_runs, runs_of


def naive_runs(words, least):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        x = 0
        while x < len(words) - q:
            if words[x] != words[x + q]:
                x += 1
                continue
            start = x
            while x < len(words) - q and words[x] == words[x + q]:
                x += 1
            length = x + q - start
            if length >= max(least, 2 * q):
                found.setdefault((start, length), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def _sequences(count):
    draw = random.Random(5)
    yield []
    yield from ([0] * n for n in (1, 2, 11, 12, 40))
    # one break between two stretches of period 2: runs of every odd period
    yield [0, 1] * 12 + [0] + [0, 1] * 12
    for _ in range(count):
        size, kinds, made = draw.randint(0, 70), draw.choice([1, 2, 2, 3, 6]), []
        while len(made) < size:
            if not made or draw.random() < 0.5:
                unit = [draw.randrange(kinds) for _ in range(draw.randint(1, 13))]
                made += (unit * 4)[:draw.randint(1, 4 * len(unit))]
            else:
                a = draw.randrange(len(made))
                made += made[a:draw.randint(a + 1, len(made))] * draw.randint(1, 3)
        yield made[:size]


def test_runs_against_brute_force():
    seen = 0
    for words in _sequences(1500):
        for least in (1, 12):
            wanted = naive_runs(words, least)
            assert [tuple(r) for r in runs_of(np.array(words, np.int64), least).tolist()] == wanted, words
            seen += len(wanted)
    assert seen > 5000


def _words(text):
    return [w.decode() for w in (text or "").encode().split()]


def _expected(doc_id, text):
    words = _words(text)
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = naive_runs(words, 12)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(kept)))


def test_query_against_brute_force(spark, tmp_path):
    draw = random.Random(6)
    rows = [(None, None), (None, "a b c"), (1, ""), (2, " \t\n "), (2, "x"), (3, "eins  zwei drei\x1cvier\x0bfünf"),
            (4, "la " * 300), (5, "la " * 300), (5, "la " * 300), (-7, "A a A a " * 9), (6, " ".join("ab" * 20))]
    for i, words in enumerate(_sequences(60)):
        rows.append((10 + i, draw.choice([" ", "\n", "  "]).join(f"wört{w}" for w in words)))
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "'x' as runs", "1 as collapsed", "2 as n", "'y' as words")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_basic_factors(spark, str(tmp_path))
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    order = lambda rows: sorted(rows, key=repr)
    assert order(tuple(r) for r in got.select(*columns).collect()) == order(_expected(*r) for r in rows)
    assert {t for _, t in got.select(*columns[1:6]).dtypes} == {"bigint"}
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 and len(_words(r[1])) > 20 for r in rows if r[0])


def test_columns_and_empty_table(spark):
    docs = spark.createDataFrame([("a b " * 10, 7, "u")], "body string, text long, runs string")
    found = find_runs(docs, "text", "body", outputs=("n_words", "collapsed")).collect()
    assert [tuple(r) for r in found] == [(7, 20, "a b")]
    assert find_runs(docs, "text", "body", keep=("runs",), outputs=("n_words",)).collect()[0].asDict() == {
        "text": 7, "runs": "u", "n_words": 20}
    assert find_runs(docs.limit(0), "text", "body").collect() == []
