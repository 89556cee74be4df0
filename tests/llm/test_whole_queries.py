"""Registered queries against brute force, on ids, vectors and repeats at the edges of what is legal."""

import hashlib
import math
import random
import re
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from journalsieve.llm import language, neighbours, queries, sketch

SPACE = r"[\x20\x09-\x0D]+"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def signed(code):
    return code - (1 << 64) if code >> 63 else code


def chain(codes):
    """XXH64 of longs one after the other, each seeded by the hash before."""
    seed = 42
    for code in codes:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", code), seed=seed)
    return signed(seed)


def brute_sketch(text):
    words = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in re.split(SPACE, text.lower()) if w]
    spans = [words[i:i + 5] for i in range(len(words) - 4)] or ([words] if words else [])
    hashes = sorted({chain(s) for s in spans})
    cut = -(1 << 63) + (1 << 60)
    low = [h for h in hashes if h < cut]
    if len(low) < 8:
        low = hashes[:8]
    return (1 << 63) - 1 if len(low) < 8 else max(cut, low[-1] + 1), low


def as_text(cut, hashes):
    return f"{cut & (1 << 64) - 1:016x}:" + "".join(f"{h & (1 << 64) - 1:016x}" for h in hashes)


def brute_likeness(a, b):
    cut = min(a[0], b[0])
    x, y = ({h for h in s[1] if h < cut} for s in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    made = [" ".join(rng.choices(words, k=rng.choice([0, 1, 4, 5, 9, 40, 700]))) for _ in range(40)]
    made += [made[5] + " more", made[7], "\t ", "", None]
    for text in [t for t in made if t and t.count(" ") > 30]:
        parts = text.split(" ")
        parts[rng.randrange(len(parts))] = "other"
        made.append("  ".join(parts).upper())
    return made


def write(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCUMENTS).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("ids", ["wide", "clustered", "dense"])
def test_sketch_query_equals_brute_force(spark, tmp_path, texts, ids, monkeypatch):
    monkeypatch.setattr(sketch, "PER_ROOT", 2)  # several ranges even of so few ids
    rng = random.Random(2)
    numbers = {"wide": [-(1 << 63), (1 << 63) - 1, *[rng.getrandbits(63) - (1 << 62) for _ in texts[2:]]],
               "clustered": [*range(len(texts) - 2), (1 << 62), (1 << 62) + 1],
               "dense": [*range(len(texts))]}[ids]
    rng.shuffle(numbers)
    folder = write(spark, tmp_path, [(n, t, None, None, None) for n, t in zip(numbers, texts)])
    by_id = {n: t or "" for n, t in zip(numbers, texts)}
    order = sorted(by_id, reverse=True)
    out = {r.doc_id: r for r in queries.op2_scaled_sketch(spark, folder).collect()}
    assert set(out) == set(by_id)
    for place, n in enumerate(order):
        text, after, row = by_id[n], by_id[order[(place + 1) % len(order)]], out[n]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        own, changed, other = map(brute_sketch, (text, edited, after))
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (row.fingerprint, row.edited_fingerprint) == (as_text(*own), as_text(*changed))
        assert abs(row.near_edited - brute_likeness(own, changed)) < 1e-12
        assert abs(row.near_next - brute_likeness(own, other)) < 1e-12


def brute_fingerprint(text):
    words = [w for w in re.split(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    spans = [words[i:i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    codes = [xxhash.xxh64_intdigest(" ".join(s).encode(), seed=42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def test_fingerprint_query_equals_brute_force(spark, tmp_path, texts):
    folder = write(spark, tmp_path, [(3 * n - 20, t, None, None, None) for n, t in enumerate(texts)])
    codes = {3 * n - 20: brute_fingerprint(t or "") for n, t in enumerate(texts)}
    least = {n: n for n in codes}
    changed = True
    while changed:
        changed = False
        for a in codes:
            for b in codes:
                if least[b] < least[a] and (codes[a] ^ codes[b]).bit_count() <= 2:
                    least[a], changed = least[b], True
    out = queries.op7_simhash_gray(spark, folder).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in out} == {
        n: (f"{codes[n]:016x}", least[n]) for n in codes}
    assert len(set(least.values())) < len({c for c in codes.values()})


def test_nearest_with_huge_and_tiny_components(spark):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(120, 6))
    for rows, factor in ((slice(0, 30), 1e160), (slice(30, 50), 1e-170), (slice(50, 55), 1e308),
                         (slice(55, 60), 5e-324), (slice(60, 80), 1e100)):
        vectors[rows] = np.clip(vectors[rows], -1.7, 1.7) * factor
    vectors[55:60, 0] = 5e-324
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    for blocks in ({}, {"block": 20, "query_block": 4}):
        out = neighbours.nearest(frame, F.col("id") % 5 == 0, 20, **blocks).collect()
        got = {}
        for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
            got.setdefault(r.query_id, []).append(r.id if "id" in r else r.vec_id)
        assert set(got) == set(range(0, 120, 5))
        for q, found in got.items():
            scores = neighbours.exact_products(np.repeat(vectors[q:q + 1], 120, 0), vectors)
            key = lambda i: (0, 0, i) if math.isnan(scores[i]) else (1, -scores[i], i)
            assert found == sorted((i for i in range(120) if i != q), key=key)[:20], q


def test_language_sample_of_rows_alike_is_bounded(spark, monkeypatch):
    """Null or equal ids: texts are drawn one by one; rows alike in id and text count once."""
    sizes = []
    whole = language.cluster
    rng = random.Random(5)
    words = ["der", "hund", "wald", "fuchs", "haus", "läuft", "springt", "abend"]
    rows = [(None, " ".join(rng.choices(words, k=12)), "de", "s", 1) for _ in range(1500)]
    rows += [(7, "the same text again and again", "en", "s", 1)] * 1500
    rows += [(i, f"the text of number {i} is short", "en", "s", 1) for i in range(100)]
    frame = spark.createDataFrame(rows, DOCUMENTS)
    seen = language.settle

    def watched(df, label):
        kept = seen(df, label)
        if label == "language-sample":
            sizes.append({r["lang"]: r["count"] for r in kept.groupBy("lang").count().collect()})
        return kept
    monkeypatch.setattr(language, "settle", watched)
    model = language.fit(frame, sample=200)
    assert whole is language.cluster and model.languages
    # German texts are all different: about 200 of them; English rows: at most one of the repeats
    assert 140 < sizes[0]["de"] < 270 and sizes[0].get("en", 0) < 40
