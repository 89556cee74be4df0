"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, and brute-force results."""

import base64
import hashlib
import io
import math
import random
import re
import struct
import zipfile
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from journalsieve.llm import (bpe, html_cut, language, mixing, neighbours, pii, pitman_yor, simhash, sketch, warc_zip)

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp int, size int"
TEXTS = ["The quick brown fox jumps over the lazy dog again and again, says İstanbul ΣΑΣ.",
         "Der schnelle Fuchs springt über den faulen Hund und läuft weiter in den Wald hinein.",
         None, "", "   \n\t", "one", "12 345 678", "a" * 3000, "word " * 5000,
         "Write to jane.doe@example.com or +1 (523) 555-1055, card 4111 1111 1111 1111, host 10.0.0.256 10.0.0.25.",
         "don't <|endoftext|> x² 日本語 ٣ 🙂\x1c\x85 a\x00b"]


@pytest.fixture(scope="module")
def docs(spark):
    texts = [*TEXTS, TEXTS[0], TEXTS[1]]
    rows = [(i * 3, t, "de" if t == TEXTS[1] else "en" if i % 2 == 0 else None, f"s{i % 2}" if i != 3 else None,
             len(t) if t else None, "x", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (0, TEXTS[0], "en", "s0", 1, None, None, None),
                                  (None, "no id here", None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_equals_the_library(spark, docs, empty):
    coder, library = bpe.encoder(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(3)
    letters = "abcdeinorst'.,!ÀéßÉ 0\n1²"
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(letters, k=rng.randint(0, 90))) for _ in range(400)]
    for text, ids in zip(texts, coder.encode(texts)):
        wanted = library.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, wanted))
        assert coder.decode(ids) == library.decode(wanted, skip_special_tokens=False)
    out = bpe.encode_decode(docs, PATH).collect()
    assert len(out) == docs.count() and all(r.n_tokens == len(r.ids) for r in out)
    assert bpe.encode_decode(empty, PATH).count() == 0


def test_sketch_neighbours_and_likeness(docs, empty):
    rows = sketch.edited_fingerprints(docs).withColumn("mark", sketch.as_text("sketch")).collect()
    assert len(rows) == docs.count()
    by_id = {}
    for r in docs.collect():
        if r.doc_id is not None:
            by_id[r.doc_id] = min(by_id.get(r.doc_id, r.text or ""), r.text or "")
    order = sorted(by_id, reverse=True)
    for r in rows:
        after = by_id[order[(order.index(r.doc_id) + 1) % len(order)]] if r.doc_id is not None else ""
        half = len(r.text) // 2
        assert r.edited == r.text[:len(r.text) - half] + after[:half] and r.n_chars == len(r.text)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    marks = {r.text: r.mark for r in rows}
    assert all(marks[r.text] == r.mark for r in rows)
    assert sketch.edited_fingerprints(empty).count() == 0


def test_sketch_estimates_containment(spark):
    rng = random.Random(5)
    long = [f"w{rng.random()}" for _ in range(4000)]
    frame = spark.createDataFrame([(" ".join(long), " ".join(long[:1500]))], "a string, b string")
    frame = sketch.with_likeness(sketch.with_sketch(sketch.with_sketch(frame, "a", "x"), "b", "y"), "x", "y", "j", "c")
    row = frame.select("j", "c").head()
    assert abs(row.j - 1496 / 3996) < 0.1 and row.c > 0.95


def test_mixing_draws_poisson_counts(spark, docs, empty):
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("s"), F.col("id") % 7)).alias("source"), F.lit("x").alias("copies"))
    out = mixing.mix_sources(many, weights={"hot": 3.0, "s1": 1.0}, seed=4)
    counts = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert set(counts) == {"hot", "s1"} and abs(counts["hot"] - 4500) < 350 and abs(counts["s1"] - 1500) < 200
    assert [r.place for r in out.collect()] == sorted(r.place for r in out.collect())
    mixed = mixing.mix_sources(docs)
    assert set(docs.columns) <= set(mixed.columns) and mixing.mix_sources(empty).count() == 0
    nodes = mixed._jdf.queryExecution().toString()
    assert "Python" not in nodes and "Arrow" not in nodes


def test_simhash_links_equal_brute_force(spark, docs, empty, monkeypatch):
    rng = random.Random(1)
    codes = [rng.getrandbits(64) for _ in range(40)]
    codes += [c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in codes for _ in range(6)]
    codes = sorted(set(codes))
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    frame = spark.createDataFrame([(c,) for c in signed], "fp long")
    part_of = {c: c for c in codes}  # the smallest code reachable by links, by brute force
    links = [(a, b) for a in codes for b in codes if a != b and (a ^ b).bit_count() <= 2]
    while any(part_of[b] < part_of[a] for a, b in links):
        for a, b in links:
            part_of[a] = min(part_of[a], part_of[b])
    for group in (1024, 4):  # small groups are dealt again by further bits
        found = {tuple(sorted(r)) for r in simhash.near_pairs(frame, 2, group).collect()}
        label = {c: c for c in signed}

        def root(c):
            while label[c] != c:
                c = label[c]
            return c
        for a, b in found:
            assert part_of[a % (1 << 64)] == part_of[b % (1 << 64)]  # an edge may stand for a chain of links
            label[root(a)] = root(b)
        for i, a in enumerate(codes):
            for j in range(i):
                if (a ^ codes[j]).bit_count() <= 2:
                    assert root(signed[i]) == root(signed[j])
        for part in {root(c) for c in signed}:
            members = [c for c in signed if root(c) == part]
            assert all(any(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for b in members if b != a)
                       for a in members if len(members) > 1)
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == docs.count() and simhash.near_duplicates(empty).count() == 0
    least = min(r.doc_id for r in docs.collect() if r.doc_id is not None and not (r.text or "").split())
    assert {r.component_id for r in out if r.fp == 0} == {least}


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(260, 12))
    vectors[50:60] = vectors[0]  # ties
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    rows += [(1000, None, "x"), (1020, [0.0] * 12, "x"), (1040, [math.nan] * 12, "x"), (1060, [None] * 12, "x"),
             (None, [1.0] * 12, "x"), (1080, [1.0, 2.0], "x"), (7, vectors[7].tolist(), "y")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    for blocks in ({}, {"block": 40, "query_block": 5}):
        out = neighbours.nearest(frame, F.col("id") % 20 == 0, 20, **blocks).collect()
        got = {}
        for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert set(got) == set(range(0, 260, 20))
        for q, found in got.items():
            scores = neighbours.exact_products(np.repeat(vectors[q:q + 1], 260, 0), vectors)
            wanted = sorted((-s, i) for i, s in enumerate(scores) if i != q)[:20]
            assert found == [(i, -s) for s, i in wanted]
    assert neighbours.nearest(frame.limit(0), F.col("id") % 20 == 0).count() == 0


def test_language_held_out_accuracy(spark, docs, empty):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit(frame.filter("doc_id % 4 != 0"))
    out = language.identify(frame.filter("doc_id % 4 = 0"), model).collect()
    assert sum(r.lang_pred == r.lang for r in out) / len(out) > 0.95
    assert sum(r.rejected for r in out) / len(out) < 0.05
    small = language.identify(docs, language.fit(docs)).collect()
    for r in small:
        letters = any(map(str.isalpha, r.text or ""))
        assert (r.lang_pred == "und") == (not letters) and (letters or r.rejected) and 0 <= r.score <= 1
    assert language.identify(empty, language.fit(empty)).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.fit(empty)).collect()} == {"und"}


def brute_spans(text):
    found = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, rule, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 13, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == 3 or pii.luhn(digits)):
                found.append((kind, *m.span()))
    return found


def test_pii_base_spans_equal_the_rules(docs, empty):
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choices("ab1234.@+- ()", k=rng.randint(0, 60)))
        assert pii.base_spans(text) == brute_spans(text), text
    out = pii.find(docs).collect()
    assert len(out) == docs.count() and pii.find(empty).count() == 0
    masked = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert masked[27] == "Write to <email> or <phone>, card <card>, host 10.0.0.256 <ip>."
    assert masked[6] is None and masked[9] == ""


def test_pii_patterns_find_unseen_identifiers(spark):
    rng = random.Random(9)
    number = lambda: f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    rows = [(i, f"filler {i} please call hotline +1 {number()} today") for i in range(12)]
    rows += [(50, f"some more text please call hotline {number()} today"), (51, f"order number is {number()} here")]
    out = {r.id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(out[50].found) == 1 and not out[50].base and not out[51].found


def test_pitman_yor_counts_and_probabilities(spark, docs, empty):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held_out = F.col("doc_id") % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    small = pitman_yor.Settings(block_bytes=1 << 18, partition_rows=20_000)
    for table in (frame, docs):
        rows = table.collect()
        counts = Counter(w for r in rows if r.doc_id is None or r.doc_id % 7 != 2 for w in tokens(r.text))
        n, v = sum(counts.values()), len(counts)
        texts = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in rows)
        out = sorted(pitman_yor.score_texts(table, held_out, settings=small).collect(),
                     key=lambda r: r.doc_id if r.doc_id is not None else -1)
        assert [r.doc_id for r in out] == [None if i < 0 else i for i, _ in texts] and {r.train_tokens for r in out} == {n}
        for r, (_, text) in zip(out, texts):
            base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(text))
            assert abs(r.base_score - base) < 1e-6 and r.n_tokens == len(tokens(text))
            assert r.n_known == sum(counts[w] > 0 for w in tokens(text)) and r.score <= 0
    assert pitman_yor.score_texts(empty, held_out).count() == 0
    # the predictive probabilities after one context add up to at most one
    codes = np.arange(256, dtype=np.int64)
    chance, _, _ = pitman_yor.sample(codes, np.random.default_rng(0).integers(0, 9, 256), 1, 1,
                                     np.array([1 / 256]), small, 1)
    assert abs(chance.sum() - 1) < 1e-9


def test_minimum_cut_equals_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 9)
        scores = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 1.5)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

        def cost(labels):
            return (sum(max(-s, 0) if x else max(s, 0) for s, x in zip(scores, labels))
                    + sum(c for a, b, c in edges if labels[a] != labels[b]))
        best = min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert abs(cost(html_cut.minimum_cut(scores, edges)) - best) < 1e-6


def test_page_text(spark):
    page = ("<html><body class=has-sidebar><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>"
            "<div class='cookie-notice'>We use cookies. Accept them.</div><div class=content><h2>Title &amp; more</h2>"
            "<p>A long paragraph with many words, that goes on\n and   on for some time.<p>Short."
            "<div class=ad>Buy now! Great offers.</div><script>var t='</p>';</script></div>"
            "<section id=comments><article><p>I liked this very much. Thanks for it.</p></article></section>"
            "<footer>&copy; x</footer>")
    assert html_cut.extract(page)[0] == ("Title & more\n\nA long paragraph with many words, that goes on and on "
                                         "for some time.\n\nShort.")
    for odd in ("", None, "<", "<p", "<!-- x", "<script>x", "a < b", "<" * 5000, "<a href='" * 500, "</div>" * 9):
        html_cut.extract(odd)
    frame = spark.createDataFrame([(1, None, page, "x"), (1, "u", None, "y"), (None, "u", "", "z")],
                                  "page_id long, url string, html string, text string")
    rows = html_cut.extract_pages(frame).collect()
    assert [r.n_chars for r in rows] == [len(r.text) for r in rows] and sum(r.n_chars > 0 for r in rows) == 1
    assert html_cut.extract_pages(frame.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "<p>ä</p>", 0), (5, "http://b/", "<p>ä</p>", 0), (5, "http://c/", "<p>ä</p>", 0),
            (3, None, None, 0), (4, "u", "", 0), (None, "u", "n", 0), (9, "u\nx", "z" * 100_000, 0)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, sha int")
    out = warc_zip.round_trip(frame).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.payload is None or base64.b32encode(hashlib.sha1(r.payload).digest()).decode() == r.payload_digest
    assert Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in out) == Counter([
        (1, 9, "revisit", 5), (5, 9, "response", None), (5, 9, "revisit", 5), (3, 0, "revisit", 4),
        (4, 0, "response", None), (None, 1, "response", None), (9, 100_000, "response", None)])
    assert Counter(r.record_type for r in out) == {"response": 4, "revisit": 3}
    assert warc_zip.round_trip(frame.limit(0)).count() == 0
    assert warc_zip.round_trip(frame, least=5).filter("record_type = 'revisit'").count() == 2


def test_zip64_directory():
    stream = io.BytesIO()
    with zipfile.ZipFile(stream, "w") as file:
        file.writestr("archive/a.gz", b"x" * 40)
        file.writestr("indexes/b.cdxj", b"index")
    plain = stream.getvalue()
    end = plain.rfind(b"PK\x05\x06")
    count, length, at = struct.unpack_from("<HII", plain, end + 10)
    directory = bytearray(plain[at:end])
    # the first member's sizes and place move into a ZIP64 field
    stored, full = struct.unpack_from("<II", directory, 20)
    header_at, = struct.unpack_from("<I", directory, 42)
    name_size, = struct.unpack_from("<H", directory, 28)
    extra = struct.pack("<HHQQQ", 1, 24, full, stored, header_at)
    struct.pack_into("<II", directory, 20, 0xFFFFFFFF, 0xFFFFFFFF)
    struct.pack_into("<I", directory, 42, 0xFFFFFFFF)
    struct.pack_into("<H", directory, 30, len(extra))
    directory[46 + name_size:46 + name_size] = extra
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, len(directory), at)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, at + len(directory), 1)
    tail = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 3) + b"end"
    wide = plain[:at] + bytes(directory) + end64 + locator + tail
    for data in (plain, wide):
        read = lambda at, n, data=data: data[at:at + n]
        members = warc_zip.central_directory(read, len(data))
        assert [(m.name, m.size) for m in members] == [("archive/a.gz", 40), ("indexes/b.cdxj", 5)]
        start = warc_zip.data_start(read, members[0])
        assert data[start:start + 40] == b"x" * 40


def test_pipeline_stages(spark, docs, empty):
    import corpus_pipeline as pipeline

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for table in (docs.select(*columns), empty.select(*columns)):
        for name, stage in pipeline.STAGES:
            table = stage(spark, table, "")
            if name != "tokens":
                assert table.columns == columns
            table = spark.createDataFrame(table.collect(), table.schema)
        assert {"doc_id", "n_tokens", "ids"} <= set(table.columns)
    rows = spark.createDataFrame([(1, TEXTS[0], "en", "a", 3), (2, TEXTS[0], "en", "b", 3), (3, TEXTS[1], "de", "a", 3)],
                                 ", ".join(f"{c} {t}" for c, t in docs.select(*columns).dtypes))
    assert sorted(r.doc_id for r in pipeline.drop_near_copies(spark, rows, "").collect()) == [1, 3]
